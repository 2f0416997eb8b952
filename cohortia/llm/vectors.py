"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated at random, by signs and fast Hadamard transforms, and hashed to the nearest of the vertices +-e_i.
Two such values make a bucket of a table. A vector also visits the buckets where one of the two values is the second
nearest vertex. Whoever meets in a bucket, at least one of them in its own, is compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.graph import components, least_ids
from cohortia.llm.shared import keep, mix, small_batches

#: Tables, and buckets a vector visits in each: its own and two others. For a cosine of 0.98, one pair in some thousands
#: at most isn't met in 6 tables (measured for 64 to 768 dimensions).
TABLES, VISITS = 6, 3
ROUNDS = 3
#: Vectors of a bucket that are compared in one piece; a larger bucket is cut into blocks, and pairs of blocks.
BLOCK = 1024
#: Buckets of up to so many vectors are compared together, larger ones each by a matrix product.
FEW = 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def bucket_codes(vectors: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Buckets of every vector, TABLES x VISITS of them, its own first in each table. ``seeds`` keep labels apart."""
    n, dims = vectors.shape
    wide = 1 << max(0, dims - 1).bit_length()
    padded = np.zeros((n, wide))
    padded[:, :dims] = vectors
    random = np.random.default_rng(wide)
    found = np.empty((n, TABLES, VISITS), np.uint64)
    for table in range(TABLES):
        nearest = []
        for _ in range(2):
            x = padded
            for _ in range(ROUNDS):
                x = hadamard(x * random.choice([-1.0, 1.0], wide))
            size = np.abs(x)
            first = size.argmax(1)
            rows = np.arange(n)
            size[rows, first] = -1
            second = size.argmax(1)
            nearest.append([2 * k + (x[rows, k] < 0) for k in (first, second)])
        (a, a2), (b, b2) = nearest
        for visit, (p, q) in enumerate(((a, b), (a2, b), (a, b2))):
            code = (p * 2 * wide + q).astype(np.uint64) + np.uint64(table << 50)
            found[:, table, visit] = mix(mix(code + np.uint64(dims << 56 & (1 << 64) - 1)) ^ seeds)
    return found.reshape(n, -1)


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        lengths = lists.value_lengths().to_numpy()
        for dims in np.unique(lengths):
            own = batch.filter(pa.array(lengths == dims))
            x = own.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            codes = bucket_codes(x, mix(own.column("label").to_numpy().view(np.uint64)))
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            packed = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (x, codes)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), own.column("copies"), packed[0], packed[1], listed], ["id", "label", "copies", "unit", "codes", "buckets"])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        fresh = root.copy()
        np.minimum.at(fresh, i, least)
        np.minimum.at(fresh, j, least)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _links(least: float):
    def count(ids, copies, codes, bucket, i, j) -> pa.RecordBatch | None:
        """Rows (id, links, peer) of the pairs i, j, each taken only in the first bucket that it meets in."""
        if not len(i):
            return None
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        x, y = codes[i].reshape(-1, TABLES, VISITS), codes[j].reshape(-1, TABLES, VISITS)
        x_at_y, y_at_x = (x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)
        table = (x_at_y | y_at_x).argmax(1)
        rows = np.arange(len(i))
        first = np.where(x_at_y[rows, table], x[rows, table, 0], y[rows, table, 0])
        mine = first == bucket[i]
        i, j = i[mine], j[mine]
        if not len(i):
            return None
        nodes, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        links = np.bincount(place, np.concatenate([copies[j], copies[i]])).astype(np.int64)
        root = forest(place[: len(i)], place[len(i) :], len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(ids[nodes]), pa.array(links), pa.array(ids[nodes[root]])], ["id", "links", "peer"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("bucket", "low", "high")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], 0)) + 1
            if waiting and any(waiting[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("bucket", "low", "high"), key, strict=True)):
                yield from pieces(waiting)
                waiting = []
            if len(edge):
                yield from pieces([*waiting, batch.slice(0, edge[-1])])
                waiting = []
            waiting.append(batch.slice(edge[-1] if len(edge) else 0))
        yield from pieces(waiting)

    def pieces(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of rows with the same bucket and pair of blocks."""
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids, copies, label, bucket, low, high, block = (rows.column(c).to_numpy() for c in ("id", "copies", "label", "bucket", "low", "high", "block"))
        own = rows.column("own").to_numpy(zero_copy_only=False)
        units = rows.column("unit").to_pylist()
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint64).reshape(len(ids), -1)
        bucket = bucket.view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, [len(ids)]])
        sizes = np.diff(starts)
        length = np.array([len(u) for u in units])

        def meet(i, j):
            fits = (own[i] | own[j]) & (label[i] == label[j]) & (length[i] == length[j]) & (ids[i] != ids[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
            return i[fits], j[fits]

        found_i, found_j = [], []
        by_row = np.repeat(sizes, sizes)
        end = np.repeat(starts[1:], sizes)
        few = by_row <= FEW
        for shift in range(1, int(min(FEW, sizes.max()))):
            i = np.flatnonzero(few & (np.arange(len(ids)) + shift < end))
            i, j = meet(i, i + shift)
            for size in np.unique(length[i]):
                k = length[i] == size
                a, b = (np.frombuffer(b"".join([units[r] for r in side[k]]), np.float64).reshape(-1, size // 8) for side in (i, j))
                near = (a * b).sum(1) >= least
                found_i.append(i[k][near])
                found_j.append(j[k][near])
        if found_i and (out := count(ids, copies, codes, bucket, np.concatenate(found_i), np.concatenate(found_j))):
            yield out
        for start, size in zip(starts[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            for dims in np.unique(length[start : start + size]):
                at = start + np.flatnonzero(length[start : start + size] == dims)
                x = np.frombuffer(b"".join([units[r] for r in at]), np.float64).reshape(len(at), -1)
                i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
                if out := count(ids, copies, codes, bucket, *meet(at[i], at[j])):
                    yield out

    return compare


def near_vectors(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors of the same non-NULL label and the same length are linked where their cosine, in double precision, is at
    least ``least``; n_links counts the others a vector is linked with, component_id is the least id reachable, kept is
    true for that vector. NULL, empty and zero vectors, those with a NULL or non-finite component, and rows with a NULL
    label are linked with nothing. Equal vectors of a label are one class: compared once, counted each. Repeated rows
    are such classes too. An id that repeats with another vector is another class, linked by its own vector only. A NULL id is linked with nothing; its component is NULL and it is kept. Empty tables give empty tables.

    No pairs leave a task: a bucket gives link counts and a spanning forest of what is linked in it. A bucket of more
    than BLOCK vectors is cut into blocks, and every two blocks are compared in a task of their own.
    """
    number = F.xxhash64(F.col(label).cast("string"))
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.coalesce(sound & F.col(label).isNotNull() & F.col(id_column).isNotNull(), F.lit(False))
    rows = small_batches(vectors).select(F.col(id_column).cast("long").alias("id"), F.when(usable, number).alias("label"), F.when(usable, x).alias("vector"))
    classes = rows.filter("label IS NOT NULL").groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a class has a number of its own, as an id may repeat with other vectors; it is written with the table, so it stays
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    hashed = keep(classes.mapInArrow(_hash, "id long, label long, copies long, unit binary, codes binary, buckets array<long>"), "buckets")

    visits = hashed.select("id", F.explode("buckets").alias("bucket"))
    large = visits.groupBy("bucket").count().filter(F.col("count") > BLOCK)
    large = large.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    split = visits.join(large, "bucket").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("bucket", "blocks"))).alias("split"))
    placed = hashed.join(split, "id", "left").select("*", F.posexplode("buckets").alias("visit", "bucket"))
    blocks = F.coalesce(F.element_at("split", F.col("bucket")), F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    own = (F.col("visit") % VISITS == 0).alias("own")
    entries = placed.select("bucket", low.alias("low"), high.alias("high"), "block", own, "id", "label", "copies", "unit", "codes")
    dealt = entries.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = keep(dealt.mapInArrow(_links(least), "id long, links long, peer long"), "links")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = least_ids(components(found, "id", "peer"), classes.select(F.col("id").alias("node"), "least")).withColumnRenamed("node", "id")
    of_class = classes.join(counts, "id", "left").join(joined, "id", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    of_class = of_class.select("label", "vector", links.alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    result = rows.join(of_class, ["label", "vector"], "left")
    result = result.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
