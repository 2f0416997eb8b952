"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. ``TREES`` independent signature orders sort all different sets by ``DEPTH``
minimum hashes each; documents with a long common prefix in an order are neighbours in it. How deep a prefix has to be
follows from the place: the next ``WINDOW`` documents of an order are candidates while they share ``LEAST_DEPTH`` values,
which reaches short prefixes where documents are sparse and only long ones where they are dense. All documents that
share ``FULL_DEPTH`` values meet as well, however many they are, where they aren't connected by then. A sketch of other
minimum hashes and the set sizes drop hopeless candidates; all others are verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.graph import components, least_ids
from cohortia.llm.shared import blocks, keep, mix, small_batches, words
from cohortia.llm.vectors import forest

TREES, DEPTH, LEAST_DEPTH, WINDOW = 24, 8, 2, 4
#: All documents with so many equal values meet: at a similarity of 0.8 one pair in some 10^5 has them in none of the orders.
FULL_DEPTH = 4
#: Documents, and shingles in all, of a common prefix that are compared in one piece; more are cut into blocks, and pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles of a piece that are counted by one matrix product.
COLUMNS = 4096
#: Values of a sketch, one byte each, and how many must be equal: at a similarity of 0.8 fewer are seen once in 10^5 pairs.
SKETCH, LEAST_SAME = 32, 16
#: Candidates with so many equal sketch values are taken to be links when the pairs to verify first are chosen.
LIKELY_SAME = 25

_random = np.random.default_rng(20)
_HASHES = TREES * DEPTH + SKETCH
_FACTORS = _random.integers(1, 1 << 32, _HASHES, np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, _HASHES, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointers): the sorted distinct shingles of ``size`` words of every text of a block, as 64-bit hashes.
    A-Z are lower-cased. A text with fewer words has one shingle, the whole sequence; one without words has none."""
    found, starts, _ = words(data, offsets, lower=True)
    n_words = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
    ends = np.cumsum(n_words)
    sets, pointers = [], [0]
    step = np.uint64(0x9E3779B97F4A7C15)
    for end, n in zip(ends.tolist(), n_words.tolist(), strict=True):
        own = found[end - n : end]
        k = min(size, n)
        h = np.zeros(n - k + 1 if n else 0, np.uint64)
        for j in range(k):
            h = mix(h * step + own[j : j + len(h)] + np.uint64(k))
        sets.append(np.unique(h))
        pointers.append(pointers[-1] + len(sets[-1]))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(pointers)


def set_sums(hashes: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart; 0 for empty ones."""
    full = np.flatnonzero(np.diff(pointers))
    found = np.zeros((2, len(pointers) - 1), np.uint64)
    if len(full):
        found[0, full] = np.add.reduceat(hashes, pointers[:-1][full])
        found[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x51ED270B)), pointers[:-1][full])
    return found[0], found[1]


def signatures(hashes: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketches) of sets that aren't empty: 16-bit values of all trees, and the sketch's bytes."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(pointers) - 1, _HASHES), np.uint32)
    for k in range(_HASHES):
        least[:, k] = np.minimum.reduceat((low if k % 2 else high) * _FACTORS[k] + _SHIFTS[k], pointers[:-1])
    least = (least ^ (least >> 15)) * np.uint32(0x2C1B3C6D)
    return (least[:, : TREES * DEPTH] >> 16).astype(">u2"), (least[:, TREES * DEPTH :] >> 24).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _describe(size: int):
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            hashes, pointers = shingle_sets(data, offsets, size)
            n = np.diff(pointers)
            full = np.flatnonzero(n)
            sums, other = set_sums(hashes, pointers)
            keys, sketches = np.zeros((len(n), TREES * DEPTH), ">u2"), np.zeros((len(n), SKETCH), np.uint8)
            if len(full):
                at = np.append(pointers[:-1][full], pointers[-1])
                keys[full], sketches[full] = signatures(hashes, at)
            columns = [batch.column("id"), batch.column("t"), pa.array(n), pa.array(sums.view(np.int64)), pa.array(other.view(np.int64)), _binary(keys), _binary(sketches)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "t", "n", "f", "g", "keys", "sketch"])

    return describe


class _Crowds:
    """Rows of one task, in order, whose first FULL_DEPTH values are those of more than WINDOW + 1 rows, or may be with the
    rows of the tasks before and after. Fewer all meet as neighbours."""

    def __init__(self):
        self.key, self.count, self.edge, self.held = None, 0, True, None

    def add(self, rows: pa.Table, head: np.ndarray) -> Iterator[pa.Table]:
        starts = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1])
        sizes = np.diff(np.append(starts, len(rows)))
        if self.key is not None and self.key != head[0].tobytes():
            self.count, self.edge, self.held = 0, False, None
        totals = sizes.copy()
        totals[0] += self.count
        out = totals > WINDOW + 1
        out[0] |= self.edge
        if out[0] and self.held is not None:
            yield self.held
            self.held = None
        if out.any():
            yield rows.take(np.flatnonzero(np.repeat(out, sizes)))
        if len(starts) > 1:
            self.edge, self.held = False, None
        self.key, self.count = head[-1].tobytes(), int(totals[-1])
        if not out[-1]:
            own = rows.slice(int(starts[-1]))
            self.held = own if self.held is None else pa.concat_tables([self.held, own])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among rows (part, tree, key, id, n, sketch) in this order. The first and last rows of the task come out
    too, with the numbers of the two boundaries they stand at, for candidates across tasks, and, without such a number,
    those of crowded prefixes."""
    names = ["a", "b", "same", "part", "tree", "key", "id", "n", "sketch"]
    part = TaskContext.get().partitionId()
    last: pa.Table | None = None
    first_seen = 0

    crowds = _Crowds()

    def edges(rows: pa.Table, boundary: int | None) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        nothing = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        columns = [*nothing, pa.array([boundary] * len(rows), pa.int64()), *[pa.concat_arrays(rows.column(c).chunks) for c in names[4:]]]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if first_seen < WINDOW:
            yield edges(rows.slice(0, WINDOW - first_seen), part - 1)
            first_seen += min(WINDOW, len(rows))
        head = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u2").reshape(-1, DEPTH)[:, :FULL_DEPTH]
        head = np.column_stack([rows.column("tree").to_numpy(), head]).astype(np.int32)
        for crowd in crowds.add(rows, head):
            yield edges(crowd, None)
        old = len(last) if last is not None else 0
        rows = (pa.concat_tables([last, rows]) if old else rows).combine_chunks()
        last = rows.slice(max(0, len(rows) - WINDOW))
        fixed = lambda c, width: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, width)
        keys, sketches = fixed("key", 2 * DEPTH).view(np.uint16), fixed("sketch", SKETCH)
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
        place = rows.column("part").to_numpy() * TREES + rows.column("tree").to_numpy()
        equal = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1) * (place[1:] == place[:-1])
        common = equal.copy()
        for shift in range(1, WINDOW + 1):
            if len(ids) <= shift:
                break
            if shift > 1:
                common = np.minimum(common[:-1], equal[shift - 1 :])
            at = np.flatnonzero(common >= LEAST_DEPTH)
            at = at[at + shift >= old]
            low, high = np.minimum(n[at], n[at + shift]), np.maximum(n[at], n[at + shift])
            at = at[(100 * low >= 80 * high) & (ids[at] != ids[at + shift])]
            same = (sketches[at] == sketches[at + shift]).sum(1)
            at, same = at[same >= LEAST_SAME], same[same >= LEAST_SAME]
            if len(at):
                x, y = ids[at], ids[at + shift]
                columns = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(same.astype(np.int32))]
                nothing = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *nothing], names)
    if last is not None:
        yield edges(last, part)
    if crowds.held is not None:
        yield edges(crowds.held, None)


_FOUND = "a long, b long, same int, part long, tree int, key binary, id long, n long, sketch binary"


def _candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, same): pairs of ids, a < b, that are neighbours in some order; and (tree, key, id, n, sketch): the documents of
    crowded prefixes."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = sets.select("id", F.col("n").cast("long").alias("n"), "sketch", "keys", tree.alias("tree"))
    key = F.substr("keys", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH))
    rows = rows.select(F.lit(0).cast("long").alias("part"), "tree", key.alias("key"), "id", "n", "sketch")
    order = ["part", "tree", "key", "id"]
    found = keep(rows.repartitionByRange(*order[1:]).sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND), "neighbours")
    edges = found.filter("part IS NOT NULL").select(*rows.columns)
    across = edges.repartition("part").sortWithinPartitions(*order).mapInArrow(_neighbours, _FOUND)
    pairs = found.select("a", "b", "same").union(across.select("a", "b", "same")).filter("a IS NOT NULL")
    crowds = found.filter("part IS NULL AND a IS NULL").select("tree", F.substr("key", F.lit(1), F.lit(2 * FULL_DEPTH)).alias("key"), "id", "n", "sketch")
    return keep(pairs.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs"), crowds


_PIECE = ["tree", "key", "low", "high"]


def _pieces(crowds: DataFrame) -> DataFrame:
    """The rows of every prefix with more than one component, dealt to pairs of blocks: (low, high, block) are added."""
    known = crowds.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("at").alias("first"), F.max("at").alias("last"))
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    known = known.filter("first <> last").select("tree", "key", parts.alias("parts"))
    placed = crowds.join(known, ["tree", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece, from rows in the order of their pieces."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*[batch.column(c).to_pylist() for c in _PIECE], strict=True))
        if waiting and tuple(waiting[-1].column(c)[-1].as_py() for c in _PIECE) != key[0]:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        starts = [0, *[k for k in range(1, len(key)) if key[k] != key[k - 1]], len(key)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            waiting.append(batch.slice(a, b - a))
            if b < len(key):
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _hopeful(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a piece that aren't connected yet and whose sizes and sketches allow for a link."""
    n, at, low, high, block = (rows.column(c).to_numpy() for c in ("n", "at", "low", "high", "block"))
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH).T
    fits = at[:, None] < at
    if low[0] != high[0]:
        fits &= block[:, None] != block
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fits &= (100 * n[:, None] >= 80 * n) & (100 * n >= 80 * n[:, None])
    same = np.zeros(fits.shape, np.uint8)
    for s in sketches:
        same += s[:, None] == s
    return np.nonzero(fits & (same >= LEAST_SAME))


_CROWD = "tree int, key binary, id long, n long, at long, sketch binary"


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        found = np.unique(np.concatenate(_hopeful(rows)))
        if len(found):
            yield from rows.select(["tree", "key", "id", "n", "at", "sketch"]).take(found).to_batches()


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shared shingles of the pairs i, j of sets."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    sets = [sets[k] for k in used]
    size = np.array([len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = times > 1
    code, row, n = (np.cumsum(often) - 1)[code][often[code]], row[often[code]], int(often.sum())
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    # a matrix product for many pairs, else each on its own
    if len(sets) ** 2 * n > 200 * (size[i] + size[j]).sum():
        by_row = np.argsort(row, kind="stable")
        own = np.split(code[by_row], np.searchsorted(row[by_row], np.arange(1, len(sets))))
        return np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24 are exact
    for start in range(0, n, COLUMNS):
        a, b = np.searchsorted(code, [start, start + COLUMNS])
        holds = np.zeros((len(sets), min(COLUMNS, n - start)), np.float32)
        holds[row[a:b], code[a:b] - start] = 1
        shared += holds @ holds.T
    return shared[i, j].astype(np.int64)


def _crowd_links(percent: int):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest (a, b) of the links of every piece."""
        for rows in _groups(batches):
            i, j = _hopeful(rows)
            if not len(i):
                continue
            lists = rows.column("shingles").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            shared, size = _shared(sets, i, j), np.diff(offsets).astype(np.int64)
            linked = shared * 100 >= (size[i] + size[j] - shared) * percent
            if not linked.any():
                continue
            ids = rows.column("id").to_numpy()
            nodes, place = np.unique(np.concatenate([i[linked], j[linked]]), return_inverse=True)
            half = len(place) // 2
            root = forest(place[:half], place[half:], len(nodes))
            inner = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(ids[nodes[root[inner]]]), pa.array(ids[nodes[inner]])], ["a", "b"])

    return link


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, text_hash, kept): one row per row of ``docs``; text_hash is the xxhash64 of the text.

    Documents are linked where 100 * shared shingles >= ``percent`` * all shingles of both, with ``percent`` at least 80;
    component_id is the least id reachable over links and kept is true for that document. Texts without words, and NULL
    texts, have no shingles and are linked with nothing. Repeated rows and rows with equal sets are one node, so copies
    cost nothing after the first. An id that repeats with another text is a node for each of its sets, linked by that set only. A NULL id is linked with nothing either: its component is NULL and it is kept. An empty
    table gives an empty table. Ids are whole numbers; columns besides id and text are not read.

    Signatures are made in one pass. Orders are cut into ranges, ties too, so no task gets a whole group of copies, and
    a document gives at most TREES * WINDOW neighbours, however large its group. First each document of a likely group is
    compared with the group's least, then only neighbours that are not yet connected: the components stay the same, and
    a large group costs one comparison a document where its members resemble their least. Where members of a crowded
    prefix are still not connected, all of them meet, in pairs of blocks: first sketches, then the full sets of those left.
    No pairs leave these tasks, but the comparisons grow with the square of what is not connected by then.
    """
    if percent < 80:
        raise ValueError("the sketch and the sizes are made for similarities of 80 percent and more")
    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    described = keep(rows.mapInArrow(_describe(size), "id long, t long, n long, f long, g long, keys binary, sketch binary"), "signatures")
    linked = described.filter("n > 0 AND id IS NOT NULL")
    # a set has a number of its own, as an id may repeat with other texts; it is written with the table, so it stays
    classes = linked.groupBy("f", "g").agg(F.min("id").alias("least"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    same_set = [F.col("s.f") == F.col("c.f"), F.col("s.g") == F.col("c.g"), F.col("s.id") == F.col("c.least")]
    sets = linked.alias("s").join(classes.alias("c"), same_set).select(F.col("c.node").alias("id"), "s.n", "s.f", "s.g", "s.keys", "s.sketch")
    pairs, crowds = _candidates(sets.dropDuplicates(["f", "g"]))

    def spelt(nodes: DataFrame) -> DataFrame:
        # these nodes grow with the documents: dealt by id at every size, never sent to all executors
        wanted = classes.join(nodes.withColumnRenamed("id", "node"), "node").select(F.col("least").alias("id"), "node", "f", "g")
        chosen = rows.join(wanted.hint("merge"), "id").dropDuplicates(["id", "t", "node"]).select("node", "f", "g", "text")

        def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in blocks(batches, "text"):
                hashes, pointers = shingle_sets(data, offsets, size)
                found = pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), pa.array(hashes.view(np.int64)))
                # of the texts with the id of a set, those that have this set
                sums = [pa.array(x.view(np.int64)) for x in set_sums(hashes, pointers)]
                own = pc.and_(pc.equal(batch.column("f"), sums[0]), pc.equal(batch.column("g"), sums[1]))
                yield pa.RecordBatch.from_arrays([batch.column("node").filter(own), found.filter(own)], ["id", "shingles"])

        return keep(chosen.mapInArrow(spell, "id long, shingles array<long>"), "shingles")

    full = spelt(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def verified(some: DataFrame) -> DataFrame:
        a = full.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
        b = full.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
        both = some.select("a", "b").join(a, "a").join(b, "b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        everything = F.size("of_a") + F.size("of_b") - shared
        return keep(both.filter(shared * 100 >= everything * percent).select("a", "b"), "links")

    likely = components(pairs.filter(F.col("same") >= LIKELY_SAME))
    first = verified(likely.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    of_a = first.select(F.col("b").alias("a"), F.col("a").alias("top_a"))
    of_b = first.select("b", F.col("a").alias("top_b"))
    open_pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    open_pairs = open_pairs.filter(F.coalesce("top_a", "a") != F.coalesce("top_b", "b"))
    links = keep(first.union(verified(open_pairs)), "links")
    found = components(links)

    crowds = crowds.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("at", F.coalesce("component", "id")).drop("component")
    dealt = _pieces(crowds).repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    likely = keep(dealt.mapInArrow(_likely, _CROWD).dropDuplicates(["tree", "key", "id"]), "crowds")
    if likely.take(1):
        dealt = _pieces(likely).join(spelt(likely.select("id").distinct()), "id").repartition(*_PIECE).sortWithinPartitions(*_PIECE)
        found = components(links.union(dealt.mapInArrow(_crowd_links(percent), "a long, b long")))

    found = least_ids(found, classes.select("node", "least"))
    member = described.select("id", "t", "n", "f", "g").join(classes, ["f", "g"], "left").join(found, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("id"))
    member = member.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.col("t").alias("text_hash"))
    return member.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
