"""Passages that repeat anywhere in a corpus, by common-prefix interval trees over anchored suffixes.

Only suffixes at anchors are sorted: of every window of ``length`` bytes, the place of the least hash of GRAM bytes. Equal
windows have their anchor at the same place, so whatever repeats over ``length`` bytes repeats around an anchor, and the
bytes ``length - GRAM`` before and after it decide. The suffixes of one anchor, sorted, with the lengths of their common
prefixes are a small enhanced suffix array. A stack scan of it gives its interval tree: all occurrences that share r bytes
after the anchor, for every r. In each interval the texts before the anchor, sorted backwards, give the intervals of those
that share l bytes before. Such a set is a maximal repeat of l + GRAM + r bytes, as its members differ both after r bytes
and before l bytes (the test of left-extension diversity). All its members repeat over ``length`` bytes if l + r allow it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import blocks, keep, mix, prefix_sums, small_batches

GRAM = 32
#: Anchor places found at a time, which bounds the memory a long text needs.
PIECE = 2 << 20
#: Different surroundings of one anchor that are compared in one piece; of more, every two blocks are compared apart.
GROUP = 4096


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of ``length`` bytes inside the texts of a block."""
    places, hashes = [], []
    width = length - GRAM + 1
    for start in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[start : start + PIECE + length - 1]
        n = len(piece) - GRAM + 1
        sums, down = prefix_sums(piece)
        grams = (sums[GRAM:] - sums[:-GRAM]) * down[:n]
        bits = np.uint64(int(n).bit_length())
        order = grams * np.uint64(0xD6E8FEB86659FD93)
        order = (order ^ (order >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        order = (order >> bits << bits) | np.arange(n, dtype=np.uint64)
        rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        rows[:n] = order
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        first = np.arange(n - width + 1)
        text = np.searchsorted(offsets, first + start, "right") - 1
        inside = first + start + length <= offsets[text + 1]
        least = np.minimum(behind[first], ahead[first + width - 1])[inside]
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        places.append(at + start)
        hashes.append(mix(grams[at]))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _scan(length: int, surroundings: bool):
    """Rows (a) of all anchors, or (k1, k2, a, c, pos, left, right) with a hash c of what surrounds them."""
    span = length - GRAM

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            at, a = anchors(data, offsets, length)
            if not len(at):
                continue
            anchor = pa.array(a.view(np.int64))
            if not surroundings:
                yield pa.RecordBatch.from_arrays([anchor], ["a"])
                continue
            text = np.searchsorted(offsets, at, "right") - 1
            left = np.minimum(at - offsets[text], span)
            right = np.minimum(offsets[text + 1] - at - GRAM, span)
            whole = memoryview(np.ascontiguousarray(data))
            spans = zip((at - left).tolist(), (at + GRAM + right).tolist(), (left * (span + 1) + right).tolist(), strict=True)
            c = np.array([xxhash.xxh3_64_intdigest(whole[x:y], seed) for x, y, seed in spans], np.uint64)
            own = [batch.column(k).take(pa.array(text)) for k in ("k1", "k2")]
            places = [pa.array(x, pa.int32()) for x in (at - offsets[text], left, right)]
            columns = [*own, anchor, pa.array(c.view(np.int64)), *places]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "a", "c", "pos", "left", "right"])

    return scan


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the listed anchors of each text."""
    names = ["a", "c", "n", "m", "left", "bytes"]
    for batch in batches:
        found: tuple[list, ...] = tuple([] for _ in names)
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            whole = text.as_buffer().to_pybytes() if text.is_valid else b""
            for w in wanted:
                piece = whole[w["pos"] - w["left"] : w["pos"] + GRAM + w["right"]]
                for column, value in zip(found, (w["a"], w["c"], w["n"], w["m"], w["left"], piece), strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names)


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    different = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (different.bit_length() + 7) // 8


def intervals(texts: list[bytes]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(order, intervals): the sorted order of the texts, and each interval (shared, first, last) of it, ends included,
    whose texts share a prefix that no text beside it has and that is as long as can be. Found by one scan with a stack."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    found, stack = [], []
    for k in range(1, len(order) + 1):
        shared = common(texts[order[k - 1]], texts[order[k]]) if k < len(order) else -1
        first = k - 1
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            found.append((depth, first, k - 1))
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))
    return order, found


def extents(contexts: list[tuple[bytes, bytes]], span: int) -> list[tuple[int, int, int]]:
    """Per occurrence of an anchor, given as (bytes before, backwards; bytes after): the bytes before and after that
    belong to maximal repeats with at least ``span`` bytes around the anchor, and how many occurrences the first such
    interval has; (-1, -1, 0) if it belongs to none.

    The scan gives the deepest intervals first, so an interval can only add bytes before, and those whose members have
    all theirs are passed over.
    """
    best = [(-1, -1, 0)] * len(contexts)
    order, after = intervals([c[1] for c in contexts])
    for r, first, last in after:
        members = [k for k in order[first : last + 1] if len(contexts[k][0]) >= span - r]
        if all(best[k][0] == len(contexts[k][0]) for k in members):
            continue
        # members that share enough bytes before; where they differ further on, the repeat is maximal to the left
        alike: dict[bytes, list[int]] = {}
        for k in members:
            alike.setdefault(contexts[k][0][: span - r], []).append(k)
        for own in alike.values():
            if len(own) < 2 or all(best[k][0] == len(contexts[k][0]) for k in own):
                continue
            own.sort(key=lambda k: contexts[k][0])
            shared = [-1, *(common(contexts[x][0], contexts[y][0]) for x, y in zip(own, own[1:])), -1]
            for k, before, behind in zip(own, shared, shared[1:]):
                x, y, n = best[k]
                best[k] = (max(x, before, behind), max(y, r), n or len(own))
    return best


def maximal_groups(contexts: list[tuple[bytes, bytes]], span: int) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, members) of every set of two occurrences or more that share l bytes before and r bytes after their anchor, l + r at
    least ``span``, which are all that share these, and of which some differ, or end, beyond them on either side."""
    order, after = intervals([c[1] for c in contexts])
    for r, first, last in after:
        alike: dict[bytes, list[int]] = {}
        for k in order[first : last + 1]:
            if len(contexts[k][0]) >= span - r:
                alike.setdefault(contexts[k][0][: span - r], []).append(k)
        for own in alike.values():
            backwards, before = intervals([contexts[k][0] for k in own])
            for l, low, high in before:
                # in the order of what follows the anchor, so the outer two share what all share
                members = sorted(backwards[low : high + 1])
                if common(contexts[own[members[0]]][1], contexts[own[members[-1]]][1]) == r:
                    yield l, r, [own[k] for k in members]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (a, low, high, c, n, left, bytes) of each piece, from rows in the order of their pieces."""
    own, key = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "low", "high", "c", "n", "left", "bytes")]
        for row in zip(*columns, strict=True):
            if row[:3] != key:
                if own:
                    yield own
                own, key = [], row[:3]
            own.append(row)
    if own:
        yield own


def _contexts(own: list[tuple]) -> list[tuple[bytes, bytes]]:
    return [(x[6][: x[5]][::-1], x[6][x[5] + GRAM :]) for x in own]


def _group(length: int):
    """Rows (a, g, l, r, c): the surroundings c that hold a maximal repeat g of l bytes, the anchor and r bytes."""
    span = length - GRAM

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _pieces(batches):
            rows = []
            for l, r, members in maximal_groups(_contexts(own), span):
                x = own[members[0]]
                passage = x[6][x[5] - l : x[5] + GRAM + r]
                # only where a window inside the passage has its anchor here, all occurrences of the passage have it
                if l in anchors(np.frombuffer(passage, np.uint8), np.array([0, len(passage)]), length)[0]:
                    g = int(np.uint64(xxhash.xxh3_64_intdigest(passage, l * (span + 1) + r)).view(np.int64))
                    rows += [(x[0], g, l, r, own[k][3]) for k in members]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "g", "l", "r", "c"])

    return group


def _compare(length: int):
    span = length - GRAM

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "c", "left", "right", "others"]
        rows: list[tuple] = []
        for own in _pieces(batches):
            found = extents(_contexts(own), span)
            rows += [(x[0], x[3], l, r, n) for x, (l, r, n) in zip(own, found, strict=True) if n and x[4] == 1]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return compare


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.hash(F.lit(1), text).alias("k2")]


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(k1, k2, id, text): the keys are hashes of 64 and 32 bits of the text, so no id is needed to tell texts apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # one number for all NULL ids, as joins don't match NULLs
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    return small_batches(docs).select(*_keys(whole), number.alias("id"), whole.alias("text"))


#: Bits of a filter over keys: as many as FILTER_SHARE times the keys, within these bounds, so at most 128 MB.
FILTER_SHARE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
_CHUNK = 32_768


def among(keys: DataFrame) -> Callable[[Column], Column]:
    """A test whether a k1 may be one of ``keys``: never wrong about those that are, now and then about others. It keeps texts that have
    nothing to be joined with from being shuffled; should it err, or be full, they are shuffled and no result changes."""
    bits = LEAST_BITS
    most = FILTER_SHARE * keys.count()
    while bits < min(most, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col("k1"), F.lit(bits))
    chunks = keys.select(F.floor(place / _CHUNK).cast("int").alias("chunk"), (place % _CHUNK).alias("bit")).groupBy("chunk")
    found = np.zeros((bits // _CHUNK, _CHUNK // 8), np.uint8)
    for row in chunks.agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        found[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(found.ravel())

    @F.arrow_udf("boolean")
    def maybe(values: pa.Array) -> pa.Array:
        at = values.to_numpy(zero_copy_only=False).astype(np.int64) % bits
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return maybe


def _surroundings(docs: DataFrame, length: int, id_column: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k1, k2, a, c, pos, left, right) of all anchors that occur again; (a, c, n, ...) of their different surroundings; and (a, low,
    high, c, n, left, bytes), in order, of those to be compared, in pieces."""
    rows = _keyed(docs, id_column, text)
    seen = rows.select("text").mapInArrow(_scan(length, False), "a long").groupBy("a").count().filter("count > 1").select("a")
    # both tables of counts are written, so that the joins with them have a shuffle on either side that can be split
    seen = keep(seen, "seen")
    full = "k1 long, k2 int, a long, c long, pos int, left int, right int"
    placed = keep(rows.mapInArrow(_scan(length, True), full).join(seen, "a", "left_semi"), "anchors")

    # anchors with equal surroundings need no comparison; one of them stands for all against other surroundings
    kinds = placed.groupBy("a", "c").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("k1").alias("k1"),
        F.min_by("k2", "k1").alias("k2"),
        F.min_by("pos", "k1").alias("pos"),
        F.min("left").alias("left"),
        F.min("right").alias("right"),
    )
    kinds = keep(kinds, "surroundings")
    several = keep(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "several")
    first = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    wanted = kinds.join(several, "a").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "c", "n", "m", "pos", "left", "right")).alias("wanted"))
    wanted = wanted.join(first, ["k1", "k2"])
    some = among(kinds.join(several, "a", "left_semi").select("k1").distinct())
    cut = rows.filter(some(F.col("k1"))).join(wanted, ["k1", "k2", "id"]).select("text", "wanted").mapInArrow(_cut_out, "a long, c long, n long, m long, left long, bytes binary")
    blocks = F.ceil(F.col("m") / GROUP).cast("int")
    cut = cut.withColumn("block", F.pmod(F.col("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = cut.select("a", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "c", "n", "left", "bytes")
    return placed, kinds, tiles.repartition("a", "low", "high").sortWithinPartitions("a", "low", "high")


def repeated_passages(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, start, end, occurrences): for every anchor that lies in a repeat, the bytes of the text with the hashes k1
    and k2 that repeats of at least ``length`` bytes around it cover, and in how many surroundings one of them is."""
    span = length - GRAM
    placed, kinds, tiles = _surroundings(docs, length, id_column, text)
    compared = tiles.mapInArrow(_compare(length), "a long, c long, left long, right long, others long")
    compared = compared.groupBy("a", "c").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("others").alias("others"))
    equal = kinds.filter((F.col("n") > 1) & (F.col("left") + F.col("right") >= span)).select("a", "c", "left", "right", F.col("n").alias("others"))
    covered = compared.union(equal)
    covered = covered.select("a", "c", F.col("left").alias("l"), F.col("right").alias("r"), "others")
    found = placed.select("k1", "k2", "a", "c", "pos").join(covered, ["a", "c"])
    spans = found.select("k1", "k2", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + GRAM + F.col("r")).alias("end"), F.col("others").alias("occurrences"))
    spans = keep(spans.distinct(), "spans")
    return spans


def repeat_groups(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(anchor, passage, n_bytes, occurrences, k1, k2, start, end, copies): the maximal repeats of at least ``length`` bytes, each with
    all its occurrences, one per row.

    A group is (anchor, passage), hashes both. Its ``occurrences`` are counted over all texts, overlapping ones and those in copies
    too; a row is the place, in bytes, in the text with the hashes k1 and k2 (xxhash64, and hash after the number 1), and ``copies``
    the number of rows with that text. A passage is followed for ``length - GRAM`` bytes to either side of an anchor, so a longer repeat is several
    groups, one per anchor, that overlap. Where an anchor has more than GROUP different surroundings, these are compared in pairs of
    blocks: a repeat whose occurrences differ on the left within one pair and on the right within another only is not named then,
    but the longer ones that each of these pairs shares are. NULL and empty texts, and those shorter than ``length``, have none; repeated rows, and equal
    or NULL ids, repeat each other; an empty table gives an empty table. Columns besides id and text are not read.
    """
    span = length - GRAM
    placed, kinds, tiles = _surroundings(docs, length, id_column, text)
    found = tiles.mapInArrow(_group(length), "a long, g long, l long, r long, c long")
    equal = kinds.filter((F.col("n") > 1) & (F.col("left") + F.col("right") >= span))
    equal = equal.select("a", F.col("c").alias("g"), F.col("left").cast("long").alias("l"), F.col("right").cast("long").alias("r"), "c")
    # pieces of one anchor name a group alike
    members = keep(found.union(equal).distinct(), "groups")
    # the counts per group and the places per surroundings are written or summed first, so no group is ever in one task
    counts = members.join(kinds.select("a", "c", "n"), ["a", "c"]).groupBy("a", "g").agg(F.sum("n").alias("occurrences"))
    counts = keep(counts, "counts")
    places = placed.groupBy("a", "c", "k1", "k2", "pos").agg(F.count(F.lit(1)).alias("copies"))
    rows = members.join(keep(places, "places"), ["a", "c"]).join(counts, ["a", "g"])
    start = (F.col("pos") - F.col("l")).alias("start")
    n_bytes = F.col("l") + F.col("r") + GRAM
    return rows.select(F.col("a").alias("anchor"), F.col("g").alias("passage"), n_bytes.alias("n_bytes"), "occurrences", "k1", "k2", start, (start + n_bytes).alias("end"), "copies")


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        kinds[0] = batch.schema.field("id").type
        rows = []
        for doc_id, text, starts, ends in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            whole = text.as_buffer().to_pybytes() if text.is_valid else b""
            kept, removed, spans, upto, reach = [], 0, 0, 0, -1
            for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                if a > reach:
                    kept.append(whole[upto:a])
                    spans += 1
                    upto = reach = a
                if b > reach:
                    removed += b - reach
                    upto = reach = b
            kept.append(whole[upto:])
            rest = b"".join(kept)
            rows.append((doc_id, len(whole), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def cut_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_text): one row per row of ``docs``.

    Every byte of a text's UTF-8 form is removed that is covered by a string of ``length`` bytes which also starts
    anywhere else, in the same text or another; overlapping ones count. n_spans counts the maximal removed runs;
    kept_text has the bytes that are left, in which a character at an edge may be cut. Whole texts are searched; matches
    don't cross texts. NULL texts are empty; nothing is removed from texts shorter than ``length``. Repeated rows, also with equal or
    NULL ids, repeat each other and lose all bytes if they have ``length`` of them. An empty table gives an empty table.

    Anchors are counted before they are shuffled, and anchors with equal surroundings become one row, so a passage in a
    third of all texts is compared only where its surroundings differ; more than GROUP different ones are dealt over tasks. Texts
    without a repeat are not shuffled: a filter over the keys of the others, of bounded size, is sent to the scan.
    """
    spans = repeated_passages(docs, length, id_column, text).select("k1", "k2", "start", "end").distinct()
    spans = keep(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "cuts")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = small_batches(docs).select(*_keys(whole), F.col(id_column).alias("id"), whole.alias("text"))
    marked = rows.withColumn("maybe", among(spans)(F.col("k1")))
    joined = marked.filter("maybe").join(spans, ["k1", "k2"], "left").select("id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    kind = docs.schema[id_column].dataType.simpleString()
    found = joined.mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
    none = F.lit(0).cast("long")
    bytes_ = F.col("text").cast("binary")
    whole = marked.filter("NOT maybe").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(bytes_, 256).alias("kept_sha256"), bytes_.alias("kept_text")
    )
    return found.unionByName(whole).withColumnRenamed("id", id_column)
