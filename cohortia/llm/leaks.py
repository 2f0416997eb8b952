"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case letters and digits, every run of anything else one space. An item is looked for by
windows of ``WINDOW`` bytes, one every ``STRIDE``, so every passage of at least ``WINDOW + STRIDE - 1`` bytes holds one
and is found, wherever it lies in the item; shorter items are looked for as a whole. A window of m bytes with at most e edits shares at
least m + 1 - q (e + 1) q-grams with its copy, and these lie on e + 1 neighbouring diagonals (place in the text less place
in the item). So shared q-grams are counted in overlapping diagonal bands, and only windows with enough in a band are aligned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import blocks, small_batches

Q = 8
WINDOW, STRIDE = 64, 16
#: Edits of a window, as a share of its length.
EDITS = 0.1
#: Bytes of benchmark text a pass over the documents looks for; more are looked for in more passes.
PASS_BYTES = 2 << 20

#: Shared grams that are looked at together, which bounds a task's memory.
SLICE = 1 << 20
#: Places of text that are aligned together, likewise.
CELLS = 1 << 17

_FOLD = np.full(256, 32, np.uint8)
for _k in range(256):
    if _k >= 128 or chr(_k).isalnum():
        _FOLD[_k] = _k + 32 if 65 <= _k <= 90 else _k
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20

LEAKS = "array<struct<item:long,windows:int,found:int,start:long,end:long,edits:int>>"


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, offsets) of a block as it is compared; places are those of the bytes in ``data``."""
    folded = _FOLD[data]
    word = folded != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    places = np.flatnonzero(keep)
    return folded[places], places, np.searchsorted(places, offsets)


def grams(data: np.ndarray) -> np.ndarray:
    """The q-grams at all places, as 64-bit numbers."""
    n = len(data) - Q + 1
    found = np.empty(max(n, 0), np.uint64)
    for k in range(min(Q, len(found))):
        found[k::Q] = np.frombuffer(data[k : k + (len(found[k::Q])) * Q].tobytes(), "<u8")
    return found


class Benchmark:
    """The items' windows and the places of all their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [], []
        #: Per item, where its windows start, their bytes, and the edits that each may have.
        self.starts, self.windows, self.edits = [], [], []
        codes, owners, places = [], [], []
        least = []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data = plain(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(data) < Q:
                continue
            size = min(WINDOW, len(data))
            starts = sorted({*range(0, len(data) - size + 1, STRIDE), len(data) - size})
            # the bound must stay above 0 for the lemma to say something, which limits the edits of short windows
            edits = min(int(size * EDITS), (size - Q) // Q)
            self.starts.append(np.array(starts))
            self.windows.append([data[s : s + size] for s in starts])
            self.edits.append(edits)
            least.append(size + 1 - Q * (edits + 1))
            found = grams(np.frombuffer(data, np.uint8))
            codes.append(found)
            owners.append(np.full(len(found), len(self.ids)))
            places.append(np.arange(len(found)))
            self.ids.append(item)
            self.texts.append(data)
        self.least = np.array(least, np.int64)
        self.longest = max((len(t) for t in self.texts), default=0)
        empty = np.zeros(0, np.int64)
        all_codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(all_codes, kind="stable")
        self.owners, self.places = ((np.concatenate(x) if x else empty)[order] for x in (owners, places))
        self.codes, first = np.unique(all_codes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.step = int(WINDOW * EDITS) + 1
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.codes * _SPREAD) >> np.uint64(64 - _BITS)] = True


def nearest(pairs: list[tuple[bytes, np.ndarray]]) -> list[tuple[int, int]]:
    """For pairs of a pattern and a text (edits, end): the least edit distance of the pattern to any part of the text, and where the
    first such part ends. Pairs with equally long patterns are aligned together, as many as CELLS places of text allow."""
    found = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        size, many, width = len(pairs[order[0]][0]), 0, 0
        for k in order:
            wider = max(width, len(pairs[k][1]))
            if len(pairs[k][0]) != size or (many and (many + 1) * wider > CELLS):
                break
            many, width = many + 1, wider
        own, order = order[:many], order[many:]
        patterns = np.frombuffer(b"".join(pairs[k][0] for k in own), np.uint8).reshape(many, size)
        ends = np.array([len(pairs[k][1]) for k in own])
        texts = np.zeros((width, many), np.uint8)
        for column, k in enumerate(own):
            texts[: ends[column], column] = pairs[k][1]
        places = np.arange(width + 1, dtype=np.int32)[:, None]
        row, best = np.zeros((2, width + 1, many), np.int32)
        for i in range(size):
            best[0] = i + 1
            np.minimum(row[:-1] + (texts != patterns[:, i]), row[1:] + 1, out=best[1:])
            best -= places
            np.minimum.accumulate(best, axis=0, out=row)
            row += places
        row[places > ends] = size + 1  # a shorter text has ended there
        at = row.argmin(0)
        for column, k in enumerate(own):
            found[k] = (int(row[at[column], column]), int(at[column]))
    return found


def summed(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of several tables of counts together."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some, n in parts:
        if not len(keys):
            keys, counts = some, n
            continue
        both = np.concatenate([keys, some])
        keys, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def find_leaks(data: np.ndarray, offsets: np.ndarray, known: Benchmark) -> list[list[dict]]:
    """For each text of a block, the items that it holds windows of."""
    leaks: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    text, places, ends = plain(data, offsets)
    codes = grams(text)
    if not len(codes) or not known.ids:
        return leaks
    at = np.flatnonzero(known.filter[(codes * _SPREAD) >> np.uint64(64 - _BITS)])
    k = np.minimum(np.searchsorted(known.codes, codes[at]), len(known.codes) - 1)
    hit = known.codes[k] == codes[at]
    at, k = at[hit], k[hit]
    doc = np.searchsorted(ends, at, "right") - 1
    hit = at + Q <= ends[doc + 1]
    at, k, doc = at[hit], k[hit], doc[hit]
    n = known.first[k + 1] - known.first[k]
    bands = (int(np.diff(ends).max()) + 2 * known.longest) // known.step + 3

    def postings() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cell, place in the item) of every shared gram, some at a time: in periodic texts there are as many as the product of
        both lengths."""
        upto = np.cumsum(n)
        for base in range(0, int(upto[-1]) if len(upto) else 0, SLICE):
            first, last = np.searchsorted(upto, [base, min(base + SLICE, int(upto[-1])) - 1], "right")
            own = slice(first, last + 1)
            many, end = n[own], min(base + SLICE, int(upto[-1]))
            number = np.arange(base, end)
            which = first + np.repeat(np.arange(len(many)), np.minimum(upto[own], end) - np.maximum(upto[own] - many, base))
            posting = known.first[k[which]] + number - (upto[which] - n[which])
            item, place = known.owners[posting], known.places[posting]
            diagonal = at[which] - ends[doc[which]] - place + known.longest
            yield (doc[which] * len(known.ids) + item) * bands + diagonal // known.step, place

    cells, counts = summed(np.unique(cell, return_counts=True) for cell, _ in postings())
    # a band is two neighbouring cells; cell b belongs to the bands that start at b - 1 and b
    both = counts.copy()
    follows = np.flatnonzero(cells[1:] == cells[:-1] + 1)
    both[follows] += counts[follows + 1]
    enough = np.flatnonzero(both >= known.least[cells // bands % len(known.ids)])
    cells = cells[enough]
    runs = np.split(cells, np.flatnonzero(np.diff(cells) != 1) + 1) if len(cells) else []
    if not runs:
        return leaks
    starts, stops = np.array([r[0] for r in runs]), np.array([r[-1] + 1 for r in runs])

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for cell, place in postings():
            run = np.searchsorted(starts, cell, "right") - 1
            inside = (run >= 0) & (cell <= stops[run])
            yield np.unique(run[inside] * known.longest + place[inside], return_counts=True)

    near_keys, near_counts = summed(near())
    near_sums = np.append(0, np.cumsum(near_counts))
    # per run of bands, the windows found in it: those found as they are at once, the others by alignment
    hits: list[list[tuple[int, int, int, int]]] = [[] for _ in runs]
    open_: list[tuple[int, int, int, bytes, int, np.ndarray]] = []
    for number, run in enumerate(runs):
        d, i = divmod(int(run[0]) // bands, len(known.ids))
        low = int(run[0]) % bands * known.step - known.longest
        high = (int(run[-1]) % bands + 2) * known.step - known.longest
        own = text[ends[d] : ends[d + 1]]
        starts = known.starts[i] + number * known.longest
        size, edits = len(known.windows[i][0]), known.edits[i]
        inside = np.searchsorted(near_keys, np.stack([starts, starts + size - Q + 1]))
        for k in np.flatnonzero(near_sums[inside[1]] - near_sums[inside[0]] >= known.least[i]).tolist():
            start, pattern = int(known.starts[i][k]), known.windows[i][k]
            a, b = max(0, low + start - edits), min(len(own), high + start + size + edits)
            region = own[a:b]
            exact = region.tobytes().find(pattern)
            if exact >= 0:
                hits[number].append((k, a + exact, a + exact + size, 0))
            else:
                open_.append((number, k, a, pattern, edits, region))
    aligned = [(*x, *y) for x, y in zip(open_, nearest([(x[3], x[5]) for x in open_]), strict=True)]
    aligned = [x for x in aligned if x[6] <= x[4]]
    backwards = nearest([(pattern[::-1], region[:end][::-1]) for _, _, _, pattern, _, region, _, end in aligned])
    for (number, k, a, _, _, _, distance, end), (_, back) in zip(aligned, backwards, strict=True):
        hits[number].append((k, a + end - back, a + end, distance))
    for run, found in zip(runs, hits, strict=True):
        if found:
            d, i = divmod(int(run[0]) // bands, len(known.ids))
            first, last = (int(places[ends[d] + p]) for p in (min(x[1] for x in found), max(x[2] for x in found) - 1))
            whole = data[offsets[d] : offsets[d + 1]]
            starts = (whole & 0xC0) != 0x80
            a, b = int(np.count_nonzero(starts[: first - offsets[d]])), int(np.count_nonzero(starts[: last - offsets[d] + 1]))
            leaks[d].append({"item": known.ids[i], "windows": len(known.windows[i]), "found": len(found), "start": a, "end": b, "edits": sum(x[3] for x in found)})
    for own in leaks:
        own.sort(key=lambda x: (x["item"], x["start"]))
    return leaks


def _looker(items: Broadcast):
    @F.arrow_udf(LEAKS)
    def look(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.int64()), ("windows", pa.int32()), ("found", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
        benchmark = Benchmark(items.value)
        for texts in columns:
            found = []
            for _, data, offsets in blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
                found += find_leaks(data, offsets, benchmark)
            yield pa.array(found, kind)

    return look


def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", column: str = "leaks") -> DataFrame:
    """``docs`` with the column ``leaks``: for each place that holds windows of a benchmark item, the item's id, its
    number of windows and how many were found, the code points where they start and end, and their edits.

    NULL and empty texts have no leaks; repeated rows have the same. Items that are NULL, or have fewer than Q letters,
    digits and spaces, can't be told from chance and are left out; equal items are all named. Item ids are whole numbers. Without
    documents or items nothing is found. Very long and periodic texts and items are compared whole, in slices of bounded memory. A column of the same name is replaced; other columns are left alone.

    One pass without a shuffle for every PASS_BYTES of benchmark text, each with an index of that size sent to the executors.
    """
    known = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    found = []
    for k in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).collect()
        found.append(_looker(docs.sparkSession.sparkContext.broadcast(sorted((r["id"], r["text"]) for r in rows)))(F.col(text)))
    kept = [c for c in docs.columns if c != column]
    return small_batches(docs).select(*kept, (F.concat(*found) if len(found) > 1 else found[0]).alias(column))
