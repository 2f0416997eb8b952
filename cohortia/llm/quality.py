"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A score is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise part costs time in proportion to the number of
features that are set, as it equals half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import blocks, first_of_each, prefix_sums, small_batches, words

#: Buckets of hashed words.
BUCKETS = 1 << 15
#: Factors of a feature.
FACTORS = 8
#: Labelled rows the model is fitted on at most, about; a bounded sample of those with the lowest hashes.
SAMPLE_ROWS = 10_000

_SHARES = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.97])
_SIZES = np.array([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384, 65536, 1 << 20])
_BINS = 17
#: Structure statistics, each cut into bins; sizes first, shares after.
_SIZE_NAMES = ("bytes", "words", "lines", "bytes_per_word", "words_per_line")
_SHARE_NAMES = ("upper", "digit", "mark", "beyond_ascii", "repeated_words", "commonest_word", "repeated_lines", "words_ending_in_marks", "capital_words")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _bin_of(byte_class: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for k in range(256):
        c = chr(k)
        table[k] = {"upper": "A" <= c <= "Z", "digit": "0" <= c <= "9", "mark": 32 < k < 127 and not c.isalnum(), "beyond_ascii": k > 127, "line": k == 10}[byte_class]
    return table


_CLASSES = {name: _bin_of(name) for name in ("upper", "digit", "mark", "beyond_ascii", "line")}


def block_features(data: np.ndarray, offsets: np.ndarray, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointers, features, values) of a block of texts, as in a compressed sparse row matrix.

    Word features have the square root of their counts, scaled to length 1; each statistic and each metadata column sets
    one of its bins. NaN metadata have a bin of their own, as have texts without words.
    """
    n = len(offsets) - 1
    hashes, starts, ends = words(data, offsets, lower=True)
    doc = np.searchsorted(offsets, starts, "right") - 1
    keys, counts = np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    word_doc, word = keys // BUCKETS, keys % BUCKETS
    n_words = np.bincount(doc, minlength=n)
    value = np.sqrt(counts) / np.sqrt(np.maximum(n_words, 1))[word_doc]

    size = np.diff(offsets)
    by_class = {name: _sums(table[data], offsets) for name, table in _CLASSES.items()}
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, word_doc, counts)
    fresh = np.flatnonzero(_CLASSES["line"][data]) + 1
    line_starts = np.union1d(offsets[:-1], fresh)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    sums, down = prefix_sums(data)
    line_hash = (sums[line_ends] - sums[line_starts]) * down[line_starts]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    order = np.lexsort((line_hash, line_doc))
    same = (line_doc[order][1:] == line_doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    repeated_lines = np.bincount(line_doc[order][1:][same], minlength=n)
    ends_in_mark = np.bincount(doc, _CLASSES["mark"][data[ends - 1]] if len(ends) else None, minlength=n)
    capital = np.bincount(doc, _CLASSES["upper"][data[starts]] if len(starts) else None, minlength=n)

    sizes, wordy = np.maximum(size, 1), np.maximum(n_words, 1)
    stats = [size, n_words, n_lines, size / wordy, n_words / np.maximum(n_lines, 1)]
    stats = [np.digitize(x, _SIZES) for x in stats]
    shares = [by_class[k] / sizes for k in ("upper", "digit", "mark", "beyond_ascii")]
    shares += [1 - np.bincount(word_doc, minlength=n) / wordy, commonest / wordy, repeated_lines / np.maximum(n_lines, 1), ends_in_mark / wordy, capital / wordy]
    stats += [np.digitize(x, _SHARES) for x in shares]
    stats += [np.where(np.isnan(x), _BINS - 1, np.minimum(np.digitize(np.nan_to_num(x), _SIZES), _BINS - 2)) for x in metadata]
    fields = np.stack(stats, 1) + BUCKETS + _BINS * np.arange(len(stats))
    weight = np.full(fields.shape, 1 / np.sqrt(len(stats)))

    owner = np.concatenate([word_doc, np.repeat(np.arange(n), fields.shape[1])])
    order = np.argsort(owner, kind="stable")
    pointers = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=pointers[1:])
    return pointers, np.concatenate([word, fields.ravel()])[order], np.concatenate([value, weight.ravel()])[order]


def n_features(n_metadata: int) -> int:
    return BUCKETS + _BINS * (len(_SIZE_NAMES) + len(_SHARE_NAMES) + n_metadata)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, pointers: np.ndarray, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Raw scores in time linear in the number of values, by the sum-of-squares identity."""
        terms = self.factors[features] * values[:, None]
        sums = np.add.reduceat(terms, pointers[:-1])
        squares = np.add.reduceat((terms * terms).sum(1), pointers[:-1])
        return self.bias + np.add.reduceat(self.weights[features] * values, pointers[:-1]) + 0.5 * ((sums * sums).sum(1) - squares)


def probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], size: int, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Fits the machine to (label, features, values) by logistic loss, with steps that shrink per weight. Runs on the
    driver over the bounded sample. Without rows every score is one half."""
    random = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(size), random.normal(0, 0.05, (size, FACTORS)))
    if not rows:
        machine.factors[:] = 0
        return machine
    labels = np.array([r[0] for r in rows], float)
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            features, values = np.concatenate([rows[k][1] for k in own]), np.concatenate([rows[k][2] for k in own])
            lengths = np.array([len(rows[k][1]) for k in own])
            pointers = np.append(0, np.cumsum(lengths))
            terms = machine.factors[features] * values[:, None]
            sums = np.add.reduceat(terms, pointers[:-1])
            error = probability(machine.raw(pointers, features, values)) - labels[own]
            spread = np.repeat(error, lengths)[:, None] * values[:, None]
            used, place = np.unique(features, return_inverse=True)
            grad_w, grad_v = np.zeros(len(used)), np.zeros((len(used), FACTORS))
            np.add.at(grad_w, place, spread[:, 0])
            np.add.at(grad_v, place, spread * (np.repeat(sums, lengths, 0) - terms))
            grad_w = grad_w / len(own) + decay * machine.weights[used]
            grad_v = grad_v / len(own) + decay * machine.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            machine.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            machine.bias -= rate * float(error.mean())
    return machine


def _metadata(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in names]


def _rows(docs: DataFrame, text: str, metadata: Sequence[str], *others) -> tuple[DataFrame, list[str]]:
    names = [f"m{k}" for k in range(len(metadata))]
    return small_batches(docs).select(*others, F.col(text).alias("text"), *[F.col(c).cast("double").alias(n) for c, n in zip(metadata, names, strict=True)]), names


def learn_quality(
    docs: DataFrame, label: str, text: str = "text", metadata: Sequence[str] = (), labels: DataFrame | None = None, id_column: str = "doc_id"
) -> Machine:
    """Fits the machine to rows with text and a 0/1 label, which ``labels`` gives by id where it isn't a column of ``docs``; rows without
    a label are left out.

    Of equal texts with equal labels one counts, the one with the least metadata (NULL first), so copies don't fill the sample. Of more
    than SAMPLE_ROWS different ones it takes those with the lowest hashes; their features come to the driver. NULL and empty texts are
    one text. Only hashes, ids and metadata are shuffled, and the texts of the sample."""
    rows, names = _rows(docs, text, metadata, F.col(label).cast("int").alias("label") if labels is None else F.col(id_column).alias("id"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    known, same = rows.drop("text"), list(names)
    if labels is not None:
        known = known.join(labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")), "id")
        same.append("id")
    least = F.min(F.struct(F.lit(0).alias("none"), *same)).alias("least")
    chosen = known.filter("label IS NOT NULL").groupBy("hash", "label").agg(least).orderBy("hash", "label").limit(SAMPLE_ROWS)
    chosen = chosen.select(F.col("hash").alias("h"), F.col("label").alias("y"), *[F.col("least")[n].alias(f"least_{n}") for n in same])
    own = F.col("hash") == F.col("h")
    if labels is None:
        own &= F.col("label") == F.col("y")
    for name in same:
        own &= F.col(name).eqNullSafe(F.col(f"least_{name}"))
    sample = rows.join(F.broadcast(chosen), own)  # SAMPLE_ROWS rows at most
    rows = first_of_each(sample.select(F.col("y").alias("label"), "hash", "text", *names), "hash", "label")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            pointers, found, values = block_features(data, offsets, _metadata(batch, names))
            cut = lambda x, kind: pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), pa.array(x.astype(kind)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), cut(found, np.int32), cut(values, np.float32)], ["label", "features", "values"])

    collected = rows.mapInArrow(features, "label int, features array<int>, values array<float>").toArrow()
    found = zip(collected["label"].to_pylist(), collected["features"], collected["values"], strict=True)
    examples = [(y, np.asarray(f.values.to_numpy()), np.asarray(v.values.to_numpy(), float)) for y, f, v in found]
    examples.sort(key=lambda r: (len(r[1]), r[1].tobytes(), r[0]))  # the order of tasks must not matter
    return fit(examples, n_features(len(metadata)))


def score_quality(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """(id, score): the probability that a text is good, one row per row of ``docs``, over whole texts.

    NULL and empty texts are scored by their structure alone, NULL metadata as unknown; repeated rows get equal scores.
    Only the id, the text and the metadata are read. One pass, no shuffle.
    """
    rows, names = _rows(docs, text, metadata, F.col(id_column).alias("id"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BUCKETS and FACTORS

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            raw = sent.value.raw(*block_features(data, offsets, _metadata(batch, names)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(probability(raw))], ["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_column)
