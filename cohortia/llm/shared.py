"""What several operators need: tables in the shared folder, blocks of texts as bytes, hashes of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in blocks of about so many bytes, which bounds a task's memory; a longer text is a block.
BLOCK_BYTES = 2 << 20
#: Rows of an Arrow batch between the JVM and Python; with texts of some kilobytes a batch is a few megabytes.
BATCH_ROWS = 500


def one_process(master: str) -> bool:
    """Whether executors run in the driver's process; local-cluster starts processes of its own."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a
    local folder, and a cluster an error, as its executors wouldn't see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_llm_folder", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="llm-")
            spark._llm_folder = folder
    return folder.rstrip("/")


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back, which cuts the lineage: a lost executor
    costs no more than the tasks that ran on it. Each call writes a folder of its own."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the batch size for the Python steps below, so that long texts don't add up in memory, and lets the workers of
    a local session find this package wherever the driver found it."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def first_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key, for samples with a bounded number of keys: a task passes on the first row of each, so a key that a third of all
    rows have is one row a task before it is shuffled. Which row of a key stays is open."""

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            fresh = []
            for k, key in enumerate(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            if fresh:
                yield batch.take(pa.array(fresh, pa.int64()))

    return small_batches(df).mapInArrow(once, df.schema).dropDuplicates(list(keys))


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets): runs of rows whose texts have about ``most`` bytes. NULL is an empty text."""
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            continue
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            own = offsets[start : end + 1]
            yield batch.slice(start, end - start), data[own[0] : own[-1]], own - own[0]
            start = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + (n >> 2) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, so that all their bits are of use."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the hash of bytes s..e-1 is (sums[e] - sums[s]) * inverse[s], equal for equal bytes."""
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words ``[^\\x20\\x09-\\x0D]+`` of a block; texts end words. ``lower`` folds A-Z."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends
