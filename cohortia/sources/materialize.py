"""Tables that are computed once, kept as Parquet and rebuilt when their sources change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.sources.readers import path_has, table_contract
from cohortia.sources.writers import write_parquet


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, modificationTime) of files or folders, without reading any of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*")
    return files.load(list(paths)).select("path", "length", "modificationTime")


def _digest(files: DataFrame, *by: str) -> DataFrame:
    """One md5 per group of files over path, size and modification time. The per-file digests are summed, so the files need not be
    brought together in order."""
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    whole = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(each).cast("string"), F.sum("length").cast("string"))
    return files.groupBy(*by).agg(F.md5(whole).alias("fingerprint"))


def source_fingerprint(df: DataFrame) -> DataFrame:
    """(fingerprint) of the files behind a table, from their listing; no row is read."""
    return _digest(_listed(df.sparkSession, df.inputFiles()))


def partition_fingerprints(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(value, fingerprint) per partition folder ``by``=value of a dataset, from the listing of its files."""
    value = F.url_decode(F.regexp_extract("path", f"/{by}=([^/]+)/", 1))
    return _digest(_listed(spark, [path]).withColumn("value", value).filter("value <> ''"), "value")


def _stored_fingerprint(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.parquet(path).limit(1).collect()
    except AnalysisException:
        return None
    return rows[0]["fingerprint"] if rows else None


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    required: Sequence[str] = (),
    force: bool = False,
    sources: DataFrame | None = None,
    partition_by: Sequence[str] | None = None,
) -> DataFrame:
    """The table at ``path``, built and written there when it is not.

    It is built again with ``force``, when a required column is missing, or when ``sources`` (a table
    read from files) has another fingerprint than at the last build. The old fingerprint is emptied before
    the data is written and the new one written after it, so a build that died in between is done again.
    """
    mark_path = path.rstrip("/") + "_fingerprint"
    mark = None if sources is None else source_fingerprint(sources).collect()[0]["fingerprint"]
    fresh = not force and path_has(spark, path, required)
    if fresh and mark is not None:
        fresh = _stored_fingerprint(spark, mark_path) == mark
    if not fresh:
        if mark is not None:  # no mark may stand beside data that is only partly written
            write_parquet(spark.createDataFrame([], "fingerprint string"), mark_path)
        write_parquet(build(), path, partition_by)
        if mark is not None:
            write_parquet(spark.createDataFrame([(mark,)], "fingerprint string"), mark_path)
    return spark.read.parquet(path)


def materialize_partitions(
    spark: SparkSession, path: str, source: str, by: str, build: Callable[[DataFrame], DataFrame], required: Sequence[str] = ()
) -> DataFrame:
    """The table at ``path``, partitioned by ``by`` like its source, with only the partitions built anew whose files changed.

    ``build`` gets the source cut to the changed partitions and returns their rows, ``by`` included. These replace the old ones
    folder by folder; a partition that has no rows any more is replaced by an empty file, and partitions that the source has lost are
    not returned. Marks of partitions under work are taken away first, so what dies in between is done again.
    """
    mark_path = path.rstrip("/") + "_fingerprint"
    schema = "value string, fingerprint string"
    now = {r.value: r.fingerprint for r in partition_fingerprints(spark, source, by).collect()}  # a row per partition
    known: dict[str, str] = {}
    if path_has(spark, path, [by, *required]) and path_has(spark, mark_path, ["value"]):
        known = {r.value: r.fingerprint for r in spark.read.parquet(mark_path).collect()}
    changed = sorted(v for v, mark in now.items() if known.get(v) != mark)
    if changed or set(known) - set(now):
        kept = [(v, m) for v, m in sorted(known.items()) if now.get(v) == m]
        write_parquet(spark.createDataFrame(kept, schema), mark_path)
    if changed:
        rows = spark.read.parquet(source)
        built = build(rows.filter(F.col(by).cast("string").isin(changed)))
        before = dict(partition_fingerprints(spark, path, by).collect()) if known else {}
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        after = dict(partition_fingerprints(spark, path, by).collect())
        for value in changed:
            if value in after and before.get(value) == after[value]:
                write_parquet(built.drop(by).limit(0), f"{path.rstrip('/')}/{by}={value}")
        write_parquet(spark.createDataFrame(sorted(now.items()), schema), mark_path)
    return spark.read.parquet(path).filter(F.col(by).cast("string").isin(sorted(now)))


def materialize_bucketed(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], key: str, buckets: int, required: Sequence[str] = (), force: bool = False
) -> DataFrame:
    """A catalog table bucketed and sorted by a link key, built when it is not there, lacks a required column, or with ``force``.

    Tables with as many buckets on keys of one type meet in joins and group by that key without a shuffle: the funnel, the linked
    and unlinked rows and the pairs of ``operators.link`` need no more than their small results dealt.
    """
    if force or table_contract(spark, [key, *required], name):
        # rows are dealt by the key first, so that a bucket is one file, not one per task
        rows = build().repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
