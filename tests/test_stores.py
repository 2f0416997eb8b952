"""Files and kept tables: counts from footers, rejected rows, sized files, changed partitions, buckets."""

import glob
import io
import time
from contextlib import redirect_stdout

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortia.operators import frequency, link
from cohortia.sources import materialize, readers, writers
from tests.conftest import rows


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    counted = readers.row_count(spark, str(tmp_path / "t"))
    assert "PushedAggregation: [COUNT(*)]" in plan(counted) and rows(counted) == [(1000,)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert "BatchScan" not in plan(spark.read.parquet(str(tmp_path / "t")))


def test_rejected_rows_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name;score\n1;ñu;2.5\n2;short\n3;long;1.0;more\nx;bad;1.0\n4;;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id;name;score\n5;fine;0.5\n", encoding="utf-8")
    found = readers.read_csv(spark, str(tmp_path), schema="id int, name string, score double", rejects="_bad")
    assert rows(readers.csv_report(found, "_bad")) == [("a.csv", 5, 3), ("b.csv", 1, 0)]
    assert rows(readers.accepted(found, "_bad"), "id") == [(1, "ñu", 2.5), (4, None, None), (5, "fine", 0.5)]
    bad = {r["_bad"]: (r["id"], r["name"]) for r in found.filter("_bad IS NOT NULL").collect()}
    assert bad == {"2;short": (2, "short"), "3;long;1.0;more": (3, "long"), "x;bad;1.0": (None, "bad")}
    with pytest.raises(ValueError, match="schema"):
        readers.read_csv(spark, str(tmp_path), rejects="_bad")


def test_sized_files_with_useful_statistics(spark, tmp_path):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, 2015).otherwise(2014 + F.col("id") % 10 % 3 * 2).alias("year"), F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = str(tmp_path / "t")
    writers.write_parquet(df.repartition(7), path, ["year"], sort_by=["key"], target_bytes=1 << 20)
    files = {y: glob.glob(f"{path}/year={y}/*.parquet") for y in (2014, 2015, 2016, 2018)}
    assert 2 <= len(files[2015]) <= 8  # the hot year is split, into files of about the wanted size
    assert all(len(f) <= len(files[2015]) for f in files.values()) and sum(map(len, files.values())) < 7 * 3
    for file in [f for own in files.values() for f in own]:
        keys = pq.read_table(file, columns=["key"])["key"].to_pylist()
        stats = pq.ParquetFile(file).metadata.row_group(0).column(0).statistics
        assert keys == sorted(keys) and stats.has_min_max and stats.min == keys[0]
    assert spark.read.parquet(path).count() == 60_000
    assert spark.conf.get(writers.TARGET, None) != str(1 << 20)


def test_only_changed_partitions_are_built(spark, tmp_path):
    source, path, seen = str(tmp_path / "s"), str(tmp_path / "t"), []

    def build(part):
        seen.append(sorted(r[0] for r in part.select("year").distinct().collect()))
        return part.filter("v >= 0").groupBy("year").agg(F.sum("v").alias("total"))

    def load():
        return rows(materialize.materialize_partitions(spark, path, source, "year", build, ["total"]).select("year", "total"))

    def put(values):
        time.sleep(1.1)
        df = spark.createDataFrame(values, "year int, v int")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(source)

    put([(2014, 1), (2015, 2), (2016, 3)])
    assert load() == load() == [(2014, 1), (2015, 2), (2016, 3)] and seen == [[2014, 2015, 2016]]
    put([(2015, 7)])
    assert load() == [(2014, 1), (2015, 7), (2016, 3)] and seen[1:] == [[2015]]
    put([(2016, -1), (2017, 4)])
    assert load() == [(2014, 1), (2015, 7), (2017, 4)] and seen[2:] == [[2016, 2017]]
    assert load() == [(2014, 1), (2015, 7), (2017, 4)] and len(seen) == 3


def test_fingerprints_read_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(10).withColumn("year", F.col("id") % 2).write.partitionBy("year").parquet(path)
    marks = materialize.partition_fingerprints(spark, path, "year")
    assert [r.value for r in marks.orderBy("value").collect()] == ["0", "1"]
    assert "content" not in plan(marks).split("ReadSchema")[1]


def test_bucketed_tables_join_without_a_shuffle(spark):
    members = spark.createDataFrame([(k, 2014 + k % 3, f"m{k}") for k in range(200)], "id int, year int, name string")
    links = spark.createDataFrame([(k, f"e{k}") for k in range(0, 200, 3)] + [(0, "again"), (None, "x")], "id int, event string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = materialize.materialize_bucketed(spark, "bucketed_members", lambda: members, "id", 4)
        b = materialize.materialize_bucketed(spark, "bucketed_links", lambda: links, "id", 4)
        for make in (link.unlinked, link.linked):
            df = make(a, b, "id")
            assert "Exchange" not in plan(df) and rows(df) == rows(make(members, links, "id"))
        funnel = link.cohort_funnel(a, b, "year", "id")
        assert plan(funnel, "simple").count("Exchange") == 1 and "hashpartitioning(year" in plan(funnel, "simple")
        assert rows(funnel) == rows(link.cohort_funnel(members, links, "year", "id"))
        attached = link.attach(a, b.dropDuplicates(["id"]), "id", ["event"])
        assert "Exchange" not in plan(attached)
        assert "Exchange" in plan(link.unlinked(members, links, "id"))  # other inputs are dealt as ever
        materialize.materialize_bucketed(spark, "bucketed_members", lambda: members.limit(3), "id", 4)
        assert spark.table("bucketed_members").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("bucketed_members", "bucketed_links"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_sketches_of_slices_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 4).alias("slice"), (F.col("id") % 3000).alias("a"), F.when(F.col("id") < 50, F.col("id")).alias("b"))
    sketches = frequency.distinct_sketches(df, ["slice"], ["a", "b"])
    found = {r.field: r.n_distinct for r in frequency.union_counts(sketches).collect()}
    assert abs(found["a"] - 3000) < 200 and found["b"] == 50
    some = {r.field: r.n_distinct for r in frequency.union_counts(sketches.filter("slice = 1")).collect()}
    assert abs(some["a"] - 750) < 50 and some["b"] == 13
