"""Exact quantiles by narrowing and correlations by ranges, against NumPy and plain ranks; shared aggregations of a page."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.operators import conform, paired, selection
from cohortia.plans import profiles, schemas, star_profiles
from tests.conftest import records, rows


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def values(kind, n):
    dice = np.random.default_rng(4)
    if kind == "spread":
        return dice.normal(0, 1e6, n), dice.exponential(1, n) - 0.5
    if kind == "ties":
        return dice.integers(0, 7, n).astype(float), np.where(dice.random(n) < 0.4, 3.25, dice.random(n))
    if kind == "constant":
        return np.full(n, 2.5), np.arange(n) - n / 2.0
    return -(10.0 ** dice.integers(-300, 300, n)), np.where(dice.random(n) < 0.5, 0.0, -0.0)


@pytest.mark.parametrize(
    ("kind", "n", "few", "accuracy"),
    [("spread", 3000, 20_000, 10_000), *((kind, 3000, 50, 200) for kind in ("spread", "ties", "constant", "extreme")), ("spread", 2, 50, 200), ("ties", 1, 50, 200)],
)
def test_counted_quantiles(spark, monkeypatch, kind, n, few, accuracy):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "PLACES", 40)
    x, y = values(kind, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    (row,) = selection.counted_quantiles(df, ["x", "y"], 5).collect()
    assert row.total == n == sum(g.n for g in row.groups)
    for edges, data in ((row.edges_x, x), (row.edges_y, y)):
        exact = np.quantile(data, np.arange(6) / 5)
        assert np.allclose(edges, sorted(set(exact.tolist())), rtol=1e-12, atol=0) or np.allclose(np.interp(range(len(edges)), range(len(edges)), edges), np.unique(exact.round(12)), rtol=1e-9)
    if few < n and kind == "spread":
        assert len(row.groups) < n  # rows between the brackets are counted, not listed


def test_no_rows_and_plan(spark):
    df = spark.range(1000).select(F.rand(3).alias("x"), F.rand(4).alias("y"))
    assert selection.counted_quantiles(df.limit(0), ["x", "y"], 5).count() == 0
    text = plan(paired.quantile_transition(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y"))
    assert text.count("Exchange") <= 5 and "Join" not in text and "SortMerge" not in text
    with pytest.raises(ValueError):
        selection.counted_quantiles(df, ["x"], 1)


def average_ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


@pytest.mark.parametrize("kind", ["spread", "ties", "hot"])
def test_correlations_equal_plain_ranks(spark, kind):
    dice = np.random.default_rng(9)
    x, y = values("ties" if kind == "ties" else "spread", 1500)
    y = y + x / (1 + np.abs(x))
    if kind == "hot":
        x[dice.random(1500) < 0.4], y[dice.random(1500) < 0.35] = 1.5, -7.0
    data = [(float(a), float(b), 1.0, None if k % 3 else float(k)) for k, (a, b) in enumerate(zip(x, y))] + [(float("nan"), 1.0, 1.0, 1.0), (None, 2.0, 1.0, None)]
    df = spark.createDataFrame(data, "x double, y double, flat double, gaps double").repartition(3)
    pairs = {"all": ("y", "x"), "flat": ("y", "flat"), "gaps": ("y", "gaps"), "none": ("gaps", "nothing")}
    found = {r["label"]: r for r in records(paired.correlations(df.withColumn("nothing", F.lit(None).cast("double")), pairs))}
    assert found["all"]["n"] == 1500 and found["none"] == {"label": "none", "n": 0, "pearson": None, "spearman": None, "strength": found["none"]["strength"]}
    assert found["all"]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert found["all"]["spearman"] == pytest.approx(np.corrcoef(average_ranks(x), average_ranks(y))[0, 1], abs=1e-9)
    assert found["flat"]["pearson"] is None and found["flat"]["spearman"] is None
    some = np.arange(0, 1500, 3)
    assert found["gaps"]["spearman"] == pytest.approx(np.corrcoef(average_ranks(some), average_ranks(y[some]))[0, 1], abs=0.01)


def test_correlations_count_equal_pairs_before_they_are_dealt(spark):
    df = spark.range(0, 6000, 1, 3).selectExpr("CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS wide")
    text = plan(paired.correlations(df, {"few": ("y", "x"), "wide": ("wide", "x")}))
    lowest = text[text.rindex("Exchange hashpartitioning") :]
    assert "partial_count" in lowest and "Window" not in lowest and "Exchange" not in lowest[8:]
    # few partitions make no large ranges
    assert paired.LEAST_RANGES >= 100 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = {r["label"]: r for r in records(paired.correlations(df, {"few": ("y", "x"), "wide": ("wide", "x")}))}
    numbers = np.arange(6000)
    assert found["few"]["n"] == found["wide"]["n"] == 6000
    for label, y in (("few", numbers % 11), ("wide", numbers)):
        assert found[label]["spearman"] == pytest.approx(np.corrcoef(average_ranks(numbers % 7), average_ranks(y))[0, 1], abs=1e-9)


def test_correlations_pass_over_their_rows_once(spark):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    df = spark.range(0, 900, 1, 3).selectExpr("CAST(id % 30 AS DOUBLE) AS x", "CAST(id * id AS DOUBLE) AS y").mapInArrow(count, "x double, y double")
    (row,) = records(paired.correlations(df, {"p": ("y", "x")}))
    assert row["n"] == 900 and passed.value == 900


def test_delta_summaries(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (float("nan"), 1.0), (4.0, 5.0)], "x double, y double")
    assert rows(paired.delta_summaries(df, {"a": ("y", "x"), "b": ("x", "x")}), "label") == [("a", 2, 1.5), ("b", 3, 0.0)]


def test_a_page_is_one_scan_and_one_exchange(spark, tmp_path):
    data = [("201510", "M", "01/02/1995", "COLOMBIA", "2", 10.0 + k, "1", "true" if k % 2 else None) for k in range(8)]
    names = "periodo string, estu_genero string, estu_fechanacimiento string, estu_nacionalidad string, fami_estratovivienda string, estu_inse_individual double, estu_nse_individual string, estu_pagomatriculabeca string"
    spark.createDataFrame(data, names).write.parquet(str(tmp_path / "rows"))
    table = profiles.consolidated_socio({2015: spark.read.parquet(str(tmp_path / "rows"))})
    counts = plan(profiles.socioeconomic_profile(table)["counts"])
    assert counts.count("FileScan") == 1 and counts.count("Exchange") == 1
    kept = []

    def keep(name, df):
        kept.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    tables = profiles.socioeconomic_profile(table, keep=keep)
    assert kept == ["socio_counts"]
    for name, found in tables.items():
        assert str(tmp_path / "rows") not in plan(found), name
    assert rows(tables["total"]) == [(8,)] and dict(rows(tables["payments"]))["Beca"] == 4
    assert sum(r["n"] for r in records(tables["index"])) == 8


def test_years_come_from_the_dates(spark):
    df = spark.createDataFrame([("1988-05-01", 1), ("1990-01-01", 2), (None, 3)], "d string, v int").withColumn("d", F.to_timestamp("d"))
    tables = star_profiles.by_year(df, "d")
    assert {y: t.collect()[0][0] if t.count() else None for y, t in tables.items()} == {1988: 1, 1989: None, 1990: 2, None: 3}
    assert list(star_profiles.by_year(df.filter("v < 3"), "d")) == [1988, 1989, 1990]
    assert schemas.LINK.names == ["estu_consecutivo_sbpro", "estu_consecutivo_sb11"]


def exams(spark, folder):
    """Orders and their lines over three years, some without a date."""
    lines = "id AS l_orderkey, CAST(1 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, CAST(id * 10 AS DOUBLE) AS l_extendedprice"
    date = "IF(id % 10 = 9, NULL, make_timestamp(1996 + CAST(id % 3 AS INT), 12, 31, 23, 59, 59))"
    spark.range(60).selectExpr(*lines.split(", ", 3), f"{date} AS l_shipdate", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus", "'A' AS l_returnflag").write.parquet(f"{folder}/lineitem.parquet")
    orders = ["id AS o_orderkey", "id AS o_custkey", f"{date} AS o_orderdate", "'F' AS o_orderstatus", "CAST(id * id AS DOUBLE) AS o_totalprice", "'5-LOW' AS o_orderpriority"]
    spark.range(60).selectExpr(*orders).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_paired_rows_read_each_table_once_whatever_the_years(spark, tmp_path):
    folder = exams(spark, tmp_path)
    paired_rows = star_profiles.exam_pairs(spark, folder)
    assert plan(paired_rows).count("FileScan") == 3 and "Union" not in plan(paired_rows)  # lines, links and orders
    assert rows(paired_rows.groupBy("anio").count(), "anio") == [(1996, 18), (1997, 18), (1998, 18), (None, 6)]
    found = {r["label"]: r for r in records(star_profiles.paired_profile_correlations(spark, folder))}
    assert found["Puntaje Global"]["n"] == 60 and found["Puntaje Global"]["spearman"] == 1.0


def test_a_year_that_lacks_a_column_is_one_more_table(spark, tmp_path):
    folder = exams(spark, tmp_path)
    members = conform.union_years(star_profiles.school_tables(spark, folder), schemas.SCHOOL_EXAM, year="anio_cohorte")
    assert plan(members).count("FileScan") == 2
    areas = members.groupBy("anio_cohorte").agg(F.count(F.lit(1)), F.count("cole_area_ubicacion"))
    assert rows(areas, "anio_cohorte") == [(1996, 18, 18), (1997, 18, 0), (1998, 18, 18), (None, 6, 6)]
    years = conform.union_years({1996: members.drop("anio_cohorte")}, schemas.SCHOOL_EXAM, year="anio_cohorte")
    assert years.columns == members.columns
