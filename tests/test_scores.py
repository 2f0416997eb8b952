"""Ranks, quantiles, correlations, histograms and prediction quality against pandas and NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import histogram, ordering, paired, prediction
from tests.conftest import records, rows


@pytest.fixture(scope="module")
def frame():
    """Tied, skewed and missing values; a third of x has one value."""
    rng = np.random.default_rng(3)
    n = 3000
    x = np.round(rng.normal(50, 10, n), 1)
    x[: n // 3] = 47.0
    y = np.round(x * 0.4 + rng.normal(0, 8, n), 2)
    pdf = pd.DataFrame({"x": x, "y": y, "z": np.round(rng.exponential(3, n), 3), "year": rng.integers(2016, 2020, n)})
    pdf.loc[::17, "x"] = np.nan
    pdf.loc[::23, "y"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    """The same rows; missing as NULL, but for some NaN that must count as missing too."""
    sdf = spark.createDataFrame(frame)
    return sdf.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(6).cache()


@pytest.mark.parametrize("ranges", [2, 7, 40])
def test_average_rank(df, frame, ranges):
    found = {r["x"]: r["rank"] for r in records(ordering.average_rank(df, "x", ranges=ranges))}
    expected = dict(zip(frame["x"].dropna(), frame["x"].dropna().rank(), strict=True))
    assert found == expected


@pytest.mark.parametrize("cuts", [[], [1.0], [-5.0, 0.5, 2.0, 99.0]])
def test_any_edges_give_the_same_ranks(df, monkeypatch, cuts):
    expected = rows(ordering.average_rank(df, "z"))
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    monkeypatch.setattr(ordering, "range_edges", lambda rows, *rest: rows.groupBy().agg(edges.alias("_edges")))
    assert rows(ordering.average_rank(df, "z")) == expected


def test_grouped_cumulative_counts(df, frame):
    found = records(ordering.cumulative_counts(df, "z", ["year"]))
    for r in found[::50]:
        group = frame[frame["year"] == r["year"]]["z"]
        assert (r["before"], r["n"], r["total"]) == ((group < r["z"]).sum(), (group == r["z"]).sum(), len(group))
    assert sum(r["n"] for r in found) == len(frame)


def test_weighted_counts(spark):
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (1.0, 2), (None, 9)], "v double, w bigint")
    assert rows(ordering.cumulative_counts(weighted, "v", weight="w")) == [(1.0, 5, 0, 6), (2.0, 1, 5, 6)]


@pytest.mark.parametrize("n", [4, 5, 7, 10])
def test_quantiles_interpolate_like_numpy(df, frame, n):
    found = [r["edge"] for r in sorted(records(ordering.quantiles(df, "y", n)), key=lambda r: r["q"])]
    expected = np.percentile(frame["y"].dropna(), np.linspace(0, 100, n + 1))
    assert found == pytest.approx(expected, abs=1e-9)


def test_quantiles_of_few_rows(spark):
    few = spark.createDataFrame([(3.0,), (1.0,)], "v double")
    assert [r["edge"] for r in sorted(records(ordering.quantiles(few, "v", 2)), key=lambda r: r["q"])] == [1.0, 2.0, 3.0]
    assert ordering.quantiles(few.limit(0), "v", 2).count() == 0


PAIRS = {"XY": ("y", "x"), "ZX": ("x", "z")}


def test_correlations(df, frame):
    found = {r["label"]: r for r in records(paired.correlations(df, PAIRS))}
    for label, (y, x) in PAIRS.items():
        both = frame[[x, y]].dropna()
        assert found[label]["n"] == len(both)
        assert found[label]["pearson"] == pytest.approx(both[x].corr(both[y]), abs=1e-9)
        assert found[label]["spearman"] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-9)


def test_correlation_of_one_pair_and_of_a_constant(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    row = records(paired.correlations(one, {"p": ("y", "x")}))[0]
    assert (row["n"], row["pearson"], row["spearman"]) == (1, None, None)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = records(paired.correlations(flat, {"p": ("y", "x")}))[0]
    assert (row["n"], row["pearson"], row["spearman"]) == (2, None, None)
    empty = records(paired.correlations(one.limit(0), {"p": ("y", "x")}))[0]
    assert (empty["n"], empty["pearson"], empty["spearman"]) == (0, None, None)


def test_quintile_transition(df, frame):
    both = frame[["z", "y"]].dropna()
    expected = pd.crosstab(pd.qcut(both["z"], 5, labels=False) + 1, pd.qcut(both["y"], 5, labels=False) + 1, normalize="index") * 100
    found = {(r["from_bin"], r["to_bin"]): r["pct"] for r in records(paired.quantile_transition(df, "z", "y", 5))}
    assert len(found) == 25
    for (a, b), pct in found.items():
        assert pct == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_quintiles_with_repeated_edges_have_fewer_bins(df, spark):
    tied = spark.range(3000).select((F.col("id") % 3).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    cells = records(paired.quantile_transition(tied, "x", "y", 5))
    assert {(r["from_bins"], r["to_bins"]) for r in cells} == {(2, 5)} and len(cells) == 10
    assert sum(r["n"] for r in cells) == 3000
    few = spark.createDataFrame([(float(i), 1.0) for i in range(4)], "x double, y double")
    cells = records(paired.quantile_transition(few, "x", "y", 5))
    assert sum(r["n"] for r in cells) == 4 and {(r["from_bins"], r["to_bins"]) for r in cells} == {(5, 1)}
    assert paired.quantile_transition(few.limit(0), "x", "y", 5).count() == 0
    enough = spark.createDataFrame([(float(i), float(-i)) for i in range(5)], "x double, y double")
    cells = paired.quantile_transition(enough, "x", "y", 5)
    assert rows(cells.filter("n > 0").select("from_bin", "to_bin")) == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_paired_means(df, frame):
    found = {r["year"]: (r["x_mean"], r["y_mean"]) for r in records(paired.paired_trend(df, "year", "x", "y"))}
    expected = frame.groupby("year")[["x", "y"]].mean()
    assert found == {y: pytest.approx((r["x"], r["y"])) for y, r in expected.iterrows()}
    assert paired.paired_trends(df, "year", PAIRS).count() == 8


def test_contribution(spark):
    data = [(2016, 0.5, 0.4, None, 0.1), (2016, 0.7, None, 0.3, 0.2), (2017, 0.6, 0.5, 0.9, 0.3), (None, 1.0, 0.0, 1.0, 0.0)]
    frame = spark.createDataFrame(data, "anio int, g double, g0 double, c double, c0 double")
    pairs = {"Global": ("g", "g0"), "C": ("c", "c0")}
    matrix = {r["anio"]: (r["Global"], r["C"]) for r in records(paired.contribution_matrix(frame, "anio", pairs, {"Global": "c0"}))}
    assert matrix[2016] == pytest.approx(((0.6 - 0.3) * 100, 10.0)) and matrix[2017] == pytest.approx((10.0, 60.0))
    long = paired.contribution(frame, "anio", pairs, {"Global": "c0"})
    kpi = records(paired.contribution_kpis(long, "anio", ["Global"], "Global"))[0]
    assert (kpi["best_year"], kpi["best_label"]) == (2016, "C")
    assert kpi["main_mean"] == pytest.approx(20.0) and kpi["best_label_mean"] == pytest.approx(35.0)


def test_delta(df, frame):
    both = frame[["x", "y"]].dropna()
    row = records(paired.delta_summary(df.withColumn("y", F.when(~F.isnan("y"), F.col("y"))), "x", "y"))[0]
    assert row["n"] == len(both) and row["mean"] == pytest.approx((both["y"] - both["x"]).mean())


@pytest.mark.parametrize(("column", "bins"), [("x", 40), ("y", 35), ("z", 60), ("year", 3)])
def test_histogram_counts_like_numpy(df, frame, column, bins):
    found = sorted(records(histogram.histogram(df, column, bins)), key=lambda r: r["bin"])
    counts, edges = np.histogram(frame[column].dropna(), bins=bins)
    assert [r["n"] for r in found] == list(counts)
    assert [r["low"] for r in found] == pytest.approx(edges[:-1])


def test_histogram_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    found = sorted(records(histogram.histogram(one, "v", 4)), key=lambda r: r["bin"])
    assert [r["n"] for r in found] == list(np.histogram([2.0, 2.0], bins=4)[0])
    assert histogram.histogram(one.filter("v IS NULL"), "v", 4).count() == 0


def test_density_counts_like_numpy(df, frame):
    both = frame[["z", "y"]].dropna()
    expected, _, _ = np.histogram2d(both["z"], both["y"], bins=45)
    found = {(r["x_bin"], r["y_bin"]): r["n"] for r in records(histogram.density2d(df, "z", "y", 45))}
    assert sum(found.values()) == len(both)
    assert found == {(i, j): int(expected[i, j]) for i, j in zip(*np.nonzero(expected), strict=True)}


def test_banded_histogram(df, frame):
    found = records(histogram.banded_histogram(df, "x", 40, (0.0, 41.1, 100.1), ("low", "high"), (0.0, 100.0)))
    known = frame["x"].dropna()
    assert sum(r["n"] for r in found if r["band"] == "low") == (known < 41.1).sum()
    assert sum(r["n"] for r in found) == len(known)


def test_histogram_summary(spark):
    hist = spark.createDataFrame([(0, 0.0, 1.0, 2), (1, 1.0, 2.0, 5), (2, 2.0, 3.0, 5)], "bin int, low double, high double, n bigint")
    row = records(histogram.histogram_summary(hist))[0]
    assert (row["cases"], row["peak"], row["first"], row["last"]) == (12, 1.5, 0.5, 2.5)


@pytest.fixture(scope="module")
def predicted(spark):
    rng = np.random.default_rng(5)
    real = rng.normal(0.5, 0.1, 2000)
    pred = 0.5 * real + 0.25 + rng.normal(0, 0.05, 2000)
    real[0], pred[0] = 0.95, 0.1
    pdf = pd.DataFrame({"id": range(2000), "real": real, "pred": pred})
    return pdf, spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(9999, 0.5, None)], "id bigint, real double, pred double"))


def test_error_metrics(predicted):
    pdf, sdf = predicted
    e = pdf["real"] - pdf["pred"]
    row = records(prediction.error_metrics(sdf, "real", "pred"))[0]
    assert row["n"] == 2000
    assert row["mae"] == pytest.approx(e.abs().mean()) and row["mse"] == pytest.approx((e**2).mean())
    assert row["rmse"] == pytest.approx(math.sqrt((e**2).mean())) and row["bias"] == pytest.approx(e.mean())
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((pdf["real"] - pdf["real"].mean()) ** 2).sum())


def test_r2_of_a_constant_is_missing(spark):
    flat = spark.createDataFrame([(1.0, 0.5), (1.0, 2.0)], "real double, pred double")
    assert records(prediction.error_metrics(flat, "real", "pred"))[0]["r2"] is None
    assert prediction.error_metrics(flat.limit(0), "real", "pred").count() == 0


def test_sigma_bands(predicted):
    pdf, sdf = predicted
    e = (pdf["real"] - pdf["pred"]).to_numpy()
    mu, sigma = e.mean(), e.std(ddof=1)
    row = records(prediction.sigma_stats(sdf, "real", "pred"))[0]
    assert row["mu"] == pytest.approx(mu) and row["sigma"] == pytest.approx(sigma)
    assert row["outliers"] == (np.abs(e - mu) > 3 * sigma).sum() >= 1
    assert row["high_2"] == pytest.approx(mu + 2 * sigma)


def test_ellipse_and_classes(predicted):
    pdf, sdf = predicted
    points = pdf[["real", "pred"]].to_numpy()
    cov = np.cov(points.T)
    c2 = -2 * math.log(0.05)
    axes = records(prediction.ellipse_axes(sdf, "real", "pred", 0.95))[0]
    low, high = np.linalg.eigvalsh(cov)
    assert (axes["major"], axes["minor"]) == pytest.approx((math.sqrt(c2 * high), math.sqrt(c2 * low)))
    centred = points - points.mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
    found = {r["id"]: r for r in records(prediction.classify_points(sdf, "real", "pred", 0.95))}
    assert len(found) == 2000
    assert {i for i, r in found.items() if r["ellipse_outlier"]} == set(np.nonzero(d2 > c2)[0])
    assert found[0]["point_class"] == "both"
    counts = dict(rows(prediction.point_classes(sdf, "real", "pred", 0.95)))
    assert sum(counts.values()) == 2000
    boundary = np.array([(r["x"], r["y"]) for r in records(prediction.ellipse(sdf, "real", "pred", 0.95))]) - points.mean(axis=0)
    assert len(boundary) == 360
    assert np.einsum("ij,jk,ik->i", boundary, np.linalg.inv(cov), boundary) == pytest.approx(np.full(360, c2))


def test_one_row_has_no_spread(spark):
    one = spark.createDataFrame([(1, 1.0, 0.5)], "id int, real double, pred double")
    row = records(prediction.sigma_stats(one, "real", "pred"))[0]
    assert (row["n"], row["mu"], row["sigma"], row["outliers"]) == (1, 0.5, None, 0)
    assert records(prediction.point_classes(one, "real", "pred"))[0]["point_class"] == "normal"


def test_points_on_a_line_are_never_outside(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "real double, pred double")
    assert prediction.classify_points(line, "real", "pred").filter("ellipse_outlier").count() == 0


def test_three_rows_have_no_ellipse(spark):
    three = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 5.0, 9.0)], "id int, real double, pred double")
    assert prediction.ellipse(three, "real", "pred").count() == 0
    assert rows(prediction.classify_points(three, "real", "pred").select("ellipse_outlier").distinct()) == [(False,)]


def test_sample_is_repeatable_and_whole_when_small(predicted):
    _, sdf = predicted
    first = rows(prediction.sample_points(sdf, ["id"], 100))
    assert len(first) == 100 and first == rows(prediction.sample_points(sdf.repartition(7), ["id"], 100))
    assert first != rows(prediction.sample_points(sdf, ["id"], 100, seed=1))
    assert prediction.sample_points(sdf, ["id"], 6000).count() == 2001


def test_modules_and_forms(spark):
    data = [(1, "test", 0.5, 0.4, 0.2, None), (1, "test", 0.6, 0.6, 0.3, 0.1), (2, "test", 0.5, 0.1, 0.2, 0.2)]
    frame = spark.createDataFrame(data, "forma int, split string, a_real double, a_pred double, b_real double, b_pred double")
    modules = prediction.module_columns(frame, ["a", "b", "c"])
    assert list(modules) == ["a", "b"]
    found = {r["module"]: r for r in records(prediction.error_metrics_by_module(frame.filter("forma = 1"), modules))}
    assert (found["a"]["n"], found["b"]["n"]) == (2, 1) and found["a"]["mae"] == 0.05
    table = {r["module"]: (r["1"], r["2"]) for r in records(prediction.metrics_by_form(frame, modules, "forma", [1, 2], "mae", 4))}
    assert table == {"a": (0.05, 0.4), "b": (0.2, 0.0)}


def test_global_column_gets_its_name(spark):
    frame = spark.createDataFrame([(1.0,)], "punt_global_calc_norm double")
    assert prediction.canonical_global(frame).columns == ["global_real"]
    assert prediction.canonical_global(frame.toDF("global_real")).columns == ["global_real"]
    assert prediction.canonical_global(frame.toDF("x")).columns == ["x"]


def test_stored_metrics_win(spark):
    stored = spark.createDataFrame([("f1", "a", 0.1, None)], "form string, module string, mae double, mse double")
    computed = spark.createDataFrame([("f1", "a", 0.5, 0.25), ("f1", "global", 0.2, 0.04)], "form string, module string, mae double, mse double")
    found = prediction.stored_or_computed(stored, computed, ["form", "module"])
    assert rows(found) == [("f1", "a", 0.1, 0.25), ("f1", "global", 0.2, 0.04)]


def test_chosen_k(spark):
    sweep = [("forma1", 8, 0.0649), ("forma1", 256, 0.0616), ("forma1", 128, 0.0620), ("forma2", 16, 0.07), ("forma2", 8, 0.07)]
    found = prediction.choose_k(spark.createDataFrame(sweep, "form string, k int, mae_val double"))
    assert rows(found.filter("chosen").select("form", "k")) == [("forma1", 256), ("forma2", 8)]
