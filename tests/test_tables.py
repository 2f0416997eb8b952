"""Frequency tables, filters, cross-tables, rankings, places and summaries."""

import pytest
from pyspark.sql import functions as F

from cohortia.operators import crosstab, filters, frequency, geo, ranking, summary, trend
from cohortia.plans import constants as fixed
from tests.conftest import records, rows


@pytest.fixture
def answers(spark):
    data = [(" a ", "x"), ("a", None), ("b", "x"), ("", "y"), (None, "y"), ("b", "z"), ("c", " ")]
    return spark.createDataFrame(data, "f string, g string")


def test_frequency(answers):
    assert [tuple(r) for r in frequency.ordered(frequency.frequency(answers, "f")).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in frequency.frequency(answers, "f", 2).collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in frequency.frequency(answers, "f", 1, "key").collect()] == [("a", 2)]
    assert [r[0] for r in frequency.ordered(frequency.frequency(answers, "f"), ascending=True).collect()] == ["c", "a", "b"]


def test_frequency_of_many_columns(answers):
    assert rows(frequency.frequency_many(answers, ["f", "g"])) == [("f", "a", 2), ("f", "b", 2), ("f", "c", 1), ("g", "x", 2), ("g", "y", 2), ("g", "z", 1)]
    assert rows(frequency.frequency_many(answers, ["f", "g"], top=1)) == [("f", "a", 2), ("g", "x", 2)]
    assert frequency.frequency_many(answers, ["f"], by=["g"]).columns == ["g", "field", "value", "n"]


@pytest.fixture
def institutions(spark):
    names = [(f"U{i:02d}", 50 - i) for i in range(25)] + [("The Pinned One", 3), ("pinned other", 1)]
    return spark.createDataFrame(names, "name string, n int").select("name", F.explode(F.sequence(F.lit(1), "n")))


def test_pinned_outside_the_top(institutions):
    found = frequency.top_pinned(institutions, "name", 20, "pinned")
    assert found.count() == 21
    assert rows(found.filter("pinned")) == [("THE PINNED ONE", 3, True)]


def test_pinned_inside_the_top(institutions):
    found = frequency.top_pinned(institutions, "name", 20, "u07")
    assert found.count() == 20 and found.filter("pinned").count() == 0


def test_pinned_absent(institutions):
    assert frequency.top_pinned(institutions, "name", 5, "nowhere").count() == 5


def test_tie_at_the_last_rank_goes_by_value(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert [r[0] for r in frequency.frequency(frame, "v", 2).collect()] == ["a", "b"]


def test_codes_domestic_and_classes(spark):
    codes = spark.createDataFrame([("3.0",), ("3",), ("NSE",), (None,)], "c string")
    assert rows(frequency.code_totals(codes, "c")) == [("3", 2), ("NSE", 1)]
    home = spark.createDataFrame([("colombia",), (None,), ("PERU",), ("PERU",), ("CHILE",)], "c string")
    assert rows(frequency.domestic_split(home, "c", "COLOMBIA")) == [(2, 3)]
    assert [tuple(r) for r in frequency.domestic_and_foreign(home, "c", "COLOMBIA", 1).collect()] == [("COLOMBIA", 2), ("PERU", 2)]
    origin = spark.createDataFrame([("OFICIAL NACIONAL",), ("otro",)], "o string")
    assert rows(frequency.class_totals(origin, "o", fixed.ORIGIN_TYPES)) == [("Pública", 1)]


def test_score_summaries(spark):
    scores = spark.createDataFrame([("1", 2.0, "a"), ("bad", 4.0, "a"), ("3", None, "b")], "t string, d double, g string")
    assert rows(frequency.score_stats(scores, ["t", "d"], 1)) == [("d", 2.0, 4.0, 3.0), ("t", 1.0, 3.0, 2.0)]
    assert rows(frequency.mean_profile(scores, {"d": "D"}, 2)) == [("D", 3.0)]
    assert rows(frequency.group_mean(scores, "g", "d")) == [("a", 3.0), ("b", None)]
    assert rows(frequency.top_mean(scores, "g", "d", 5)) == [("a", 3.0)]
    assert rows(frequency.distinct_counts(scores, ["t", "g"])) == [("g", 2), ("t", 3)]
    assert rows(frequency.distinct_counts_approx(scores, ["g"])) == [("g", 2)]


def test_filters(spark):
    data = [(2015, " BOG ", "UNI TOKEN-CALI", "Sí", "oficial nacional"), (2016, "BOG", "OTHER", "no", "x"), (2015, "CALI", "TOKEN", None, None)]
    frame = spark.createDataFrame(data, "anio int, depto string, inst string, pago string, origen string")

    def count(**kw):
        return filters.apply_filters(frame, **kw).count()

    assert count() == 3
    assert count(equals={"anio": 2015, "absent": 1, "depto": None}) == 2
    assert count(trimmed={"depto": "BOG"}) == 2 and count(equals={"depto": "BOG"}) == 1
    assert count(isin={"anio": [2016], "depto": []}) == 1
    assert count(token=("inst", "token")) == 2
    assert count(campus_of=("inst", "token", "CALI")) == 1
    assert count(flag="pago", truth=fixed.TRUTH_LONG) == 1
    assert count(sets=("origen", fixed.ORIGIN_TYPES["Pública"])) == 1
    assert count(equals={"anio": 2015}, token=("inst", "token"), flag="pago", truth=fixed.TRUTH_LONG) == 1


def test_prediction_slice(spark):
    frame = spark.createDataFrame([(1, "media", "test", "A"), (1, "media", "val", "B"), (2, "media", "test", "A")], "forma int, metodo string, split string, inst_nombre_institucion_sbpro string")
    assert filters.prediction_slice(frame, 1, "media", "todos", "__TODAS__").count() == 2
    assert filters.prediction_slice(frame, 1, "media", "test", "A").count() == 1


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("anio", F.col("id")).write.parquet(str(tmp_path / "t"))
    filtered = filters.apply_filters(spark.read.parquet(str(tmp_path / "t")), equals={"anio": 3})
    assert "EqualTo(anio,3)" in filtered._jdf.queryExecution().executedPlan().toString()


def test_levels_pairs_and_ranges(spark, answers):
    assert filters.keep_levels(answers, {"f": ["a"], "g": ["x"]}).count() == 1
    assert filters.complete_pairs(answers, "f", "g").count() == 5
    assert filters.between(spark.range(10), "id", 2, 4).count() == 3


def test_choices(answers):
    offered = filters.options(answers, "f")
    assert [r[0] for r in offered.collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in filters.valid_choices(["c", "zz", "a", "b"], offered, 2).collect()] == [("c", 1), ("a", 3)]


def test_campus_choices(spark):
    frame = spark.createDataFrame([("TOKEN-B",), ("TOKEN-A",), ("TOKEN",), ("X-C",), (None,)], "n string")
    assert [r[0] for r in filters.campus_options(frame, "n", "token").collect()] == ["A", "B", "SIN SEDE"]


def test_transition_table_is_dense(spark):
    data = [(" A-", "-A1")] * 3 + [("A-", "A1"), ("B+", "B2"), ("B+", "??"), (None, "A1")]
    frame = spark.createDataFrame(data, "s string, d string")
    found = crosstab.transition(frame, "s", "d", fixed.ENGLISH_SCHOOL, fixed.ENGLISH_DEGREE)
    cells = {(r["from_level"], r["to_level"]): (r["n"], r["pct"]) for r in records(found)}
    assert len(cells) == 25
    assert cells["A-", "-A1"] == (3, 75.0) and cells["A-", "A1"] == (1, 25.0) and cells["B+", "B2"] == (1, 100.0)
    assert cells["A1", "A1"] == (0, 0.0)


def test_conditional_share(spark):
    data = [("P", "M", "1")] * 3 + [("P", "M", "2")] * 3 + [("P", "X", "3"), ("P", "M", None)]
    frame = spark.createDataFrame(data, "padre string, madre string, estrato string")
    found = rows(crosstab.conditional_share(frame, "estrato", {"padre": "P", "madre": "M"}))
    assert found == [("1", 3, 50.0, True), ("2", 3, 50.0, False)]
    assert crosstab.conditional_share(frame, "estrato", {"padre": "none"}).count() == 0
    with pytest.raises(ValueError):
        crosstab.conditional_share(frame, "estrato", {"padre": None})


def test_flags(spark):
    data = [(True, True, "1"), (True, False, "1"), (None, True, None)]
    frame = spark.createDataFrame(data, "a boolean, b boolean, e string")
    labels = {"a": "A", "b": "B"}
    assert rows(crosstab.flag_totals(frame, labels)) == [("A", 2), ("B", 2)]
    pairs = {(r[0], r[1]): r[2] for r in rows(crosstab.flag_cooccurrence(frame, labels))}
    assert pairs == {("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 2}
    assert rows(crosstab.flag_by_group(frame, "e", labels)) == [("1", 2, 1), ("No reporta", 0, 1)]


@pytest.fixture
def scores(spark):
    data = [("A", 0.5, 0.4), ("A", 0.7, None), ("B", 0.6, 0.9), ("C", None, 0.1), ("D", None, None), (None, 1.0, 1.0)]
    return spark.createDataFrame(data, "inst string, g double, c double")


def test_ranking(scores):
    means = ranking.group_means(scores, "inst", ["g", "c"])
    assert {r[0] for r in rows(means)} == {"A", "B", "C"}
    assert rows(ranking.ranking(means, "inst", "g", 20)) == [(1, "A", 0.6), (2, "B", 0.6)]
    assert rows(ranking.best(means, "inst", ["g", "c"])) == [("c", "B", 0.9), ("g", "A", 0.6)]


def test_comparison_of_selected(scores):
    matrix = ranking.compare_groups(scores, "inst", ["B", "Z", "A"], ["g", "c"])
    assert rows(matrix, "position") == [(1, "B", 0.6, 0.9), (2, "Z", None, None), (3, "A", 0.6, 0.4)]
    pairs = rows(ranking.pair_compare(matrix, "inst", {"g": "G"}))
    assert [(a, b) for a, b, *_ in pairs] == [("B", "A"), ("B", "Z"), ("Z", "A")]
    assert rows(ranking.spread(matrix, "c")) == [(0.4, 0.9, 0.5)]
    marked = {(r["inst"], r["score"]): (r["is_best"], r["is_worst"]) for r in records(ranking.mark_extremes(matrix, "inst", ["g", "c"]))}
    assert marked["B", "c"] == (True, False) and marked["A", "c"] == (False, True)
    assert marked["A", "g"] == (True, False) and marked["Z", "g"] == (False, False)
    facts = records(summary.comparison_facts(ranking.mark_extremes(matrix, "inst", ["g", "c"]), "inst", "g"))[0]
    assert (facts["best_key"], facts["best_score"], facts["spread"]) == ("A", "c", 0.0)


def test_at_most_four_are_compared(scores):
    assert ranking.compare_groups(scores, "inst", list("ABCDEF"), ["g"]).count() == 6


def test_places_meet_without_accents(spark):
    counts = spark.createDataFrame([("bogota", 3), ("Bogotá", 2), ("Atlantis", 1)], "value string, n bigint")
    towns = geo.coordinates(spark, fixed.TOWN_COORDINATES)
    assert rows(geo.match_places(counts, towns, "name", ["lat"])) == [("Bogotá", 2, "BOGOTÁ", 4.711), ("bogota", 3, "BOGOTÁ", 4.711)]
    assert rows(geo.match_places(counts, towns, "name", exact=True)) == []


def test_trend(spark):
    line = spark.createDataFrame([(2010, 1.0), (2011, 3.0), (2012, 5.0)], "x int, y double")
    assert rows(trend.linear_trend(line, "x", "y").select("x", F.round("fitted", 6), F.round("slope", 6), "r2")) == [(2010, 1.0, 2.0, 1.0), (2011, 3.0, 2.0, 1.0), (2012, 5.0, 2.0, 1.0)]
    kpi = records(trend.trend_kpi(line, "x", "y"))[0]
    assert (kpi["trend"], kpi["first_x"], kpi["last_x"], kpi["total_change"]) == ("up", 2010, 2012, 4.0)
    assert rows(trend.year_change(line, "x", "y")) == [(2011, 2.0), (2012, 2.0)]
    end = records(trend.first_last(line, "x", "y"))[0]
    assert (end["first_y"], end["last_y"], end["direction"]) == (1.0, 5.0, "up")


def test_trend_of_one_point_and_of_a_constant(spark):
    one = spark.createDataFrame([(2010, 1.0)], "x int, y double")
    assert rows(trend.linear_fit(one, "x", "y")) == [(1, None, None, None)]
    assert trend.trend_kpi(one, "x", "y").count() == 0
    flat = spark.createDataFrame([(2010, 1.0), (2011, 1.0)], "x int, y double")
    fit = records(trend.linear_fit(flat, "x", "y"))[0]
    assert (fit["slope"], fit["r2"]) == (0.0, 1.0)


def test_trend_of_a_constant_x(spark):
    same = spark.createDataFrame([(2010, 1.0), (2010, 2.0)], "x int, y double")
    assert records(trend.linear_fit(same, "x", "y"))[0]["slope"] is None


def test_shares_sum_to_100(spark):
    frame = spark.createDataFrame([(2010, 30, 70), (2011, 0, 0)], "x int, a int, b int")
    found = rows(trend.stacked_share(frame, "x", ["a", "b"]))
    assert found == [(2010, "a", 30.0), (2010, "b", 70.0), (2011, "a", None), (2011, "b", None)]


def test_series_facts(spark):
    frame = spark.createDataFrame([("a", 2), ("b", 5), ("c", 5), ("d", None)], "i string, n bigint")
    row = records(summary.series_summary(frame, "i", "n"))[0]
    assert (row["total"], row["mean"], row["max_item"], row["min_item"]) == (12, 4.0, "b", "a")
    share = records(summary.share_summary(frame, "i", "n"))[0]
    assert (share["categories"], share["max_item"]) == (3, "b") and share["max_share"] == pytest.approx(500 / 12)


def test_series_comparison(spark):
    frame = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 3.99)], "s string, v double")
    total = records(summary.compare_series(frame, "s", "v"))[0]
    assert (total["max_series"], total["similar"]) == ("s", True)
    mean = records(summary.compare_series(frame, "s", "v", averaged=True))[0]
    assert (mean["max_series"], mean["min_series"], mean["similar"]) == ("t", "s", False)


def test_matrix_extremes(spark):
    frame = spark.createDataFrame([("r1", "c1", -2.0), ("r1", "c2", 3.0), ("r2", "c1", 3.0), ("r2", "c2", None)], "r string, c string, v double")
    row = records(summary.matrix_extrema(frame, "r", "c", "v"))[0]
    assert (row["max_row"], row["max_col"], row["min_row"], row["min_col"], row["is_signed"]) == ("r1", "c2", "r1", "c1", True)


def test_indicators(spark):
    metrics = spark.createDataFrame([(0.5, None)], "mae double, r2 double")
    found = summary.kpi_long([summary.indicators(metrics, "rna", {"kpi_mae=mae": "MAE", "kpi_n=r2": "n"})], fixed.ESTIMATOR_KEYS)
    assert rows(found) == [("rna", "kpi_mae", "kpi", "MAE", "0.5", "estimator"), ("rna", "kpi_n", "kpi", "n", "—", "indicator")]
