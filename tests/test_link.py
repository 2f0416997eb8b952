"""Linking: funnel, unlinked rows, arrivals, pairs and balanced joins."""

import pytest
from pyspark.sql import functions as F

from cohortia.operators import conform, link
from cohortia.plans import constants as fixed
from tests.conftest import records, rows


@pytest.fixture
def members(spark):
    data = [("a", 2010, "E1"), ("b", 2010, None), ("c", 2010, "E2"), ("d", 2011, "E1"), (None, 2011, "E3")]
    return spark.createDataFrame(data, "key string, cohort int, stratum string")


@pytest.fixture
def links(spark):
    # a has two links, z is on this side only, one key is NULL
    data = [("a", "p1"), ("a", "p2"), ("d", "p3"), ("z", "p4"), (None, "p5")]
    return spark.createDataFrame(data, "sb11 string, sbpro string")


def test_funnel_counts_members_once(members, links):
    found = {r["cohort"]: r for r in records(link.cohort_funnel(members, links, "cohort", "key", "sb11"))}
    assert (found[2010]["total"], found[2010]["linked"], found[2010]["unlinked"]) == (3, 1, 2)
    assert (found[2010]["linked_rate"], found[2010]["unlinked_rate"]) == (33.33, 66.67)
    assert (found[2011]["total"], found[2011]["linked"]) == (2, 1)


def test_funnel_with_fan_out(members, links):
    funnel = link.cohort_funnel(members, links, "cohort", "key", "sb11", distinct=False)
    assert {r["cohort"]: r["linked"] for r in records(funnel)} == {2010: 2, 2011: 1}


def test_funnel_total_and_empty(spark, members, links):
    total = records(link.funnel_total(link.cohort_funnel(members, links, "cohort", "key", "sb11")))[0]
    assert (total["total"], total["linked"], total["linked_rate"]) == (5, 2, 40.0)
    nobody = records(link.funnel_total(link.cohort_funnel(members.limit(0), links, "cohort", "key", "sb11")))[0]
    assert (nobody["total"], nobody["linked_rate"]) == (0, 0.0)


def test_linked_and_unlinked_split_the_members(members, links):
    without = link.unlinked(members, links, "key", "sb11")
    assert rows(without.select("key", "cohort")) == rows(members.filter("key IS NULL OR key IN ('b', 'c')").select("key", "cohort"))
    assert without.columns == members.columns
    assert rows(link.linked(members, links, "key", "sb11").select("key")) == [("a",), ("d",)]


def test_funnel_of_counts(members):
    row = records(link.funnel_of_counts(members, members.filter("cohort = 2011")))[0]
    assert (row["total"], row["linked"], row["unlinked"], row["unlinked_rate"]) == (5, 3, 2, 40.0)


@pytest.fixture
def arrivals(spark, members, links):
    events = spark.createDataFrame(
        [("p1", "20151", "LAW"), ("p1", "20151", ""), ("p2", "20152", "LAW"), ("p3", "20181", None), ("p9", "20151", "LAW"), ("p2", None, "LAW")],
        "id string, periodo string, grp string",
    )
    return link.arrival_counts(members, links, events, "cohort", "key", "sb11", "sbpro", "id", "periodo", "grp", fixed.NO_GROUP)


def test_arrival_counts(arrivals):
    assert rows(arrivals.select("cohort", "group", "period", "n")) == [
        (2010, "(sin grupo)", "20151", 1),
        (2010, "LAW", "20151", 1),
        (2010, "LAW", "20152", 1),
        (2011, "(sin grupo)", "20181", 1),
    ]


def test_arrival_counts_multiply_repeated_rows(spark):
    twice = spark.createDataFrame([("a", 2010), ("a", 2010)], "key string, cohort int")
    links = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "q")], "sb11 string, sbpro string")
    events = spark.createDataFrame([("p", "20151")] * 3 + [("q", "20151")], "id string, periodo string")
    found = link.arrival_counts(twice, links, events, "cohort", "key", "sb11", "sbpro", "id", "periodo")
    plain = (
        twice.join(links, twice["key"] == links["sb11"]).join(events, links["sbpro"] == events["id"]).count()
    )
    assert [r["n"] for r in records(found)] == [plain] == [14]


def test_arrivals_collapse(arrivals):
    assert rows(link.collapse_arrivals(arrivals, ["cohort"])) == [(2010, 3), (2011, 1)]
    levels = rows(link.arrival_levels(arrivals).groupBy("level").agg(F.sum("n")))
    assert levels == [(0, 4), (1, 4), (2, 4)]


def test_arrival_timing(spark):
    data = [(2010, "20142", 3), (2010, "20151", 4), (2010, "20152", 1), (2010, "20161", 2), (2010, "bad", 9)]
    arrivals = spark.createDataFrame(data, "cohort int, period string, n bigint")
    row = records(link.arrival_timing(arrivals, 10))[0]
    assert (row["total"], row["early_count"], row["on_time_count"], row["late_count"]) == (10, 3, 5, 2)
    assert (row["early_pct"], row["on_time_pct"], row["late_pct"]) == (30.0, 50.0, 20.0)
    assert (row["early_avg_dev"], row["late_avg_dev"]) == (-1.0, 2.0)
    assert row["avg_dev"] == pytest.approx((-3 + 0 + 1 + 4) / 10)
    assert link.arrival_timing(arrivals.filter("period = 'bad'"), 10).count() == 0


def test_standard_of_a_group(spark):
    groups = spark.createDataFrame([("DERECHO",), ("ECONOMÍA",), ("?",), (None,)], "g string")
    found = {r["g"]: (r["standard_years"], r["standard_semesters"]) for r in records(link.with_standard(groups, "g", fixed.GROUP_STANDARDS))}
    assert found == {"DERECHO": (5.0, 10), "ECONOMÍA": (4.5, 9), "?": (5.0, 10), None: (5.0, 10)}
    assert len(fixed.GROUP_STANDARDS) == 20


def test_arrivals_by_year_and_deviation(spark):
    arrivals = spark.createDataFrame([(2010, "20142", 3), (2010, "20151", 4), (2011, "20151", 1)], "cohort int, period string, n bigint")
    assert rows(link.arrival_by_year(arrivals)) == [(2014, 3), (2015, 5)]
    assert rows(link.arrival_by_year(arrivals, 4.5)) == [(2010, 2014, 3, "standard"), (2010, 2015, 4, "standard"), (2011, 2015, 1, "standard")]
    assert rows(link.arrival_by_deviation(arrivals, 10), "deviation") == [(-2, 1, "early"), (-1, 3, "early"), (0, 4, "standard")]


def test_pair_drops_keys_and_suffixes(spark):
    later = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "id string, score double")
    earlier = spark.createDataFrame([("a", 5.0), ("b", 6.0)], "id string, score double")
    links = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p3", "a"), (None, "a")], "pro string, old string")
    joined = link.pair(later, links, earlier, "id", "id", "pro", "old", "_sb11")
    assert joined.columns == ["score", "score_sb11"]
    assert rows(joined) == [(1.0, 5.0), (1.0, 6.0)]


def test_attach_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    extra = spark.createDataFrame([(1, 0.5), (3, 0.7), (None, 0.9)], "k int, p double")
    assert rows(link.attach(left, extra, "k", {"p": "pred"}), "v") == [(1, "x", 0.5), (2, "y", None), (None, "z", None)]


def test_attach_repeats_for_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x")], "k int, v string")
    extra = spark.createDataFrame([(1, 0.5), (1, 0.7)], "k int, p double")
    assert link.attach(left, extra, "k", ["p"]).count() == 2


def test_union_of_drifting_years(spark):
    from cohortia.plans.schemas import contract

    old = spark.createDataFrame([("1", " 7 ")], "id string, old_score string")
    both = spark.createDataFrame([("2", "8", None), ("3", None, "9"), ("4", "bad", "1")], "id string, score string, old_score string")
    bare = spark.createDataFrame([(5,)], "id int")
    united = conform.union_years({2012: bare, 2010: old, 2011: both}, contract("id town", "score"), {"old_score": "score"})
    assert united.columns == ["id", "town", "score", "anio"]
    assert rows(united, "id") == [("1", None, 7.0, 2010), ("2", None, 8.0, 2011), ("3", None, 9.0, 2011), ("4", None, 1.0, 2011), ("5", None, None, 2012)]
    with pytest.raises(ValueError):
        conform.union_years({}, contract("id"))


def test_names(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "`Fami Estrato-Vivienda` int, key int, score double".replace("double", "int"))
    assert conform.find_column(frame, ["nothing", "fami_estratovivienda"]) == "Fami Estrato-Vivienda"
    assert conform.find_column(frame, ["nothing"]) is None
    assert conform.suffix(frame, "_x", ["key"], {"score": "s"}).columns == ["Fami Estrato-Vivienda_x", "key", "s"]


def test_compact_numbers(spark):
    frame = conform.compact_numbers(spark.createDataFrame([(1, 2.0, "a")], "i int, d double, s string"))
    assert [t for _, t in frame.dtypes] == ["int", "float", "string"]


def test_no_job_while_a_plan_is_built(spark):
    skewed = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    """Links, attached columns, ranks, quantile tables and correlations run when they are used."""
    from cohortia.operators import ordering, paired

    def jobs() -> int:
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))

    scores = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        keys = skewed.select("k")
        plans = [link.unlinked(skewed, keys, "k"), link.linked(skewed, keys, "k"), link.attach(skewed, keys.distinct().withColumn("w", F.lit(1)), "k", ["w"])]
        plans += [ordering.average_rank(scores, "x"), paired.quantile_transition(scores, "x", "y"), paired.correlations(scores, {"p": ("y", "x")})]
        assert jobs() == 0
        assert all(p.columns for p in plans)
        plans[0].count()
        assert jobs() > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_funnel_shuffles_members_once(spark):
    members = spark.range(1000).select(F.col("id").alias("id"), (F.col("id") % 5).alias("year"))
    links = spark.range(0, 1000, 3).select(F.col("id").alias("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = link.cohort_funnel(members, links, "year", "id")._jdf.queryExecution().sparkPlan().toString()
        executed = link.cohort_funnel(members, links, "year", "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert plan and executed.count("Exchange hashpartitioning") <= 3
