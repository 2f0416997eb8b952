"""Queries on linking: funnel, unlinked rows, arrivals, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.classes import trend_class
from cohortia.functions.dates import cohort_year as first_cohort
from cohortia.functions.dates import parse_period, semester_gap
from cohortia.functions.text import null_label
from cohortia.operators import frequency, link, trend
from cohortia.plans.registry import query, table

STANDARDS = (("F", "Closed", 4.5), ("O", "Open", 5.0))

# SQL fragments shared by the oracle texts of this module
MEMBERS_SQL = "members AS (SELECT o_orderkey, year(o_orderdate) AS cohort FROM orders)"
LINKS_SQL = "links AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"
FUNNEL_SQL = f"""{MEMBERS_SQL}, {LINKS_SQL}, counted AS (
  SELECT cohort, count(*) AS total, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM links)) AS linked
  FROM members GROUP BY cohort), funnel AS (
  SELECT cohort, total, linked, total - linked AS unlinked,
         round(linked * 100.0 / total, 2)::DOUBLE AS linked_rate,
         round((total - linked) * 100.0 / total, 2)::DOUBLE AS unlinked_rate FROM counted)"""
ARRIVALS_SQL = f"""{MEMBERS_SQL}, arrivals AS (
  SELECT cohort, e.l_linestatus AS "group",
         (year(e.l_shipdate) * 10 + CASE WHEN month(e.l_shipdate) <= 6 THEN 1 ELSE 2 END)::VARCHAR AS period,
         count(*)::BIGINT AS n
  FROM members m JOIN lineitem k ON m.o_orderkey = k.l_orderkey AND k.l_returnflag = 'A'
  JOIN lineitem e ON e.l_orderkey = k.l_orderkey GROUP BY ALL), parsed AS (
  SELECT *, period[1:4]::INT AS arrival_year,
         (period[1:4]::INT - cohort) * 2 + period[5:5]::INT - 1 AS gap FROM arrivals)"""


def members(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.withColumn("cohort", F.year("o_orderdate"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey")


def events(spark: SparkSession, folder: str) -> DataFrame:
    half = F.when(F.month("l_shipdate") <= 6, F.lit(1)).otherwise(F.lit(2))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linestatus", (F.year("l_shipdate") * 10 + half).cast("string").alias("period")
    )


def funnel(spark: SparkSession, folder: str, distinct: bool = True) -> DataFrame:
    return link.cohort_funnel(
        members(spark, folder), links(spark, folder), "cohort", "o_orderkey", "l_orderkey", distinct
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    keys = links(spark, folder).select(F.col("l_orderkey").alias("member"), F.col("l_orderkey").alias("event"))
    return link.arrival_counts(
        members(spark, folder),
        keys,
        events(spark, folder),
        cohort="cohort",
        key="o_orderkey",
        link_member="member",
        link_event="event",
        event_key="l_orderkey",
        period="period",
        group="l_linestatus",
    )


@query(f"WITH {FUNNEL_SQL} SELECT * FROM funnel")
def cohort_funnel(spark, folder):
    return funnel(spark, folder)


@query(
    f"""WITH {FUNNEL_SQL}, s AS (SELECT sum(total)::BIGINT AS total, sum(linked)::BIGINT AS linked FROM funnel)
    SELECT total, linked, total - linked AS unlinked, round(linked * 100.0 / total, 2)::DOUBLE AS linked_rate,
           round((total - linked) * 100.0 / total, 2)::DOUBLE AS unlinked_rate FROM s"""
)
def cohort_total(spark, folder):
    return link.funnel_total(funnel(spark, folder))


@query(
    f"""WITH {MEMBERS_SQL}, {LINKS_SQL}, t AS (SELECT cohort, count(*) AS total FROM members GROUP BY cohort),
    f AS (SELECT cohort, count(*) AS linked FROM members JOIN links ON o_orderkey = l_orderkey GROUP BY cohort)
    SELECT t.cohort, total, coalesce(linked, 0) AS linked, total - coalesce(linked, 0) AS unlinked,
           round(coalesce(linked, 0) * 100.0 / total, 2)::DOUBLE AS linked_rate,
           round((total - coalesce(linked, 0)) * 100.0 / total, 2)::DOUBLE AS unlinked_rate
    FROM t LEFT JOIN f USING (cohort)"""
)
def cohort_funnel_fanout(spark, folder):
    return funnel(spark, folder, distinct=False)


@query(
    f"""WITH {LINKS_SQL}, u AS (SELECT count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM links)) AS n,
                                        count(*) AS total FROM orders)
    SELECT total, total - n AS linked, n AS unlinked, round((total - n) * 100.0 / total, 2)::DOUBLE AS linked_rate,
           round(n * 100.0 / total, 2)::DOUBLE AS unlinked_rate FROM u"""
)
def cohort_funnel_of_counts(spark, folder):
    everybody = members(spark, folder)
    missing = link.unlinked(everybody, links(spark, folder), "o_orderkey", "l_orderkey")
    return link.funnel_of_counts(everybody, missing)


@query("SELECT min(year(o_orderdate))::INT AS cohort_year FROM orders")
def cohort_year(spark, folder):
    coded = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("period"))
    return first_cohort(coded, "period")


@query(
    f"""WITH {LINKS_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS cohort
    FROM orders WHERE NOT EXISTS (SELECT 1 FROM links WHERE l_orderkey = o_orderkey)"""
)
def unlinked_detail(spark, folder):
    missing = link.unlinked(members(spark, folder), links(spark, folder), "o_orderkey", "l_orderkey")
    return missing.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cohort")


@query(
    f"""WITH {LINKS_SQL} SELECT o_orderkey, year(o_orderdate)::INT AS cohort
    FROM orders WHERE EXISTS (SELECT 1 FROM links WHERE l_orderkey = o_orderkey)"""
)
def linked_detail(spark, folder):
    found = link.linked(members(spark, folder), links(spark, folder), "o_orderkey", "l_orderkey")
    return found.select("o_orderkey", "cohort")


@query(
    f"""WITH {LINKS_SQL}, u AS (SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM links WHERE l_orderkey = o_orderkey)),
    v AS (SELECT CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'No reporta' ELSE o_orderpriority END AS p,
                 o_orderstatus AS s FROM u)
    SELECT 'priority' AS field, p AS value, count(*) AS n FROM v GROUP BY p
    UNION ALL SELECT 'status', s, count(*) FROM v GROUP BY s"""
)
def unlinked_detail_freq(spark, folder):
    missing = link.unlinked(members(spark, folder), links(spark, folder), "o_orderkey", "l_orderkey")
    unset = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    labelled = missing.select(
        null_label(unset, "No reporta", ["4-not specified"]).alias("priority"),
        null_label("o_orderstatus", "No reporta").alias("status"),
    )
    return frequency.frequency_many(labelled, ["priority", "status"])


@query(f"WITH {ARRIVALS_SQL} SELECT * FROM arrivals")
def arrival_counts(spark, folder):
    return arrivals(spark, folder)


@query(
    f"""WITH {ARRIVALS_SQL} SELECT cohort, "group", period, sum(n)::BIGINT AS n,
           (grouping("group") + grouping(cohort))::INT AS level
    FROM arrivals GROUP BY GROUPING SETS ((cohort, "group", period), (cohort, period), (period))"""
)
def arrival_levels(spark, folder):
    return link.arrival_levels(arrivals(spark, folder))


@query(f"WITH {ARRIVALS_SQL} SELECT cohort, period, sum(n)::BIGINT AS n FROM arrivals GROUP BY ALL")
def arrival_collapsed(spark, folder):
    return link.collapse_arrivals(arrivals(spark, folder), ["cohort", "period"])


TIMING_COLUMNS_SQL = """sum(n)::BIGINT AS total,
  coalesce(sum(n) FILTER (gap < std), 0)::BIGINT AS early_count,
  round(coalesce(sum(n) FILTER (gap < std), 0) * 100.0 / sum(n), 6) + 0.0 AS early_pct,
  round(coalesce(sum(n * (gap - std)) FILTER (gap < std) / sum(n) FILTER (gap < std), 0), 6) + 0.0 AS early_avg_dev,
  coalesce(sum(n) FILTER (gap BETWEEN std AND std + 1), 0)::BIGINT AS on_time_count,
  round(coalesce(sum(n) FILTER (gap BETWEEN std AND std + 1), 0) * 100.0 / sum(n), 6) + 0.0 AS on_time_pct,
  coalesce(sum(n) FILTER (gap > std + 1), 0)::BIGINT AS late_count,
  round(coalesce(sum(n) FILTER (gap > std + 1), 0) * 100.0 / sum(n), 6) + 0.0 AS late_pct,
  round(coalesce(sum(n * (gap - std)) FILTER (gap > std + 1) / sum(n) FILTER (gap > std + 1), 0), 6) + 0.0 AS late_avg_dev,
  round(sum(n * (gap - std)) / sum(n), 6) + 0.0 AS avg_dev"""


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


TIMING_RATES = ("early_pct", "early_avg_dev", "on_time_pct", "late_pct", "late_avg_dev", "avg_dev")


@query(f"WITH {ARRIVALS_SQL}, g AS (SELECT *, 4 AS std FROM parsed) SELECT {TIMING_COLUMNS_SQL} FROM g")
def arrival_timing(spark, folder):
    return _rounded(link.arrival_timing(arrivals(spark, folder), 4), *TIMING_RATES)


@query(
    f"""WITH {ARRIVALS_SQL}, g AS (SELECT *, CASE "group" WHEN 'F' THEN 9 ELSE 10 END AS std,
      CASE "group" WHEN 'F' THEN 'Closed' ELSE 'Open' END AS standard_label FROM parsed)
    SELECT cohort, standard_label, {TIMING_COLUMNS_SQL} FROM g GROUP BY ALL"""
)
def arrival_timing_by_group(spark, folder):
    timed = link.with_standard(arrivals(spark, folder), "group", STANDARDS)
    return _rounded(
        link.arrival_timing(timed, "standard_semesters", by=["cohort", "standard_label"]), *TIMING_RATES
    )


@query(f"WITH {ARRIVALS_SQL} SELECT arrival_year, sum(n)::BIGINT AS n FROM parsed GROUP BY ALL")
def arrival_by_year(spark, folder):
    return link.arrival_by_year(arrivals(spark, folder))


@query(
    f"""WITH {ARRIVALS_SQL} SELECT cohort, arrival_year, sum(n)::BIGINT AS n,
      CASE WHEN arrival_year - (cohort + 1.5) < -0.5 THEN 'early' WHEN arrival_year - (cohort + 1.5) <= 0.5 THEN 'standard'
           WHEN arrival_year - (cohort + 1.5) <= 2.5 THEN 'late' ELSE 'very_late' END AS distance_class
    FROM parsed GROUP BY ALL"""
)
def arrival_year_classes(spark, folder):
    return link.arrival_by_year(arrivals(spark, folder), 1.5)


@query(
    f"""WITH {ARRIVALS_SQL} SELECT gap - 3 AS deviation, sum(n)::BIGINT AS n,
      CASE WHEN gap < 3 THEN 'early' WHEN gap = 3 THEN 'standard' WHEN gap - 3 <= 4 THEN 'late' ELSE 'very_late' END
      AS deviation_class FROM parsed GROUP BY ALL"""
)
def arrival_by_deviation(spark, folder):
    return link.arrival_by_deviation(arrivals(spark, folder), 3)


@query(
    """WITH c AS (SELECT year(o_orderdate) AS cohort, CASE l_linenumber % 5
        WHEN 0 THEN (year(l_shipdate) * 10 + CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END)::VARCHAR
        WHEN 1 THEN ' ' || (year(l_shipdate) * 10 + 2)::VARCHAR || '.0 '
        WHEN 2 THEN year(l_shipdate)::VARCHAR
        WHEN 3 THEN (year(l_shipdate) * 10 + 3)::VARCHAR ELSE 'n/a' END AS code, year(l_shipdate) AS y, month(l_shipdate) AS m,
        l_linenumber % 5 AS k
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    p AS (SELECT cohort, CASE WHEN k <= 2 THEN y END AS y,
        CASE k WHEN 0 THEN CASE WHEN m <= 6 THEN 1 ELSE 2 END WHEN 1 THEN 2 WHEN 2 THEN 1 END AS s FROM c)
    SELECT y::INT AS year, CASE WHEN y IS NOT NULL THEN s END::INT AS semester,
           CASE WHEN y IS NOT NULL THEN (y - cohort) * 2 + s - 1 END::INT AS gap, count(*) AS n FROM p GROUP BY ALL"""
)
def period_codes(spark, folder):
    rows = members(spark, folder).join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    year, kind = F.year("l_shipdate"), F.col("l_linenumber") % 5
    half = F.when(F.month("l_shipdate") <= 6, F.lit(1)).otherwise(F.lit(2))
    code = (
        F.when(kind == 0, (year * 10 + half).cast("string"))
        .when(kind == 1, F.concat(F.lit(" "), (year * 10 + 2).cast("string"), F.lit(".0 ")))
        .when(kind == 2, year.cast("string"))
        .when(kind == 3, (year * 10 + 3).cast("string"))
        .otherwise(F.lit("n/a"))
    )
    parsed = parse_period(code)
    return (
        rows.select(
            parsed["year"].alias("year"), parsed["semester"].alias("semester"), semester_gap(parsed, "cohort").alias("gap")
        )
        .groupBy("year", "semester", "gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    f"""WITH {FUNNEL_SQL}, f AS (SELECT regr_slope(unlinked_rate, cohort) AS slope, regr_intercept(unlinked_rate, cohort) AS icpt,
        regr_r2(unlinked_rate, cohort) AS r2 FROM funnel)
    SELECT cohort, unlinked_rate, round(icpt + slope * cohort, 6) + 0.0 AS fitted, round(slope, 6) + 0.0 AS slope,
           round(r2, 6) + 0.0 AS r2 FROM funnel, f"""
)
def rate_trend(spark, folder):
    fitted = trend.linear_trend(funnel(spark, folder), "cohort", "unlinked_rate")
    return _rounded(fitted, "fitted", "slope", "r2")


@query(
    f"""WITH {FUNNEL_SQL}, k AS (SELECT regr_slope(unlinked_rate, cohort) AS slope, min(cohort) AS first_x, max(cohort) AS last_x,
        arg_max(unlinked_rate, cohort) - arg_min(unlinked_rate, cohort) AS d FROM funnel)
    SELECT round(slope, 6) + 0.0 AS slope, CASE WHEN slope > 0.05 THEN 'up' WHEN slope < -0.05 THEN 'down' ELSE 'flat' END AS trend,
           first_x, last_x, round(d, 6) + 0.0 AS total_change FROM k"""
)
def trend_kpi(spark, folder):
    return _rounded(trend.trend_kpi(funnel(spark, folder), "cohort", "unlinked_rate"), "slope", "total_change")


@query(
    f"""WITH {FUNNEL_SQL} SELECT cohort, 'linked' AS part, round(linked * 100.0 / total, 6)::DOUBLE AS share FROM funnel
    UNION ALL SELECT cohort, 'unlinked', round(unlinked * 100.0 / total, 6)::DOUBLE FROM funnel"""
)
def stacked_share(spark, folder):
    return _rounded(trend.stacked_share(funnel(spark, folder), "cohort", ["linked", "unlinked"]), "share")


@query(
    f"""WITH {FUNNEL_SQL}, d AS (SELECT cohort, unlinked_rate - lag(unlinked_rate) OVER (ORDER BY cohort) AS c FROM funnel)
    SELECT cohort, round(c, 3) + 0.0 AS change FROM d WHERE c IS NOT NULL"""
)
def rate_delta(spark, folder):
    return _rounded(trend.year_change(funnel(spark, folder), "cohort", "unlinked_rate", None), "change", digits=3)


@query(
    f"""WITH {FUNNEL_SQL}, e AS (SELECT min(cohort) AS first_x, arg_min(linked_rate, cohort) AS first_y, max(cohort) AS last_x,
        arg_max(linked_rate, cohort) AS last_y FROM funnel)
    SELECT first_x, first_y, last_x, last_y, round(last_y - first_y, 6) + 0.0 AS change,
           CASE WHEN last_y > first_y THEN 'up' WHEN last_y < first_y THEN 'down' ELSE 'stable' END AS direction FROM e"""
)
def first_last(spark, folder):
    return _rounded(trend.first_last(funnel(spark, folder), "cohort", "linked_rate"), "change")


@query(
    """WITH y AS (SELECT l_returnflag, year(l_shipdate) AS x, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
    s AS (SELECT l_returnflag, regr_slope(p, x) AS slope FROM y GROUP BY ALL)
    SELECT l_returnflag, CASE WHEN slope > 0.05 THEN 'up' WHEN slope < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM s"""
)
def trend_classes(spark, folder):
    means = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", F.year("l_shipdate").alias("x"))
        .agg(F.avg("l_extendedprice").alias("p"))
    )
    slopes = means.groupBy("l_returnflag").agg(F.regr_slope("p", "x").alias("slope"))
    return slopes.select("l_returnflag", trend_class("slope").alias("trend"))
