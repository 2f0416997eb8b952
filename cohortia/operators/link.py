"""Two populations linked through a key table: funnel, unlinked rows, arrival counts and timing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from cohortia.functions.classes import arrival_class, deviation_class, year_distance_class
from cohortia.functions.dates import parse_period, semester_gap
from cohortia.functions.numbers import as_column, percent


def cohort_funnel(
    members: DataFrame,
    links: DataFrame,
    cohort: str,
    key: str,
    link_key: str | None = None,
    distinct: bool = True,
    digits: int | None = 2,
) -> DataFrame:
    """Members, linked and unlinked members and both rates of each cohort.

    ``distinct`` counts a member once however many links it has; without it a member counts once
    per link, so unlinked may fall below the number of members without a link. Links are reduced to
    one row per key; members are dealt once, by key, and counted after the join, whose member side
    adaptive execution splits where a key is frequent.
    """
    per_key = members.select(cohort, key)
    per_link = (
        links.select(F.col(link_key or key).alias(key))
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_links"))
    )
    hits = F.when(F.col("_links").isNotNull(), F.lit(1)) if distinct else F.col("_links")
    counted = (
        per_key.join(per_link, key, "left")
        .groupBy(cohort)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("linked"),
        )
    )
    return _with_rates(counted, digits)


def _with_rates(counted: DataFrame, digits: int | None) -> DataFrame:
    return counted.withColumn("unlinked", F.col("total") - F.col("linked")).withColumns(
        {
            "linked_rate": percent("linked", "total", digits),
            "unlinked_rate": percent("unlinked", "total", digits),
        }
    )


def funnel_total(funnel: DataFrame, digits: int | None = 2) -> DataFrame:
    """All cohorts together; the rates come from the summed counts."""
    summed = funnel.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked")
    )
    return _with_rates(summed, digits)


def funnel_of_counts(members: DataFrame, unlinked_rows: DataFrame, digits: int | None = 2) -> DataFrame:
    """Funnel of one cohort that comes as two tables: everybody, and those that did not go on."""
    counted = members.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "linked", F.col("total") - unlinked_rows.agg(F.count(F.lit(1))).scalar()
    )
    return _with_rates(counted, digits)


def unlinked(members: DataFrame, links: DataFrame, key: str, link_key: str | None = None) -> DataFrame:
    """Members without a link, whole rows. A plain join, whose member side adaptive execution splits where a
    key is frequent; nothing runs until the result is used."""
    linked_keys = links.select(F.col(link_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return members.join(linked_keys, key, "left_anti").select(*members.columns)


def linked(members: DataFrame, links: DataFrame, key: str, link_key: str | None = None) -> DataFrame:
    """Members with at least one link, whole rows, each once."""
    linked_keys = links.select(F.col(link_key or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return members.join(linked_keys, key, "left_semi").select(*members.columns)


def arrival_counts(
    members: DataFrame,
    links: DataFrame,
    events: DataFrame,
    cohort: str,
    key: str,
    link_member: str,
    link_event: str,
    event_key: str,
    period: str,
    group: str | None = None,
    no_group: str = "(sin grupo)",
) -> DataFrame:
    """(cohort, group, period, n): member-link-event matches of all cohorts and years in one job.

    Each table is reduced to counts per key first, and so is the first join's result, so the joins
    carry one row per distinct combination instead of one per match.
    """
    one = F.count(F.lit(1))
    per_member = members.filter(F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_member"), F.col(cohort).alias("cohort")
    ).agg(one.alias("_m"))
    per_link = links.groupBy(F.col(link_member).alias("_member"), F.col(link_event).alias("_event")).agg(
        one.alias("_l")
    )
    name = F.col(group) if group else F.lit(None).cast("string")
    label = F.when(name.isNull() | (name == ""), F.lit(no_group)).otherwise(name)
    per_event = (
        events.filter(F.col(period).isNotNull() & F.col(event_key).isNotNull())
        .groupBy(F.col(event_key).alias("_event"), F.col(period).cast("string").alias("period"), label.alias("group"))
        .agg(one.alias("_e"))
    )
    reached = (
        per_link.join(per_member, "_member")
        .groupBy("_event", "cohort")
        .agg(F.sum(F.col("_m") * F.col("_l")).alias("_ml"))
    )
    return (
        reached.join(per_event, "_event")
        .groupBy("cohort", "group", "period")
        .agg(F.sum(F.col("_ml") * F.col("_e")).alias("n"))
    )


def collapse_arrivals(arrivals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Arrival counts over groups, or over cohorts: summed by what is left."""
    return arrivals.groupBy(*by).agg(F.sum("n").alias("n"))


def arrival_levels(arrivals: DataFrame) -> DataFrame:
    """Counts by cohort-group-period, by cohort-period and by period in one pass; a collapsed column
    is NULL and ``level`` is 0, 1 or 2."""
    sets = [["cohort", "group", "period"], ["cohort", "period"], ["period"]]
    level = F.grouping("group") + F.grouping("cohort")
    return arrivals.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("cohort"), F.col("group"), F.col("period")
    ).agg(F.sum("n").alias("n"), level.cast("int").alias("level"))


def with_standard(
    df: DataFrame, group: str, standards: Sequence[tuple[str, str, float]], general_years: float = 5.0
) -> DataFrame:
    """Standard duration of the reference group in years and semesters, the general one elsewhere."""
    schema = StructType(
        [
            StructField("_key", StringType()),
            StructField("standard_label", StringType()),
            StructField("_years", DecimalType(3, 1)),
        ]
    )
    rows = df.sparkSession.createDataFrame(
        [(key, label, Decimal(str(years))) for key, label, years in standards], schema
    )
    # the standards are a list in memory, a few rows
    joined = df.join(F.broadcast(rows), df[group] == rows["_key"], "left").drop("_key")
    years = F.coalesce(F.col("_years").cast("double"), F.lit(float(general_years)))
    return joined.withColumns(
        {"standard_years": years, "standard_semesters": F.round(years * 2).cast("int")}
    ).drop("_years")


# arrival years are not bounded unless the caller does
YEARS = (None, None)


def parsed_arrivals(
    arrivals: DataFrame, cohort: str = "cohort", period: str = "period", years: tuple[int | None, int | None] = YEARS
) -> DataFrame:
    """Arrivals with a readable period, inside ``years`` where they are given: arrival year, semester and
    semesters since the cohort year."""
    code = F.col("_code")
    return (
        arrivals.withColumn("_code", parse_period(period, *years))
        .filter(code.isNotNull())
        .withColumns(
            {
                "arrival_year": code["year"],
                "arrival_semester": code["semester"],
                "gap": semester_gap(code, cohort),
            }
        )
        .drop("_code")
    )


def arrival_timing(
    arrivals: DataFrame,
    standard: int | str | Column = 10,
    by: Sequence[str] = (),
    cohort: str = "cohort",
    period: str = "period",
    n: str = "n",
    years: tuple[int | None, int | None] = YEARS,
) -> DataFrame:
    """Early, on-time and late arrivals: counts, percentages and mean deviations in semesters.

    ``standard`` is a number of semesters or a column of them.
    """
    std = F.lit(standard) if isinstance(standard, int) else as_column(standard)
    rows = parsed_arrivals(arrivals, cohort, period, years).select(
        *by,
        F.col(n).alias("_n"),
        (F.col("gap") - std).alias("_dev"),
        arrival_class("gap", std).alias("_class"),
    )

    def count_of(label: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_class") == label, F.col("_n"))), F.lit(0)).cast("bigint")

    def deviation_of(label: str) -> Column:
        return F.sum(F.when(F.col("_class") == label, F.col("_dev") * F.col("_n")))

    sums = rows.groupBy(*by).agg(
        F.sum("_n").alias("total"),
        F.sum(F.col("_dev") * F.col("_n")).alias("_dev_sum"),
        count_of("early").alias("early_count"),
        count_of("on_time").alias("on_time_count"),
        count_of("late").alias("late_count"),
        deviation_of("early").alias("_early_sum"),
        deviation_of("late").alias("_late_sum"),
    )
    return sums.filter(F.col("total") > 0).select(
        *by,
        "total",
        "early_count",
        percent("early_count", "total").alias("early_pct"),
        F.when(F.col("early_count") > 0, F.col("_early_sum") / F.col("early_count"))
        .otherwise(F.lit(0.0))
        .alias("early_avg_dev"),
        "on_time_count",
        percent("on_time_count", "total").alias("on_time_pct"),
        "late_count",
        percent("late_count", "total").alias("late_pct"),
        F.when(F.col("late_count") > 0, F.col("_late_sum") / F.col("late_count"))
        .otherwise(F.lit(0.0))
        .alias("late_avg_dev"),
        (F.col("_dev_sum") / F.col("total")).alias("avg_dev"),
    )


def arrival_by_year(
    arrivals: DataFrame,
    standard_years: float | None = None,
    cohort: str = "cohort",
    period: str = "period",
    n: str = "n",
    years: tuple[int | None, int | None] = YEARS,
) -> DataFrame:
    """Arrivals by calendar year. With a standard, by cohort too, with the class of the distance to
    the expected year (cohort + standard)."""
    rows = parsed_arrivals(arrivals, cohort, period, years)
    if standard_years is None:
        return rows.groupBy("arrival_year").agg(F.sum(n).alias("n"))
    distance = F.col("arrival_year") - (F.col(cohort) + F.lit(float(standard_years)))
    return (
        rows.groupBy(cohort, "arrival_year")
        .agg(F.sum(n).alias("n"))
        .withColumn("distance_class", year_distance_class(distance))
    )


def arrival_by_deviation(
    arrivals: DataFrame,
    standard: int | str = 10,
    cohort: str = "cohort",
    period: str = "period",
    n: str = "n",
    years: tuple[int | None, int | None] = YEARS,
) -> DataFrame:
    """Arrivals by deviation from the standard in semesters, with the class of the deviation."""
    std = F.lit(standard) if isinstance(standard, int) else F.col(standard)
    return (
        parsed_arrivals(arrivals, cohort, period, years)
        .groupBy((F.col("gap") - std).alias("deviation"))
        .agg(F.sum(n).alias("n"))
        .withColumn("deviation_class", deviation_class("deviation"))
    )


def pair(
    left: DataFrame,
    links: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    link_left: str,
    link_right: str,
    right_suffix: str = "_sb11",
    keep_keys: bool = False,
) -> DataFrame:
    """One wide row per linked pair; right columns get a suffix and the keys are dropped.

    Both joins are plain inner equi-joins of shuffled inputs, so adaptive execution can split a
    skewed key on either side.
    """
    spare_right = right.select(
        *[
            F.col(c).alias("_right_key" if c == right_key else c + right_suffix)
            for c in right.columns
        ]
    )
    spare_links = links.select(F.col(link_left).alias("_left_key"), F.col(link_right).alias("_right_key"))
    joined = left.join(spare_links, left[left_key] == spare_links["_left_key"]).drop("_left_key")
    joined = joined.join(spare_right, "_right_key")
    if keep_keys:
        return joined.withColumnRenamed("_right_key", right_key + right_suffix)
    return joined.drop("_right_key", left_key)


def attach(df: DataFrame, extra: DataFrame, key: str, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Columns of another table by key, NULL where it has none. Plain left join; see ``unlinked`` on skew."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    wanted = extra.select(F.col(key), *[F.col(c).alias(n) for c, n in names.items()])
    return df.join(wanted, key, "left").select(*df.columns, *names.values())
