"""Trends over cohorts, on tables that are already aggregated to one row per cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.classes import direction_class, trend_class


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (points, slope, intercept, r2) of the least-squares line; NULL below two points.
    A constant y gives r2 = 1."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.agg(
        F.count_if(x.isNotNull() & y.isNotNull()).alias("points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    return fit.select(
        "points", *[F.when(F.col("points") >= 2, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")]
    )


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, fitted, slope, r2): the series with its trend line."""
    fit = linear_fit(df, x, y).select(F.struct("slope", "intercept", "r2")).scalar()
    slope, intercept = F.col("_fit.slope"), F.col("_fit.intercept")
    return (
        df.select(x, y)
        .withColumn("_fit", fit)
        .select(
            x, y, (intercept + slope * F.col(x)).alias("fitted"), slope.alias("slope"), F.col("_fit.r2").alias("r2")
        )
    )


def first_last(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: first and last point of a series, its change and the direction."""
    points = df.filter(F.col(y).isNotNull())
    ends = points.agg(
        F.min(x).alias("first_x"),
        F.min_by(y, x).alias("first_y"),
        F.max(x).alias("last_x"),
        F.max_by(y, x).alias("last_y"),
    )
    return ends.withColumn("change", F.col("last_y") - F.col("first_y")).withColumn(
        "direction", direction_class("change")
    )


def trend_kpi(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope and its class, first and last x, total change. No row below two points."""
    fit = linear_fit(df, x, y).select(F.struct("points", "slope")).scalar()
    return (
        first_last(df, x, y)
        .withColumn("_fit", fit)
        .filter(F.col("_fit.points") >= 2)
        .select(
            F.col("_fit.slope").alias("slope"),
            trend_class("_fit.slope").alias("trend"),
            "first_x",
            "last_x",
            F.col("change").alias("total_change"),
        )
    )


def stacked_share(df: DataFrame, x: str, parts: Sequence[str]) -> DataFrame:
    """(x, part, share): each part's percentage of the row's parts, which sum to 100."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    entries = [
        F.struct(F.lit(p).alias("part"), F.when(total > 0, F.col(p) / total * 100).alias("share")) for p in parts
    ]
    return df.select(x, F.inline(F.array(*entries)))


def year_change(df: DataFrame, x: str, y: str, digits: int | None = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, change): difference to the previous row by x; the first has none and is left out.

    Without ``by`` the window has no partition, so that is for tables with one row per cohort or year.
    """
    previous = F.lag(y).over(Window.partitionBy(*by).orderBy(x) if by else Window.orderBy(x))
    change = F.col(y) - F.col("_previous")
    return (
        df.withColumn("_previous", previous)
        .filter(F.col("_previous").isNotNull())
        .select(*by, x, (change if digits is None else F.round(change, digits)).alias("change"))
    )
