"""Facts about a series, a share table or a matrix, and the long table of indicators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _high(item, value):
    """Item of the highest value; ties go to the item that sorts first."""
    return F.min_by(item, F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col(item))))


def _low(item, value):
    return F.min_by(item, F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col(item))))


def series_summary(df: DataFrame, item: str, value: str) -> DataFrame:
    """One row: total, mean, and the highest and lowest item with their values."""
    return df.agg(
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        _high(item, value).alias("max_item"),
        F.max(value).alias("max_value"),
        _low(item, value).alias("min_item"),
        F.min(value).alias("min_value"),
    )


def share_summary(df: DataFrame, item: str, value: str) -> DataFrame:
    """One row: total, number of categories, and the largest and smallest share in percent."""
    row = df.agg(
        F.sum(value).alias("total"),
        F.count(value).alias("categories"),
        _high(item, value).alias("max_item"),
        F.max(value).alias("_max"),
        _low(item, value).alias("min_item"),
        F.min(value).alias("_min"),
    )
    return row.select(
        "total",
        "categories",
        "max_item",
        F.when(F.col("total") != 0, F.col("_max") / F.col("total") * 100).alias("max_share"),
        "min_item",
        F.when(F.col("total") != 0, F.col("_min") / F.col("total") * 100).alias("min_share"),
    )


def compare_series(df: DataFrame, series: str, value: str, averaged: bool = False) -> DataFrame:
    """One row: the highest and lowest of several series, by mean (scores, rates) or by total
    (counts), and whether they are within 2 percent of each other."""
    total = F.avg(value) if averaged else F.sum(value)
    per_series = df.groupBy(series).agg(total.cast("double").alias("_v"))
    row = per_series.agg(
        _high(series, "_v").alias("max_series"),
        F.max("_v").alias("max_value"),
        _low(series, "_v").alias("min_series"),
        F.min("_v").alias("min_value"),
    )
    scale = F.greatest(F.abs("max_value"), F.abs("min_value"), F.lit(1e-9))
    return row.withColumn("similar", (F.col("max_value") - F.col("min_value")) / scale <= 0.02)


def matrix_extrema(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One row: the cells with the highest and lowest value, and whether values fall below zero.
    Ties go to the cell that sorts first."""
    cell = F.struct(row, col)
    known = F.col(value).isNotNull()
    ends = df.agg(
        F.min_by(cell, F.when(known, F.struct(-F.col(value), F.col(row), F.col(col)))).alias("_high"),
        F.max(value).alias("max_value"),
        F.min_by(cell, F.when(known, F.struct(F.col(value), F.col(row), F.col(col)))).alias("_low"),
        F.min(value).alias("min_value"),
    )
    return ends.select(
        F.col(f"_high.{row}").alias("max_row"),
        F.col(f"_high.{col}").alias("max_col"),
        "max_value",
        F.col(f"_low.{row}").alias("min_row"),
        F.col(f"_low.{col}").alias("min_col"),
        "min_value",
        (F.col("min_value") < 0).alias("is_signed"),
    )


def indicators(row: DataFrame, section: str, columns: Mapping[str, str]) -> DataFrame:
    """(section, item, kind, label, value): one row per column of a one-row table; the value is text,
    and a dash when missing. ``columns`` maps item and source column to label, as ``item=column``."""
    entries = []
    for spec, label in columns.items():
        item, _, column = spec.partition("=")
        entries.append(
            F.struct(
                F.lit(item).alias("item"),
                F.lit("kpi").alias("kind"),
                F.lit(label).alias("label"),
                F.coalesce(F.col(column or item).cast("string"), F.lit("—")).alias("value"),
            )
        )
    return row.select(F.lit(section).alias("section"), F.inline(F.array(*entries)))


def kpi_long(sections: Iterable[DataFrame], estimator_keys: Iterable[str]) -> DataFrame:
    """All indicators in one table, each tagged as an indicator or as an estimator."""
    parts = list(sections)
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    key = F.concat_ws("::", "section", "item")
    tag = F.when(key.isin(*estimator_keys), F.lit("estimator")).otherwise(F.lit("indicator"))
    return united.withColumn("tag", tag)


def comparison_facts(marked: DataFrame, key: str, main: str) -> DataFrame:
    """One row from a long comparison table (key, score, value): best key of the main score, the
    score with the highest mean, and the spread of the main score."""
    per_score = marked.groupBy("score").agg(
        F.avg("value").alias("_mean"), _high(key, "value").alias("_best"), F.max("value").alias("_max"), F.min("value").alias("_min")
    )
    is_main = F.col("score") == main
    return per_score.agg(
        F.max(F.when(is_main, F.col("_best"))).alias("best_key"),
        F.max(F.when(is_main, F.col("_max"))).alias("best_value"),
        _high("score", "_mean").alias("best_score"),
        F.max("_mean").alias("best_score_mean"),
        F.max(F.when(is_main, F.col("_max") - F.col("_min"))).alias("spread"),
    )
