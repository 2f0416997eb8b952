"""Frequency tables, top lists and score summaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortia.functions.classes import classify_sets
from cohortia.functions.numbers import nan_to_null, to_number
from cohortia.functions.text import code_text, is_domestic


def _filled(df: DataFrame, c: str | Column) -> DataFrame:
    column = F.col(c) if isinstance(c, str) else c
    return df.select(F.trim(column.cast("string")).alias("value")).filter(F.col("value") != "")


def frequency(df: DataFrame, c: str | Column, top: int | None = None, order: str = "count") -> DataFrame:
    """(value, n) of the non-blank answers, by falling count or by ``key``; ties go by value.

    With ``top`` the first rows in that order. Without it the table comes unsorted, so that a
    caller that only stores or joins it pays for no sort.
    """
    counted = _filled(df, c).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else ordered(counted, order).limit(top)


def ordered(counted: DataFrame, order: str = "count", ascending: bool = False) -> DataFrame:
    """A frequency table sorted by ``key``, or by count in either direction."""
    if order == "key":
        return counted.orderBy("value")
    return counted.orderBy(F.asc("n") if ascending else F.desc("n"), "value")


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., field, value): one row per non-blank trimmed answer."""
    texts = df.select(*keep, *[F.trim(F.col(c).cast("string")).alias(c) for c in columns])
    return texts.unpivot(list(keep), list(columns), "field", "value").filter(F.col("value") != "")


def frequency_many(
    df: DataFrame, columns: Sequence[str], top: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(field, value, n) for many columns from one scan and one aggregation."""
    counted = melt(df, columns, by).groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counted
    rank = F.row_number().over(Window.partitionBy(*by, "field").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def code_totals(df: DataFrame, c: str) -> DataFrame:
    """Frequency of a code whose numeric spellings (3 and 3.0) are one value."""
    return frequency(df, code_text(c))


def top_pinned(df: DataFrame, c: str | Column, k: int, pin: str) -> DataFrame:
    """Top k, plus the most frequent value that contains ``pin`` when none of the top k does."""
    column = F.col(c) if isinstance(c, str) else c
    counted = frequency(df, F.upper(column)).withColumn("_named", F.upper(F.col("value")).contains(pin.upper()))
    entry = F.struct((-F.col("n")).alias("n"), "value")
    best = counted.groupBy().agg(F.min(F.when(F.col("_named"), entry)).alias("best"))
    rows = F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))
    both = ordered(counted).limit(k).agg(F.sort_array(rows).alias("top")).withColumn("best", best.scalar())
    missing = F.col("best").isNotNull() & ~F.exists("top", lambda e: F.upper(e["value"]).contains(pin.upper()))
    listed = F.transform("top", lambda e: F.struct(e["value"].alias("value"), (-e["n"]).alias("n"), F.lit(False).alias("pinned")))
    extra = F.struct(F.col("best.value").alias("value"), (-F.col("best.n")).alias("n"), F.lit(True).alias("pinned"))
    whole = F.when(missing, F.concat(listed, F.array(extra))).otherwise(listed)
    return both.select(F.inline(whole))


def append_rows(top: DataFrame, extra: DataFrame) -> DataFrame:
    return top.unionByName(extra)


def top_mean(df: DataFrame, key: str | Column, score: str, k: int) -> DataFrame:
    """The k keys with the highest mean score; keys and scores that are missing are left out."""
    column = F.col(key) if isinstance(key, str) else key
    means = (
        df.select(column.alias("value"), F.col(score).alias("_score"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.avg("_score").alias("mean"))
        .filter(F.col("mean").isNotNull())
    )
    return means.orderBy(F.desc("mean"), "value").limit(k)


def domestic_split(df: DataFrame, c: str, country: str, prefix: bool = False) -> DataFrame:
    """One row: domestic and foreign totals; a missing country counts as domestic."""
    home = is_domestic(c, country, prefix)
    return df.agg(
        F.count_if(home).alias("domestic"),
        F.count_if(~home).alias("foreign"),
    )


def foreign_top(df: DataFrame, c: str, country: str, top: int, prefix: bool = False) -> DataFrame:
    """Most frequent foreign countries."""
    foreign = df.filter(~is_domestic(c, country, prefix))
    return frequency(foreign, F.upper(F.col(c)), top)


def domestic_and_foreign(df: DataFrame, c: str, country: str, top: int) -> DataFrame:
    """The home country's row followed by the top foreign countries."""
    home = domestic_split(df, c, country).select(F.lit(country).alias("value"), F.col("domestic").alias("n"))
    return append_rows(home, foreign_top(df, c, country, top))


def class_totals(df: DataFrame, c: str, groups: Mapping[str, Iterable[str]]) -> DataFrame:
    """Rows of each value set; sets without rows do not appear."""
    return frequency(df.select(classify_sets(c, groups).alias(c)), c)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_distinct) exact, through one grouped pass instead of one distinct per column."""
    return frequency_many(df, columns).groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))


def distinct_counts_approx(df: DataFrame, columns: Sequence[str], rsd: float = 0.01) -> DataFrame:
    """Like distinct_counts with sketches: no shuffle of the values."""
    return (
        melt(df, columns).groupBy("field").agg(F.approx_count_distinct("value", rsd).alias("n_distinct"))
    )


def distinct_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], size: int = 12) -> DataFrame:
    """(by..., field, sketch): a mergeable sketch of the different values of each column in each slice, NULL left out.

    The table is small and can be kept: counts for any set of slices come from it by ``union_counts``, without the rows. Their relative
    error has a standard deviation of about 1.04 / sqrt(2 ** size).
    """
    return melt(df, columns, by).groupBy(*by, "field").agg(F.hll_sketch_agg("value", size).alias("sketch"))


def union_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., field, n_distinct): about how many different values the slices have together. Filters choose the slices."""
    return sketches.groupBy(*by, "field").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def _stack(row: DataFrame, fields: Sequence[str], parts: Sequence[str], name: str) -> DataFrame:
    """One wide row with columns ``{part}_{i}`` to one row per field."""
    entries = [
        F.struct(F.lit(field).alias(name), *[F.col(f"{part}_{i}").alias(part) for part in parts])
        for i, field in enumerate(fields)
    ]
    return row.select(F.inline(F.array(*entries)))


def _number(df: DataFrame, column: str) -> Column:
    """A number as it is, NaN missing; text through the lenient parser."""
    kind = df.schema[column].dataType if column in df.columns else None
    return nan_to_null(column) if isinstance(kind, NumericType) else to_number(column)


def score_stats(df: DataFrame, scores: Sequence[str], digits: int | None = None) -> DataFrame:
    """(score, min, max, mean) of each score column; bad text counts as missing."""
    aggregates = []
    for i, score in enumerate(scores):
        value = _number(df, score)
        for part, expr in (("min", F.min(value)), ("max", F.max(value)), ("mean", F.avg(value))):
            aggregates.append((F.round(expr, digits) if digits is not None else expr).alias(f"{part}_{i}"))
    return _stack(df.agg(*aggregates), scores, ["min", "max", "mean"], "score")


def mean_profile(df: DataFrame, scores: Mapping[str, str], digits: int | None = None) -> DataFrame:
    """(label, mean) of several scores over all rows. ``scores`` maps column to label."""
    means = []
    for i, score in enumerate(scores):
        value = F.avg(_number(df, score))
        means.append((F.round(value, digits) if digits is not None else value).alias(f"mean_{i}"))
    return _stack(df.agg(*means), list(scores.values()), ["mean"], "label")


def group_mean(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, mean) by year, department or group; missing keys are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(score).alias("mean"))
