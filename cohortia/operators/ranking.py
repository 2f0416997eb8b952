"""Institution means, rankings and comparison of a few selected institutions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_means(df: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """Mean of each score per key; keys without any score are left out, and so is the NULL key."""
    means = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(s).alias(s) for s in scores])
    return means.dropna(how="all", subset=list(scores))


def ranking(means: DataFrame, key: str, score: str, k: int = 20, digits: int | None = 2) -> DataFrame:
    """(position, key, score) of the k highest means; ties go by key.

    The position is numbered after the limit, on k rows.
    """
    top = means.filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    position = F.row_number().over(Window.orderBy(F.desc(score), key))
    value = F.col(score) if digits is None else F.round(score, digits)
    return top.select(position.alias("position"), key, value.alias(score))


def best(means: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """(score, best, value): the key with the highest mean of every score; ties go by key."""
    aggregates, entries = [], []
    for i, s in enumerate(scores):
        order = F.when(F.col(s).isNotNull(), F.struct(-F.col(s), F.col(key)))
        aggregates += [F.min_by(key, order).alias(f"_k{i}"), F.max(s).alias(f"_v{i}")]
        entries.append(F.struct(F.lit(s).alias("score"), F.col(f"_k{i}").alias("best"), F.col(f"_v{i}").alias("value")))
    return means.agg(*aggregates).select(F.inline(F.array(*entries)))


def compare_groups(df: DataFrame, key: str, selected: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """(position, key, means...) of the selected keys in the order picked; a key without rows stays,
    with NULL scores. Every selected key is compared; how many a page shows is the caller's choice."""
    picked = list(selected)
    means = df.filter(F.col(key).isin(*picked)).groupBy(key).agg(*[F.avg(s).alias(s) for s in scores])
    places = df.sparkSession.createDataFrame(list(enumerate(picked, start=1)), f"position int, `{key}` string")
    return places.join(means, key, "left").select("position", key, *scores)


def pair_compare(matrix: DataFrame, key: str, scores: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """(first, second, score, first_value, second_value): every unordered pair of the compared keys.

    ``matrix`` comes from compare_groups: one row per selected key, so the pairs of a score are few.
    """
    labels = dict(scores) if isinstance(scores, Mapping) else {s: s for s in scores}
    long = matrix.select(
        "position",
        F.col(key).alias("_key"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("score"), F.col(c).cast("double").alias("_value"))
                    for c, label in labels.items()
                ]
            )
        ),
    )
    left = long.select(
        F.col("position").alias("_a"), F.col("_key").alias("first"), "score", F.col("_value").alias("first_value")
    )
    right = long.select(
        F.col("position").alias("_b"), F.col("_key").alias("second"), "score", F.col("_value").alias("second_value")
    )
    return left.join(right, "score").filter("_a < _b").select("first", "second", "score", "first_value", "second_value")


def spread(matrix: DataFrame, score: str) -> DataFrame:
    """(low, high, spread) of one score among the compared keys."""
    return matrix.agg(F.min(score).alias("low"), F.max(score).alias("high")).withColumn(
        "spread", F.col("high") - F.col("low")
    )


def mark_extremes(matrix: DataFrame, key: str, scores: Sequence[str], digits: int | None = 2) -> DataFrame:
    """(key, score, value, is_best, is_worst) on rounded values; the worst is marked only where it
    differs from the best."""
    long = matrix.select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("score"),
                        (F.col(s) if digits is None else F.round(s, digits)).alias("value"),
                    )
                    for s in scores
                ]
            )
        ),
    )
    ends = long.groupBy("score").agg(F.max("value").alias("_high"), F.min("value").alias("_low"))
    return long.join(ends, "score").select(
        key,
        "score",
        "value",
        F.coalesce(F.col("value") == F.col("_high"), F.lit(False)).alias("is_best"),
        F.coalesce((F.col("value") == F.col("_low")) & (F.col("_low") != F.col("_high")), F.lit(False)).alias("is_worst"),
    )
