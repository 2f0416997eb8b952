"""Cross-tables: transitions, conditional shares, flag co-occurrence and dense grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.filters import keep_levels


def grid(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the declared values, in a table of its own."""
    cells = df.sparkSession.range(1).select(F.lit(0).alias("_seed"))
    for name, values in domains.items():
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return cells.drop("_seed")


def dense(df: DataFrame, domains: Mapping[str, Sequence], fill: Mapping[str, object]) -> DataFrame:
    """An aggregated table with a row for every declared combination; gaps take the fill values."""
    keys = list(domains)
    filled = grid(df, domains).join(df, keys, "left")
    return filled.fillna({c: v for c, v in fill.items() if v is not None})


def transition(
    df: DataFrame, a: str, b: str, levels_a: Sequence[str], levels_b: Sequence[str], digits: int | None = None
) -> DataFrame:
    """(from_level, to_level, n, pct): pct is the share within the from-level, 0 in empty cells.

    Answers outside the declared levels are left out, so the table never has more cells than the
    two level lists allow.
    """
    counted = (
        keep_levels(df.select(a, b), {a: levels_a, b: levels_b})
        .groupBy(F.col(a).alias("from_level"), F.col(b).alias("to_level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return dense(
        row_percent(counted, ["from_level"], digits),
        {"from_level": levels_a, "to_level": levels_b},
        {"n": 0, "pct": 0.0},
    )


def row_percent(counted: DataFrame, row: Sequence[str], digits: int | None = None) -> DataFrame:
    """Share of each count within its row, for a table that is already aggregated to few cells."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*row)) * 100
    return counted.withColumn("pct", share if digits is None else F.round(share, digits))


def conditional_share(
    df: DataFrame, target: str, given: Mapping[str, str | None], digits: int | None = 2
) -> DataFrame:
    """(value, n, probability, most_likely): distribution of the target among the rows that meet
    every given answer. At least one answer must be set. The mode is the highest (rounded)
    probability; ties go by value."""
    wanted = {c: v for c, v in given.items() if v}
    if not wanted:
        raise ValueError("conditional_share needs at least one given answer")
    rows = df
    for c, value in wanted.items():
        rows = rows.filter(F.col(c) == F.lit(value))
    counted = (
        rows.select(F.col(target).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per answer, so one task holds them
    answers = Window.partitionBy(F.lit(1))
    share = F.col("n") / F.sum("n").over(answers) * 100
    shares = counted.withColumn("probability", share if digits is None else F.round(share, digits))
    first = F.row_number().over(answers.orderBy(F.desc("probability"), "value"))
    return shares.withColumn("most_likely", first == 1)


def _count_true(condition: Column) -> Column:
    return F.count_if(condition)


def flag_totals(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """(flag, n): rows where each flag is true. ``flags`` maps boolean column to label."""
    totals = df.agg(*[_count_true(F.col(c)).alias(f"_{i}") for i, c in enumerate(flags)])
    entries = [
        F.struct(F.lit(label).alias("flag"), F.col(f"_{i}").alias("n")) for i, label in enumerate(flags.values())
    ]
    return totals.select(F.inline(F.array(*entries)))


def flag_cooccurrence(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """(flag_a, flag_b, n): rows where both flags are true, for every pair and each with itself.

    One pass: the counts are conditional sums of a single aggregation.
    """
    columns = list(flags)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    counts = df.agg(
        *[_count_true(F.col(columns[i]) & F.col(columns[j])).alias(f"_{i}_{j}") for i, j in pairs]
    )
    labels = list(flags.values())
    entries = [
        F.struct(
            F.lit(labels[i]).alias("flag_a"),
            F.lit(labels[j]).alias("flag_b"),
            F.col(f"_{min(i, j)}_{max(i, j)}").alias("n"),
        )
        for i in range(len(columns))
        for j in range(len(columns))
    ]
    return counts.select(F.inline(F.array(*entries)))


def flag_by_group(df: DataFrame, group: str, flags: Mapping[str, str], missing: str = "No reporta") -> DataFrame:
    """One row per group with the true-count of each flag, a column per label."""
    name = F.coalesce(F.col(group).cast("string"), F.lit(missing)).alias(group)
    return df.groupBy(name).agg(*[_count_true(F.col(c)).alias(label) for c, label in flags.items()])
