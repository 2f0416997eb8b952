"""Exact ranks and quantiles of a column of any size.

A global rank needs the number of smaller values. Values are first reduced to counts, then cut into
value ranges by approximate quantiles; running sums inside the ranges plus the totals of the lower
ranges give exact numbers, and no task sees more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# only how evenly the work is cut depends on these
SKETCH_ACCURACY = 10
SAMPLE_SHARE = 0.01
SAMPLE_SEED = 7


def range_edges(df: DataFrame, value: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by..., _edges): edges that cut the values of each group into ranges of about equal row counts.

    Approximate quantiles of a sample, from one sketching pass without a shuffle of rows. A range holds
    about rows / ranges rows, so at most that many distinct values. Where exactly the edges fall, or that
    a group has none, has no effect on results. One row per group; nothing comes to the driver.
    """
    if ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probes = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(F.col(value).cast("double"), probes, SKETCH_ACCURACY * ranges)
    known = df.sample(SAMPLE_SHARE, SAMPLE_SEED).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(*by).agg(F.array_sort(F.array_distinct(sketch)).alias("_edges"))


def _range_number(value: Column, edges: Column, most: int) -> Column:
    """How many of at most ``most`` edges lie below the value, by binary search; 0 without edges."""
    steps = [2**i for i in reversed(range(most.bit_length()))]

    def probe(found: Column, width: Column) -> Column:
        ahead = found + width
        return F.when((ahead <= F.size(edges)) & (F.get(edges, ahead - 1) < value), ahead).otherwise(found)

    return F.coalesce(F.reduce(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe), F.lit(0))


def cumulative_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """(by..., value, n, before, total): distinct values with their count, the number of rows with a
    smaller value, and the rows of the group. NULL and NaN are left out.

    ``weight`` is how many rows a row stands for. Distinct values are cut at the edges of their group,
    which come by a join, so the number of groups is free; nothing runs until the result is used.
    """
    by = list(by)
    if ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(*by, F.col(value).cast("double").alias(value), *([weight] if weight else [])).filter(
        F.col(value).isNotNull() & ~F.isnan(value)
    )
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.groupBy(*by, value).agg(size.alias("n"))
    edges = range_edges(rows, value, by, ranges)
    if by:
        renamed = edges.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_edges")
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
        placed = counts.join(renamed, reduce(and_, same), "left")
    else:
        placed = counts.withColumn("_edges", edges.scalar())
    placed = placed.withColumn("_range", _range_number(F.col(value), F.col("_edges"), ranges)).select(*by, value, "n", "_range")
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most ``ranges`` rows per group
    totals = (
        placed.groupBy(*by, "_range")
        .agg(F.sum("n").alias("_n"))
        .select(
            *[F.col(c).alias(f"_of_{c}") for c in by],
            F.col("_range").alias("_of_range"),
            F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"),
            F.sum("_n").over(Window.partitionBy(*by)).alias("total"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_range") == F.col("_of_range")]
    return running.join(totals, reduce(and_, same)).select(
        *by, value, "n", (F.col("_inside") + F.col("_lower")).alias("before"), "total"
    )


def average_rank(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """(by..., value, n, rank, total): 1-based rank of each distinct value, ties sharing the mean."""
    return cumulative_counts(df, value, by, weight, ranges).select(
        *by, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total"
    )


def quantiles(
    df: DataFrame, value: str, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., q, edge, total): the n + 1 exact n-quantile edges, with linear interpolation.

    Edge i sits at position i (total - 1) / n of the sorted rows; whole-number arithmetic keeps
    positions that fall on a row exact.
    """
    by = list(by)
    counts = cumulative_counts(df, value, by)
    # edges i with i (total - 1) / n in (before - 1, before + count) are those a value can hold
    last = F.greatest(F.col("total") - 1, F.lit(1))
    low = F.greatest(F.ceil((F.col("before") - 1) * n / last) - 1, F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("before") + F.col("n")) * n / last) + 1, F.lit(n)).cast("int")
    high = F.when(F.col("total") == 1, F.lit(n)).otherwise(high)
    held = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    positions = counts.withColumn("q", F.explode(held)).withColumns(
        {
            "_low": F.floor(F.col("q") * (F.col("total") - 1) / n),
            "_rest": (F.col("q") * (F.col("total") - 1)) % n,
        }
    )
    positions = positions.withColumn("_high", F.when(F.col("_rest") > 0, F.col("_low") + 1).otherwise(F.col("_low")))

    def holds(position: str) -> Column:
        return (F.col("before") <= F.col(position)) & (F.col(position) < F.col("before") + F.col("n"))

    edge = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rest") / n)
    return (
        positions.filter(holds("_low") | holds("_high"))
        .groupBy(*by, "q", "_rest", "total")
        .agg(
            F.max(F.when(holds("_low"), F.col(value))).alias("_a"),
            F.max(F.when(holds("_high"), F.col(value))).alias("_b"),
        )
        .select(*by, "q", edge.alias("edge"), "total")
    )
