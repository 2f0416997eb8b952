"""Equal-width histograms and 2-D densities; the last bin is closed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.classes import band
from cohortia.functions.numbers import nan_to_null


def _limits(df: DataFrame, columns: Sequence[str], clip: tuple[float, float] | None = None) -> Column:
    """Scalar struct with the low and high end of every column; a constant column gets +-0.5."""
    ends = []
    for i, c in enumerate(columns):
        low, high = F.min(c).cast("double"), F.max(c).cast("double")
        if clip:
            low = F.when(low.isNotNull(), F.greatest(low, F.lit(float(clip[0]))))
            high = F.when(high.isNotNull(), F.least(high, F.lit(float(clip[1]))))
        ends += [low.alias(f"low{i}"), high.alias(f"high{i}")]
    widened = []
    for i in range(len(columns)):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
        widened += [(low - half).alias(f"low{i}"), (high + half).alias(f"high{i}")]
    return df.agg(*ends).select(F.struct(*widened)).scalar()


def _with_bin(df: DataFrame, name: str, value: str, low: str, high: str, bins: str | int) -> DataFrame:
    """0-based bin of a value inside [low, high]; the edges low + i * width decide, so a value that
    rounding put on the wrong side of its edge is moved."""
    value, low, high = F.col(value), F.col(low), F.col(high)
    bins = F.lit(bins) if isinstance(bins, int) else F.col(bins)
    guess, width = F.col("_guess"), (high - low) / bins
    too_high = (value < low + guess * width).cast("int")
    too_low = ((value >= low + (guess + 1) * width) & (guess < bins - 1)).cast("int")
    return (
        df.withColumn("_guess", F.least(F.floor((value - low) / (high - low) * bins), bins - 1))
        .withColumn(name, (guess - too_high + too_low).cast("int"))
        .drop("_guess")
    )


def histogram(df: DataFrame, c: str, bins: int, clip: tuple[float, float] | None = None) -> DataFrame:
    """(bin, low, high, n) with every bin present; no rows when there are no values."""
    return histograms(df, {c: bins}, clip).drop("field")


def histograms(df: DataFrame, columns: Mapping[str, int], clip: tuple[float, float] | None = None) -> DataFrame:
    """(field, bin, low, high, n): histograms of several columns from one pass for the limits and
    one for the counts. ``columns`` maps column to number of bins."""
    names = list(columns)
    values = df.select(*[nan_to_null(c).alias(c) for c in names])
    ends = _limits(values, names, clip)

    def frames(*extra) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(c).alias("field"),
                    F.lit(columns[c]).alias("_bins"),
                    F.col(f"_ends.low{i}").alias("_low"),
                    F.col(f"_ends.high{i}").alias("_high"),
                    *[e(c) for e in extra],
                )
                for i, c in enumerate(names)
            ]
        )

    long = values.withColumn("_ends", ends).select(F.inline(frames(lambda c: F.col(c).alias("_v"))))
    inside = long.filter(F.col("_v").between(F.col("_low"), F.col("_high")))
    counted = (
        _with_bin(inside, "bin", "_v", "_low", "_high", "_bins")
        .groupBy("field", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_high") - F.col("_low")) / F.col("_bins")
    grid = (
        df.sparkSession.range(1)
        .select(ends.alias("_ends"))
        .select(F.inline(frames()))
        .filter(F.col("_low").isNotNull())
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
        .select(
            "field",
            "bin",
            (F.col("_low") + F.col("bin") * width).alias("low"),
            (F.col("_low") + (F.col("bin") + 1) * width).alias("high"),
        )
    )
    return grid.join(counted, ["field", "bin"], "left").select(
        "field", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def banded_histogram(
    df: DataFrame,
    c: str,
    bins: int,
    edges: Sequence[float],
    labels: Sequence[str],
    clip: tuple[float, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(band, bin, low, n): counts on bins shared by all bands, non-empty cells only. ``weight`` is how many rows a row
    stands for."""
    rows = F.lit(1) if weight is None else F.col(weight)
    values = df.select(nan_to_null(c).alias("_v"), rows.cast("long").alias("_n")).filter(F.col("_v").isNotNull())
    limits = _limits(values, ["_v"], clip)
    inside = (
        values.withColumn("_ends", limits)
        .select("_v", "_n", F.col("_ends.low0").alias("_low"), F.col("_ends.high0").alias("_high"))
        .filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        .withColumn("band", band("_v", edges, labels))
        .filter(F.col("band").isNotNull())
    )
    # the limits are the same in every row
    return (
        _with_bin(inside, "bin", "_v", "_low", "_high", bins)
        .groupBy("band", "bin", "_low", "_high")
        .agg(F.sum("_n").alias("n"))
        .select(
            "band", "bin", (F.col("_low") + F.col("bin") * ((F.col("_high") - F.col("_low")) / bins)).alias("low"), "n"
        )
    )


def density2d(df: DataFrame, x: str, y: str, bins: int = 45) -> DataFrame:
    """(x_bin, y_bin, x_mid, y_mid, n): non-empty cells of the 2-D histogram of complete pairs."""
    values = df.select(nan_to_null(x).alias("_x"), nan_to_null(y).alias("_y")).dropna()
    ends = ["_x_low", "_x_high", "_y_low", "_y_high"]
    names = ["low0", "high0", "low1", "high1"]
    ranged = values.withColumn("_ends", _limits(values, ["_x", "_y"])).select(
        "_x", "_y", *[F.col(f"_ends.{n}").alias(e) for n, e in zip(names, ends, strict=True)]
    )
    binned = _with_bin(_with_bin(ranged, "x_bin", "_x", "_x_low", "_x_high", bins), "y_bin", "_y", "_y_low", "_y_high", bins)

    def mid(axis: str) -> Column:
        low, high = F.col(f"_{axis}_low"), F.col(f"_{axis}_high")
        return (low + (F.col(f"{axis}_bin") + 0.5) * ((high - low) / bins)).alias(f"{axis}_mid")

    # the limits are the same in every row
    return (
        binned.groupBy("x_bin", "y_bin", *ends)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("x_bin", "y_bin", mid("x"), mid("y"), "n")
    )


def histogram_summary(hist: DataFrame) -> DataFrame:
    """(cases, mean, peak, first, last) of a histogram, on its bin centres; a tie for the peak goes
    to the lower bin."""
    centres = hist.withColumn("_mid", (F.col("low") + F.col("high")) / 2)
    return centres.agg(
        F.sum("n").alias("cases"),
        (F.sum(F.col("_mid") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min_by("_mid", F.struct(-F.col("n"), F.col("_mid"))).alias("peak"),
        F.min("_mid").alias("first"),
        F.max("_mid").alias("last"),
    )
