"""Prediction quality: error metrics, sigma bands, probability ellipse, point classes, stored metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("mae", "mse", "rmse", "r2", "n")

Modules = Mapping[str, tuple[str, str]]


def module_columns(df: DataFrame, modules: Sequence[str]) -> dict[str, tuple[str, str]]:
    """module -> (real column, predicted column) for the modules the table has."""
    present = set(df.columns)
    named = {m: (f"{m}_real", f"{m}_pred") for m in modules}
    return {m: c for m, c in named.items() if present.issuperset(c)}


def canonical_global(df: DataFrame, candidates: Sequence[str] = ("global_sbpro", "punt_global_calc_norm")) -> DataFrame:
    """The first candidate column under the name global_real, unless the table has that already."""
    if "global_real" in df.columns:
        return df
    found = next((c for c in candidates if c in df.columns), None)
    return df if found is None else df.withColumnRenamed(found, "global_real")


def melt_predictions(df: DataFrame, modules: Modules, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., module, real, pred): complete pairs of each module."""
    entries = [
        F.struct(
            F.lit(m).alias("module"),
            F.col(real).cast("double").alias("real"),
            F.col(pred).cast("double").alias("pred"),
        )
        for m, (real, pred) in modules.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries))).dropna(subset=["real", "pred"])


def error_metrics(
    df: DataFrame, real: str, pred: str, by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """(by..., n, mae, mse, rmse, r2, bias) on complete pairs, in one pass. The error is real minus
    predicted; r2 is NULL where real does not vary."""
    error = F.col(real) - F.col(pred)
    sums = (
        df.dropna(subset=[real, pred])
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("mse"),
            F.var_pop(real).alias("_var"),
            F.avg(error).alias("bias"),
        )
        .filter(F.col("n") > 0)
    )
    values = {
        "mae": F.col("mae"),
        "mse": F.col("mse"),
        "rmse": F.sqrt("mse"),
        "r2": F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")),
        "bias": F.col("bias"),
    }
    return sums.select(
        *by, "n", *[(v if digits is None else F.round(v, digits)).alias(name) for name, v in values.items()]
    )


def error_metrics_by_module(
    df: DataFrame, modules: Modules, by: Sequence[str] = (), digits: int | None = 4
) -> DataFrame:
    """Error metrics of every module, each on its own complete pairs."""
    return error_metrics(melt_predictions(df, modules, by), "real", "pred", [*by, "module"], digits)


def metrics_by_form(
    df: DataFrame, modules: Modules, form: str, forms: Sequence, metric: str = "mae", digits: int | None = None
) -> DataFrame:
    """One row per module, one column per form."""
    long = error_metrics_by_module(df, modules, [form], digits)
    return long.groupBy("module").pivot(form, list(forms)).agg(F.first(metric))


def _moments(df: DataFrame, real: str, pred: str) -> Column:
    """Scalar struct of everything sigma bands and the ellipse need, from one pass."""
    x, y = F.col(real), F.col(pred)
    error = x - y
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("mu"),
        F.stddev_samp(error).alias("sigma"),
        F.avg(x).alias("x"),
        F.avg(y).alias("y"),
        F.var_samp(x).alias("xx"),
        F.var_samp(y).alias("yy"),
        F.covar_samp(x, y).alias("xy"),
    )
    return row.select(F.struct("*")).scalar()


def _is_sigma_outlier(real: str, pred: str) -> Column:
    error = F.col(real) - F.col(pred)
    return F.coalesce(F.abs(error - F.col("_m.mu")) > 3 * F.col("_m.sigma"), F.lit(False))


def sigma_stats(df: DataFrame, real: str, pred: str) -> DataFrame:
    """One row: n, mean and sample deviation of the error, the +-1, 2, 3 sigma bands, and the number
    and percentage of rows more than 3 sigma from the mean."""
    pairs = df.dropna(subset=[real, pred])
    flagged = pairs.withColumn("_m", _moments(pairs, real, pred))
    # the moments are the same in every row
    counted = flagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.first("_m").alias("_m"),
        F.count_if(_is_sigma_outlier(real, pred)).alias("outliers"),
    )
    mu, sigma = F.col("_m.mu"), F.col("_m.sigma")
    bands = []
    for k in (1, 2, 3):
        bands += [(mu - k * sigma).alias(f"low_{k}"), (mu + k * sigma).alias(f"high_{k}")]
    return counted.filter(F.col("n") > 0).select(
        "n",
        mu.alias("mu"),
        sigma.alias("sigma"),
        *bands,
        "outliers",
        (F.col("outliers") / F.col("n") * 100).alias("outlier_pct"),
    )


def chi2_quantile(level: float) -> float:
    """Quantile of the chi-square distribution with two degrees of freedom."""
    return -2.0 * math.log(1.0 - level)


def ellipse_axes(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    """One row: centre, covariance, semi-axes and the angle of the major axis of the probability
    ellipse. No row with fewer than four complete pairs."""
    pairs = df.dropna(subset=[x, y])
    row = (
        df.sparkSession.range(1)
        .select(_moments(pairs, x, y).alias("_m"))
        .select("_m.n", F.col("_m.x").alias("cx"), F.col("_m.y").alias("cy"), "_m.xx", "_m.xy", "_m.yy")
    )
    half = (F.col("xx") + F.col("yy")) / 2
    root = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    c2 = chi2_quantile(level)
    zero = F.lit(0.0)
    return row.filter(F.col("n") >= 4).withColumns(
        {
            "major": F.sqrt(F.greatest((half + root) * c2, zero)),
            "minor": F.sqrt(F.greatest((half - root) * c2, zero)),
            "angle": F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2,
        }
    )


def ellipse(df: DataFrame, x: str, y: str, level: float = 0.95, points: int = 360) -> DataFrame:
    """(i, x, y): boundary points of the probability ellipse."""
    t = F.col("i") * (2 * math.pi / (points - 1))
    along, across = F.col("major") * F.cos(t), F.col("minor") * F.sin(t)
    cos, sin = F.cos("angle"), F.sin("angle")
    return (
        ellipse_axes(df, x, y, level)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .select(
            "i",
            (F.col("cx") + along * cos - across * sin).alias("x"),
            (F.col("cy") + along * sin + across * cos).alias("y"),
        )
    )


def _is_outside(real: str, pred: str, level: float) -> Column:
    """Squared Mahalanobis distance beyond the chi-square quantile; false when it cannot be computed."""
    dx, dy = F.col(real) - F.col("_m.x"), F.col(pred) - F.col("_m.y")
    xx, xy, yy = F.col("_m.xx"), F.col("_m.xy"), F.col("_m.yy")
    det = xx * yy - xy * xy
    distance = (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det
    return F.coalesce(F.when((F.col("_m.n") >= 4) & (det > 0), distance > chi2_quantile(level)), F.lit(False))


def classify_points(df: DataFrame, real: str, pred: str, level: float = 0.95) -> DataFrame:
    """The complete rows with sigma_outlier, ellipse_outlier and point_class: normal, ellipse_only,
    sigma_only or both. Moments come from all rows, in a pass of their own."""
    pairs = df.dropna(subset=[real, pred])
    flagged = (
        pairs.withColumn("_m", _moments(pairs, real, pred))
        .withColumns(
            {"sigma_outlier": _is_sigma_outlier(real, pred), "ellipse_outlier": _is_outside(real, pred, level)}
        )
        .drop("_m")
    )
    sigma, outside = F.col("sigma_outlier"), F.col("ellipse_outlier")
    return flagged.withColumn(
        "point_class",
        F.when(sigma & outside, F.lit("both"))
        .when(sigma, F.lit("sigma_only"))
        .when(outside, F.lit("ellipse_only"))
        .otherwise(F.lit("normal")),
    )


def point_classes(df: DataFrame, real: str, pred: str, level: float = 0.95) -> DataFrame:
    """(point_class, n)."""
    return classify_points(df, real, pred, level).groupBy("point_class").agg(F.count(F.lit(1)).alias("n"))


def sample_points(df: DataFrame, keys: Sequence[str], n: int | None, seed: int = 42) -> DataFrame:
    """At most n rows (all with None), the same ones every time for a seed: those with the lowest MD5 of
    seed and keys as text."""
    if n is None:
        return df
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(name), *keys).limit(n)


def explode_metrics(df: DataFrame, metrics: str, levels: Sequence[str]) -> DataFrame:
    """Nested metric maps to rows (levels..., mae, mse, rmse, r2); a missing mse is rmse squared.

    ``metrics`` holds a map per level down to a struct: two levels are form -> target, three are
    method -> form -> target.
    """
    rows = df.select(F.col(metrics).alias("_map"))
    for i, level in enumerate(levels):
        rows = rows.select(*levels[:i], F.explode("_map").alias(level, "_map"))
    return rows.select(
        *levels,
        F.col("_map.mae").alias("mae"),
        F.coalesce("_map.mse", F.col("_map.rmse") * F.col("_map.rmse")).alias("mse"),
        F.col("_map.rmse").alias("rmse"),
        F.col("_map.r2").alias("r2"),
    )


def compare_metrics(
    metrics: DataFrame, row: str, across: str, values: Sequence[str], metric: str = "mae"
) -> DataFrame:
    """One row per target and per value of every other level, one column per method or form.

    Levels are the columns of ``metrics`` besides ``row``, ``across`` and the metrics, whatever their type. A cell is
    one row of the table, so the greatest of its values is that value; were there more, it would still not depend on
    their order.
    """
    levels = [c for c in metrics.columns if c not in (row, across, metric, *METRICS)]
    return metrics.groupBy(row, *levels).pivot(across, list(values)).agg(F.max(metric))


def stored_or_computed(
    stored: DataFrame, computed: DataFrame, keys: Sequence[str], values: Sequence[str] = ("mae", "mse")
) -> DataFrame:
    """Metrics per key from the stored table where it has them, else those computed from rows; keys
    that only one of them knows are kept."""
    known = stored.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return computed.join(known, list(keys), "full").select(
        *keys, *[F.coalesce(f"_{v}", v).alias(v) for v in values]
    )


def choose_k(sweep: DataFrame, by: Sequence[str] = ("form",), k: str = "k", mae: str = "mae_val") -> DataFrame:
    """The sweep with ``chosen``: the k of least validation error, the smaller one when equal. Where the
    sweep has the ``stored_choice`` of its file, ``agrees`` tells whether that is the same k.

    The window is over one row per k of a form.
    """
    best = F.min_by(k, F.struct(F.col(mae), F.col(k))).over(Window.partitionBy(*by))
    stored = [c for c in ("stored_choice",) if c in sweep.columns]
    rows = sweep.withColumn("_k", best)
    agrees = [(F.col(c) == F.col("_k")).alias("agrees") for c in stored]
    return rows.select(*by, k, mae, (F.col(k) == F.col("_k")).alias("chosen"), *stored, *agrees)
