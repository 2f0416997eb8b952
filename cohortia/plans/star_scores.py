"""Queries on paired scores, correlations, histograms and prediction quality.

Paired scores are order price (earlier) and line price (later), year is the order year. Predictions
are line prices against quantity times retail price; form is the line status, split the return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions import classes
from cohortia.operators import histogram, link, paired, prediction
from cohortia.plans.registry import query, table
from cohortia.plans.star_tables import rounded
from cohortia.sources import readers


def later_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with three scores on a 0-1 scale; the link key is the line's order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        (F.col("l_extendedprice") / 100000).alias("price"),
        (F.col("l_quantity") / 50).alias("quantity"),
        F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 10).alias("tax"),
    )


def earlier_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000).alias("price"),
        (F.dayofmonth("o_orderdate") / 31).alias("day"),
    )


def paired_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = earlier_scores(spark, folder)
    keys = orders.select(F.col("key").alias("later"), F.col("key").alias("earlier"))
    return link.pair(later_scores(spark, folder), keys, orders, "key", "key", "later", "earlier", "_before")


PAIRED_SQL = """pairs AS (SELECT l_extendedprice / 100000 AS price, l_quantity / 50 AS quantity,
    CASE WHEN l_tax > 0.01 THEN l_tax * 10 END AS tax, year(o_orderdate)::INT AS year_before,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS price_before, day(o_orderdate) / 31.0::DOUBLE AS day_before
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAIRS = {"Price": ("price", "price_before"), "Quantity": ("quantity", "day_before"), "Tax": ("tax", "day_before")}
# the earlier price has gaps, which its fallback fills
FALLBACK = {"Price": "day_before"}
LONG_SQL = f"""{PAIRED_SQL}, long AS (SELECT 'Price' AS label, year_before, price AS y, price_before AS x FROM pairs
    UNION ALL SELECT 'Quantity', year_before, quantity, day_before FROM pairs
    UNION ALL SELECT 'Tax', year_before, tax, day_before FROM pairs),
    complete AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL)"""
FILLED_SQL = LONG_SQL.replace("price AS y, price_before AS x", "price AS y, coalesce(price_before, day_before) AS x")
CONTRIBUTION_SQL = f"""{FILLED_SQL}, contribution AS (
    SELECT year_before, label, (avg(y) - avg(x)) * 100 AS value FROM complete GROUP BY ALL)"""


@query(
    f"WITH {PAIRED_SQL} SELECT year_before, round(price, 9) AS price, round(price_before, 9) AS price_before, round(quantity, 9) AS quantity FROM pairs"
)
def paired_join(spark, folder):
    rows = paired_rows(spark, folder).select("year_before", "price", "price_before", "quantity")
    return rounded(rows, "price", "price_before", "quantity", digits=9)


@query(
    f"""WITH {PAIRED_SQL} SELECT year_before, round(avg(price_before), 6) AS x_mean, round(avg(price), 6) AS y_mean
    FROM pairs GROUP BY ALL"""
)
def paired_trend(spark, folder):
    trend = paired.paired_trend(paired_rows(spark, folder), "year_before", "price_before", "price")
    return rounded(trend, "x_mean", "y_mean")


@query(
    f"WITH {LONG_SQL} SELECT year_before, label, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM long GROUP BY ALL"
)
def paired_trends(spark, folder):
    return rounded(paired.paired_trends(paired_rows(spark, folder), "year_before", PAIRS), "x_mean", "y_mean")


@query(
    f"""WITH {CONTRIBUTION_SQL} SELECT year_before, round(max(value) FILTER (label = 'Price'), 5) AS "Price",
      round(max(value) FILTER (label = 'Quantity'), 5) AS "Quantity", round(max(value) FILTER (label = 'Tax'), 5) AS "Tax"
    FROM contribution GROUP BY ALL"""
)
def contribution_matrix(spark, folder):
    matrix = paired.contribution_matrix(paired_rows(spark, folder), "year_before", PAIRS, FALLBACK)
    return rounded(matrix, *PAIRS, digits=5)


@query(
    f"""WITH {CONTRIBUTION_SQL}, m AS (SELECT label, avg(value) AS m FROM contribution WHERE label <> 'Price' GROUP BY ALL)
    SELECT round((SELECT avg(value) FROM contribution WHERE label = 'Price'), 5) AS main_mean, arg_max(label, m) AS best_label,
      round(max(m), 5) AS best_label_mean, (SELECT arg_max(year_before, value) FROM contribution WHERE label = 'Price') AS best_year,
      (SELECT round(max(value), 5) FROM contribution WHERE label = 'Price') AS best_year_value FROM m"""
)
def contribution_kpi(spark, folder):
    long = paired.contribution(paired_rows(spark, folder), "year_before", PAIRS, FALLBACK)
    kpis = paired.contribution_kpis(long, "year_before", ["Price"], "Price")
    return rounded(kpis, "main_mean", "best_label_mean", "best_year_value", digits=5)


@query(
    f"""WITH {LONG_SQL}, ranked AS (SELECT label, x, y,
        rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry FROM complete)
    SELECT label, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman,
      CASE WHEN abs(corr(x, y)) >= 0.7 THEN 'strong' WHEN abs(corr(x, y)) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength
    FROM ranked GROUP BY ALL"""
)
def corr_table(spark, folder):
    return rounded(paired.correlations(paired_rows(spark, folder), PAIRS), "pearson", "spearman")


@query(
    """SELECT l_extendedprice AS value, count(*) AS n, any_value(r) + (count(*) - 1) / 2.0::DOUBLE AS rank,
      (SELECT count(*) FROM lineitem) AS total
    FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY ALL"""
)
def average_rank(spark, folder):
    from cohortia.operators.ordering import average_rank as ranks

    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return ranks(rows, "value")


@query(
    """WITH q AS (SELECT o_orderstatus, count(*) AS total, quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e
      FROM orders GROUP BY ALL)
    SELECT o_orderstatus, (i - 1)::INT AS q, round(e[i], 4) AS edge, total FROM q, range(1, 12) t(i)"""
)
def quantile_edges(spark, folder):
    from cohortia.operators.ordering import quantiles

    edges = quantiles(table(spark, folder, "orders"), "o_totalprice", 10, ["o_orderstatus"])
    return rounded(edges, "edge", digits=4)


@query(
    f"""WITH {LONG_SQL}, p AS (SELECT x, y FROM complete WHERE label = 'Price'),
    e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS ex, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS ey FROM p),
    b AS (SELECT (1 + (x > ex[1])::INT + (x > ex[2])::INT + (x > ex[3])::INT + (x > ex[4])::INT) AS from_bin,
                 (1 + (y > ey[1])::INT + (y > ey[2])::INT + (y > ey[3])::INT + (y > ey[4])::INT) AS to_bin FROM p, e),
    c AS (SELECT from_bin, to_bin, count(*) AS n FROM b GROUP BY ALL)
    SELECT from_bin, to_bin, n, round(n * 100.0 / sum(n) OVER (PARTITION BY from_bin), 6)::DOUBLE AS pct, 5 AS from_bins, 5 AS to_bins FROM c"""
)
def quintile_transition(spark, folder):
    return rounded(paired.quantile_transition(paired_rows(spark, folder), "price_before", "price", 5), "pct")


@query(
    f"""WITH {PAIRED_SQL} SELECT count(*) AS n, round(avg(price - price_before), 6) + 0.0 AS mean FROM pairs WHERE price_before IS NOT NULL"""
)
def delta_summary(spark, folder):
    return rounded(paired.delta_summary(paired_rows(spark, folder), "price_before", "price"), "mean")


def histogram_sql(source: str, column: str, bins: int, extra: str = "") -> str:
    """Bins of one column as NumPy cuts them: edges decide, the last bin is closed."""
    return f"""v AS (SELECT {column} AS v FROM {source} WHERE ({column}) IS NOT NULL {extra}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    g AS (SELECT v, lo, hi, (hi - lo) / {bins} AS w, least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS b FROM v, m),
    c AS (SELECT (b - (v < lo + b * w)::INT + (v >= lo + (b + 1) * w AND b < {bins - 1})::INT) AS bin, count(*) AS n FROM g GROUP BY ALL),
    h AS (SELECT t.bin::INT AS bin, lo + t.bin * ((hi - lo) / {bins}) AS low, lo + (t.bin + 1) * ((hi - lo) / {bins}) AS high, coalesce(n, 0) AS n
      FROM range(0, {bins}) t(bin) CROSS JOIN m LEFT JOIN c ON c.bin = t.bin)"""


@query(
    f"WITH {PAIRED_SQL}, {histogram_sql('pairs', 'price - price_before', 50)} SELECT bin, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, n FROM h"
)
def delta_histogram(spark, folder):
    return rounded(paired.delta_histogram(paired_rows(spark, folder), "price_before", "price", 50), "low", "high")


@query(f"WITH {histogram_sql('orders', 'o_totalprice', 40)} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM h")
def histogram_bins(spark, folder):
    return rounded(histogram.histogram(table(spark, folder, "orders"), "o_totalprice", 40), "low", "high")


@query(
    f"""SELECT 'l_quantity' AS field, * FROM (WITH {histogram_sql('lineitem', 'l_quantity', 35)} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM h)
    UNION ALL SELECT 'l_extendedprice', * FROM (WITH {histogram_sql('lineitem', 'l_extendedprice', 60)} SELECT bin, round(low, 6), round(high, 6), n FROM h)"""
)
def histograms(spark, folder):
    many = histogram.histograms(table(spark, folder, "lineitem"), {"l_quantity": 35, "l_extendedprice": 60})
    return rounded(many, "low", "high")


@query(
    f"""WITH {histogram_sql('orders', 'o_totalprice', 40)}, s AS (SELECT (low + high) / 2 AS mid, n FROM h)
    SELECT sum(n)::BIGINT AS cases, round(sum(mid * n) / sum(n), 4) AS mean, round(first(mid ORDER BY n DESC, mid), 4) AS peak,
      round(min(mid), 4) AS first, round(max(mid), 4) AS last FROM s"""
)
def histogram_summary(spark, folder):
    hist = histogram.histogram(table(spark, folder, "orders"), "o_totalprice", 40)
    return rounded(histogram.histogram_summary(hist), "mean", "peak", "first", "last", digits=4)


@query(
    """WITH v AS (SELECT c_acctbal / 100 AS v FROM customer), m AS (SELECT greatest(min(v), 0) AS lo, least(max(v), 100) AS hi FROM v),
    g AS (SELECT v, lo, hi, (hi - lo) / 40 AS w, least(floor((v - lo) / (hi - lo) * 40), 39)::INT AS b FROM v, m WHERE v BETWEEN lo AND hi)
    SELECT CASE WHEN v < 41.1 THEN 'Bajo' WHEN v < 51.2 THEN 'Medio-bajo' WHEN v < 64.1 THEN 'Medio-alto' ELSE 'Alto' END AS band,
      (b - (v < lo + b * w)::INT + (v >= lo + (b + 1) * w AND b < 39)::INT)::INT AS bin,
      round(lo + (b - (v < lo + b * w)::INT + (v >= lo + (b + 1) * w AND b < 39)::INT) * w, 4) AS low, count(*) AS n FROM g GROUP BY ALL"""
)
def banded_histogram(spark, folder):
    from cohortia.plans.constants import INDEX_EDGES, INDEX_LABELS

    rows = table(spark, folder, "customer").select((F.col("c_acctbal") / 100).alias("v"))
    return rounded(histogram.banded_histogram(rows, "v", 40, INDEX_EDGES, INDEX_LABELS, (0.0, 100.0)), "low", digits=4)


def density_sql(bins: int) -> str:
    def cut(v: str) -> str:
        b = f"least(floor(({v} - {v}lo) / ({v}hi - {v}lo) * {bins}), {bins - 1})::INT"
        w = f"(({v}hi - {v}lo) / {bins})"
        return f"({b} - ({v} < {v}lo + {b} * {w})::INT + ({v} >= {v}lo + ({b} + 1) * {w} AND {b} < {bins - 1})::INT)::INT"

    return f"""d AS (SELECT x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
    m AS (SELECT min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi FROM d),
    b AS (SELECT {cut('x')} AS x_bin, {cut('y')} AS y_bin, xlo, xhi, ylo, yhi FROM d, m)
    SELECT x_bin, y_bin, round(xlo + (x_bin + 0.5) * (xhi - xlo) / {bins}, 6) AS x_mid,
      round(ylo + (y_bin + 0.5) * (yhi - ylo) / {bins}, 6) AS y_mid, count(*) AS n FROM b GROUP BY ALL"""


@query(f"WITH {PAIRED_SQL}, p AS (SELECT price_before AS x, price AS y FROM pairs), {density_sql(45)}")
def density2d(spark, folder):
    return rounded(histogram.density2d(paired_rows(spark, folder), "price_before", "price", 45), "x_mid", "y_mid")


# ---- prediction quality --------------------------------------------------------------------------

MODULES = {"price": ("price_real", "price_pred"), "quantity": ("quantity_real", "quantity_pred")}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Line price (in thousands) against quantity times retail price, with a gap in every eleventh
    line; quantity against a tenth of the part size times eight."""
    rows = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    estimate = F.col("l_quantity") * F.col("p_retailprice") / 1000
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linestatus").alias("form"),
        F.col("l_returnflag").alias("split"),
        (F.col("l_extendedprice") / 1000).alias("price_real"),
        F.when(F.col("l_orderkey") % 11 != 0, estimate).alias("price_pred"),
        F.col("l_quantity").alias("quantity_real"),
        (F.col("p_size") * 0.8).alias("quantity_pred"),
    )


PREDICTIONS_SQL = """pred AS (SELECT l_orderkey, l_linenumber, l_linestatus AS form, l_returnflag AS split, l_extendedprice / 1000 AS price_real,
    CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity * p_retailprice / 1000 END AS price_pred, l_quantity AS quantity_real,
    p_size * 0.8::DOUBLE AS quantity_pred FROM lineitem JOIN part ON l_partkey = p_partkey),
    modules AS (SELECT form, split, 'price' AS module, price_real AS real, price_pred AS pred FROM pred WHERE price_pred IS NOT NULL
      UNION ALL SELECT form, split, 'quantity', quantity_real, quantity_pred FROM pred)"""


def metrics_sql(digits: int) -> str:
    return f"""count(*) AS n, round(avg(abs(real - pred)), {digits}) AS mae, round(avg(power(real - pred, 2)), {digits}) AS mse,
      round(sqrt(avg(power(real - pred, 2))), {digits}) AS rmse,
      round(1 - avg(power(real - pred, 2)) / var_pop(real), {digits}) + 0.0 AS r2, round(avg(real - pred), {digits}) + 0.0 AS bias"""


METRIC_NAMES = ("mae", "mse", "rmse", "r2", "bias")


@query(f"WITH {PREDICTIONS_SQL} SELECT {metrics_sql(6)} FROM modules WHERE module = 'price' AND split = 'A'")
def error_metrics(spark, folder):
    rows = predictions(spark, folder).filter("split = 'A'")
    return rounded(prediction.error_metrics(rows, "price_real", "price_pred"), *METRIC_NAMES)


@query(f"WITH {PREDICTIONS_SQL} SELECT form, module, {metrics_sql(4)} FROM modules GROUP BY ALL")
def error_metrics_by_module(spark, folder):
    return rounded(
        prediction.error_metrics_by_module(predictions(spark, folder), MODULES, ["form"]), *METRIC_NAMES, digits=4
    )


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT module, round(avg(power(real - pred, 2)) FILTER (form = 'F'), 6) AS "F",
      round(avg(power(real - pred, 2)) FILTER (form = 'O'), 6) AS "O" FROM modules WHERE split = 'R' GROUP BY ALL"""
)
def metrics_by_form(spark, folder):
    test = predictions(spark, folder).filter("split = 'R'")
    return rounded(prediction.metrics_by_form(test, MODULES, "form", ["F", "O"], "mse"), "F", "O")


@query(
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT module, 1 - avg(power(real - pred, 2)) / var_pop(real) AS r2 FROM modules GROUP BY ALL)
    SELECT module, CASE WHEN r2 >= 0.7 THEN 'very_good' WHEN r2 >= 0.4 THEN 'moderate' WHEN r2 >= 0 THEN 'poor' ELSE 'worse_than_mean' END AS fit FROM m"""
)
def fit_classes(spark, folder):
    metrics = prediction.error_metrics_by_module(predictions(spark, folder), MODULES, digits=None)
    return metrics.select("module", classes.fit_class("r2").alias("fit"))


PRICE_SQL = f"{PREDICTIONS_SQL}, p AS (SELECT *, price_real - price_pred AS e FROM pred WHERE price_pred IS NOT NULL)"


@query(
    f"""WITH {PRICE_SQL}, s AS (SELECT avg(e) AS mu, stddev_samp(e) AS sd FROM p)
    SELECT count(*) AS n, round(any_value(mu), 6) + 0.0 AS mu, round(any_value(sd), 6) AS sigma,
      round(any_value(mu - sd), 6) AS low_1, round(any_value(mu + sd), 6) AS high_1, round(any_value(mu - 2 * sd), 6) AS low_2,
      round(any_value(mu + 2 * sd), 6) AS high_2, round(any_value(mu - 3 * sd), 6) AS low_3, round(any_value(mu + 3 * sd), 6) AS high_3,
      count(*) FILTER (abs(e - mu) > 3 * sd) AS outliers, round(count(*) FILTER (abs(e - mu) > 3 * sd) * 100.0 / count(*), 6)::DOUBLE AS outlier_pct FROM p, s"""
)
def sigma_bands(spark, folder):
    stats = prediction.sigma_stats(predictions(spark, folder), "price_real", "price_pred")
    names = [c for c in stats.columns if c not in ("n", "outliers")]
    return rounded(stats, *names)


MOMENTS_SQL = f"""{PRICE_SQL}, m AS (SELECT count(*) AS n, avg(price_real) AS cx, avg(price_pred) AS cy, var_samp(price_real) AS xx,
    covar_samp(price_real, price_pred) AS xy, var_samp(price_pred) AS yy, avg(e) AS mu, stddev_samp(e) AS sd FROM p)"""
CLASSES_SQL = f"""{MOMENTS_SQL}, d AS (SELECT p.*, abs(e - mu) > 3 * sd AS s,
    (yy * power(price_real - cx, 2) - 2 * xy * (price_real - cx) * (price_pred - cy) + xx * power(price_pred - cy, 2)) / (xx * yy - xy * xy)
      > -2 * ln(1 - 0.95) AS o FROM p, m),
    classed AS (SELECT *, CASE WHEN s AND o THEN 'both' WHEN s THEN 'sigma_only' WHEN o THEN 'ellipse_only' ELSE 'normal' END AS point_class FROM d)"""


@query(
    f"""WITH {MOMENTS_SQL} SELECT n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(xx, 5) AS xx, round(xy, 5) + 0.0 AS xy, round(yy, 5) AS yy,
      round(sqrt(((xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy)) * -2 * ln(1 - 0.9)), 5) AS major,
      round(sqrt(((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy)) * -2 * ln(1 - 0.9)), 5) AS minor,
      round(atan2(2 * xy, xx - yy) / 2, 5) + 0.0 AS angle FROM m"""
)
def ellipse_axes(spark, folder):
    axes = prediction.ellipse_axes(predictions(spark, folder), "price_real", "price_pred", 0.9)
    return rounded(axes, *[c for c in axes.columns if c != "n"], digits=5)


@query(
    f"""WITH {MOMENTS_SQL}, a AS (SELECT cx, cy, sqrt(((xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy)) * -2 * ln(1 - 0.95)) AS major,
      sqrt(((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy)) * -2 * ln(1 - 0.95)) AS minor, atan2(2 * xy, xx - yy) / 2 AS g FROM m)
    SELECT i::INT AS i, round(cx + major * cos(i * 2 * pi() / 359) * cos(g) - minor * sin(i * 2 * pi() / 359) * sin(g), 5) + 0.0 AS x,
      round(cy + major * cos(i * 2 * pi() / 359) * sin(g) + minor * sin(i * 2 * pi() / 359) * cos(g), 5) + 0.0 AS y FROM a, range(0, 360) t(i)"""
)
def ellipse_points(spark, folder):
    points = prediction.ellipse(predictions(spark, folder), "price_real", "price_pred")
    return rounded(points, "x", "y", digits=5)


@query(f"WITH {CLASSES_SQL} SELECT point_class, count(*) AS n FROM classed GROUP BY ALL")
def point_classes(spark, folder):
    return prediction.point_classes(predictions(spark, folder), "price_real", "price_pred")


@query(f"WITH {CLASSES_SQL} SELECT l_orderkey, l_linenumber, s AS sigma_outlier, o AS ellipse_outlier, point_class FROM classed")
def classified_points(spark, folder):
    rows = prediction.classify_points(predictions(spark, folder), "price_real", "price_pred")
    return rows.select("l_orderkey", "l_linenumber", "sigma_outlier", "ellipse_outlier", "point_class")


@query(
    f"""WITH {CLASSES_SQL} SELECT l_orderkey, l_linenumber, point_class FROM classed
    ORDER BY md5('42|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), l_orderkey, l_linenumber LIMIT 6000"""
)
def sample_points(spark, folder):
    points = prediction.classify_points(predictions(spark, folder), "price_real", "price_pred")
    sample = prediction.sample_points(points, ["l_orderkey", "l_linenumber"], 6000)
    return sample.select("l_orderkey", "l_linenumber", "point_class")


# ---- stored metrics ------------------------------------------------------------------------------


def metrics_document(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of both forms as one JSON text, nested form -> module, without mse in form O."""
    metrics = prediction.error_metrics_by_module(predictions(spark, folder), MODULES, ["form"], None)
    # forms x modules entries, whatever the number of rows
    per_form = metrics.groupBy("form").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("module", F.struct("mae", F.when(F.col("form") == "F", F.col("mse")).alias("mse"), "rmse", "r2"))
            )
        ).alias("_targets")
    )
    document = per_form.agg(F.map_from_entries(F.collect_list(F.struct("form", "_targets"))).alias("m"))
    return document.select(F.to_json("m").alias("value"))


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT form, module AS target, round(avg(abs(real - pred)), 6) AS mae, round(avg(power(real - pred, 2)), 6) AS mse,
      round(sqrt(avg(power(real - pred, 2))), 6) AS rmse, round(1 - avg(power(real - pred, 2)) / var_pop(real), 6) + 0.0 AS r2 FROM modules GROUP BY ALL"""
)
def metrics_json(spark, folder):
    parsed = readers.parse_json(metrics_document(spark, folder), "value", readers.METRICS_SCHEMA)
    rows = prediction.explode_metrics(parsed, "metrics", ["form", "target"])
    return rounded(rows, "mae", "mse", "rmse", "r2")


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT module AS target, form, round(avg(abs(real - pred)), 6) AS model,
      round(avg(abs(real - pred)) * 2, 6) AS twice FROM modules GROUP BY ALL"""
)
def method_compare(spark, folder):
    """Two methods for each form and target; the second has twice the errors of the first."""
    parsed = readers.parse_json(metrics_document(spark, folder), "value", readers.METRICS_SCHEMA)
    rows = prediction.explode_metrics(parsed, "metrics", ["form", "target"])
    methods = F.explode(F.array(F.struct(F.lit("model").alias("method"), F.lit(1).alias("k")), F.struct(F.lit("twice").alias("method"), F.lit(2).alias("k"))))
    rows = rows.withColumn("_m", methods).select("form", "target", F.col("_m.method").alias("method"), (F.col("mae") * F.col("_m.k")).alias("mae"))
    return rounded(prediction.compare_metrics(rows, "target", "method", ["model", "twice"]), "model", "twice")


@query(
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT form, module, avg(abs(real - pred)) AS mae, avg(power(real - pred, 2)) AS mse FROM modules GROUP BY ALL)
    SELECT form, module, round(mae * CASE WHEN module = 'price' THEN 2 ELSE 1 END, 6) AS mae,
      round(mse * CASE WHEN module = 'price' THEN 4 ELSE 1 END, 5) AS mse FROM m
    UNION ALL SELECT form, 'stored only', round(mae * 2, 6), round(mse * 4, 5) FROM m WHERE module = 'price'"""
)
def metrics_with_fallback(spark, folder):
    """Stored metrics (here twice the price errors) win; quantity is only known from rows, and one module
    only from the store."""
    computed = prediction.error_metrics_by_module(predictions(spark, folder), MODULES, ["form"], None)
    stored = computed.filter("module = 'price'").select(
        "form", "module", (F.col("mae") * 2).alias("mae"), (F.col("mse") * 4).alias("mse")
    )
    stored = stored.union(stored.withColumn("module", F.lit("stored only")))
    merged = prediction.stored_or_computed(stored, computed, ["form", "module"])
    return rounded(rounded(merged, "mae"), "mse", digits=5)


SWEEP = (8, 16, 32, 48)
SWEEP_SQL = """rows AS (SELECT l_linestatus AS form, l_returnflag AS split, l_extendedprice / 1000 AS real, k,
      floor(l_quantity * k / 51)::INT AS cluster FROM lineitem, (VALUES (8), (16), (32), (48)) t(k)),
    centres AS (SELECT form, k, cluster, avg(real) AS centre FROM rows WHERE split = 'A' GROUP BY ALL),
    sweep AS (SELECT form, k, avg(abs(real - centre)) AS mae_val FROM rows JOIN centres USING (form, k, cluster) WHERE split = 'N' GROUP BY ALL)"""


@query(
    f"""WITH {SWEEP_SQL} SELECT form, k, round(mae_val, 6) AS mae_val, row_number() OVER (PARTITION BY form ORDER BY mae_val, k) = 1 AS chosen FROM sweep"""
)
def k_sweep(spark, folder):
    """Mean per quantity range learnt on split A, validated on split N, for several range counts."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("form"),
        F.col("l_returnflag").alias("split"),
        (F.col("l_extendedprice") / 1000).alias("real"),
        "l_quantity",
        F.explode(F.array(*[F.lit(k) for k in SWEEP])).alias("k"),
    )
    clustered = rows.withColumn("cluster", F.floor(F.col("l_quantity") * F.col("k") / 51).cast("int"))
    keys = ["form", "k", "cluster"]
    centres = clustered.filter("split = 'A'").groupBy(*keys).agg(F.avg("real").alias("centre"))
    held_out = clustered.filter("split = 'N'")
    sweep = (
        held_out.join(centres, keys)
        .groupBy("form", "k")
        .agg(F.avg(F.abs(F.col("real") - F.col("centre"))).alias("mae_val"))
    )
    return rounded(prediction.choose_k(sweep), "mae_val")
