"""Paired scores: trends, contribution, correlation, differences and quantile transitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.classes import strength_class
from cohortia.operators.histogram import histogram
from cohortia.operators.ordering import SKETCH_ACCURACY
from cohortia.operators.selection import counted_quantiles

Pairs = Mapping[str, tuple[str, str]]


def melt_pairs(
    df: DataFrame, pairs: Pairs, keep: Sequence[str] = (), fallback: Mapping[str, str] | None = None
) -> DataFrame:
    """(keep..., label, y, x): complete pairs of every label in one long table.

    ``pairs`` maps label to (later score, earlier score). ``fallback`` maps a label to a column that
    fills gaps of its earlier score.
    """
    entries = []
    for label, (y, x) in pairs.items():
        earlier = F.col(x).cast("double")
        if fallback and label in fallback:
            earlier = F.coalesce(earlier, F.col(fallback[label]).cast("double"))
        entries.append(
            F.struct(F.lit(label).alias("label"), F.col(y).cast("double").alias("y"), earlier.alias("x"))
        )
    both = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return df.select(*keep, F.inline(F.array(*entries))).filter(both)


def paired_trend(df: DataFrame, year: str, x: str, y: str) -> DataFrame:
    """(year, x_mean, y_mean): one-sided means, only years where both exist."""
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(year)
        .agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))
        .dropna(subset=["x_mean", "y_mean"])
    )


def paired_trends(df: DataFrame, year: str, pairs: Pairs) -> DataFrame:
    """(year, label, x_mean, y_mean) of all pairs from one aggregation."""
    means = df.filter(F.col(year).isNotNull()).groupBy(year)
    aggregates, entries = [], []
    for i, (label, (y, x)) in enumerate(pairs.items()):
        aggregates += [F.avg(x).alias(f"_x{i}"), F.avg(y).alias(f"_y{i}")]
        entries.append(
            F.struct(F.lit(label).alias("label"), F.col(f"_x{i}").alias("x_mean"), F.col(f"_y{i}").alias("y_mean"))
        )
    long = means.agg(*aggregates).select(year, F.inline(F.array(*entries)))
    return long.dropna(subset=["x_mean", "y_mean"])


def contribution(
    df: DataFrame, year: str, pairs: Pairs, fallback: Mapping[str, str] | None = None
) -> DataFrame:
    """(year, label, value): mean later score minus mean earlier score, in points, on complete pairs."""
    return (
        melt_pairs(df, pairs, [year], fallback)
        .filter(F.col(year).isNotNull())
        .groupBy(year, "label")
        .agg(((F.avg("y") - F.avg("x")) * 100).alias("value"))
    )


def contribution_matrix(
    df: DataFrame, year: str, pairs: Pairs, fallback: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per year, one column per label; a label without pairs in a year is NULL."""
    long = contribution(df, year, pairs, fallback)
    return long.groupBy(year).pivot("label", list(pairs)).agg(F.first("value"))


def contribution_kpis(long: DataFrame, year: str, aggregates: Iterable[str], main: str) -> DataFrame:
    """One row from the long contribution table: mean of the main label over years, its best year,
    and the best single competence by mean over years. ``aggregates`` are labels that are not single
    competences; ties go to the earlier year and to the label that sorts first."""
    per_label = long.groupBy("label").agg(
        F.avg("value").alias("mean"),
        F.max("value").alias("best"),
        F.min_by(F.col(year), F.struct(-F.col("value"), F.col(year))).alias("best_year"),
    )
    is_main = F.col("label") == main
    single = ~F.col("label").isin(*aggregates)
    rank = F.when(single, F.struct(-F.col("mean"), F.col("label")))
    return per_label.agg(
        F.max(F.when(is_main, F.col("mean"))).alias("main_mean"),
        F.min_by(F.when(single, F.col("label")), rank).alias("best_label"),
        F.max(F.when(single, F.col("mean"))).alias("best_label_mean"),
        F.max(F.when(is_main, F.col("best_year"))).alias("best_year"),
        F.max(F.when(is_main, F.col("best"))).alias("best_year_value"),
    )


#: Ranges that the values of a side are cut into: at least, so that no task holds much of a side where there are few partitions, and
#: at most, as the table of range pairs has four times their square of rows a label.
LEAST_RANGES, MOST_RANGES = 128, 512


def _range_facts(counted: DataFrame, labels: int, ranges: int, size: int) -> Column:
    """A list by label number: the means of both sides and ``size`` edges that cut the counted pairs into ranges of about equal size by
    their values, the last ones infinite. A value with more pairs than a range holds is an edge."""
    probes = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    sides = []
    for s in ("x", "y"):
        edges = f"array_distinct(percentile_approx({s}, array({probes}), {SKETCH_ACCURACY * ranges}))"
        sides.append(f"'m{s}', sum(w * {s}) / sum(w), 'e{s}', slice({edges} || array_repeat(DOUBLE('infinity'), {size}), 1, {size})")
    found = counted.groupBy("k").agg(F.expr(f"named_struct({', '.join(sides)}) AS facts"))
    listed = found.agg(F.expr("collect_list(named_struct('k', k, 'facts', facts)) AS listed"))
    return listed.selectExpr(f"transform(sequence(0, {labels - 1}), i -> get(filter(listed, e -> e.k = i), 0).facts) AS facts").scalar()


def correlations(df: DataFrame, pairs: Pairs, digits: int | None = None) -> DataFrame:
    """(label, n, pearson, spearman, strength) of every label; the two are NULL with fewer than two pairs or where a side does
    not vary, and pairs without complete rows have n = 0. Spearman is Pearson of average ranks.

    One pass over ``df``, which melts the pairs and counts equal ones in each task before they are shuffled. All else works on counted
    pairs: means and range edges are found, the pairs are dealt by ranges of x and then of y, ranked inside the ranges, and summed by
    pairs of ranges; the rows before a range are sums of that small table, so ranks are never joined to rows. A value that is an edge is
    a range of its own, where all ranks are equal: its pairs need no order and are salted.
    """
    ranges = max(LEAST_RANGES, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    entries = []
    for k, (y, x) in enumerate(pairs.values()):
        whole = f"CAST(`{x}` AS DOUBLE) IS NOT NULL AND CAST(`{y}` AS DOUBLE) IS NOT NULL AND NOT isnan(CAST(`{x}` AS DOUBLE)) AND NOT isnan(CAST(`{y}` AS DOUBLE))"
        sides = [f"'{s}', IF({whole}, CAST(`{c}` AS DOUBLE), NULL) + 0.0D" for s, c in (("x", x), ("y", y))]
        entries.append(f"named_struct('k', {k}, {', '.join(sides)})")
    melted = df.selectExpr(f"inline(array({', '.join(entries)}))").filter("x IS NOT NULL")
    counted = melted.groupBy("k", "x", "y").agg(F.expr("count(1) AS w"))
    bits = ranges.bit_length()
    placed = counted.select("*", _range_facts(counted, len(pairs), ranges, 1 << bits).alias("_facts"))
    # edges below a value, by binary search: a column per side, a projection per step
    placed = placed.selectExpr("*", "0 AS _rx", "0 AS _ry")
    for step in (1 << bit for bit in reversed(range(bits))):
        moved = [f"_r{s} + IF(_facts[k].e{s}[_r{s} + {step - 1}] < {s}, {step}, 0) AS _r{s}" for s in ("x", "y")]
        placed = placed.selectExpr(*counted.columns, "_facts", *moved)
    of_sides = [f"{s} - _facts[k].m{s} AS c{s}" for s in ("x", "y")] + [f"2 * _r{s} + IF(_facts[k].e{s}[_r{s}] = {s}, 1, 0) AS r{s}" for s in ("x", "y")]
    long = placed.selectExpr(*counted.columns, *of_sides)
    for s, other in (("x", "y"), ("y", "x")):
        at_edge = F.col(f"r{s}") % 2 == 1
        long = long.withColumn("_salt", F.when(at_edge, F.pmod(F.xxhash64(other), F.lit(ranges))).otherwise(F.lit(0)))
        upto = F.sum("w").over(Window.partitionBy("k", f"r{s}", "_salt").orderBy(s))
        equal = F.sum("w").over(Window.partitionBy("k", f"r{s}", "_salt", s))
        long = long.withColumn(f"i{s}", F.when(at_edge, F.lit(0.0)).otherwise(upto - (equal - 1) / 2)).drop("_salt")
    sums = [
        "sum(w) AS n", "sum(w * ix) AS ix", "sum(w * iy) AS iy", "sum(w * ix * iy) AS ixy", "sum(w * ix * ix) AS ixx", "sum(w * iy * iy) AS iyy",
        "sum(w * cx * cy) AS ab", "sum(w * cx * cx) AS aa", "sum(w * cy * cy) AS bb", "min(x) AS lx", "max(x) AS hx", "min(y) AS ly", "max(y) AS hy",
    ]
    cells = long.groupBy("k", "rx", "ry").agg(*map(F.expr, sums))
    none = [f"CAST({0 if f.name == 'n' else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in cells.schema.fields[3:]]
    blank = df.sparkSession.range(1, numPartitions=1).selectExpr(f"explode(sequence(0, {len(pairs) - 1})) AS k")
    cells = cells.unionByName(blank.selectExpr("k", "-1 AS rx", "-1 AS ry", *none))
    of_label = Window.partitionBy("k")
    total = F.sum("n").over(of_label)
    for s in ("x", "y"):
        before = F.coalesce(F.sum("n").over(of_label.orderBy(f"r{s}").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        same = F.sum("n").over(Window.partitionBy("k", f"r{s}"))
        # an edge's rows share the mean of their ranks
        cells = cells.withColumn(f"o{s}", before + F.when(F.col(f"r{s}") % 2 == 1, (same + 1) / 2).otherwise(F.lit(0.0)) - (total + 1) / 2)
    ranked = cells.groupBy("k").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("ab", "aa", "bb")],
        F.expr("min(lx) < max(hx) AND min(ly) < max(hy) AS varies"),
        F.expr("sum(n * ox * oy + ox * iy + oy * ix + ixy) AS rab"),
        F.expr("sum(n * ox * ox + 2 * ox * ix + ixx) AS raa"),
        F.expr("sum(n * oy * oy + 2 * oy * iy + iyy) AS rbb"),
    )

    def ratio(a: str, b: str, c: str) -> Column:
        spread = F.sqrt(b) * F.sqrt(c)
        return F.when((F.col("n") >= 2) & F.col("varies") & (spread > 0), F.col(a) / spread)

    r, rho = ratio("ab", "aa", "bb"), ratio("rab", "raa", "rbb")
    if digits is not None:
        r, rho = F.round(r, digits), F.round(rho, digits)
    label = F.get(F.array(*map(F.lit, pairs)), F.col("k")).alias("label")
    both = ranked.select(label, "n", r.alias("pearson"), rho.alias("spearman"))
    return both.withColumn("strength", strength_class("pearson"))


def pearson(df: DataFrame, pairs: Pairs) -> DataFrame:
    """(label, n, pearson) of every pair; NULL below two pairs or where a side does not vary. Pairs
    without complete rows do not appear."""
    return correlations(df, pairs).filter("n > 0").select("label", "n", "pearson")


def spearman(df: DataFrame, pairs: Pairs) -> DataFrame:
    """(label, spearman): Pearson of average ranks over complete pairs."""
    return correlations(df, pairs).filter("n > 0").select("label", "spearman")


def delta(df: DataFrame, x: str, y: str) -> DataFrame:
    """(delta): later minus earlier score of the complete pairs."""
    return df.dropna(subset=[x, y]).select((F.col(y) - F.col(x)).alias("delta"))


def delta_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    return delta(df, x, y).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))


def delta_summaries(df: DataFrame, pairs: Pairs) -> DataFrame:
    """(label, n, mean) of the differences of every pair, also of those without complete rows, from one pass."""
    parts = []
    for label, (y, x) in pairs.items():
        difference = F.nanvl(F.col(y).cast("double"), F.lit(None)) - F.nanvl(F.col(x).cast("double"), F.lit(None))
        parts.append(F.struct(F.lit(label).alias("label"), F.count(difference).alias("n"), F.avg(difference).alias("mean")))
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def delta_histogram(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    return histogram(delta(df, x, y), "delta", bins)


def _quantile_bin(value: Column, edges: Column) -> Column:
    """Right-closed bins from 1 over an array of different edges; the lowest edge belongs to the first."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return (F.size(F.filter(inner, lambda e: e < value)) + 1).cast("int")


def quantile_transition(df: DataFrame, x: str, y: str, n: int = 5, digits: int | None = None) -> DataFrame:
    """(from_bin, to_bin, n, pct, from_bins, to_bins): quantile bins of x against quantile bins of y.

    Quantile edges that repeat, as they do where values are tied or few, are one edge, so a side has
    ``from_bins`` or ``to_bins`` bins, ``n`` at most; all their pairs are listed. A constant side has one bin.
    A page that shows nothing unless there are n bins filters on the two numbers. The edges are exact.
    Nothing runs until the table is used. All edges of both sides come from one narrowing, and the cells are summed
    over its groups, so the pairs are passed over three times and never sorted.
    """
    pairs = melt_pairs(df, {"": (y, x)}).select("x", "y")
    found = counted_quantiles(pairs, ["x", "y"], n)
    bins = [F.greatest(F.size(e) - 1, F.least(F.size(e), F.lit(1))).alias(f"{side}_bins") for side, e in (("from", "edges_x"), ("to", "edges_y"))]
    none = F.lit(None).cast("int")

    def empty(a: Column) -> Column:
        cell = lambda b: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("n"), a.alias("a"), b.alias("b"))
        return F.transform(F.sequence(F.lit(1), F.col("to_bins")), cell)

    groups = F.transform("groups", lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), g["n"].alias("n"), none.alias("a"), none.alias("b")))
    grid = F.flatten(F.transform(F.sequence(F.lit(1), F.col("from_bins")), empty))
    # the edges are worked out once, below the generator
    rows = found.select("groups", "edges_x", "edges_y", *bins).select("edges_x", "edges_y", "from_bins", "to_bins", F.inline(F.concat(groups, grid)))
    from_bin = F.coalesce("a", _quantile_bin(F.col("x"), F.col("edges_x"))).alias("from_bin")
    to_bin = F.coalesce("b", _quantile_bin(F.col("y"), F.col("edges_y"))).alias("to_bin")
    rows = rows.select("from_bins", "to_bins", from_bin, to_bin, "n")
    counted = rows.groupBy("from_bins", "to_bins", "from_bin", "to_bin").agg(F.sum("n").alias("n"))
    # a from-bin without rows, which interpolated edges can leave, has no shares
    of_row = F.sum("n").over(Window.partitionBy("from_bin"))
    share = F.when(of_row > 0, F.col("n") / F.greatest(of_row, F.lit(1)) * 100).otherwise(F.lit(0.0))
    counted = counted.withColumn("pct", share if digits is None else F.round(share, digits))
    return counted.select("from_bin", "to_bin", "n", "pct", "from_bins", "to_bins")
