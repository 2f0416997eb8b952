"""Exact quantiles of several columns at once by narrowing brackets, without sorting the rows.

Three passes. The first sketches every column, which brackets each quantile with an error that is known. The second counts what
lies below each bracket and sketches its inside, which brackets it again. The third keeps single values inside the brackets, a few
per million rows, and only counts outside them. Each pass ends in one row; nothing is approximate in the end, as the values at the
wanted places are found by exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One over the error of a sketch, as a share of its rows.
ACCURACY = 10_000
#: Errors of a sketch that a bracket leaves on each side.
SLACK = 4
#: Sketched places inside a bracket.
PLACES = 500
#: Rows up to which a bracket is all there is, or stays as it is.
FEW = 20_000

# Expressions are text here: there are some per column and quantile, which are slow to build call by call.


def _sketch(column: str, shares: Sequence[float]) -> str:
    listed = ", ".join(f"{share!r}D" for share in shares)
    return f"percentile_approx({column}, array({listed}), {ACCURACY})"


def _first_brackets(rows: DataFrame, columns: Sequence[str], n: int) -> Column:
    margin = SLACK / ACCURACY
    probes = [p for i in range(1, n) for p in (max(0.0, i / n - margin), min(1.0, i / n + margin))]
    found = ", ".join(f"'{c}', {_sketch(c, probes)}" for c in columns)
    return rows.agg(F.expr(f"named_struct('total', count(1), {found}) AS first")).scalar()


def _second_brackets(rows: DataFrame, columns: Sequence[str], n: int) -> Column:
    parts, sums, brackets = [], ["count(1) AS total"], []
    places = [k / PLACES for k in range(PLACES + 1)]
    for c in columns:
        lows, highs = [], []
        for i in range(1, n):
            name = f"{c}_{i}"
            low, high = f"_a.{c}[{2 * i - 2}]", f"_a.{c}[{2 * i - 1}]"
            parts += [
                f"IF(_a.total <= {FEW} OR {c} BETWEEN {low} AND {high}, {c}, NULL) AS {name}",
                f"CAST(_a.total > {FEW} AND {c} < {low} AS INT) AS below_{name}",
            ]
            sums += [f"{_sketch(name, places)} AS {name}", f"count({name}) AS in_{name}", f"sum(below_{name}) AS below_{name}"]
            at = f"((total - 1) * {i} DIV {n} - below_{name})"
            down = f"greatest(0, CAST(floor(({at} / in_{name} - {2 / ACCURACY}D) * {PLACES}) AS INT))"
            up = f"least({PLACES}, CAST(ceil((({at} + 2) / in_{name} + {2 / ACCURACY}D) * {PLACES}) AS INT))"
            lows.append(f"{name}[IF(in_{name} <= {FEW}, 0, {down})]")
            highs.append(f"{name}[IF(in_{name} <= {FEW}, {PLACES}, {up})]")
        brackets += [f"'low_{c}', array({', '.join(lows)})", f"'high_{c}', array({', '.join(highs)})"]
    first = rows.select(*columns, _first_brackets(rows, columns, n).alias("_a")).selectExpr(*parts)
    return first.selectExpr(*sums).selectExpr(f"named_struct({', '.join(brackets)}) AS second").scalar()


def _value_at(ordered: str, place: str) -> str:
    """The value at a place of counted groups in order; it must be the value of a group that holds nothing else."""
    lost = "CAST(raise_error('a quantile left its bracket') AS DOUBLE)"
    value = f"IF(s.upto <= {place} AND {place} < s.upto + g.n, IF(g.single, g.value, {lost}), s.value)"
    start = "named_struct('upto', 0L, 'value', CAST(NULL AS DOUBLE))"
    return f"aggregate({ordered}, {start}, (s, g) -> named_struct('upto', s.upto + g.n, 'value', {value}), s -> s.value)"


def counted_quantiles(rows: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """One row (total, edges_<column>..., groups): the different n-quantile edges of every column, in order, with linear
    interpolation, and the rows as counted groups (<column>..., n).

    Rows that lie between the same edges in all columns, as far as the brackets tell, are one group with one of their values; no edge
    lies between the values of a group, so a group is in one bin of each column. ``rows`` has doubles without NULL and NaN in columns
    with plain names; without rows the table is empty. Quantile i is at place i (total - 1) / n, taken in whole numbers. A value that a
    third of all rows share is one group.
    """
    if n < 2:
        raise ValueError("quantiles need two parts at least")
    keys, sums, all_sums, entries, kept = [], ["count(1) AS n"], ["sum(n) AS total"], [], []
    for c in columns:
        pairs = [(f"_b.low_{c}[{i}]", f"_b.high_{c}[{i}]") for i in range(n - 1)]
        inside = " OR ".join(f"{c} BETWEEN {low} AND {high}" for low, high in pairs)
        between = " + ".join(f"CAST({high} < {c} AS INT)" for _, high in pairs)
        keys += [c, f"IF({inside}, {c}, NULL) AS single_{c}", f"IF({inside}, NULL, {between}) AS between_{c}"]
        for f in ("min", "max"):
            sums.append(f"{f}({c}) AS {f}_{c}")
            all_sums.append(f"{f}({f}_{c}) AS {f}_{c}")
        entries.append(f"'{c}', named_struct('value', min_{c}, 'single', single_{c} IS NOT NULL, 'n', n)")
        kept.append(f"'{c}', g.{c}.value")
    placed = rows.select(*columns, _second_brackets(rows, columns, n).alias("_b")).selectExpr(*keys)
    groups = placed.groupBy(*[f"{kind}_{c}" for c in columns for kind in ("single", "between")]).agg(*map(F.expr, sums))
    one = groups.selectExpr(*all_sums, f"collect_list(named_struct({', '.join(entries)})) AS all").filter("total > 0")
    one = one.selectExpr("*", *[f"array_sort(transform(all, g -> g.{c})) AS order_{c}" for c in columns])
    edges = []
    for c in columns:
        place, rest = f"((total - 1) * i DIV {n})", f"((total - 1) * i % {n})"
        a, b = _value_at(f"order_{c}", place), _value_at(f"order_{c}", f"({place} + 1)")
        ends = f"transform(sequence(1, {n - 1}), i -> named_struct('a', {a}, 'b', IF({rest} > 0, {b}, {a}), 'share', {rest} / {n}))"
        edges.append(f"array_distinct(array(min_{c}) || transform({ends}, e -> e.a + (e.b - e.a) * e.share) || array(max_{c})) AS edges_{c}")
    return one.selectExpr("total", *edges, f"transform(all, g -> named_struct({', '.join(kept)}, 'n', g.{columns[0]}.n)) AS groups")
