"""Connected components of a graph of any size, by turning every component into a star around its least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge between two different nodes, with the least node it is connected to.

    Rounds of two steps: each node hands its larger neighbours to its least neighbour, then all its smaller neighbours
    (in both cases a minimum, combined before the shuffle, and a join). The rounds end when no edge changes, after a
    number in the order of the logarithm of the longest path. Edges are written to the shared folder after each round.
    Repeated edges, edges in both directions, loops and NULLs do no harm; an empty table gives an empty table.
    """
    ends = (F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
    pairs = keep(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*ends).filter("u > v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(pairs)
    while now[0]:
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("x")).union(pairs.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
        large = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = keep(handed.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, state(pairs)
        if now == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def least_ids(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, component) with each component named by the least id of its nodes; ``ids`` is (node, least), a row per node."""
    least = found.join(ids, "node").groupBy("component").agg(F.min("least").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
