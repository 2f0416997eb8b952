"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents (by a hash of their ids and texts) into a queue that may be gone through several times. A
document's virtual finish time is the number of its source's tokens up to its end, divided by the source's target.
Documents are taken in the order of these times until the total budget is spent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm.shared import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the shuffle hash that cut a source's queue into parts; sums inside the parts run in parallel.
PART_DIGITS = 3
#: Ranges per unit of virtual time, in which the place of the cut is looked for.
STEPS = 4096


def sized_documents(docs: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, key): sizes are words, 0 for NULL and empty texts; the key shuffles the documents. It is of id and
    text, so that documents without an id, or with one that repeats, don't come together."""
    name = F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(name).alias("key"),
    )


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, number, source_size, target, budget): one row per source.

    Sources in the order of code points, NULL last, have the weights in turn, and share ``share`` times all tokens by
    weight. A target stops at ``most`` times the source's size; what is left goes to the others by weight, until none is
    above. The water level is found in the order of most * size / weight by running sums. One row per source is in one
    task here: sources are a dimension, not data that grows with the documents.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", F.row_number().over(by_source))
    turn = F.pmod(F.col("number") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    totals = totals.select("source", "number", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    above = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("limit").over(below), F.lit(0.0))
    totals = totals.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    totals = totals.withColumn("level", left / F.sum("weight").over(above))
    target = F.least(F.col("limit"), F.col("weight") * F.max("level").over(everything))
    return totals.select("source", "number", "source_size", target.alias("target"), "budget")


def _range(time: Column) -> Column:
    """Number of the range of a virtual time: even up to 2, by powers beyond, so that there are a few thousand at most."""
    return F.when(time < 2, F.floor(time * STEPS)).otherwise(2 * STEPS + F.floor(F.log2(time) * 64)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rounds): one row per document.

    taken is the number of words the mix takes of it, repeats counted: 0, its size, up to ``most`` times its size; the
    one document at the cut is taken in part, so that all words together are the budget (rounded down). rounds counts
    how often it is taken, also in part.

    NULL sources are a source of their own, the last. NULL and empty texts have size 0 and take part with nothing, also
    where a source has no other. Repeated rows and equal or NULL ids are documents of their own; rows that are equal have equal
    places up to running sums, which tell them apart. The hash of ids and texts fixes the order, so reruns agree. An empty table
    gives an empty table. Other columns are left alone.

    Only ids, sources, sizes and hashes are shuffled, never texts. A source with a third of all documents is summed in
    up to 16 ** PART_DIGITS parts, the global order in ranges of virtual time, and only the range at the cut is sorted.
    """
    spark = docs.sparkSession
    sized = keep(sized_documents(docs, id_column, text, source), "sizes")
    targets = keep(source_targets(sized, weights, share, most), "targets")
    part = F.substring("key", 1, PART_DIGITS)
    numbered = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("part", part)
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("number", "part").agg(F.sum("size").alias("_size"))
    sums = sums.select("number", "part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = numbered.withColumn("_inside", F.sum("size").over(inside)).join(sums, ["number", "part"])
    queued = keep(
        queued.select("doc_id", "source", "size", "source_size", "target", "number", (F.col("_before") + F.col("_inside")).alias("upto")),
        "queues",
    )

    def end(turn: int | Column) -> Column:
        return F.col("upto") + F.col("source_size") * turn

    def time(upto: Column) -> Column:
        return upto / F.col("target")

    turns = queued.filter("size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    items = turns.select("number", "size", end(F.col("_turn")).alias("c"), time(end(F.col("_turn"))).alias("t"))
    ranges = items.groupBy(_range(F.col("t")).alias("r")).agg(F.sum("size").alias("_size"))
    ranges = ranges.withColumn("upto", F.sum("_size").over(Window.orderBy("r")))
    found = targets.select("budget").limit(1).collect()
    budget = int(found[0]["budget"]) if found else 0
    cut = None
    place = ranges.filter(F.col("upto") > budget).orderBy("r").limit(1).collect()
    if place:
        low = place[0]["upto"] - place[0]["_size"]
        order = Window.orderBy("t", "number", "c")
        near = items.filter(_range(F.col("t")) == place[0]["r"]).withColumn("upto", F.sum("size").over(order) + F.lit(low))
        cut = near.filter(F.col("upto") > budget).orderBy("t", "number", "c").limit(1).collect()[0]

    def words(turn: int) -> Column:
        if cut is None:
            return F.col("size")
        at, number, c = F.lit(cut["t"]), F.lit(cut["number"]), F.lit(cut["c"])
        t = time(end(turn))
        earlier = (t < at) | ((t == at) & ((F.col("number") < number) | ((F.col("number") == number) & (end(turn) < c))))
        same = (t == at) & (F.col("number") == number) & (end(turn) == c)
        rest = F.lit(budget) - (F.lit(cut["upto"]) - F.col("size"))
        return F.when(F.col("size") == 0, 0).when(earlier, F.col("size")).when(same, rest).otherwise(0).cast("long")

    taken = [words(k) for k in range(most)]
    total, rounds = taken[0], (taken[0] > 0).cast("int")
    for x in taken[1:]:
        total, rounds = total + x, rounds + (x > 0).cast("int")
    return queued.select("doc_id", "source", "size", "source_size", "target", total.cast("long").alias("taken"), rounds.alias("rounds"))
