"""Merkle manifest of a dataset: leaves per row, a tree per group and a tree over the groups.

The manifest is a content-addressed graph: records map a digest to the digests of its children. Proofs come from a descent:
requests for leaves start at the root, each step looks up the record of the digest they stand at, follows the child that
the next digit of their rank names, and collects the other children. Reversed, what they collected leads from the leaf to
the root. Requests that agree in their leading digits go down as one row until their digits part, so the steps near the
root have few rows and no key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.llm.shared import keep

#: Children of a node.
WIDTH = 16
_BITS = WIDTH.bit_length() - 1
#: Rows of a partition in what monotonically_increasing_id gives.
_ROW_BITS = 33


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 as lowercase hex over the values in turn: ``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, from the leaf's level up, each level from left to right."""
    return F.sha2(_joined(F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


@dataclass
class Manifest:
    """What ``build_manifest`` wrote: ``groups`` (tree, run, requests, children), runs of up to WIDTH leaves; ``sources``
    (group, tree, subroot, height), a row per group; ``records``, a table (digest, children) per height of the groups'
    trees; ``top``, the same for the tree over the groups; and ``root``, NULL for an empty table."""

    groups: DataFrame
    sources: DataFrame
    root: str | None
    records: list[DataFrame] = field(default_factory=list)
    top: list[DataFrame] = field(default_factory=list)

    def store(self) -> DataFrame | None:
        """(digest, children): every record once; None where a lone leaf is all there is."""
        found = None
        for records in [*self.records, *self.top]:
            found = records if found is None else found.unionByName(records)
        return None if found is None else found.dropDuplicates(["digest"])


def _ranked(rows: DataFrame, carried: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves, sources): leaves with the number of their tree, their rank in it and its size.

    One global sort by (group, key, digest) of digests and keys only. Its ranges are cut by rows, also inside a large group and
    among equal rows; positions are the place in a range plus the sizes of the ranges before.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "_tie")
    ordered = ordered.sortWithinPartitions(F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "_tie")
    ordered = keep(ordered.drop("_tie").withColumn("place", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("place", _ROW_BITS)
    row = F.col("place").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = ordered.withColumns({"part": part, "row": row})
    # a row per group and range from here
    spans = placed.groupBy("group", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    in_group = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = keep(
        spans.withColumns(
            {"before": F.coalesce(F.sum("n").over(in_group), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("group"))}
        ),
        "spans",
    )
    heads = spans.filter("before = 0")
    # a row per range in one window, never a row per group
    starts = heads.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(
        F.col("part").alias("_part"),
        F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    numbered = heads.join(starts, F.col("part") == F.col("_part"))
    tree = F.col("_start") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    sources = keep(numbered.select("group", tree.alias("tree"), "total"), "sources")
    spans = spans.join(sources.select(F.col("group").alias("_of"), "tree"), F.col("group").eqNullSafe(F.col("_of")))
    spans = spans.select(F.col("group").alias("_group"), F.col("part").alias("_part"), "first", "before", "total", "tree")
    here = (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group"))
    leaves = placed.join(spans, here).select(
        "tree", (F.col("row") - F.col("first") + F.col("before")).alias("rank"), "total", "group", "key", "leaf", *carried
    )
    return leaves, sources


def _height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves; a lone leaf is its own root."""
    height = 0
    while n > 1:
        n, height = -(-n // WIDTH), height + 1
    return height


def _height_of(total: Column, most: int) -> Column:
    height = F.lit(0)
    for h in range(1, most + 1):
        height = F.when(total > WIDTH ** (h - 1), F.lit(h)).otherwise(height)
    return height.cast("int")


def _grow(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(records of every level, tops): builds the levels above nodes (tree, rank, digest, children, left), where ``left``
    is the number of nodes their tree has on that level; ``children`` is NULL for leaves."""
    records: list[DataFrame] = []
    tops = nodes.filter("left = 1").select("tree", "digest")
    for _ in range(levels):
        up = nodes.filter("left > 1").groupBy("tree", F.shiftright("rank", _BITS).alias("rank"))
        run = F.sort_array(F.collect_list(F.struct("rank", "digest")))
        up = up.agg(run["digest"].alias("children"), F.first("left").alias("left"))
        up = up.select("tree", "rank", F.sha2(_joined(F.col("children")), 256).alias("digest"), "children", F.ceil(F.col("left") / WIDTH).alias("left"))
        nodes = keep(up, "level")
        records.append(nodes.select("digest", "children"))
        tops = tops.unionByName(nodes.filter("left = 1").select("tree", "digest"))
    return records, tops


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "source",
    carry: Mapping[str, Column] | None = None,
) -> Manifest:
    """Leaves over ``columns``, a tree per ``group`` with leaves in the order of ``key``, and a tree over their roots.

    NULL groups are one group, the first; groups follow by their UTF-8 bytes. NULL keys come first in their group. Equal keys
    are leaves of their own, in the order of their digests; equal rows are equal leaves side by side. Empty texts and texts of
    any length are leaves like others. An empty table has no leaf and the root NULL. Columns that aren't named play no part,
    whatever their names. ``carry`` names values of a row that stay with its request, as digests of other versions.

    Texts are hashed where they are read; only digests are sorted and shuffled. Every level is a table in the shared folder.
    """
    carried = dict(carry or {})
    names = [f"_c{k}" for k in range(len(carried))]
    rows = docs.select(
        F.col(group).alias("group"),
        F.col(key).alias("key"),
        leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        *[value.alias(n) for n, value in zip(names, carried.values(), strict=True)],
    )
    leaves, sources = _ranked(rows, names)
    request = F.struct("rank", "group", "key", "leaf", *[F.col(n).alias(c) for n, c in zip(names, carried, strict=True)])
    runs = leaves.groupBy("tree", F.shiftright("rank", _BITS).alias("run"))
    runs = runs.agg(F.sort_array(F.collect_list(request)).alias("requests"), F.first("total").alias("total"))
    runs = keep(runs.withColumn("children", F.col("requests")["leaf"]), "runs")
    sizes = sources.agg(F.max("total"), F.count(F.lit(1))).collect()[0]  # two numbers
    if not sizes[1]:
        return Manifest(runs, sources.select("group", "tree", F.lit(None).cast("string").alias("subroot"), F.lit(0).alias("height")), None)
    highest, top_height = _height(sizes[0]), _height(sizes[1])
    lone = F.col("total") == 1
    first = runs.select(
        "tree",
        F.col("run").alias("rank"),
        F.when(lone, F.element_at("children", 1)).otherwise(F.sha2(_joined(F.col("children")), 256)).alias("digest"),
        F.when(~lone, F.col("children")).alias("children"),
        F.ceil(F.col("total") / WIDTH).alias("left"),
    )
    records, tops = _grow(first, max(highest - 1, 0))
    records = ([first.filter("children IS NOT NULL").select("digest", "children")] if highest else []) + records
    sources = sources.select("group", "tree", _height_of(F.col("total"), highest).alias("height"))
    sources = keep(sources.join(tops.withColumnRenamed("digest", "subroot"), "tree"), "subroots")
    above = sources.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest"), F.lit(None).cast("array<string>").alias("children"), F.lit(sizes[1]).alias("left"))
    top, root = _grow(above, top_height)
    return Manifest(runs, sources, root.collect()[0]["digest"], records, top)  # one digest


_PATH = "array<struct<left:string,right:string>>"


def _step(path: Column, children: Column, digit: Column) -> Column:
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(WIDTH))
    return F.concat(path, F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"))))


def _descend(frontier: DataFrame, records: DataFrame, height: int, wanted: DataFrame | None = None) -> DataFrame:
    """Requests that stand at the given height look up their digest and go one level down; others wait. A digest may stand
    at several places where rows repeat, but its record is there once."""
    found = records.dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), "children")
    rows = frontier.join(found, (F.col("digest") == F.col("_digest")) & (F.col("height") == height), "left")
    others = [c for c in frontier.columns if c not in ("rank", "digest", "height", "path")]
    down = rows.select(*others, "rank", "digest", "height", "path", "children", F.posexplode_outer("children").alias("digit", "child"))
    moves = F.col("child").isNotNull()
    down = down.select(
        *others,
        F.when(moves, F.shiftleft("rank", _BITS) + F.col("digit")).otherwise(F.col("rank")).alias("rank"),
        F.coalesce("child", "digest").alias("digest"),
        F.when(moves, F.col("height") - 1).otherwise(F.col("height")).alias("height"),
        F.when(moves, _step(F.col("path"), F.col("children"), F.col("digit"))).otherwise(F.col("path")).alias("path"),
    )
    if wanted is None:
        return down
    prefixes = wanted.select(F.col("tree").alias("_tree"), F.shiftright("run", _BITS * (height - 2)).alias("_prefix")).distinct()
    asked = (F.col("tree") == F.col("_tree")) & (F.col("rank") == F.col("_prefix")) & (F.col("height") == height - 1)
    kept = down.join(prefixes, asked, "left").filter(F.col("_prefix").isNotNull() | (F.col("height") != height - 1))
    return kept.drop("_tree", "_prefix")


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(group, key, leaf, carried..., subroot, root, path): for every leaf the siblings on its way to the root.

    ``path`` lists the levels from the leaf up; ``left`` and ``right`` are the siblings' digests, joined. A leaf that is its
    level's only node has empty siblings there, a lone leaf of a group has no level in that group's tree. ``wanted`` (tree, run)
    limits the requests to runs of leaves; ``manifest.groups`` says which hold a key. An empty table gives no row.
    """
    spark = manifest.groups.sparkSession
    groups = manifest.groups
    if wanted is not None:
        wanted = wanted.select("tree", "run").distinct()
        groups = groups.join(wanted, ["tree", "run"], "left_semi")
    start = [(manifest.root, 0, len(manifest.top))] if manifest.root else []
    at = spark.createDataFrame(start, "digest string, rank long, height int").withColumn("path", F.array().cast(_PATH))
    for height in range(len(manifest.top), 0, -1):
        at = _descend(at, manifest.top[height - 1], height)
    trees = manifest.sources.select("tree", "height")
    at = at.select(F.col("rank").alias("_tree"), F.col("digest"), "path", F.col("digest").alias("subroot"))
    at = at.join(trees, F.col("_tree") == F.col("tree")).select("tree", "subroot", F.lit(0).cast("long").alias("rank"), "digest", "height", "path")
    for height in range(len(manifest.records), 1, -1):
        at = _descend(at, manifest.records[height - 1], height, wanted)
    # all requests of a run meet its parent's record; their own level is added where they part
    parent = at.select(F.col("tree").alias("_tree"), F.col("rank").alias("_run"), F.col("digest").alias("_digest"), "subroot", "height", "path")
    if manifest.records:
        found = manifest.records[0].dropDuplicates(["digest"]).select("digest", F.col("children").alias("siblings"))
        parent = parent.join(found, (F.col("_digest") == F.col("digest")) & (F.col("height") == 1), "left").drop("digest")
    else:
        parent = parent.withColumn("siblings", F.lit(None).cast("array<string>"))
    met = groups.join(parent, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
    rows = met.select(F.posexplode("requests").alias("digit", "request"), "siblings", "path", "subroot", F.lit(manifest.root).alias("root"))
    whole = F.when(F.col("siblings").isNotNull(), _step(F.col("path"), F.col("siblings"), F.col("digit"))).otherwise(F.col("path"))
    return rows.select("request.*", "subroot", "root", F.reverse(whole).alias("path")).drop("rank")
