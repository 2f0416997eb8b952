"""The Merkle manifest against a plain version: nested lists of digests, and proofs folded by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortia.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, rank long, digest string, group string, leaf string, path string, key long"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def table(spark, rows, parts=3):
    full = [(i, t, lang, s, n, 7, 8, "x", "g", "l", "p", 9) for i, s, lang, n, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def way(levels, place):
    steps = []
    for level in levels[:-1]:
        run, at = place // 16 * 16, place % 16
        nodes = level[run : run + 16]
        steps.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
        place //= 16
    return steps


def plain(rows):
    """sorted (key, leaf, subroot, root, path)"""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, h(*map(field, r))) for r in groups[name]))
        trees.append((leaves, plain_tree([leaf for *_, leaf in leaves])))
    above = plain_tree([levels[-1][0] for _, levels in trees])
    found = []
    for k, (leaves, levels) in enumerate(trees):
        for place, (known, key, leaf) in enumerate(leaves):
            path = way(levels, place) + way(above, k)
            found.append((key if known else None, leaf, levels[-1][0], above[-1][0], tuple(path)))
    return sorted(found, key=str)


def proofs(docs, **how):
    rows = manifest.prove(manifest.build_manifest(docs), **how).collect()
    return sorted(((r.key, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in rows), key=str)


CASES = {
    "mixed": [(k, ["a", "b", None, "ä", "Z", ""][k % 6] if k % 7 else "a", "en" if k % 3 else None, k if k % 5 else None, f"Text {k} é" if k % 4 else None) for k in range(700)]
    + [(1, "a", None, None, ""), (1, "a", None, None, ""), (None, "a", None, None, "x"), (None, None, None, None, None), (None, None, None, None, None), (9999, "alone", "en", 5, "L" * 300_000)],
    "hot": [(k, "s", "en", 1, "same") for k in range(16**2 + 1)],
    "equal rows": [(5, "s", "en", 1, "same")] * 600 + [(6, None, None, None, None)],
    "one row": [(3, None, None, None, "only")],
    "many groups": [(k, f"g{k}", "en", 1, "t") for k in range(40)] + [(100 + k, "g7", "en", 1, "t") for k in range(16)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_plain_trees(spark, name):
    rows = CASES[name]
    assert proofs(table(spark, rows)) == plain(rows)


def test_empty(spark):
    built = manifest.build_manifest(table(spark, []))
    assert built.root is None and built.store() is None and manifest.prove(built).collect() == []


def test_fold_and_tampering(spark):
    rows = CASES["mixed"][:200]
    docs = table(spark, rows)
    other = manifest.leaf_digest([F.col(c) for c in COLUMNS[:-1]] + [F.translate("text", "T", "t")])
    found = manifest.prove(manifest.build_manifest(docs, carry={"other": other}))
    found = found.select("key", "leaf", "root", manifest.fold(F.col("leaf"), F.col("path")).alias("same"), manifest.fold(F.col("other"), F.col("path")).alias("changed"), manifest.path_digest(F.col("path")).alias("proof"))
    expected = {(key, leaf): h(*(s for step in path for s in step)) for key, leaf, _, _, path in plain(rows)}
    texts = {r[0]: r[4] for r in rows}
    for r in found.collect():
        assert r.same == r.root and r.proof == expected[r.key, r.leaf]
        assert (r.changed == r.root) == (texts[r.key] is None)


def test_store_and_wanted(spark):
    rows = CASES["mixed"]
    built = manifest.build_manifest(table(spark, rows))
    records = {r.digest: r.children for r in built.store().collect()}
    assert all(h(*children) == digest and len(children) <= 16 for digest, children in records.items())
    waiting, leaves = [built.root], set()
    while waiting:
        digest = waiting.pop()
        if digest in records:
            waiting += records[digest]
        else:
            leaves.add(digest)
    assert leaves == {leaf for _, leaf, *_ in plain(rows)}
    wanted = built.groups.filter(F.exists("requests", lambda r: r["key"].isin(17, 9999)))
    some = {(r.key, r.leaf) for r in manifest.prove(built, wanted).collect()}
    every = {(key, leaf): (root, path) for key, leaf, _, root, path in plain(rows)}
    assert {17, 9999} <= {k for k, _ in some} and len(some) <= 32 and some <= set(every)
