"""Maximal repeats with all their occurrences, and names that are too long, against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import personal, repeats

LENGTH = 60
SPAN = LENGTH - repeats.GRAM


def corpus():
    dice = np.random.default_rng(8)
    letters = lambda n: "".join(dice.choice(list("abcd \n"), n))
    passages = [letters(n) for n in (60, 64, 75, 150)]
    rows = [(k, letters(int(dice.integers(0, 40))) + passages[k % 4][int(dice.integers(0, 6)) :] + letters(int(dice.integers(0, 40)))) for k in range(24)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, passages[2]), (53, "x" + passages[2] + "y" + passages[2]), (54, None), (55, ""), (None, passages[1])]
    return rows


def occurrences(texts, passage):
    return {(k, p) for k, t in enumerate(texts) for p in range(len(t) - len(passage) + 1) if t.startswith(passage, p)}


def plain_repeats(texts):
    """All strings of LENGTH bytes and more that occur again, and whose occurrences differ, or end, on both sides."""
    found = {}
    for n in range(LENGTH, max(map(len, texts)) + 1):
        places = defaultdict(list)
        for k, t in enumerate(texts):
            for p in range(len(t) - n + 1):
                places[t[p : p + n]].append((k, p))
        for passage, own in places.items():
            before = [texts[k][p - 1 : p] if p else (k, p) for k, p in own]
            after = [texts[k][p + n : p + n + 1] or (k, p) for k, p in own]
            if len(own) > 1 and len(set(before)) > 1 and len(set(after)) > 1:
                found[passage] = own
    return found


@pytest.mark.parametrize("group", [4096, 5])
def test_groups_have_all_occurrences(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus()
    texts = [(t or "").encode() for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r.k1, r.k2): (r.text or "").encode() for r in docs.select("text", *repeats._keys(F.coalesce("text", F.lit("")))).collect()}
    groups = defaultdict(list)
    for r in repeats.repeat_groups(docs, length=LENGTH).collect():
        groups[r.anchor, r.passage].append(r)
    named = set()
    for own in groups.values():
        strings = {keys[r.k1, r.k2][r.start : r.end] for r in own}
        assert len(strings) == 1
        passage = strings.pop()
        assert len(passage) == own[0].n_bytes >= LENGTH
        expected = occurrences(texts, passage)
        assert len(expected) == own[0].occurrences == sum(r.copies for r in own) > 1
        assert {(keys[r.k1, r.k2], r.start) for r in own} == {(texts[k], p) for k, p in expected} and len(own) == len({(texts[k], p) for k, p in expected})
        named.add(passage)
    if group == 4096:
        expected = plain_repeats(texts)
        assert len(expected) > 5
        for passage in expected:
            for at in repeats.anchors(np.frombuffer(passage, np.uint8), np.array([0, len(passage)]), LENGTH)[0].tolist():
                assert passage[max(0, at - SPAN) : at + repeats.GRAM + SPAN] in named


def test_no_groups(spark):
    rows = [(1, None), (2, ""), (2, "short"), (3, "short"), (None, "x" * 20), (4, "".join(chr(97 + k * k % 23) + str(k) for k in range(80)))]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, a string")
    assert repeats.repeat_groups(docs, length=LENGTH).collect() == []
    assert repeats.repeat_groups(docs.limit(0), length=LENGTH).collect() == []


def test_long_names_are_not_cut():
    name = "n" * (personal.MOST_NAME + 1)
    assert [units for kind, units in personal.clusters(f"{name} at example dot org") if kind == "name"] == []
    assert personal.clusters(f"{name[1:]} at example dot org")[0][1][0] == (0, personal.MOST_NAME)
    label = "l" * 64
    assert personal.clusters(f"joe at {label} dot org") == []
    assert [u[-1] for _, u in personal.clusters(f"joe at {label[1:]} dot org")] == [(75, 78)]
