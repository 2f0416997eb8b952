"""Repeated ids, periodic and very long texts, empty labels, and columns whose names a stage uses itself."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortia.llm import copies, leaks, repeats, urls, vectors

WORDS = [f"w{k}" for k in range(60)]
A, B = " ".join(WORDS[:30]), " ".join(WORDS[30:])


@pytest.mark.parametrize("turn", [1, -1])
def test_copies_of_each_text_of_an_id(spark, turn):
    rows = [(1, A), (1, B), (2, B + " x"), (3, A + " x"), (4, "other words that nobody else has")][::turn]
    found = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {(r.doc_id, r.component_id, r.kept) for r in found.collect()} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    assert found.count() == 5


@pytest.mark.parametrize("turn", [1, -1])
def test_links_of_each_vector_of_an_id(spark, turn):
    v, w = [1.0, 0.2, 0.1, 0.0], [0.0, -0.3, 1.0, 1.0]
    rows = [(1, v, 7), (1, w, 7), (2, [2 * c for c in v], 7), (5, w, 8)][::turn]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 0, 5, True)]


def search(text, known):
    data = np.frombuffer(text.encode(), np.uint8)
    return leaks.find_leaks(data, np.array([0, len(data)]), known)[0]


def test_periodic_texts_stay_in_memory():
    known = leaks.Benchmark([(1, "a" * 5000), (2, "ha " * 700), (3, "the quick brown fox jumps over the lazy dog and runs away from it all day long")])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [x["item"] for x in search("a" * 100_000, known)] == [1]
    assert 2 in [x["item"] for x in search("ha " * 20_000, known)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kilobytes
    assert search("b" * 100_000, known) == []


@pytest.mark.parametrize("size", [1 << 20, 37])
def test_slices_change_nothing(monkeypatch, size):
    dice = np.random.default_rng(3)
    vocabulary = ["".join(dice.choice(list("abcdefgh"), 4)) for _ in range(40)]
    items = [(k, " ".join(dice.choice(vocabulary, 30))) for k in range(20)]
    known = leaks.Benchmark(items)
    texts = [" ".join([*dice.choice(vocabulary, 50), items[k][1][20:120], *dice.choice(vocabulary, 50)]) for k in range(0, 20, 4)]
    expected = [search(t, known) for t in texts]
    assert all(k in [x["item"] for x in found] for k, found in zip(range(0, 20, 4), expected))
    monkeypatch.setattr(leaks, "SLICE", size)
    assert [search(t, known) for t in texts] == expected


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([("http://a.com/x", None)], 0.0), ([(None, 1), ("http://a.com/" + "y" * 5000, 1)], 1.0), ([("http://a.com", 0)], 0.0)])
def test_labels_that_tell_nothing_apart(spark, labels, score):
    model = urls.fit_url_model(spark.createDataFrame(labels, "url string, label int"))
    pages = spark.createDataFrame([(1, "http://b.net/es/"), (2, None), (3, "http://c.org/" + "z" * 20_000)], "page_id long, url string")
    found = {r.page_id: r for r in urls.judge_urls(pages, [("net", "/es/", "block")], model).collect()}
    assert {r.url_score for r in found.values()} == {score} and found[1].verdict == "block"
    assert found[2].verdict == found[3].verdict == ("block" if score else "allow")


def test_repeat_across_a_piece_of_a_long_text(spark):
    dice = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = letters[dice.integers(0, 26, repeats.PIECE + 300_000)].tobytes().decode()
    passage = text[repeats.PIECE - 150 : repeats.PIECE + 150]
    rows = [(1, text), (2, "#" + passage + "#"), (3, "-" * 150), (4, None), (5, "é" * 99)]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {
        1: (len(text), 300, 1, sha(text.replace(passage, ""))), 2: (302, 300, 1, sha("##")),
        3: (150, 0, 0, sha("-" * 150)), 4: (0, 0, 0, sha("")), 5: (198, 0, 0, sha("é" * 99)),
    }


def test_filter_is_never_wrong_about_members(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(repeats, "MOST_BITS", 1 << 16)
    rows = spark.range(60_000).select(F.xxhash64("id").alias("k1"), "id")
    for share in (10, 3000):
        maybe = repeats.among(rows.filter(F.col("id") % share == 0).select("k1"))
        kept = {r.id for r in rows.filter(maybe(F.col("k1"))).select("id").collect()}
        assert set(range(0, 60_000, share)) <= kept and len(kept) < 20_000
    assert rows.filter(repeats.among(rows.limit(0).select("k1"))(F.col("k1"))).count() == 0


CLASHES = ["_score", "_lang_pred", "_rejected", "_leaks", "leaks", "_round", "round", "_id", "id", "_rounds", "rounds", "row", "hash", "a.b", "taken_id"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(k, " ".join(WORDS[k : k + 25]) + f" letters {k}", "en", f"s{k % 2}", 5) for k in range(6)] + [(None, "no id but some words", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHES])
    spark.createDataFrame([(1, "a benchmark question that is not in any of these texts at all, so nothing is dropped")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found, name
        for r in found:
            assert all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
