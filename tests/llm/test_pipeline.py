"""The pipeline, stage by stage, against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from cohortia.llm import mixing
from cohortia.llm.shared import keep

ALPHABET = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing".split(), "bb": "quick brown jumps over lazy fences today".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random = np.random.default_rng(4)
    rows = []
    for k in range(120):
        lang = "aa" if k % 3 else "bb"
        words = [f"{w}{random.choice(list('qzxj'))}" for w in random.choice(ALPHABET[lang], 50)]
        rows.append((k, " ".join(words), lang, f"s{k % 4}" if k % 9 else None, None))
    rows += [(200, rows[0][1], "bb", "s1", 3), (201, rows[1][1] + " more", "aa", "s2", 3), (1, rows[1][1], "aa", "s1", None)]
    item = "a benchmark question that nobody should have seen before the test is over, with its answer forty two"
    rows += [(300, rows[2][1] + " " + item + " " + rows[4][1], "aa", "s3", 1), (301, "12 34", "aa", "s1", 2), (302, None, "aa", "s1", 2), (None, rows[7][1] + " unlike others", "aa", "s2", 2)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, folder), name)
        kept.append(docs)
        if name != "tokens":
            assert docs.columns == before.columns
    language, near, clean, mixed, files = kept
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert {301, 302}.isdisjoint(ids(language)) and set(range(120)) <= set(ids(language))
    gone = {200, 201}
    assert sorted(set(ids(language)) - set(ids(near)), key=str) == sorted(gone) and ids(near).count(1) == 1 and None in ids(near)
    assert set(ids(near)) - set(ids(clean)) == {300}
    rounds = {r.doc_id: r.rounds for r in mixing.mix_sources(clean).collect()}
    assert ids(mixed) == sorted((i for i, n in rounds.items() for _ in range(n)), key=str)
    found = sorted(files.collect(), key=lambda r: r.start)
    assert sorted((r.doc_id for r in found), key=str) == ids(mixed)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100
