"""Half of all rows share one text or have no id: samples stay small, sources and ranges are cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortia.llm import languages, mixing, quality, shared, tokens


def test_a_session_of_one_process_may_use_a_local_folder():
    assert shared.one_process("local") and shared.one_process("local[8]") and shared.one_process("local[*]")
    assert not any(shared.one_process(x) for x in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"))


def test_first_of_each(spark):
    rows = spark.range(1000, numPartitions=7).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 10).alias("k"), F.lit("x").alias("v"))
    assert sorted(r.k for r in shared.first_of_each(rows, "k").collect()) == [0, 1, 3, 5, 7, 9]
    assert shared.first_of_each(rows.filter("false"), "k").collect() == []


def test_quality_sample_counts_a_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, size: seen.append(rows) or size)
    varied = spark.range(200).select(F.concat(F.lit("text of number "), "id").alias("text"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").alias("m"))
    hot = spark.range(400).select(F.lit("one text").alias("text"), F.lit(1).alias("y"), F.when(F.col("id") > 5, F.col("id")).alias("m"))
    empty = spark.createDataFrame([(None, 0, 3), ("", 0, 2), ("no label", None, 1)], "text string, y int, m long")
    rows = varied.unionByName(hot).unionByName(empty)
    quality.learn_quality(rows, "y", metadata=["m"])
    assert len(seen[0]) == 202
    ided = rows.withColumn("doc_id", F.xxhash64("text", "m"))
    labels = ided.select("doc_id", "y").distinct()
    quality.learn_quality(ided.drop("y"), "y", metadata=["m"], labels=labels)
    assert sorted(r[1].tobytes() for r in seen[1]) == sorted(r[1].tobytes() for r in seen[0])
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    quality.learn_quality(rows, "y", metadata=["m"])
    assert len(seen[2]) == 50


def test_quality_features_by_hand():
    """Hashed words of a block equal those of each text on its own, with counts that a plain split gives."""
    texts = ["good words here", "", "twice twice  twice\tand once", "a", "ünïcode wörds\nin lines\n" * 30]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    (_, data, offsets), = shared.blocks([whole], "text")
    pointers, features, values = quality.block_features(data, offsets, [])
    for k, text in enumerate(texts):
        (_, data, offsets), = shared.blocks([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])], "text")
        alone = quality.block_features(data, offsets, [])
        own = slice(pointers[k], pointers[k + 1])
        order, other = np.lexsort((values[own], features[own])), np.lexsort((alone[2], alone[1]))
        assert (features[own][order] == alone[1][other]).all()
        assert np.allclose(values[own][order], alone[2][other])
        words = set(text.split())
        assert len(np.unique(features[own][features[own] < quality.BUCKETS])) == len(words)


def test_language_sample_counts_a_text_once(spark):
    varied = spark.range(300).select(F.concat(F.lit("the words of number "), F.col("id").cast("string"), F.lit(" and more")).alias("text"), F.lit("en").alias("lang"))
    hot = spark.range(300).select(F.lit("das eine wort").alias("text"), F.lit("de").alias("lang"))
    known = languages.learn_languages(varied.unionByName(hot))
    assert known.names == ("en", "de")
    assert (known.leads[1] + known.dictionaries[1]).count(b"das eine wort") <= 2
    same = languages.learn_languages(varied.unionByName(hot.limit(1)))
    assert same == known


@pytest.mark.parametrize("text", ["lower case words ünd more", "x", "many words " * 50, "1 2 3 a"])
def test_language_by_hand(spark, text):
    """The smallest encoding by plain calls of the compressor."""
    import zstandard as z

    samples = {"en": "the cat sat on the mat and the dog ran away", "de": "der hund lief weg und die katze lag auf dem sofa"}
    rows = [(f"{x} {k}", lang) for lang, x in samples.items() for k in "abcdefgh"]
    known = languages.learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    found = languages.identify(spark.createDataFrame([(text,)], "text string"), known).first()
    reduced = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
    settings = z.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    sizes = []
    for words, lead in zip(known.dictionaries, known.leads, strict=True):
        coder = z.ZstdCompressor(compression_params=settings, dict_data=z.ZstdCompressionDict(words, dict_type=z.DICT_TYPE_RAWCONTENT))
        sizes.append(len(coder.compress(lead + b" " + reduced)) - len(coder.compress(lead)))
    assert found.lang_pred == known.names[sizes.index(min(sizes))]
    assert found.score == pytest.approx((max(sizes) - min(sizes)) / max(sizes))


def test_sources_without_ids_are_summed_in_parts(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")
    )
    sized = mixing.sized_documents(rows, "doc_id", "text", "source").filter("doc_id IS NULL")
    assert sized.groupBy(F.substring("key", 1, mixing.PART_DIGITS)).count().agg(F.max("count")).first()[0] < 20
    taken = mixing.mix_sources(rows).agg(F.sum("taken")).first()[0]
    assert taken == 9000  # 150 % of 2000 documents of 3 words


def test_an_id_of_half_the_rows_is_cut_into_ranges(spark, tmp_path):
    rows = spark.range(4000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = tokens.write_sequences(rows, f"file://{tmp_path}/out", tokens.default_tokenizer(), length=64)
        counts = [r.n_docs for r in manifest.collect()]
        assert sum(counts) == 4000 and max(counts) < 2000
        found = tokens.document_checks(manifest).orderBy("start").collect()
        ids = [r.doc_id for r in found]
        assert ids == [None] * 2000 + list(range(0, 4000, 2))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
