"""The corpus pipeline: from raw documents to token files, one operator per stage.

Each stage takes (spark, docs, sf_dir) and all documents that the one before kept, and returns documents with the same
columns; the last returns what its files hold. ``run`` writes every stage's documents to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import copies, languages, leaks, mixing, tokens
from cohortia.llm.shared import keep

#: Documents whose two best languages are nearer than this share of their encoded size go.
NARROW = 0.005


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """(row, columns...): the row in one struct, so that no column of it can clash with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language isn't clear. Dictionaries are learned from ``lang``.

    NULL and empty texts have no letters and go; texts of any length are judged as ``languages.identify`` does; repeated rows are judged
    alike. Where no row has a language, nothing can be told and all go. Columns of any names are kept as they are; an empty table gives
    an empty table."""
    found = languages.identify(packed(docs, F.col("text")), languages.learn_languages(docs), narrow=NARROW, prefix="_")
    return found.filter(~F.col("_rejected")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group of near copies (five words, 80 percent), and documents with a
    NULL id. Of rows with equal id and text one stays.

    An id that repeats with another text is judged by each of its texts. NULL, empty and wordless texts are no copies. Columns of any
    names are kept as they are; an empty table gives an empty table."""
    groups = copies.near_copies(docs.select("doc_id", "text"))
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = packed(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    left = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    return left.select("row.*").dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    NULL and empty texts hold none and stay; long texts are searched whole; repeated rows are judged alike. Columns of any names are kept
    as they are; an empty table gives an empty table, an empty benchmark drops nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.mark_leaks(packed(docs, F.col("text")), items).filter(F.size("leaks") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, also where that is in part.

    NULL sources are one source; documents without words are taken no time. Rows of one id, or without an id, are all taken as often as
    the one of them that is taken most. Columns of any names are kept as they are; an empty table gives an empty table."""
    taken = mixing.mix_sources(docs.select("doc_id", "text", "source")).groupBy("doc_id").agg(F.max("rounds").alias("rounds"))
    taken = taken.filter("rounds > 0").withColumnRenamed("doc_id", "taken_id")
    mixed = packed(docs, F.col("doc_id").alias("id")).join(taken, F.col("id").eqNullSafe(F.col("taken_id")))
    return mixed.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row per document in the order of the files. NULL and empty texts are the end id alone; repeated rows are encoded
    each; an empty table gives an empty table."""
    return tokens.encode_documents(docs, tokens.default_tokenizer())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Compression, MinHash and tokens have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
