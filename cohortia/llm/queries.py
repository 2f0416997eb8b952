"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import copies, languages, leaks, manifest, mixing, personal, quality, repeats, tokens, toxicity, urls, vectors, whitening
from cohortia.llm.registry import query, table
from cohortia.llm.shared import keep

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(remainder("doc_id", 4) != 2).select("doc_id", "quality")
    machine = quality.learn_quality(docs, "quality", metadata=["n_chars"], labels=known)
    scored = quality.score_quality(docs, machine, metadata=["n_chars"])
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Pairs by shared shingles, then what each document reaches. For small tables only: a shingle's documents meet in pairs.
NEAR_COPIES_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON a = doc_id
"""


@query(NEAR_COPIES_SQL)
def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.near_copies(table(spark, sf_dir, "documents"), size=2).drop("text_hash")


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.find_personal_data(docs, personal.learn_field(docs))


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = languages.learn_languages(docs.filter(remainder("doc_id", 5) != 0))
    found = languages.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: All pairs of a label, then what each vector reaches. For small tables only.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY ALL),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""


@query(NEAR_VECTORS_SQL)
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query()
def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.mark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), "leak.windows", "leak.found", "leak.start", "leak.end", "leak.edits")


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """``labelled`` (url, label) takes the place of the small table that the package brings."""
    model = urls.fit_url_model(urls.labelled_urls(spark) if labelled is None else labelled)
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("url_score", 6).alias("url_score"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS upper, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM by_source),
levels AS (
  SELECT *, (budget - coalesce(sum(upper) OVER (ORDER BY upper / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY upper / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, number, source_size, budget, least(upper, weight * max(level) OVER ()) AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.number, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY t.number ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT doc_id, size, number, budget, upto + source_size * turn AS c, CAST(upto + source_size * turn AS DOUBLE) / target AS t
  FROM queued, (VALUES (0), (1)) v(turn) WHERE size > 0),
taken AS (
  SELECT doc_id, greatest(0, least(size, CAST(floor(budget) AS BIGINT) - (CAST(sum(size) OVER (ORDER BY t, number, c ROWS UNBOUNDED PRECEDING) AS BIGINT) - size))) AS n
  FROM items)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(sum(n), 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken USING (doc_id) GROUP BY ALL
"""


@query(MIX_SQL)
def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: crc32 byte by byte over a table; the tree level by level, 16 nodes at a time; a proof by joins with its level's run.
MANIFEST_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN xor(list_reduce(
                list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents, crc),
fields AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(other) || ':' || other, '-') AS changed
  FROM texts),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n, sha256(head || body) AS leaf, sha256(head || changed) AS tampered
  FROM fields),
nodes AS (
  SELECT tree, rank, leaf AS digest, n, 0 AS level FROM leaves
  UNION ALL
  SELECT tree, rank // 16, sha256(string_agg(digest, '' ORDER BY rank)), (n + 15) // 16, level + 1 FROM nodes WHERE n > 1
  GROUP BY tree, rank // 16, n, level),
subroots AS (SELECT tree, digest AS subroot, level AS height FROM nodes WHERE n = 1),
above AS (
  SELECT tree AS rank, subroot AS digest, count(*) OVER () AS n, 0 AS level FROM subroots
  UNION ALL
  SELECT rank // 16, sha256(string_agg(digest, '' ORDER BY rank)), (n + 15) // 16, level + 1 FROM above WHERE n > 1
  GROUP BY rank // 16, n, level),
whole AS (SELECT digest AS root FROM above WHERE n = 1),
all_nodes AS (
  SELECT tree, rank, digest, level FROM nodes WHERE n > 1
  UNION ALL
  SELECT -1, rank, digest, level FROM above WHERE n > 1),
paired AS (
  SELECT x.tree, x.rank, x.level, coalesce(string_agg(y.digest, '' ORDER BY y.rank) FILTER (y.rank < x.rank), '') AS lefts,
         coalesce(string_agg(y.digest, '' ORDER BY y.rank) FILTER (y.rank > x.rank), '') AS rights
  FROM all_nodes x JOIN all_nodes y ON x.tree = y.tree AND x.level = y.level AND x.rank // 16 = y.rank // 16 GROUP BY ALL),
climb AS (
  SELECT doc_id, tree, rank, leaf, tampered AS folded, '' AS siblings, 0 AS level, tree AS own, rank AS place FROM leaves
  UNION ALL
  SELECT * FROM (
    WITH here AS (
      SELECT c.*, CASE WHEN c.own >= 0 AND c.level = s.height THEN -1 ELSE c.own END AS o,
             CASE WHEN c.own >= 0 AND c.level = s.height THEN c.tree ELSE c.place END AS p,
             CASE WHEN c.own >= 0 AND c.level = s.height THEN 0 ELSE c.level END AS l
      FROM climb c JOIN subroots s ON s.tree = c.tree)
    SELECT h.doc_id, h.tree, h.rank, h.leaf, sha256(q.lefts || h.folded || q.rights), h.siblings || q.lefts || q.rights, h.l + 1, h.o, h.p // 16
    FROM here h JOIN paired q ON q.tree = h.o AND q.level = h.l AND q.rank = h.p)),
tops AS (SELECT coalesce(max(level), 0) AS top FROM above),
ends AS (
  SELECT c.* FROM climb c JOIN subroots s ON s.tree = c.tree, tops
  WHERE CASE WHEN top = 0 THEN c.own >= 0 AND c.level = s.height ELSE c.own = -1 AND c.level = top END)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM ends JOIN subroots USING (tree), whole
"""


@query(MANIFEST_SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = remainder("doc_id", 5) == 0
    other = F.when(hit, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    tampered = manifest.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [other])
    proofs = manifest.prove(manifest.build_manifest(docs, carry={"tampered": tampered}))
    found = proofs.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        manifest.path_digest(F.col("path")).alias("proof_sha256"),
        manifest.fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    model = toxicity.learn_toxicity(docs.select("doc_id", "text"), "toxic", known)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("hits").cast("long").alias("n_hits"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is NULL where the sum is beyond a long; deviation_digits has all of it."""
    vectors_ = table(spark, sf_dir, "embeddings")
    model = whitening.learn_whitening(vectors_)
    found = keep(whitening.whiten(vectors_, model), "whitened")
    width = 0 if model is None else len(model.axes)
    error = whitening.identity_error(found, width)
    shares = F.array(*[F.lit(float(s)) for s in model.explained]) if width else F.array().cast("array<double>")
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "value"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_digits"),
    )
