"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed n-grams: sizes and number of buckets.
SIZES = (3, 4, 5)
BUCKETS = 1 << 16

#: The labelled URLs the model learns from, made from words for hosts and for paths: unwanted ones and ordinary ones.
UNWANTED = ["casino", "casino-royal", "poker", "jackpot", "slots", "roulette", "bets", "bet-now", "sports-bet", "betting", "adult", "adults-only", "xxx", "porn", "sex-cams", "pills", "viagra", "pharmacy-cheap", "spam", "link-farm", "ads", "adserver", "click-track", "tracker-ads", "win-prize", "free-money", "loans-fast", "warez", "keygen"]
ORDINARY = ["news", "weather", "library", "museum", "university", "school", "recipes", "garden", "history", "science", "physics", "music", "travel", "health", "hospital", "city", "council", "theatre", "books", "journal", "review", "forum", "docs", "wiki", "support", "research", "nature", "football", "cinema", "radio", "notes", "homepage", "example", "farmers", "freedom", "wingate", "tracks", "clickers"]
FRONTS = ["", "www.", "m.", "blog."]
ENDS = [".com", ".net", ".org", ".example.com", ".example.net", ".example.org"]
PLAIN_PATHS = ["/", "/en/1234", "/de/77.html", "/fr/5678/", "/es/901", "/index.html", ""]
UNWANTED_PATHS = ["/casino/", "/online-casino/play", "/poker-bonus.html", "/slots/jackpot", "/betting/odds", "/bets/today", "/free-spins", "/porn/videos", "/xxx/12.html", "/sex-cams/", "/buy-viagra", "/pills/cheap", "/pharmacy/order", "/warez/crack", "/keygen.html", "/win-money/", "/loans/fast", "/ads/click", "/track/ads", "/spam/"]
ORDINARY_PATHS = ["/news/2021", "/articles/weather", "/library/books", "/about", "/contact.html", "/recipes/soup", "/history/rome", "/science/physics/12", "/wiki/garden", "/docs/manual", "/support/faq", "/travel/italy", "/health/advice", "/sports/football", "/music/jazz", "/reviews/cinema", "/events/theatre", "/blog/2020/notes", "/school/lessons", "/search"]

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path follows up to
    ``? #`` or the end. Both are empty for NULL and where there is no ``://``."""
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, parts, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or NULL. A rule (host, path, verdict) fits its host and
    all subdomains where the path starts with the rule's. Of equally long rules the one with the longer host wins, of
    equal rules ``block``. For a list of rules as short as a person writes it: it becomes one CASE expression."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r[0]))
    found = None
    for at, start, verdict in ordered:
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the default training table; label 1 is unwanted. A URL is unwanted where its host or its path is.
    Each host comes with every front and plain paths, so these tell nothing; ordinary hosts also come with unwanted paths,
    label 1, and with ordinary ones, label 0. Fronts, endings and words are taken in turn."""
    rows = []
    for label, hosts in ((1, UNWANTED), (0, ORDINARY)):
        for k, host in enumerate(hosts):
            for j, front in enumerate(FRONTS):
                rows.append((f"http://{front}{host}{ENDS[(k + j) % len(ENDS)]}{PLAIN_PATHS[(k + 2 * j) % len(PLAIN_PATHS)]}", label))
    for label, paths in ((1, UNWANTED_PATHS), (0, ORDINARY_PATHS)):
        for k, path in enumerate(paths):
            for j, front in enumerate(FRONTS):
                rows.append((f"http://{front}{ORDINARY[(5 * k + 7 * j) % len(ORDINARY)]}{ENDS[(k + j) % len(ENDS)]}{path}", label))
    table = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in rows])
    return spark.range(1, numPartitions=1).select(F.inline(table))


def _features(df: DataFrame, host: str, path: str) -> DataFrame:
    """Adds _vector: counts of hashed n-grams, those of the host apart from those of the path."""

    def grams(part: str, mark: str, n: int) -> Column:
        text = F.concat(F.lit("^"), F.regexp_replace(F.col(part), "[0-9]+", "0"), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))

    terms = F.concat(*[grams(part, mark, n) for part, mark in ((host, "h"), (path, "p")) for n in SIZES])
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_vector").transform(df.withColumn("_grams", terms)).drop("_grams")


@dataclass
class ConstantScore:
    """What takes the model's place where the labels tell nothing apart: one score for every URL."""

    score: float


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "label", strength: float = 0.01) -> LogisticRegressionModel | ConstantScore:
    """Logistic regression on the labelled URLs (label 1: unwanted). The table is small: hundreds to thousands of rows.

    Rows without a label are left out; a NULL URL is an empty one. Without labelled rows every URL scores 0, with one class only that
    class's label.
    """
    host, path = split_url(F.col(url))
    rows = labelled.select(host.alias("_host"), path.alias("_path"), F.col(label).cast("double").alias("_label")).filter("_label IS NOT NULL")
    low, high = rows.agg(F.min("_label"), F.max("_label")).first()
    if low is None or low == high:
        return ConstantScore(low or 0.0)
    learner = LogisticRegression(featuresCol="_vector", labelCol="_label", regParam=strength, maxIter=60)
    return learner.fit(_features(rows, "_host", "_path"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: LogisticRegressionModel | ConstantScore, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The columns of ``pages`` with host, path, rule, verdict and url_score.

    verdict is the longest rule's, else ``block`` where url_score, the model's probability that the URL is unwanted, is
    at least ``threshold``, else ``allow``. NULL, empty and malformed URLs have an empty host and path and are judged by
    the model like any other; repeated rows are judged alike; existing columns of these names are replaced.
    Everything is one pass of column expressions without a shuffle.
    """
    made = ["host", "path", "rule", "verdict", "url_score"]
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c not in made]
    # one struct carries the caller's columns, so that no name of theirs can clash with the model's
    rows = pages.select(F.struct(*kept).alias("_row"), host.alias("_host"), path.alias("_path"))
    found = longest_rule(F.col("_host"), F.col("_path"), rules)
    if isinstance(model, ConstantScore):
        scored, score = rows, F.lit(model.score)
    else:
        scored = model.transform(_features(rows, "_host", "_path"))
        score = vector_to_array(F.col(model.getProbabilityCol()))[1]
    judged = scored.select("_row", "_host", "_path", found.alias("_found"), score.alias("_score"))
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_found.rule").alias("rule"),
        F.coalesce(F.col("_found.verdict"), F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("url_score"),
    )
