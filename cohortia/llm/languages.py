"""Language identification by compression: the language whose dictionary makes a text smallest.

Per language, a raw-content zstandard dictionary is filled with text of a bounded sample. A text, reduced to lower-case
letters and single spaces, is encoded once with every dictionary. So that short texts leave a trace too, a little text of
the language stands before it, and the size of that alone is taken off again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import first_of_each, small_batches

#: The bounded sample a language is learned from: documents, bytes of each, bytes in all.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 150, 2500, 64 << 10
#: Bytes of the language that stand before every text.
LEAD_BYTES = 300
#: A longer text is encoded in pieces, all of which reach the dictionary.
PIECE_BYTES = 32 << 10
#: Dictionaries are sent to all executors; more languages than this are refused.
MOST_LANGUAGES = 250
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """Per language, the most frequent first: name, dictionary and the text that stands before."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    leads: tuple[bytes, ...]


def letters(text: Column) -> Column:
    """Lower-case letters, every run of anything else one space; empty without letters."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries for all non-NULL languages of ``docs``, from the 2 * SAMPLE_DOCUMENTS different texts of each with the lowest
    hashes, equal texts counted once. NULL texts and texts without letters teach nothing. The sample, at most SAMPLE_BYTES of each
    text, comes to the driver."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    different = rows.select("lang", "place").distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in different.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Languages((), (), ())
    share = None
    for name, n in counts.items():
        most = F.lit(int(min(1.0, 2 * SAMPLE_DOCUMENTS / n) * (1 << 40)))
        share = F.when(F.col("lang") == name, most) if share is None else share.when(F.col("lang") == name, most)
    sample = rows.filter(F.col("place") < share).select("lang", "place", F.substring(letters(F.col("text")), 1, SAMPLE_BYTES).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for row in sorted(first_of_each(sample, "lang", "place").collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"].encode()[:SAMPLE_BYTES])
    names = tuple(name for name in sorted(texts, key=lambda x: (-counts[x], x)) if any(texts[name]))
    whole = [b" ".join(dict.fromkeys(texts[name]))[: DICTIONARY_BYTES + LEAD_BYTES] for name in names]
    return Languages(names, tuple(x[LEAD_BYTES:] or x for x in whole), tuple(x[:LEAD_BYTES] for x in whole))


_coders: dict[Languages, list] = {}


def _encoders(languages: Languages) -> list:
    """(compressor, lead, size of the lead alone) per language, made once per worker."""
    import zstandard as z

    if languages not in _coders:
        _coders.clear()
        settings = z.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        found = []
        for words, lead in zip(languages.dictionaries, languages.leads, strict=True):
            coder = z.ZstdCompressor(compression_params=settings, dict_data=z.ZstdCompressionDict(words, dict_type=z.DICT_TYPE_RAWCONTENT))
            found.append((coder, lead, len(coder.compress(lead))))
        _coders[languages] = found
    return _coders[languages]


def encoded_sizes(text: bytes, languages: Languages) -> list[int]:
    """Bytes the text adds with each dictionary."""
    pieces = [text[k : k + PIECE_BYTES] for k in range(0, len(text), PIECE_BYTES)]
    return [sum(len(coder.compress(lead + b" " + piece)) - base for piece in pieces) for coder, lead, base in _encoders(languages)]


def identify(docs: DataFrame, languages: Languages, text: str = "text", narrow: float = 0.0, prefix: str = "") -> DataFrame:
    """``docs`` with {prefix}lang_pred, {prefix}score and {prefix}rejected; columns of these names are replaced.

    lang_pred is the language of the smallest encoding (of equal ones the most frequent when learned), ``und`` for NULL texts and texts
    without letters. score, from 0 to 1, is how much smaller the best encoding is than the second, as a share of the
    second; 0 for ``und``, 1 where only one language is known. rejected is true for ``und`` and where the score is below
    ``narrow``. Whole texts are encoded, long ones in pieces; repeated rows get equal results. One pass, no shuffle.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(column: pd.Series) -> pd.DataFrame:
        found = []
        for value in column:
            sizes = encoded_sizes(value.encode(), languages) if value and languages.names else []
            if not sizes:
                found.append((UNKNOWN, 0.0))
                continue
            order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
            best, second = sizes[order[0]], sizes[order[1]] if len(sizes) > 1 else None
            margin = 1.0 if second is None else max(0.0, min(1.0, (second - best) / second)) if second > 0 else 0.0
            found.append((languages.names[order[0]], margin))
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    names = [prefix + x for x in ("lang_pred", "score", "rejected")]
    kept = [c for c in docs.columns if c not in names]
    rows = small_batches(docs).select(F.struct(*kept).alias("_row"), guess(letters(F.col(text))).alias("_guess"))
    score = F.col("_guess.score")
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col("_guess.lang_pred").alias(names[0]),
        score.alias(names[1]),
        ((F.col("_guess.lang_pred") == UNKNOWN) | (score < narrow)).alias(names[2]),
    )
