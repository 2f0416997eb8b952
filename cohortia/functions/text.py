"""Names, places and codes: Column in, Column out."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortia.functions.numbers import as_column


def _accent_table() -> tuple[str, str]:
    """Upper-case accented Latin letters and their bare letters, from the Unicode decomposition."""
    accented, bare = [], []
    for code in range(0x00C0, 0x0180):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        marks = parts[1:]
        if char.isupper() and marks and all(unicodedata.category(m) == "Mn" for m in marks):
            accented.append(char)
            bare.append(parts[0])
    return "".join(accented), "".join(bare)


ACCENTED, BARE = _accent_table()


def clean_name(c: str | Column) -> Column:
    """Institution name without CSV quote debris: runs of quotes, outer and inner quotes,
    doubled spaces, and the blank in ``NAME -CITY``."""
    one_quote = F.regexp_replace(as_column(c), '"+', '"')
    bare = F.btrim(F.trim(one_quote), F.lit('"'))
    spaced = F.trim(F.regexp_replace(F.replace(bare, F.lit('"'), F.lit(" ")), r"\s+", " "))
    return F.replace(spaced, F.lit(" -"), F.lit("-"))


def place_key(c: str | Column) -> Column:
    """Key that ignores case, accents and outer blanks."""
    upper = F.upper(F.trim(as_column(c).cast("string")))
    return F.regexp_replace(F.translate(upper, ACCENTED, BARE), r"\p{Mn}", "")


def has_token(c: str | Column, token: str) -> Column:
    return F.coalesce(F.lower(as_column(c)).contains(token.lower()), F.lit(False))


def campus(c: str | Column, token: str, no_campus: str = "SIN SEDE") -> Column:
    """Campus of a token institution: the text after its last dash; empty for other names."""
    name = F.trim(as_column(c))
    after_dash = F.upper(F.trim(F.substring_index(name, "-", -1)))
    found = F.when(name.contains("-"), after_dash).otherwise(F.lit(no_campus))
    return F.when(has_token(c, token), found).otherwise(F.lit(""))


def lump(c: str | Column, values: Iterable[str], label: str) -> Column:
    """Merge several answers (compared in lower case) into one label; the rest is trimmed."""
    text = F.trim(as_column(c))
    return F.when(F.lower(text).isin(*values), F.lit(label)).otherwise(text)


def null_label(c: str | Column, label: str, also: Iterable[str] = ()) -> Column:
    """NULL, and any of the ``also`` answers, become the label."""
    text = F.trim(as_column(c).cast("string"))
    missing = text.isNull()
    if also := list(also):
        missing = missing | F.lower(text).isin(*also)
    return F.when(missing, F.lit(label)).otherwise(text)


def relabel(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Code to display label; codes without a label stay as they are."""
    text = as_column(c).cast("string")
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def code_text(c: str | Column) -> Column:
    """Numeric-looking code in canonical form: ``3.0`` and ``3`` are one code."""
    text = F.trim(as_column(c).cast("string"))
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def is_domestic(c: str | Column, country: str, prefix: bool = False) -> Column:
    """Whether a country is the home country; a missing one is. ``prefix`` also takes spelling
    variants that start with the home country, accents aside."""
    if prefix:
        return place_key(F.coalesce(as_column(c), F.lit(country))).startswith(country)
    return F.upper(F.trim(F.coalesce(as_column(c), F.lit(country)))) == F.lit(country)
