"""Numbers, flags and percentages: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN means missing here; averages in Spark would carry it on."""
    return F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))


def to_number(c: str | Column) -> Column:
    """Text or number to double; bad text and NaN become NULL instead of an error."""
    text = F.trim(as_column(c).cast("string"))
    # a trailing d or f is a number suffix to the cast, but not a number in exam files; few texts have one, and the pattern costs more than the cast
    lettered = F.contains(text, F.lit("d")) | F.contains(text, F.lit("D")) | F.contains(text, F.lit("f")) | F.contains(text, F.lit("F"))
    return nan_to_null(F.when(lettered, F.regexp_replace(text, "[dDfF]$", "?")).otherwise(text).try_cast("double"))


def to_flag(c: str | Column, truth: Iterable[str]) -> Column:
    """True where the trimmed lower-case text is in the truth set, false otherwise and for NULL."""
    text = F.lower(F.trim(as_column(c).cast("string")))
    return F.coalesce(text.isin(*truth), F.lit(False))


def percent(part: str | Column, total: str | Column, digits: int | None = None) -> Column:
    """part / total x 100, and 0 when the total is 0."""
    part, total = as_column(part), as_column(total)
    share = F.when(total != 0, part / total * 100).otherwise(F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def points(norm: str | Column) -> Column:
    """A 0-1 normalized score as points out of 100."""
    return as_column(norm) * 100
