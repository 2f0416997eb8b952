"""Birth dates, ages and academic periods: Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.numbers import as_column

# fixed values: accepted date layouts, day first
DATE_PATTERNS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy")

# fixed values: period years the exam pages accept
FIRST_YEAR, LAST_YEAR = 2000, 2030


def parse_date(c: str | Column, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    """Lenient day-first date; text that fits no layout gives NULL. A time of day is cut off."""
    text = F.split(F.trim(as_column(c).cast("string")), "[ T]").getItem(0)
    return F.coalesce(*[F.try_to_date(text, p) for p in patterns])


def _age(birth: Column, year: Column, month: Column, day: Column) -> Column:
    born_later = (F.month(birth) > month) | ((F.month(birth) == month) & (F.dayofmonth(birth) > day))
    return year - F.year(birth) - born_later.cast("int")


def age_at(birth: str | Column, ref_year: int | str | Column, month: int = 6, day: int = 30) -> Column:
    """Age on a fixed day (30 June) of the reference year, a number or a column."""
    year = F.lit(ref_year) if isinstance(ref_year, int) else as_column(ref_year)
    return _age(as_column(birth), year, F.lit(month), F.lit(day))


def age_on(birth: str | Column, as_of: str | Column | None = None) -> Column:
    """Age on a given day (an ISO text or a date column), today when left out."""
    if as_of is None:
        as_of = F.current_date()
    elif isinstance(as_of, str):
        as_of = F.lit(as_of).cast("date")
    return _age(as_column(birth), F.year(as_of), F.month(as_of), F.dayofmonth(as_of))


def age_from_year(birth_year: str | Column, ref_year: int) -> Column:
    return F.lit(ref_year) - as_column(birth_year)


def parse_period(c: str | Column, first: int | None = None, last: int | None = None) -> Column:
    """Period code to struct(year, semester).

    ``20162``, ``20162.0`` and `` 20162 `` give (2016, 2); ``2016`` counts as semester 1. The
    struct is NULL for anything else, a year outside the bounds (none unless given) or a semester
    other than 1 or 2.
    """
    text = F.substring_index(F.trim(as_column(c).cast("string")), ".", 1)
    size = F.length(text)
    year = F.substring(text, 1, 4).try_cast("int")
    semester = F.when(size >= 5, F.substring(text, 5, 1).try_cast("int")).when(size == 4, F.lit(1))
    ok = year.isNotNull() & semester.isin(1, 2)
    if first is not None:
        ok = ok & (year >= first)
    if last is not None:
        ok = ok & (year <= last)
    return F.when(ok, F.struct(year.alias("year"), semester.alias("semester")))


def semester_gap(period: Column, cohort: str | Column) -> Column:
    """Semesters from the cohort year to a parsed period."""
    return (period["year"] - as_column(cohort)) * 2 + (period["semester"] - 1)


def cohort_year(df: DataFrame, period: str) -> DataFrame:
    """The cohort year of a one-cohort table: the least first-four-digits of its period codes."""
    digits = F.substring(F.col(period).cast("string"), 1, 4).try_cast("int")
    return df.agg(F.min(digits).alias("cohort_year"))
