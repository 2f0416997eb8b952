"""Row classes: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortia.functions.numbers import as_column


def classify_sets(c: str | Column, groups: Mapping[str, Iterable[str]]) -> Column:
    """Label of the value set that holds the upper-case text, NULL when none does."""
    text = F.upper(F.trim(as_column(c)))
    chain = F
    for label, values in groups.items():
        chain = chain.when(text.isin(*values), F.lit(label))
    return chain


def band(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open ranges [e0, e1), [e1, e2), ...; NULL outside."""
    if len(edges) != len(labels) + 1:
        raise ValueError("a band needs one more edge than labels")
    c = as_column(c)
    chain = F
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        chain = chain.when((c >= low) & (c < high), F.lit(label))
    return chain


def arrival_class(gap: str | Column, standard: str | Column) -> Column:
    """early / on_time / late: on time is the standard semester and the one after it."""
    gap, standard = as_column(gap), as_column(standard)
    return (
        F.when(gap < standard, F.lit("early"))
        .when(gap <= standard + 1, F.lit("on_time"))
        .when(gap > standard + 1, F.lit("late"))
    )


def year_distance_class(years: str | Column) -> Column:
    """Arrival year minus expected year (which may be a half year)."""
    d = as_column(years)
    return (
        F.when(d < -0.5, F.lit("early"))
        .when(d <= 0.5, F.lit("standard"))
        .when(d <= 2.5, F.lit("late"))
        .when(d > 2.5, F.lit("very_late"))
    )


def deviation_class(semesters: str | Column) -> Column:
    """Deviation from the standard, in semesters."""
    d = as_column(semesters)
    return (
        F.when(d < 0, F.lit("early"))
        .when(d == 0, F.lit("standard"))
        .when(d <= 4, F.lit("late"))
        .when(d > 4, F.lit("very_late"))
    )


def trend_class(slope: str | Column, flat: float = 0.05) -> Column:
    slope = as_column(slope)
    return (
        F.when(slope > flat, F.lit("up"))
        .when(slope < -flat, F.lit("down"))
        .when(slope.isNotNull(), F.lit("flat"))
    )


def strength_class(r: str | Column) -> Column:
    """Strength word of a correlation."""
    size = F.abs(as_column(r))
    return (
        F.when(size >= 0.7, F.lit("strong"))
        .when(size >= 0.4, F.lit("moderate"))
        .when(size.isNotNull(), F.lit("weak"))
    )


def fit_class(r2: str | Column) -> Column:
    """Strength word of a determination coefficient."""
    r2 = as_column(r2)
    return (
        F.when(r2 >= 0.7, F.lit("very_good"))
        .when(r2 >= 0.4, F.lit("moderate"))
        .when(r2 >= 0, F.lit("poor"))
        .when(r2 < 0, F.lit("worse_than_mean"))
    )


def direction_class(change: str | Column) -> Column:
    """Direction of a first-to-last change."""
    change = as_column(change)
    return (
        F.when(change > 0, F.lit("up"))
        .when(change < 0, F.lit("down"))
        .when(change == 0, F.lit("stable"))
    )
