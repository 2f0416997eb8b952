"""Optional filters and the choice lists that feed them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.numbers import to_flag
from cohortia.functions.text import campus, has_token


def _unset(value) -> bool:
    return value is None or value == "" or (isinstance(value, (list, tuple, set)) and not value)


def apply_filters(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    trimmed: Mapping[str, str] | None = None,
    isin: Mapping[str, Sequence] | None = None,
    token: tuple[str, str] | None = None,
    campus_of: tuple[str, str, str] | None = None,
    flag: str | None = None,
    truth: Iterable[str] = (),
    sets: tuple[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Conjunction of the filters that are set; an absent column or an empty value is no filter.

    ``equals`` compares as is, so it reaches the scan; ``trimmed`` compares trimmed text; ``token``
    is (column, text contained); ``campus_of`` is (column, token, campus); ``flag`` keeps true flags;
    ``sets`` is (column, allowed upper-case texts).
    """
    present = set(df.columns)
    conditions: list[Column] = []
    for c, value in (equals or {}).items():
        if c in present and not _unset(value):
            conditions.append(F.col(c) == F.lit(value))
    for c, value in (trimmed or {}).items():
        if c in present and not _unset(value):
            conditions.append(F.trim(F.col(c)) == F.lit(value))
    for c, values in (isin or {}).items():
        if c in present and not _unset(values):
            conditions.append(F.col(c).isin(*values))
    if token and token[0] in present:
        conditions.append(has_token(token[0], token[1]))
    if campus_of and campus_of[0] in present:
        conditions.append(campus(campus_of[0], campus_of[1]) == F.lit(campus_of[2]))
    if flag and flag in present:
        conditions.append(to_flag(flag, truth))
    if sets and sets[0] in present:
        conditions.append(F.upper(F.trim(F.col(sets[0]))).isin(*sets[1]))
    for condition in conditions:
        df = df.filter(condition)
    return df


def prediction_slice(
    df: DataFrame,
    form=None,
    method: str | None = None,
    split: str | None = None,
    institution: str | None = None,
    all_splits: str = "todos",
    all_institutions: str = "__TODAS__",
    columns: tuple[str, str, str, str] = ("forma", "metodo", "split", "inst_nombre_institucion_sbpro"),
) -> DataFrame:
    """Predictions of one form, method, split and institution; the two all-marks switch a filter off."""
    values = (
        form,
        method,
        None if split == all_splits else split,
        None if institution == all_institutions else institution,
    )
    return apply_filters(df, equals=dict(zip(columns, values, strict=True)))


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y])


def between(df: DataFrame, c: str, low, high) -> DataFrame:
    return df.filter(F.col(c).between(low, high))


def keep_levels(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose trimmed answers are all among the declared levels."""
    trimmed = df.withColumns({c: F.trim(F.col(c)) for c in levels})
    for c, allowed in levels.items():
        trimmed = trimmed.filter(F.col(c).isin(*allowed))
    return trimmed


def options(df: DataFrame, c: str) -> DataFrame:
    """Distinct non-blank trimmed values in order: the choices of a filter."""
    value = F.trim(F.col(c).cast("string")).alias("value")
    return df.select(value).filter(F.col("value") != "").distinct().orderBy("value")


def campus_options(df: DataFrame, c: str, token: str) -> DataFrame:
    """Distinct campuses of the institutions whose name holds the token."""
    return df.filter(has_token(c, token)).select(campus(c, token).alias("value")).filter("value <> ''").distinct().orderBy("value")


def valid_choices(choices: Sequence[str], offered: DataFrame, limit: int | None = None) -> DataFrame:
    """The picks that are still offered, in the order picked, at most ``limit`` of them."""
    position = F.array_position(F.array(*[F.lit(c) for c in choices]), F.col("value"))
    valid = offered.filter(F.col("value").isin(*choices)).select("value", position.cast("int").alias("position"))
    valid = valid.orderBy("position")
    return valid if limit is None else valid.limit(limit)
