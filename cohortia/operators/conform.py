"""Yearly tables with drifting schemas: projection, renaming and union."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType

from cohortia.functions.numbers import nan_to_null, to_number


def conform(
    df: DataFrame, schema: StructType, aliases: Mapping[str, str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly the columns of the contract: present ones cast, absent ones NULL.

    ``aliases`` maps an old column name to the contract's name; where both are present the contract's
    own column wins and the old one fills its gaps. Columns of ``keep`` follow as they are.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        names = [field.name] + [old for old, new in (aliases or {}).items() if new == field.name]
        found = [n for n in names if n in types]
        if isinstance(field.dataType, NumericType):
            cast = [
                (nan_to_null(n) if isinstance(types[n], NumericType) else to_number(n)).cast(field.dataType)
                for n in found
            ]
        else:
            cast = [F.col(n).cast(field.dataType) for n in found]
        value = F.coalesce(*cast) if cast else F.lit(None).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns, *keep)


def stamp(df: DataFrame, name: str, value: int | str | None) -> DataFrame:
    return df.withColumn(name, F.lit(value))


#: Tables by their year, or tables of any years that have the year as a column.
Yearly = Mapping[int, DataFrame] | Sequence[DataFrame]


def union_years(
    tables: Yearly,
    schema: StructType,
    aliases: Mapping[str, str] | None = None,
    year: str = "anio",
) -> DataFrame:
    """One table from yearly tables, each conformed and stamped with its year.

    Tables that come in a list have their years in the column ``year``: years of one source and one shape are best given as one such
    table, which is read once, where a table per year reads the source once a year.
    """
    if isinstance(tables, Mapping):
        parts = [stamp(conform(df, schema, aliases), year, y) for y, df in sorted(tables.items(), key=lambda t: (t[0] is None, t[0]))]
    else:
        parts = [conform(df, schema, aliases, keep=[year]) for df in tables]
    if not parts:
        raise ValueError("no yearly table to unite")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables as they are; columns a table lacks are NULL in its rows."""
    united = tables[0]
    for table in tables[1:]:
        united = united.unionByName(table, allowMissingColumns=True)
    return united


def suffix(df: DataFrame, sfx: str, keep: Iterable[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Suffix on every column name, but for those kept or given a name of their own."""
    keep, rename = set(keep), dict(rename or {})
    names = {c: rename.get(c, c if c in keep else c + sfx) for c in df.columns}
    return df.select(*[F.col(c).alias(n) for c, n in names.items()])


def compact_numbers(df: DataFrame) -> DataFrame:
    """Doubles as 4-byte floats, for storage only."""
    return df.select(
        *[
            F.col(f.name).cast(FloatType()).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def find_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate the table has, ignoring case and punctuation."""

    def bare(name: str) -> str:
        return "".join(ch for ch in name.lower() if ch.isalnum())

    names = {bare(c): c for c in df.columns}
    return next((names[bare(c)] for c in candidates if bare(c) in names), None)
