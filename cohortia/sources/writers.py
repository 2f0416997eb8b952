"""Writers: Parquet datasets and small CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

TARGET = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
    sort_by: Sequence[str] = (),
    target_bytes: int | None = None,
) -> None:
    """Snappy Parquet, split by the given columns.

    With ``target_bytes`` the rows are dealt anew by these columns, so that files have about that size (of shuffled rows): small
    partitions share a task, one that is larger is split over several. ``sort_by`` orders the rows inside the files, so that the least
    and greatest values in their footers let later reads skip them.
    """
    if target_bytes is not None:
        df = df.hint("rebalance", *(partition_by or ()))
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or ()), *sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(TARGET, None)
    if target_bytes is not None:
        conf.set(TARGET, str(target_bytes))
    try:
        writer.parquet(path)
    finally:
        if target_bytes is not None:
            conf.unset(TARGET) if before is None else conf.set(TARGET, before)


def write_summary(tables: dict[str, DataFrame], path: str) -> None:
    """Several result tables, each under its name below one folder."""
    for name, table in tables.items():
        write_parquet(table, f"{path.rstrip('/')}/{name}")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A report table (a few rows) as one CSV file with a header; only the finished rows meet in one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
