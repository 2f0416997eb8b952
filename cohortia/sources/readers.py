"""Readers: JDBC tables, semicolon CSV, Parquet, metrics JSON, and checks on what a source offers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METRIC = "struct<mae:double,mse:double,rmse:double,r2:double>"
METRICS_SCHEMA = f"map<string,map<string,{METRIC}>>"
METHOD_METRICS_SCHEMA = (
    f"struct<metricas:map<string,map<string,map<string,{METRIC}>>>,"
    "seleccion_k:map<string,struct<k_elegido:int,barrido:array<struct<k:int,mae_val:double>>>>>"
)
METADATA_SCHEMA = (
    "struct<features_forma1:array<string>,features_forma2:array<string>,targets:array<string>,"
    "id_sbpro:string,col_global_sbpro:string,col_institucion:string,"
    "anios_train:array<int>,anios_val:array<int>,anios_test:array<int>,n_filas:bigint>"
)


@dataclass(frozen=True)
class JdbcPartition:
    """How a JDBC read is split: a numeric or date column with bounds, or a list of predicates.

    The bounds only place the splits; rows outside them are still read.
    """

    column: str | None = None
    lower: str | None = None
    upper: str | None = None
    partitions: int = 8
    predicates: tuple[str, ...] = ()


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: JdbcPartition | None = None,
    options: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options of one JDBC scan. Credentials come from ``options`` and are kept nowhere."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if partition and (partition.column is None) == (not partition.predicates):
        raise ValueError("a partitioned read needs a column with bounds, or predicates")
    merged = {"url": url, "fetchsize": "10000"}
    if partition and partition.column:
        if partition.lower is None or partition.upper is None:
            raise ValueError("a partition column needs both bounds")
        # a partitioned read takes dbtable, not query
        merged["dbtable"] = table or f"({query}) AS source"
        merged.update(
            partitionColumn=partition.column,
            lowerBound=str(partition.lower),
            upperBound=str(partition.upper),
            numPartitions=str(partition.partitions),
        )
    elif table:
        merged["dbtable"] = table
    else:
        merged["query"] = query
    merged.update(options or {})
    return merged


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    columns: Sequence[str] | None = None,
    as_string: bool = False,
    partition: JdbcPartition | None = None,
    options: Mapping[str, str] | None = None,
    query: str | None = None,
    single_task: bool = False,
) -> DataFrame:
    """A JDBC table (or query) with the wanted columns it has; the column list reaches the database.

    A ``partition`` splits the read over tasks; without one the whole table goes through one task, which
    ``single_task`` has to allow. ``as_string`` casts every column to text, for yearly tables whose types differ.
    """
    if partition is None and not single_task:
        raise ValueError("read_jdbc needs a partition, or single_task=True for a small table")
    settings = jdbc_options(url, table, query, partition, options)
    if partition and partition.predicates:
        extra = {k: v for k, v in settings.items() if k not in ("url", "dbtable", "query")}
        source = table or f"({query}) AS source"
        df = spark.read.jdbc(url, source, predicates=list(partition.predicates), properties=extra)
    else:
        df = spark.read.format("jdbc").options(**settings).load()
    return pick(df, columns, as_string)


def pick(df: DataFrame, columns: Sequence[str] | None = None, as_string: bool = False) -> DataFrame:
    """The wanted columns the table has, in the wanted order, as text if asked."""
    wanted = df.columns if columns is None else [c for c in columns if c in set(df.columns)]
    if not wanted:
        raise ValueError("the source has none of the wanted columns")
    return df.select(*[F.col(c).cast("string").alias(c) if as_string else F.col(c) for c in wanted])


def read_csv(
    spark: SparkSession, path: str | list[str], sep: str = ";", schema: StructType | str | None = None, rejects: str | None = None
) -> DataFrame:
    """Headed UTF-8 CSV; a byte-order mark is dropped by the reader. Without a schema the types are
    inferred, which costs a pass over the files.

    ``rejects`` names a further text column that holds a row as it stands in the file where it does not fit the declared schema: too
    few or too many fields, or a value that isn't of its type. The fields that could be read are there all the same.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8")
    if rejects is None:
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return reader.csv(path)
    if schema is None:
        raise ValueError("rejected rows can only be told by a declared schema")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", rejects)
    return reader.schema(declared.add(rejects, "string")).csv(path)


def csv_report(df: DataFrame, rejects: str) -> DataFrame:
    """(file, rows, rejected) per file of a table that ``read_csv`` read with a column of rejects, in one pass."""
    fields = [c for c in df.columns if c != rejects]
    # all fields have to be read along, or the reader does not parse them; the hash makes sure that they are
    parsed = df.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*fields).alias("_read"), rejects)
    bad = F.col(rejects).isNotNull() & (F.col("_read").cast("string") != "")
    return parsed.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"))


def accepted(df: DataFrame, rejects: str) -> DataFrame:
    """The rows that fit, without the column of rejects."""
    return df.filter(F.col(rejects).isNull()).drop(rejects)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """(rows) of a Parquet dataset, from the footers of its files.

    Counts are pushed down only into the newer Parquet reader, so the table is resolved with it; what other reads use stays as it is.
    """
    sources = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in sources.split(",") if s.strip().lower() != "parquet"))
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", sources)
    return df.agg(F.count(F.lit(1)).alias("rows"))


def table_contract(source: SparkSession | DataFrame, required: Sequence[str], name: str | None = None) -> list[str]:
    """Required columns that a table (by name) or a DataFrame lacks; all of them if there is no table."""
    if isinstance(source, DataFrame):
        present = set(source.columns)
    elif name is not None and source.catalog.tableExists(name):
        present = set(source.table(name).columns)
    else:
        present = set()
    return [c for c in required if c not in present]


def available_years(spark: SparkSession, pattern: str, years: Sequence[int], required: Sequence[str]) -> dict[int, DataFrame]:
    """Yearly tables that exist and have the required columns; ``pattern`` holds {year}."""
    found = {}
    for year in years:
        name = pattern.format(year=year)
        if not table_contract(spark, required, name):
            found[year] = spark.table(name)
    return found


def path_has(spark: SparkSession, path: str, required: Sequence[str]) -> bool:
    """Whether a Parquet dataset can be read and has the required columns."""
    try:
        return not table_contract(spark.read.parquet(path), required)
    except AnalysisException:
        return False


def parse_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """(metrics): the JSON documents of a text column, parsed."""
    return df.select(F.from_json(text, schema).alias("metrics"))


def read_metrics_json(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """(metrics): one row per file of nested metrics."""
    return parse_json(spark.read.text(path, wholetext=True), "value", schema)


def sweep_rows(df: DataFrame, selection: str = "metrics.seleccion_k") -> DataFrame:
    """(form, k, mae_val, stored_choice) of the stored sweeps over the number of clusters."""
    return df.select(F.explode(selection).alias("form", "_s")).select(
        "form", F.col("_s.k_elegido").alias("stored_choice"), F.explode("_s.barrido").alias("_b")
    ).select("form", F.col("_b.k").alias("k"), F.col("_b.mae_val").alias("mae_val"), "stored_choice")
