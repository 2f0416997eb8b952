"""Counts by place joined to a dimension of place names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions.text import place_key
from cohortia.operators.frequency import frequency


def coordinates(spark: SparkSession, places: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(name, lat, lon) from a plain mapping."""
    return spark.createDataFrame([(n, lat, lon) for n, (lat, lon) in places.items()], "name string, lat double, lon double")


def match_places(counts: DataFrame, dimension: DataFrame, name: str, columns: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Place counts (value, n) with the dimension's name and columns; places it lacks are dropped.

    Names meet on a key without case and accents, one dimension row per key (the first by name).
    ``exact`` compares the names as they are.
    """

    def key(c: str):
        return F.col(c) if exact else place_key(c)

    picked = F.min_by(F.struct(name, *columns), F.col(name)).alias("_place")
    places = dimension.groupBy(key(name).alias("_key")).agg(picked).select("_key", "_place.*")
    return counts.withColumn("_key", key("value")).join(places, "_key").drop("_key")


def geo_counts(df: DataFrame, place: str, dimension: DataFrame, name: str, columns: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Frequency of a place column (its top values only, if asked), matched to the dimension."""
    return match_places(frequency(df, place, top), dimension, name, columns)
