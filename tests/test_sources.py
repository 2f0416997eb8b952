"""Readers, writers and materialized tables."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cohortia.operators import prediction
from cohortia.sources import materialize, readers, writers
from tests.conftest import records, rows


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "exam.csv"
    path.write_bytes("﻿periodo;estu_genero;punt\n20151;F;50.5\n20152;M;\n".encode())
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["periodo", "estu_genero", "punt"]
    assert rows(df) == [(20151, "F", 50.5), (20152, "M", None)]
    typed = readers.read_csv(spark, str(path), schema="periodo string, estu_genero string, punt double")
    assert rows(typed) == [("20151", "F", 50.5), ("20152", "M", None)]


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "t", options={"user": "u", "password": "p"})
    assert plain == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "user": "u", "password": "p"}
    split = readers.jdbc_options("jdbc:x", query="SELECT 1", partition=readers.JdbcPartition("id", "0", "99", 16))
    assert split["dbtable"] == "(SELECT 1) AS source" and "query" not in split
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "99", "16")
    assert readers.jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"


@pytest.mark.parametrize(
    "bad",
    [
        {"table": None},
        {"table": "t", "query": "q"},
        {"table": "t", "partition": readers.JdbcPartition("id")},
        {"table": "t", "partition": readers.JdbcPartition()},
    ],
)
def test_jdbc_options_are_checked(bad):
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", **bad)


def test_pick_keeps_wanted_columns(spark):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    assert readers.pick(df, ["b", "zz", "a"], as_string=True).collect()[0] == ("2.5", "1")
    with pytest.raises(ValueError):
        readers.pick(df, ["zz"])


def test_parquet_count_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_parquet(spark.range(7).withColumn("anio", F.col("id") % 2), path, ["anio"])
    assert sorted(d for d in os.listdir(path) if d.startswith("anio")) == ["anio=0", "anio=1"]
    assert readers.row_count(spark, path).collect()[0]["rows"] == 7
    assert readers.read_parquet(spark, path, ["id"]).columns == ["id"]
    one = readers.read_parquet(spark, path).filter("anio = 1")
    assert "PartitionFilters: [isnotnull(anio" in one._jdf.queryExecution().executedPlan().toString()


def test_table_contract(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert readers.table_contract(df, ["a", "b"]) == ["b"]
    assert readers.table_contract(spark, ["a"], "no_such_table") == ["a"]
    df.createOrReplaceTempView("exam_2015")
    spark.createDataFrame([(1,)], "z int").createOrReplaceTempView("exam_2016")
    assert readers.table_contract(spark, ["a", "b"], "exam_2015") == ["b"]
    assert list(readers.available_years(spark, "exam_{year}", [2014, 2015, 2016], ["a"])) == [2015]


def test_csv_export(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([("A", 0.5)], "inst string, v double"), str(tmp_path / "out"))
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".csv")]
    assert len(files) == 1 and (tmp_path / "out" / files[0]).read_text().splitlines() == ["inst,v", "A,0.5"]


def test_summary_tables(spark, tmp_path):
    writers.write_summary({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


# published test metrics, one module per form
ENSEMBLE = {
    "forma1": {"ingles": {"mae": 0.0498955212533474, "mse": 0.0050706276670098305, "rmse": 0.0712083398697781, "r2": 0.5993809700012207}},
    "forma2": {"ingles": {"mae": 0.0486, "rmse": 0.0701, "r2": 0.6122}},
}
CLUSTERS = {
    "metricas": {
        "media": {"forma1": {"ingles": {"mae": 0.0504, "rmse": 0.0711, "r2": 0.6003}}},
        "reglineal": {"forma1": {"ingles": {"mae": 0.0485, "rmse": 0.0690, "r2": 0.6239}}},
    },
    "seleccion_k": {
        "forma1": {
            "k_elegido": 256,
            "barrido": [
                {"k": 8, "mae_val": 0.0649}, {"k": 16, "mae_val": 0.0640}, {"k": 32, "mae_val": 0.0632},
                {"k": 64, "mae_val": 0.0625}, {"k": 128, "mae_val": 0.0620}, {"k": 256, "mae_val": 0.0616},
            ],
        }
    },
}


def test_metrics_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(ENSEMBLE, indent=2))
    found = prediction.explode_metrics(readers.read_metrics_json(spark, str(tmp_path / "m.json")), "metrics", ["form", "target"])
    by_form = {r["form"]: r for r in records(found)}
    assert by_form["forma1"]["mse"] == 0.0050706276670098305
    assert by_form["forma1"]["mse"] == pytest.approx(by_form["forma1"]["rmse"] ** 2, abs=1e-9)
    assert by_form["forma2"]["mse"] == pytest.approx(0.0701**2)
    assert rows(prediction.compare_metrics(found, "target", "form", ["forma1", "forma2"])) == [("ingles", 0.0498955212533474, 0.0486)]
    levels = [(m, f, "t", 0.1 * k) for k, (m, f) in enumerate([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")])]
    for given in (levels, levels[::-1]):
        table = spark.createDataFrame(given, "method string, form string, target string, mae double")
        assert rows(prediction.compare_metrics(table, "target", "method", ["a", "b"])) == [("t", "1", 0.0, 0.2), ("t", "2", 0.1, pytest.approx(0.3))]


def test_cluster_metrics_json(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps(CLUSTERS))
    document = readers.read_metrics_json(spark, str(tmp_path / "k.json"), readers.METHOD_METRICS_SCHEMA)
    rows_by_method = prediction.explode_metrics(document, "metrics.metricas", ["method", "form", "target"])
    compared = prediction.compare_metrics(rows_by_method, "target", "method", ["media", "reglineal"])
    assert rows(compared) == [("ingles", "forma1", 0.0504, 0.0485)]
    sweep = readers.sweep_rows(document)
    assert rows(sweep.select("stored_choice").distinct()) == [(256,)]
    assert rows(prediction.choose_k(sweep).filter("chosen").select("k")) == [(256,)]


def test_metadata_json(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"targets": ["a", "b"], "anios_train": [2010, 2011], "n_filas": 1045656}))
    row = records(readers.read_metrics_json(spark, str(tmp_path / "meta.json"), readers.METADATA_SCHEMA).select("metrics.*"))[0]
    assert (row["targets"], row["anios_train"], row["n_filas"], row["id_sbpro"]) == (["a", "b"], [2010, 2011], 1045656, None)


def test_materialize_builds_once(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert materialize.materialize(spark, path, build, ["id"]).count() == 3
    assert len(built) == 1
    materialize.materialize(spark, path, build, ["id"], force=True)
    assert len(built) == 2
    with_missing = materialize.materialize(spark, path, lambda: spark.range(2).withColumn("x", F.lit(1)), ["id", "x"])
    assert with_missing.columns == ["id", "x"]


def test_materialize_follows_its_sources(spark, tmp_path):
    source, path, built = str(tmp_path / "s"), str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("total"))

    def load():
        return materialize.materialize(spark, path, build, ["total"], sources=spark.read.parquet(source))

    spark.range(3).write.parquet(source)
    assert load().collect()[0]["total"] == 3 and load().collect()[0]["total"] == 3
    assert len(built) == 1
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert load().collect()[0]["total"] == 10 and len(built) == 2


def test_fingerprint_ignores_row_order(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(10).repartition(3).write.parquet(path)
    prints = {materialize.source_fingerprint(spark.read.parquet(path)).collect()[0][0] for _ in range(2)}
    assert len(prints) == 1
