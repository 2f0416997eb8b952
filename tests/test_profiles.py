"""The ready-made profiles on small exam-like tables."""

import pytest
from pyspark.sql import functions as F

from cohortia.operators import prediction
from cohortia.plans import constants as fixed
from cohortia.plans import profiles, schemas
from cohortia.sources.materialize import materialize
from tests.conftest import records, rows


def exam(spark, data):
    """A frame from dictionaries; columns a row lacks are NULL, everything is text."""
    names = sorted({k for row in data for k in row})
    lines = [tuple(None if row.get(n) is None else str(row[n]) for n in names) for row in data]
    return spark.createDataFrame(lines, ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def school(spark):
    base = {"fami_estratovivienda": "Estrato 1", "cole_naturaleza": "OFICIAL", "cole_area_ubicacion": "URBANO", "estu_depto_presentacion": "BOGOTA"}
    return {
        2010: exam(spark, [{**base, "estu_consecutivo": f"s{i}"} for i in range(4)] + [{"estu_consecutivo": "s9", "fami_estratovivienda": "Sin Estrato"}]),
        2011: exam(spark, [{**base, "estu_consecutivo": f"t{i}"} for i in range(2)]),
    }


@pytest.fixture(scope="module")
def links(spark):
    return exam(spark, [{"estu_consecutivo_sbpro": f"p{i}", "estu_consecutivo_sb11": k} for i, k in enumerate(["s0", "s1", "t0"])])


@pytest.fixture(scope="module")
def degree(spark):
    return {
        2015: exam(spark, [{"estu_consecutivo": "p0", "periodo": "20151", "gruporeferencia": "DERECHO"}, {"estu_consecutivo": "p1", "periodo": "20152.0", "gruporeferencia": None}]),
        2019: exam(spark, [{"estu_consecutivo": "p2", "periodo": "20191"}]),
    }


def test_cohort_continuation(school, links, degree):
    tables = profiles.cohort_continuation(school, links, degree)
    funnel = {r["anio_cohorte"]: r for r in records(tables["funnel"])}
    assert (funnel[2010]["total"], funnel[2010]["linked"], funnel[2010]["linked_rate"]) == (5, 2, 40.0)
    assert records(tables["total"])[0]["linked_rate"] == 42.86
    assert rows(tables["change"]) == [(2011, -10.0)]
    assert ("fami_estratovivienda", "No reporta", 1) in rows(tables["unlinked_counts"])
    timing = records(tables["timing"])[0]
    assert (timing["total"], timing["on_time_count"], timing["late_count"]) == (3, 2, 1)
    for name, table in tables.items():
        assert table.count() > 0, name
    law = profiles.cohort_continuation(school, links, degree, cohort=2010, group="DERECHO")
    assert rows(law["arrival_years"]) == [(2010, 2015, 1, "standard")]


def test_kept_tables_are_written_once(spark, school, links, degree, tmp_path):
    written = []

    def keep(name, df):
        written.append(name)
        return materialize(spark, str(tmp_path / name), lambda: df)

    tables = profiles.cohort_continuation(school, links, degree, keep=keep)
    assert written == ["cohort_funnel", "cohort_arrival"]
    assert records(tables["total"])[0]["linked"] == 3
    assert "Join" not in tables["trend"]._jdf.queryExecution().executedPlan().toString()
    assert tables["total"] is tables["total"] and len(list(tables)) == len(tables)


def test_cohort_continuation_from_two_files(spark, school):
    members = exam(spark, [{"periodo": "20152"}] * 4)
    tables = profiles.cohort_continuation_csv(members, school[2011])
    assert records(tables["funnel"])[0]["unlinked_rate"] == 50.0
    assert rows(tables["cohort"]) == [(2015,)]
    assert tables["unlinked_counts"].count() == 4


@pytest.fixture(scope="module")
def socio(spark):
    rows_ = [
        {
            "periodo": f"2015{1 + i % 2}",
            "estu_genero": "MF"[i % 2],
            "estu_fechanacimiento": f"{1 + i}/07/199{i % 10}",
            "estu_nacionalidad": [None, "COLOMBIA", "PERU"][i % 3],
            "estu_depto_reside": ["BOGOTÁ", "Antioquia"][i % 2],
            "estu_mcpio_reside": ["bogota", "Cali"][i % 2],
            "fami_estratovivienda": [None, "Estrato 2"][i % 2],
            "estu_inse_individual": str(30 + 5 * i),
            "estu_nse_individual": ["3.0", "3", "1"][i % 3],
            "inst_nombre_institucion": '""UNI  A"" -CALI' if i % 2 else "UNI TOKEN-CALI",
            "inst_origen": ["OFICIAL NACIONAL", "REGIMEN ESPECIAL"][i % 2],
            "estu_prgm_academico": f"P{i % 4}",
            "estu_pagomatriculabeca": ["true", "no"][i % 2],
            "estu_pagomatriculapadres": ["s", "S"][i % 2],
        }
        for i in range(12)
    ]
    return profiles.consolidated_socio({2015: exam(spark, rows_)})


def test_socioeconomic_profile(socio):
    tables = profiles.socioeconomic_profile(socio)
    assert rows(tables["total"]) == [(12,)]
    assert rows(tables["nationality"]) == [(8, 4)]
    assert rows(tables["level"]) == [("1", 4, fixed.LEVEL_LABELS["1"]), ("3", 8, fixed.LEVEL_LABELS["3"])]
    assert dict(rows(tables["payments"])) == {"Beca": 6, "Crédito": 0, "Padres": 12, "Recursos propios": 0}
    assert {r["value"] for r in records(tables["institutions"])} == {"UNI A-CALI", "UNI TOKEN-CALI"}
    assert {r["name"] for r in records(tables["map_town_home"])} == {"BOGOTÁ", "CALI"}
    assert {r["name"] for r in records(tables["map_department_home"])} == {"BOGOTÁ", "ANTIOQUIA"}
    assert tables["payment_pairs"].count() == 16
    empty = {"map_department_exam", "map_department_programme", "map_town_exam", "top_department_exam", "top_town_exam", "occupation_father", "occupation_mother", "reference_group", "nucleus"}
    for name, table in tables.items():
        assert (table.count() == 0) == (name in empty), name


def test_exam_filters(socio):
    assert profiles.exam_filters(socio).count() == 12
    assert profiles.exam_filters(socio, anio=2015, genero="M", depto="BOGOTÁ").count() == 6
    assert profiles.exam_filters(socio, token="token", sede="CALI").count() == 6
    assert profiles.exam_filters(socio, origen="Pública").count() == 6
    assert profiles.exam_filters(socio, pago="estu_pagomatriculabeca").count() == 6
    assert profiles.exam_filters(socio, anio=2016).count() == 0


@pytest.fixture(scope="module")
def paired_table(spark):
    def scores(i, names, shift):
        return {n: round(0.2 + (i * 7 % 23) / 40 + shift * j / 50, 4) for j, n in enumerate(names)}

    later = [c for _, c, _ in fixed.ALL_SCORE_PAIRS]
    earlier = [c.removesuffix("_sb11") for _, _, c in fixed.ALL_SCORE_PAIRS]
    degree = {
        year: exam(
            spark,
            [{"estu_consecutivo": f"p{year}{i}", "mod_ingles_desem": "B1", **scores(i, later, year - 2015)} for i in range(20)],
        )
        for year in (2016, 2017)
    }
    old = {c if c != "punt_lectura_critica_norm" else "punt_lenguaje_norm" for c in earlier}
    school = {
        2010: exam(spark, [{"estu_consecutivo": f"s{i}", "desemp_ingles": "A1", **scores(i + 1, sorted(old), 1)} for i in range(20)]),
        2011: exam(spark, [{"estu_consecutivo": f"s{i}", "desemp_ingles": "A2", **scores(i + 2, earlier, 2)} for i in range(20, 40)]),
    }
    links = exam(
        spark,
        [{"estu_consecutivo_sbpro": f"p{2016 + i // 20}{i % 20}", "estu_consecutivo_sb11": f"s{i}"} for i in range(40)],
    )
    return profiles.paired_scores(degree, links, school)


def test_paired_scores(paired_table):
    assert paired_table.count() == 40
    assert "estu_consecutivo" not in paired_table.columns and "punt_lenguaje_norm_sb11" not in paired_table.columns
    assert paired_table.filter("punt_lectura_critica_norm_sb11 IS NULL").count() == 0


def test_paired_profile(paired_table):
    tables = profiles.paired_profile(paired_table)
    assert tables["trend"].count() == 12
    assert {r["n"] for r in records(tables["correlations"])} == {40}
    assert rows(tables["english"].filter("n > 0").select("from_level", "to_level", "pct")) == [("A1", "B1", 100.0), ("A2", "B1", 100.0)]
    label = fixed.SCORE_PAIRS[0][0]
    assert rows(tables[f"density: {label}"].agg(F.sum("n"))) == [(40,)]
    assert rows(tables[f"delta histogram: {label}"].agg(F.sum("n"))) == [(40,)]


def test_contribution_profile(paired_table):
    tables = profiles.contribution_profile(paired_table)
    assert [r["anio"] for r in records(tables["matrix"].orderBy("anio"))] == [2016, 2017]
    assert records(tables["kpis"])[0]["main_mean"] is not None
    assert records(tables["extremes"])[0]["max_value"] is not None


@pytest.fixture(scope="module")
def norms(spark):
    data = [
        {"inst_nombre_institucion": f'"U{i % 5}" -X', "estu_prgm_academico": f"P{i % 3}", "estu_prgm_departamento": "D", "gruporeferencia": "G", **{c: round(0.1 * (i % 5) + 0.01 * j, 3) for j, c in enumerate(fixed.COMPETENCES)}}
        for i in range(20)
    ]
    return profiles.consolidated_norms({2016: exam(spark, data)})


def test_institution_comparison(norms):
    tables = profiles.institution_comparison(norms, ["U1-X", "U4-X"])
    assert [r["inst_nombre_institucion"] for r in records(tables["ranking"])][:2] == ["U4-X", "U3-X"]
    assert records(tables["spread"])[0]["spread"] == pytest.approx(0.3)
    assert records(tables["facts"])[0]["best_key"] == "U4-X"
    assert tables["pairs"].count() == 6
    assert "matrix" not in profiles.institution_comparison(norms, ["U1-X"])


def test_score_profile(spark):
    data = [{"mod_ingles_punt": str(100 + i), "punt_global": "bad" if i == 0 else str(i), "mod_ingles_desem": "B1"} for i in range(10)]
    tables = profiles.score_profile(profiles.consolidated_scores({2016: exam(spark, data)}))
    counts = dict(rows(tables["histograms"].groupBy("field").agg(F.sum("n"))))
    assert counts == {"mod_ingles_punt": 10, "punt_global": 9}
    assert rows(tables["levels"]) == [("mod_ingles_desem", "B1", 10)]


def test_exam_profiles(spark):
    data = [{"estu_fechanacimiento": "1/1/2000", "estu_nacionalidad": None, "estu_genero": "F", "punt": str(i), "ies": f"U{i % 3}", "inst_nombre_institucion": "I", "estu_prgm_academico": "P", "beca": "true"} for i in range(6)]
    frame = exam(spark, data)
    one = profiles.school_exam_profile(frame, ["punt"], ["estu_genero"], as_of="2016-01-01", wanted_institution="ies", pin="zz")
    assert rows(one["age"]) == [(16, 6)] and rows(one["scores"]) == [("punt", 0.0, 5.0, 2.5)]
    assert one["wanted_institution"].count() == 3 and rows(one["nationality"]) == [("COLOMBIA", 6)]
    two = profiles.degree_exam_profile(frame, ["punt"], ["estu_genero"], 2023, payments={"beca": "Beca"})
    assert rows(two["age"]) == [(23, 6)] and rows(two["payments"]) == [("Beca", 6)]
    old = exam(spark, [{"ESTU_NACIMIENTO_ANNO": "1980", "ESTU_PAIS_RESIDE": "Colombia - X", "INST": "I", "PRG": "P"}])
    three = profiles.degree_exam_profile(old, ["ESTU_NACIMIENTO_ANNO"], ["INST"], 2006, birth_year="ESTU_NACIMIENTO_ANNO", nationality="ESTU_PAIS_RESIDE", country_prefix=True, institution="INST", programme="PRG")
    assert rows(three["age"]) == [(26, 1)] and rows(three["nationality"]) == [(1, 0)]


def test_stratum_probability(spark):
    data = [{"fami_educacionpadre": p, "fami_educacionmadre": "M", "fami_estratovivienda": e} for p, e in [("Ninguno", "1"), ("No sabe", "1"), ("X", "2"), (None, "3")]]
    tables = profiles.stratum_probability(exam(spark, data), father="No aplica")
    assert rows(tables["probability"]) == [("1", 2, 100.0, True)]
    assert [r[0] for r in tables["father_options"].collect()] == ["No aplica", "X"]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.range(60).select(
        F.lit(1).alias("forma"),
        F.when(F.col("id") % 2 == 0, F.lit("test")).otherwise(F.lit("val")).alias("split"),
        (F.col("id") / 60).alias("ingles_real"),
        (F.col("id") / 70 + 0.05).alias("ingles_pred"),
        "id",
    )


def test_prediction_quality(spark, predictions):
    tables = profiles.prediction_quality(predictions, "ingles", sample_key=["id"])
    assert rows(tables["classes"].agg(F.sum("n"))) == [(60,)]
    assert rows(tables["residuals"].agg(F.sum("n"))) == [(60,)]
    assert tables["ellipse"].count() == 360 and tables["points"].count() == 60
    assert records(profiles.residual_classes(tables["metrics"]))[0]["fit"] == "very_good"
    stored = spark.createDataFrame([(m, f, "ingles", 0.1 * k, 0.2 * k) for k, (m, f) in enumerate([("a", "forma1"), ("a", "forma2"), ("b", "forma1"), ("b", "forma2")])], "method string, form string, target string, mae double, mse double")
    sweep = spark.createDataFrame([("forma1", 8, 0.3, 16), ("forma1", 16, 0.2, 16), ("forma2", 8, 0.1, 16), ("forma2", 16, 0.2, 16)], "form string, k int, mae_val double, stored_choice int")
    tables = profiles.prediction_quality(predictions, "ingles", metrics=stored, sweep=sweep, methods=["a", "b"], sample=7, sample_key=["id"])
    assert tables["points"].count() == 7
    assert rows(tables["forms_mse"]) == [("ingles", "a", 0.0, 0.2), ("ingles", "b", 0.4, pytest.approx(0.6))]
    assert rows(tables["methods"]) == [("ingles", "forma1", 0.0, 0.2), ("ingles", "forma2", 0.1, pytest.approx(0.3))]
    assert rows(tables["sweep"].filter("chosen").select("form", "k", "agrees")) == [("forma1", 16, True), ("forma2", 8, False)]
    assert prediction.module_columns(predictions, list(fixed.MODULES)) == {"ingles": ("ingles_real", "ingles_pred")}


def test_executive_summary(norms, socio, school, links, degree, predictions, spark):
    scores = profiles.consolidated_scores({2016: exam(spark, [{c: "1" for c in [*schemas.MODULE_SCORES, "mod_ingles_desem"]}] * 3)})
    continuation = profiles.cohort_continuation(school, links, degree)
    stored = spark.createDataFrame([("forma1", "ingles", 0.1, 0.2, 0.3), ("forma2", "ingles", 0.2, 0.3, 0.4)], "form string, target string, mae double, mse double, r2 double")
    tables = profiles.executive_summary(
        norms, scores, socio, continuation["funnel"], continuation["arrivals"], predictions, continuation["unlinked_counts"], stored
    )
    assert rows(tables["forms: r2"]) == [("ingles", 0.3, 0.4)]
    kpis = {r["item"]: r["value"] for r in records(tables["kpis"])}
    assert kpis == {"kpi_registros": "12", "kpi_universidades": "5", "kpi_programas": "3", "kpi_tasa": "42.9", "kpi_mejor": "U4-X"}
    for name, table in tables.items():
        assert table.count() > 0, name
