"""Column functions on hand-made edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from cohortia.functions import classes, dates, numbers, text
from cohortia.plans import constants as fixed


def apply(spark, values, function, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_bad_number_text_becomes_null(spark):
    values = ["", " 2 ", "abc", None, "NaN", "3.5", "1d", "2F", "1e3"]
    assert apply(spark, values, numbers.to_number) == [None, 2.0, None, None, None, 3.5, None, None, 1000.0]


def test_only_texts_with_suffix_letters_meet_the_pattern(spark):
    values = [" 2.5D ", "3f", "1d\n", "Infinity", "inf", "0.1", "-7e-3", "d", "f1"]
    assert apply(spark, values, numbers.to_number) == [None, None, None, float("inf"), None, 0.1, -0.007, None, None]
    shown = str(numbers.to_number("c")._jc)
    assert "contains" in shown and shown.index("contains") < shown.index("regexp_replace")


def test_nan_becomes_null(spark):
    assert apply(spark, [float("nan"), 1.0, None], numbers.to_number, "double") == [None, 1.0, None]


def test_flags_differ_by_truth_set(spark):
    values = ["true", " T", "1", "1.0", "Sí", "s", "yes", "no", None]
    short = apply(spark, values, lambda c: numbers.to_flag(c, fixed.TRUTH_SHORT))
    long = apply(spark, values, lambda c: numbers.to_flag(c, fixed.TRUTH_LONG))
    assert short == [True, True, True, False, False, True, False, False, False]
    assert long == [True, True, True, True, True, True, True, False, False]


def test_booleans_read_as_flags(spark):
    assert apply(spark, [True, False, None], lambda c: numbers.to_flag(c, fixed.TRUTH_SHORT), "boolean") == [True, False, False]


def test_percent_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in frame.select(numbers.percent("a", "b", 2)).collect()] == [33.33, 0.0]


def test_points(spark):
    assert apply(spark, [0.25], numbers.points, "double") == [25.0]


def test_period_codes(spark):
    values = ["20161", "20162", "20161.0", "2016", " 20161 ", "20163", "19991", "20311", "201", "", "20x61", None]
    found = apply(spark, values, lambda c: dates.parse_period(c, 2000, 2030))
    assert [tuple(r) if r else None for r in found] == [
        (2016, 1), (2016, 2), (2016, 1), (2016, 1), (2016, 1), None, None, None, None, None, None, None,
    ]
    assert [tuple(r) for r in apply(spark, ["19991", "20311"], dates.parse_period)] == [(1999, 1), (2031, 1)]


def test_semester_gap(spark):
    assert apply(spark, ["20152", "20101"], lambda c: dates.semester_gap(dates.parse_period(c), F.lit(2010))) == [11, 0]


def test_dates_day_first(spark):
    values = ["31/12/1999", "1999-12-31", "5/4/2000", "05-04-2000", "12/31/1999", "junk", "1999-12-31 00:00:00", "1999-12-31T10:00", None]
    day, april = dt.date(1999, 12, 31), dt.date(2000, 4, 5)
    assert apply(spark, values, dates.parse_date) == [day, day, april, april, day, None, day, day, None]


def test_age_turns_after_june_30(spark):
    births = [dt.date(2000, 6, 30), dt.date(2000, 7, 1), dt.date(2000, 1, 1), None]
    assert apply(spark, births, lambda c: dates.age_at(c, 2020), "date") == [20, 19, 20, None]


def test_age_on_a_day(spark):
    births = [dt.date(2000, 3, 15), dt.date(2000, 3, 16)]
    assert apply(spark, births, lambda c: dates.age_on(c, "2020-03-15"), "date") == [20, 19]
    today = dt.date.today()
    age = today.year - 2000 - ((today.month, today.day) < (3, 15))
    assert apply(spark, births[:1], dates.age_on, "date") == [age]


def test_age_from_year(spark):
    assert apply(spark, [1980.0, None], lambda c: dates.age_from_year(c, 2006), "double") == [26.0, None]


def test_cohort_year(spark):
    frame = spark.createDataFrame([("20152",), (None,), ("20151",)], "periodo string")
    assert dates.cohort_year(frame, "periodo").collect()[0][0] == 2015


def test_clean_names(spark):
    values = ['"""ESCUELA DE  INGENIERIA ""JULIO"" -BOGOTÁ"""', "PLAIN", '  "A"  ', None, 'UNI "X" CALI']
    assert apply(spark, values, text.clean_name) == ["ESCUELA DE INGENIERIA JULIO-BOGOTÁ", "PLAIN", "A", None, "UNI X CALI"]


def test_place_keys_ignore_case_and_accents(spark):
    values = ["Bogotá", "BOGOTA", " bogotá ", "Nariño", "ITAGÜÍ", "Córdoba", None]
    assert apply(spark, values, text.place_key) == ["BOGOTA", "BOGOTA", "BOGOTA", "NARINO", "ITAGUI", "CORDOBA", None]


def test_campus(spark):
    values = ["UNI TOKEN-CALI", "uni token - Medellín ", "UNI TOKEN", "OTHER-CALI", "A-B TOKEN-C-d", None]
    assert apply(spark, values, lambda c: text.campus(c, "Token")) == ["CALI", "MEDELLÍN", "SIN SEDE", "", "D", ""]
    assert apply(spark, values, lambda c: text.has_token(c, "TOKEN")) == [True, True, True, False, True, False]


def test_lumped_answers(spark):
    values = [" Ninguno ", "NO SABE", "No aplica", " Primaria ", None]
    lumped = apply(spark, values, lambda c: text.lump(c, fixed.NOT_APPLICABLE_ANSWERS, fixed.NOT_APPLICABLE))
    assert lumped == ["No aplica", "No aplica", "No aplica", "Primaria", None]


def test_null_label(spark):
    values = [None, "Sin Estrato", "sin estrato ", "Estrato 1"]
    found = apply(spark, values, lambda c: text.null_label(c, fixed.NOT_REPORTED, fixed.NO_STRATUM))
    assert found == ["No reporta", "No reporta", "No reporta", "Estrato 1"]


def test_relabel_keeps_unknown_codes(spark):
    assert apply(spark, ["M", "F", "X", None], lambda c: text.relabel(c, fixed.SEX_LABELS)) == ["Masculino", "Femenino", "X", None]


def test_code_text(spark):
    assert apply(spark, ["3.0", "3", " 3 ", "NSE4", "3.9", None, "1e30"], text.code_text) == ["3", "3", "3", "NSE4", "3", None, "1e30"]


def test_domestic(spark):
    values = [None, "colombia", " COLOMBIA ", "Colombia - Bogotá", "CÓLOMBIA", "PERÚ"]
    assert apply(spark, values, lambda c: text.is_domestic(c, "COLOMBIA")) == [True, True, True, False, False, False]
    assert apply(spark, values, lambda c: text.is_domestic(c, "COLOMBIA", True)) == [True, True, True, True, True, False]


def test_origin_types(spark):
    values = [" oficial nacional", "NO OFICIAL - FUNDACIÓN", "NO OFICIAL - FUNDACION", "REGIMEN ESPECIAL", "OTRO", None]
    found = apply(spark, values, lambda c: classes.classify_sets(c, fixed.ORIGIN_TYPES))
    assert found == ["Pública", "Privada", "Privada", "Régimen especial", None, None]


def test_index_bands_are_half_open(spark):
    values = [0.0, 41.1, 51.2, 64.1, 100.0, 100.1, -1.0, None]
    found = apply(spark, values, lambda c: classes.band(c, fixed.INDEX_EDGES, fixed.INDEX_LABELS), "double")
    assert found == ["Bajo", "Medio-bajo", "Medio-alto", "Alto", "Alto", None, None, None]


def test_arrival_classes(spark):
    assert apply(spark, [9, 10, 11, 12, None], lambda c: classes.arrival_class(c, F.lit(10)), "int") == [
        "early", "on_time", "on_time", "late", None,
    ]


def test_distance_and_deviation_classes(spark):
    distances = [-1.0, -0.5, 0.5, 2.5, 3.0]
    assert apply(spark, distances, classes.year_distance_class, "double") == ["early", "standard", "standard", "late", "very_late"]
    assert apply(spark, [-1, 0, 1, 4, 5], classes.deviation_class, "int") == ["early", "standard", "late", "late", "very_late"]


def test_trend_strength_fit_and_direction(spark):
    assert apply(spark, [0.06, 0.05, -0.06, None], classes.trend_class, "double") == ["up", "flat", "down", None]
    assert apply(spark, [-0.7, 0.4, 0.1, None], classes.strength_class, "double") == ["strong", "moderate", "weak", None]
    assert apply(spark, [0.7, 0.4, 0.0, -0.1], classes.fit_class, "double") == ["very_good", "moderate", "poor", "worse_than_mean"]
    assert apply(spark, [1.0, -1.0, 0.0], classes.direction_class, "double") == ["up", "down", "stable"]
