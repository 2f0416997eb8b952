"""Queries that run whole profiles over the star-schema tables in the shape of yearly exam tables.

School exams are orders by order year, degree exams are line items by ship year, and the line items
returned as 'A' are the links.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.operators import filters, link
from cohortia.plans import constants as fixed
from cohortia.plans import profiles
from cohortia.plans.registry import query, table
from cohortia.plans.star_scores import PREDICTIONS_SQL, histogram_sql, predictions
from cohortia.plans.star_tables import rounded

def by_year(df: DataFrame, date: str) -> dict[int | None, DataFrame]:
    """One table per year that the dates span, and one under None for rows without a date where there are such. The years come from the
    table's least and greatest date; ranges of dates reach the files, where a year taken from the date would not."""
    at = F.col(date)
    low, high, without = df.agg(F.year(F.min(date)), F.year(F.max(date)), F.count_if(at.isNull())).collect()[0]
    years = range(low, high + 1) if low is not None else ()
    tables = {y: df.filter((at >= F.lit(dt.datetime(y, 1, 1))) & (at < F.lit(dt.datetime(y + 1, 1, 1)))).drop(date) for y in years}
    if without or not tables:
        tables[None] = df.filter(at.isNull()).drop(date)
    return tables


def with_years(df: DataFrame, date: str, lacking: tuple[int, str] | None = None, year: str = "anio") -> list[DataFrame]:
    """The yearly tables as one table with a column for the year, which is read once, not once a year. ``lacking`` is a year and a
    column that its table does not have; that year is a table of its own."""
    dated = df.withColumn(year, F.year(date)).drop(date)
    if lacking is None:
        return [dated]
    of_year = F.col(year).eqNullSafe(lacking[0])
    return [dated.filter(~of_year), dated.filter(of_year).drop(lacking[1])]


def school_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders as yearly school exams; 1997 lacks the area column, numbers are left untyped."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("_date"),
        F.col("o_orderkey").alias("estu_consecutivo"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Sin Estrato")).otherwise(F.col("o_orderpriority")).alias("fami_estratovivienda"),
        F.col("o_orderstatus").alias("cole_naturaleza"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("URBANO")).otherwise(F.lit("RURAL")).alias("cole_area_ubicacion"),
        (F.col("o_custkey") % 33).cast("string").alias("estu_depto_presentacion"),
    )
    return with_years(orders, "_date", (1997, "cole_area_ubicacion"), "anio_cohorte")


def degree_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Line items as yearly degree exams; 1996 has no reference group."""
    half = F.when(F.month("l_shipdate") <= 6, F.lit(1)).otherwise(F.lit(2))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("_date"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("p")).alias("estu_consecutivo"),
        # accepted exam years start in 2000
        ((F.year("l_shipdate") + 10) * 10 + half).cast("string").alias("periodo"),
        F.when(F.col("l_linestatus") == "F", F.lit("ECONOMÍA")).otherwise(F.lit("DERECHO")).alias("gruporeferencia"),
    )
    return with_years(lines, "_date", (1996, "gruporeferencia"))


def exam_links(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    return (
        table(spark, folder, "lineitem")
        .filter("l_returnflag = 'A'")
        .select(F.concat(key, F.lit("p")).alias("estu_consecutivo_sbpro"), key.alias("estu_consecutivo_sb11"))
    )


def continuation(spark: SparkSession, folder: str, **picked) -> profiles.Profile:
    return profiles.cohort_continuation(
        school_tables(spark, folder), exam_links(spark, folder), degree_tables(spark, folder), **picked
    )


@query(
    """WITH c AS (SELECT year(o_orderdate)::INT AS anio_cohorte, count(*) AS total,
        count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS linked FROM orders GROUP BY ALL)
    SELECT anio_cohorte, total, linked, total - linked AS unlinked, round(linked * 100.0 / total, 2)::DOUBLE AS linked_rate,
      round((total - linked) * 100.0 / total, 2)::DOUBLE AS unlinked_rate FROM c"""
)
def continuation_funnel(spark, folder):
    return continuation(spark, folder)["funnel"]


UNLINKED_SQL = """u AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'No reporta' ELSE o_orderpriority END AS e, o_orderstatus AS s,
    CASE WHEN year(o_orderdate) = 1997 THEN 'No reporta' WHEN o_custkey % 2 = 0 THEN 'URBANO' ELSE 'RURAL' END AS a, (o_custkey % 33)::VARCHAR AS d
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))"""


@query(
    f"""WITH {UNLINKED_SQL} SELECT 'fami_estratovivienda' AS field, e AS value, count(*) AS n FROM u GROUP BY ALL
    UNION ALL SELECT 'cole_naturaleza', s, count(*) FROM u GROUP BY ALL
    UNION ALL SELECT 'cole_area_ubicacion', a, count(*) FROM u GROUP BY ALL
    UNION ALL SELECT 'estu_depto_presentacion', d, count(*) FROM u GROUP BY ALL"""
)
def continuation_unlinked(spark, folder):
    return continuation(spark, folder)["unlinked_counts"]


@query(
    """WITH a AS (SELECT year(o_orderdate) AS cohort, (year(e.l_shipdate) + 10 - year(o_orderdate)) * 2
        + CASE WHEN month(e.l_shipdate) <= 6 THEN 0 ELSE 1 END AS gap FROM orders
      JOIN lineitem k ON o_orderkey = k.l_orderkey AND k.l_returnflag = 'A' JOIN lineitem e ON e.l_orderkey = k.l_orderkey
      WHERE year(o_orderdate) = 1998 AND e.l_linestatus = 'F' AND year(e.l_shipdate) <> 1996)
    SELECT count(*) AS total, count(*) FILTER (gap < 9) AS early_count, round(count(*) FILTER (gap < 9) * 100.0 / count(*), 6)::DOUBLE AS early_pct,
      round(coalesce(avg(gap - 9) FILTER (gap < 9), 0), 6) + 0.0 AS early_avg_dev, count(*) FILTER (gap IN (9, 10)) AS on_time_count,
      round(count(*) FILTER (gap IN (9, 10)) * 100.0 / count(*), 6)::DOUBLE AS on_time_pct, count(*) FILTER (gap > 10) AS late_count,
      round(count(*) FILTER (gap > 10) * 100.0 / count(*), 6)::DOUBLE AS late_pct, round(coalesce(avg(gap - 9) FILTER (gap > 10), 0), 6) + 0.0 AS late_avg_dev,
      round(avg(gap - 9), 6) + 0.0 AS avg_dev FROM a"""
)
def continuation_timing(spark, folder):
    """One cohort and one reference group, whose standard is nine semesters."""
    timing = continuation(spark, folder, cohort=1998, group="ECONOMÍA")["timing"]
    return rounded(timing, "early_pct", "early_avg_dev", "on_time_pct", "late_pct", "late_avg_dev", "avg_dev")


def continuation_files(spark: SparkSession, folder: str) -> profiles.Profile:
    """All orders and those without a returned line, as the two files of one cohort."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("fami_estratovivienda"), F.col("o_orderstatus").alias("cole_naturaleza")
    )
    returned = table(spark, folder, "lineitem").filter("l_returnflag = 'A'")
    return profiles.cohort_continuation_csv(orders, link.unlinked(orders, returned, "o_orderkey", "l_orderkey"))


@query(
    """WITH c AS (SELECT count(*) AS total, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS linked FROM orders)
    SELECT total, linked, total - linked AS unlinked, round(linked * 100.0 / total, 2)::DOUBLE AS linked_rate,
      round((total - linked) * 100.0 / total, 2)::DOUBLE AS unlinked_rate FROM c"""
)
def continuation_csv_funnel(spark, folder):
    return continuation_files(spark, folder)["funnel"]


@query(
    """WITH u AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))
    SELECT 'fami_estratovivienda' AS field, o_orderpriority AS value, count(*) AS n FROM u GROUP BY ALL
    UNION ALL SELECT 'cole_naturaleza', o_orderstatus, count(*) FROM u GROUP BY ALL"""
)
def continuation_csv_unlinked(spark, folder):
    return continuation_files(spark, folder)["unlinked_counts"]


# ---- socio-economic profile ----------------------------------------------------------------------


def socio_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders with their customer and nation as yearly socio-economic tables, all text."""
    rows = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    key, nation = F.col("o_orderkey"), F.col("n_nationkey")
    shaped = rows.select(
        F.col("o_orderdate").alias("_date"),
        F.date_format("o_orderdate", "yyyyMM").alias("periodo"),
        F.when(key % 3 == 0, F.lit("M")).otherwise(F.lit("F")).alias("estu_genero"),
        F.date_format(F.date_sub("o_orderdate", 8000), "dd/MM/yyyy").alias("estu_fechanacimiento"),
        F.when(nation < 15, F.lit(" Colombia")).when(nation > 16, F.col("n_name")).alias("estu_nacionalidad"),
        F.col("n_name").alias("estu_depto_reside"),
        F.col("o_orderpriority").alias("fami_estratovivienda"),
        (F.col("o_totalprice") / 5000).cast("string").alias("estu_inse_individual"),
        F.when(key % 2 == 0, (key % 4 + 1).cast("double").cast("string")).otherwise((key % 4 + 1).cast("string")).alias("estu_nse_individual"),
        F.concat(F.lit('"""'), F.col("c_mktsegment"), F.lit(' ""X"" -CALI"')).alias("inst_nombre_institucion"),
        F.when(F.col("o_orderstatus") == "F", F.lit("oficial nacional"))
        .when(F.col("o_orderstatus") == "O", F.lit("NO OFICIAL - FUNDACIÓN"))
        .otherwise(F.lit("?"))
        .alias("inst_origen"),
        F.when(F.col("o_orderstatus") == "P", F.lit("true")).otherwise(F.lit("no")).alias("estu_pagomatriculabeca"),
        F.when(key % 5 == 0, F.lit("Si")).otherwise(F.lit("0")).alias("estu_pagomatriculapadres"),
    )
    return with_years(shaped, "_date")


def socio(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.consolidated_socio(socio_tables(spark, folder))


SOCIO_SQL = """socio AS (SELECT year(o_orderdate) AS anio, strftime(o_orderdate, '%Y%m') AS periodo, CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE 'F' END AS sex,
    o_orderdate::DATE - 8000 AS birth, CASE WHEN n_nationkey <= 16 THEN 'COLOMBIA' ELSE n_name END AS country, n_name, o_orderpriority AS stratum,
    o_totalprice / 5000 AS idx, (o_orderkey % 4 + 1)::VARCHAR AS level, c_mktsegment || ' X-CALI' AS inst, o_orderstatus AS status,
    o_orderstatus = 'P' AS "Beca", o_orderkey % 5 = 0 AS "Padres"
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    f"""WITH {SOCIO_SQL} SELECT 'periodo' AS field, periodo AS value, count(*) AS n FROM socio GROUP BY ALL
    UNION ALL SELECT 'estu_genero', sex, count(*) FROM socio GROUP BY ALL
    UNION ALL SELECT 'estu_depto_reside', n_name, count(*) FROM socio GROUP BY ALL
    UNION ALL SELECT 'fami_estratovivienda', stratum, count(*) FROM socio GROUP BY ALL
    UNION ALL SELECT 'fami_tieneinternet', 'false', count(*) FROM socio
    UNION ALL SELECT 'fami_tienecomputador', 'false', count(*) FROM socio
    UNION ALL SELECT 'inst_origen', CASE status WHEN 'F' THEN 'oficial nacional' WHEN 'O' THEN 'NO OFICIAL - FUNDACIÓN' ELSE '?' END, count(*) FROM socio GROUP BY ALL
    UNION ALL SELECT 'inst_nombre_institucion', inst, count(*) FROM socio GROUP BY ALL"""
)
def socio_counts(spark, folder):
    return profiles.socioeconomic_profile(socio(spark, folder))["counts"]


@query(
    f"""WITH {SOCIO_SQL}, a AS (SELECT (anio - year(birth) - ((month(birth), day(birth)) > (6, 30))::INT)::INT AS edad FROM socio)
    SELECT edad, count(*) AS n FROM a WHERE edad BETWEEN 15 AND 60 GROUP BY ALL"""
)
def socio_ages(spark, folder):
    return profiles.socioeconomic_profile(socio(spark, folder))["age"]


@query(
    f"""WITH {SOCIO_SQL} SELECT level AS value, CASE level WHEN '1' THEN '1 — Nivel socioeconómico bajo' WHEN '2' THEN '2 — Nivel socioeconómico medio-bajo'
      WHEN '3' THEN '3 — Nivel socioeconómico medio-alto' ELSE '4 — Nivel socioeconómico alto' END AS label, count(*) AS n FROM socio GROUP BY ALL"""
)
def socio_levels(spark, folder):
    return profiles.socioeconomic_profile(socio(spark, folder))["level"]


@query(
    f"""WITH {SOCIO_SQL}, f AS (SELECT "Beca" AS b, "Padres" AS p FROM socio)
    SELECT a AS flag_a, c AS flag_b, CASE WHEN a = 'Beca' AND c = 'Beca' THEN (SELECT count(*) FILTER (b) FROM f)
        WHEN a = 'Padres' AND c = 'Padres' THEN (SELECT count(*) FILTER (p) FROM f)
        WHEN a IN ('Beca', 'Padres') AND c IN ('Beca', 'Padres') THEN (SELECT count(*) FILTER (b AND p) FROM f) ELSE 0 END AS n
    FROM (VALUES ('Beca'), ('Crédito'), ('Padres'), ('Recursos propios')) x(a), (VALUES ('Beca'), ('Crédito'), ('Padres'), ('Recursos propios')) y(c)"""
)
def socio_payment_pairs(spark, folder):
    return profiles.socioeconomic_profile(socio(spark, folder))["payment_pairs"]


@query(
    f"""WITH {SOCIO_SQL}, m AS (SELECT greatest(min(idx), 0) AS lo, least(max(idx), 100) AS hi FROM socio),
    v AS (SELECT idx, lo, (hi - lo) / 40 AS w, least(floor((idx - lo) / (hi - lo) * 40), 39)::INT AS g,
        CASE WHEN idx < 41.1 THEN 'Bajo' WHEN idx < 51.2 THEN 'Medio-bajo' WHEN idx < 64.1 THEN 'Medio-alto' ELSE 'Alto' END AS band
      FROM socio, m WHERE idx BETWEEN lo AND hi),
    b AS (SELECT band, lo, w, (g - (idx < lo + g * w)::INT + (idx >= lo + (g + 1) * w AND g < 39)::INT)::INT AS bin FROM v)
    SELECT band, bin, round(lo + bin * w, 6) + 0.0 AS low, count(*) AS n FROM b GROUP BY ALL"""
)
def socio_index(spark, folder):
    return rounded(profiles.socioeconomic_profile(socio(spark, folder))["index"], "low")


@query(
    f"""WITH {SOCIO_SQL} SELECT 'total' AS item, count(*) AS n FROM socio UNION ALL SELECT 'domestic', count(*) FILTER (country = 'COLOMBIA') FROM socio
    UNION ALL SELECT 'foreign', count(*) FILTER (country <> 'COLOMBIA') FROM socio
    UNION ALL (SELECT 'foreign: ' || country, count(*) FROM socio WHERE country <> 'COLOMBIA' GROUP BY ALL)
    UNION ALL SELECT 'flag: Beca', count(*) FILTER ("Beca") FROM socio UNION ALL SELECT 'flag: Padres', count(*) FILTER ("Padres") FROM socio
    UNION ALL SELECT 'flag: Crédito', 0 FROM (SELECT 1) UNION ALL SELECT 'flag: Recursos propios', 0 FROM (SELECT 1)"""
)
def socio_overview(spark, folder):
    """Totals, countries and flags of the page."""
    tables = profiles.socioeconomic_profile(socio(spark, folder))
    split = tables["nationality"].select(F.explode(F.create_map(F.lit("domestic"), "domestic", F.lit("foreign"), "foreign")).alias("item", "n"))
    parts = [tables["total"].select(F.lit("total").alias("item"), "n"), split]
    parts.append(tables["foreign"].select(F.concat(F.lit("foreign: "), "value").alias("item"), "n"))
    parts.append(tables["payments"].select(F.concat(F.lit("flag: "), "flag").alias("item"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    f"""WITH {SOCIO_SQL} SELECT stratum AS fami_estratovivienda, count(*) FILTER ("Beca") AS "Beca", 0::BIGINT AS "Crédito",
      count(*) FILTER ("Padres") AS "Padres", 0::BIGINT AS "Recursos propios" FROM socio WHERE sex = 'M' AND n_name = 'NATION_3' GROUP BY ALL"""
)
def socio_payments(spark, folder):
    """Payment flags by stratum under two filters."""
    picked = profiles.exam_filters(socio(spark, folder), genero="M", depto="NATION_3")
    return profiles.socioeconomic_profile(picked)["stratum_payment"]


@query(
    f"""WITH {SOCIO_SQL}, n AS (SELECT n_name AS value, count(*) AS n FROM socio WHERE status = 'F' GROUP BY ALL)
    SELECT value, n, nation.n_name AS name FROM n JOIN nation ON value = nation.n_name"""
)
def socio_map(spark, folder):
    """Map counts of the public institutions' rows."""
    dimension = table(spark, folder, "nation").select(F.lower("n_name").alias("name"))
    picked = profiles.exam_filters(socio(spark, folder), origen="Pública")
    matched = profiles.socioeconomic_profile(picked, dimension)["map_department_home"]
    return matched.withColumn("name", F.upper("name"))


# ---- score profiles ------------------------------------------------------------------------------


def norm_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Line items as yearly normalized scores by supplier nation; 1999 lacks the official global."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    shaped = lines.select(
        F.col("l_shipdate").alias("_date"),
        F.concat(F.lit("U"), F.col("s_nationkey").cast("string"), F.lit(" -X")).alias("inst_nombre_institucion"),
        F.col("l_linestatus").alias("estu_prgm_academico"),
        F.col("l_returnflag").alias("gruporeferencia"),
        F.lit("D").alias("estu_prgm_departamento"),
        (F.col("l_quantity") / 50).cast("string").alias("mod_ingles_punt_norm"),
        (F.col("l_extendedprice") / 100000).cast("string").alias("punt_global_norm"),
        ((F.col("l_extendedprice") + F.col("l_quantity")) / 100050).alias("punt_global_calc_norm"),
    )
    return with_years(shaped, "_date", (1999, "punt_global_norm"))


NORMS_SQL = """norms AS (SELECT year(l_shipdate) AS anio, 'U' || s_nationkey || '-X' AS inst, l_returnflag AS grp, l_quantity / 50 AS ingles,
    CASE WHEN year(l_shipdate) <> 1999 THEN l_extendedprice / 100000 END AS g, (l_extendedprice + l_quantity) / 100050 AS gc
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(
    f"""WITH {NORMS_SQL}, m AS (SELECT inst, avg(g) AS g FROM norms WHERE grp IN ('A', 'R') GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY g DESC, inst)::INT AS position, inst AS inst_nombre_institucion, round(g, 2) AS punt_global_norm FROM m
    ORDER BY position LIMIT 20"""
)
def institution_ranking(spark, folder):
    """Rankings under a group filter."""
    norms = profiles.consolidated_norms(norm_tables(spark, folder))
    picked = filters.apply_filters(norms, isin={"gruporeferencia": ["A", "R"]})
    return profiles.institution_comparison(picked, [])["ranking"]


@query(
    f"""WITH {NORMS_SQL}, m AS (SELECT inst, round(avg(ingles), 2) AS i, round(avg(g), 2) AS g, round(avg(gc), 2) AS c FROM norms
      WHERE inst IN ('U3-X', 'U7-X', 'U11-X') GROUP BY ALL),
    l AS (SELECT inst, 'mod_ingles_punt_norm' AS score, i AS value FROM m UNION ALL SELECT inst, 'punt_global_norm', g FROM m
      UNION ALL SELECT inst, 'punt_global_calc_norm', c FROM m UNION ALL SELECT inst, s, NULL FROM m, (VALUES ('mod_razona_cuantitat_punt_norm'),
      ('mod_lectura_critica_punt_norm'), ('mod_competen_ciudada_punt_norm')) v(s)),
    e AS (SELECT *, max(value) OVER (PARTITION BY score) AS hi, min(value) OVER (PARTITION BY score) AS lo FROM l)
    SELECT inst AS inst_nombre_institucion, score, value, coalesce(value = hi, false) AS is_best, coalesce(value = lo AND lo <> hi, false) AS is_worst FROM e"""
)
def institution_table(spark, folder):
    norms = profiles.consolidated_norms(norm_tables(spark, folder))
    return profiles.institution_comparison(norms, ["U3-X", "U7-X", "U11-X"])["marked"]


@query(
    """WITH v AS (SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem),
    m AS (SELECT min(q) AS ql, max(q) AS qh, min(p) AS pl, max(p) AS ph FROM v),
    b AS (SELECT 'mod_ingles_punt' AS field, q AS x, ql AS lo, (qh - ql) / 40 AS w, least(floor((q - ql) / (qh - ql) * 40), 39)::INT AS b FROM v, m
      UNION ALL SELECT 'punt_global', p, pl, (ph - pl) / 40, least(floor((p - pl) / (ph - pl) * 40), 39)::INT FROM v, m)
    SELECT field, (b - (x < lo + b * w)::INT + (x >= lo + (b + 1) * w AND b < 39)::INT)::INT AS bin, count(*) AS n FROM b GROUP BY ALL"""
)
def score_histograms(spark, folder):
    """Scores that come as text in yearly tables; the scores no table has leave no histogram."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("_date"),
        F.col("l_quantity").cast("string").alias("mod_ingles_punt"),
        F.col("l_extendedprice").alias("punt_global"),
    )
    scores = profiles.consolidated_scores(with_years(lines, "_date"))
    return profiles.score_profile(scores)["histograms"].filter("n > 0").select("field", "bin", "n")


@query(
    """WITH e AS (SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'No aplica' WHEN 'FURNITURE' THEN 'No aplica' ELSE c_mktsegment END AS p,
        o_orderpriority AS v FROM orders JOIN customer ON o_custkey = c_custkey),
    c AS (SELECT v AS value, count(*) AS n FROM e WHERE p = 'No aplica' GROUP BY ALL),
    s AS (SELECT *, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS probability FROM c)
    SELECT *, row_number() OVER (ORDER BY probability DESC, value) = 1 AS most_likely FROM s"""
)
def stratum_probability(spark, folder):
    rows = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    segment = F.col("c_mktsegment")
    answer = F.when(segment == "MACHINERY", F.lit(" Ninguno")).when(segment == "FURNITURE", F.lit("No Sabe")).otherwise(segment)
    shaped = rows.select(answer.alias("fami_educacionpadre"), F.col("o_orderpriority").alias("fami_estratovivienda"))
    return profiles.stratum_probability(shaped, father=fixed.NOT_APPLICABLE)["probability"]


# ---- paired scores and contribution --------------------------------------------------------------


def exam_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as degree exams and their orders as school exams, linked one by one."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = table(spark, folder, "lineitem")
    degree = lines.select(
        F.col("l_shipdate").alias("_date"),
        key.alias("estu_consecutivo"),
        F.element_at(F.array(*map(F.lit, fixed.ENGLISH_DEGREE)), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("mod_ingles_desem"),
        (F.col("l_quantity") / 50).alias("mod_ingles_punt_norm"),
        (F.col("l_extendedprice") / 100000).alias("punt_global_norm"),
        (F.col("l_extendedprice") / 100000 + F.col("l_quantity") / 50).alias("punt_global_calc_norm"),
    )
    school = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("_date"),
        F.col("o_orderkey").cast("string").alias("estu_consecutivo"),
        F.element_at(F.array(*map(F.lit, fixed.ENGLISH_SCHOOL)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("desemp_ingles"),
        (F.dayofmonth("o_orderdate") / 31).alias("punt_ingles_norm"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000).alias("punt_global_norm"),
        (F.col("o_totalprice") / 500000).alias("punt_global_calc_norm"),
    )
    links = lines.select(key.alias("estu_consecutivo_sbpro"), F.col("l_orderkey").cast("string").alias("estu_consecutivo_sb11"))
    return profiles.paired_scores(with_years(degree, "_date"), links, with_years(school, "_date"))


EXAM_PAIRS_SQL = """p AS (SELECT year(l_shipdate)::INT AS anio, l_linenumber % 5 + 1 AS de, o_orderkey % 5 + 1 AS se,
      l_quantity / 50 AS yi, day(o_orderdate) / 31.0::DOUBLE AS xi, l_extendedprice / 100000 AS yg,
      CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS xg, l_extendedprice / 100000 + l_quantity / 50 AS yc, o_totalprice / 500000 AS xc
    FROM lineitem JOIN (SELECT l_orderkey AS ko, l_linenumber AS kl FROM lineitem) k ON l_orderkey = ko AND l_linenumber = kl JOIN orders ON ko = o_orderkey),
    l AS (SELECT anio, 'Competencia en Inglés' AS label, yi AS y, xi AS x FROM p UNION ALL SELECT anio, 'Puntaje Global', yg, xg FROM p
      UNION ALL SELECT anio, 'Puntaje global calculado', yc, xc FROM p)"""
EMPTY_PAIRS_SQL = """(VALUES ('Competencia lógico-cuantitativa'), ('Competencia lectora-comunicativa'), ('Competencia ciudadana-cívica')) e(label)"""


@query(f"WITH {EXAM_PAIRS_SQL} SELECT anio, label, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM l GROUP BY ALL")
def paired_profile_trend(spark, folder):
    return rounded(profiles.paired_profile(exam_pairs(spark, folder))["trend"], "x_mean", "y_mean")


@query(
    f"""WITH {EXAM_PAIRS_SQL} SELECT label, count(y - x) AS n, round(avg(y - x), 6) + 0.0 AS mean FROM l GROUP BY ALL
    UNION ALL SELECT label, 0, NULL FROM {EMPTY_PAIRS_SQL}"""
)
def paired_profile_deltas(spark, folder):
    return rounded(profiles.paired_profile(exam_pairs(spark, folder))["deltas"], "mean")


@query(
    f"""WITH {EXAM_PAIRS_SQL}, c AS (SELECT de, se, count(*) AS n FROM p GROUP BY ALL)
    SELECT ['A-', 'A1', 'A2', 'B1', 'B+'][i] AS from_level, ['-A1', 'A1', 'A2', 'B1', 'B2'][j] AS to_level, coalesce(n, 0) AS n,
      round(coalesce(n * 100.0 / sum(n) OVER (PARTITION BY i), 0), 6)::DOUBLE AS pct
    FROM range(1, 6) a(i), range(1, 6) b(j) LEFT JOIN c ON se = i AND de = j"""
)
def paired_profile_english(spark, folder):
    return rounded(profiles.paired_profile(exam_pairs(spark, folder))["english"], "pct")


@query(
    f"""WITH {EXAM_PAIRS_SQL}, r AS (SELECT label, x, y, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0::DOUBLE AS ry
      FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT label, count(*) AS n, round(corr(x, y), 3) + 0.0 AS pearson, round(corr(rx, ry), 3) + 0.0 AS spearman FROM r GROUP BY ALL)
    SELECT label, n, pearson, spearman FROM c UNION ALL SELECT label, 0, NULL, NULL FROM {EMPTY_PAIRS_SQL}"""
)
def paired_profile_correlations(spark, folder):
    found = profiles.paired_profile(exam_pairs(spark, folder))["density_correlations"]
    return rounded(found.drop("strength"), "pearson", "spearman", digits=3)


@query(
    f"""WITH {EXAM_PAIRS_SQL}, q AS (SELECT xi AS x, yi AS y FROM p),
    e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS ex, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS ey FROM q),
    b AS (SELECT (1 + (x > ex[1])::INT + (x > ex[2])::INT + (x > ex[3])::INT + (x > ex[4])::INT) AS from_bin,
                 (1 + (y > ey[1])::INT + (y > ey[2])::INT + (y > ey[3])::INT + (y > ey[4])::INT) AS to_bin FROM q, e)
    SELECT from_bin, to_bin, count(*) AS n FROM b GROUP BY ALL"""
)
def paired_profile_quintiles(spark, folder):
    cells = profiles.paired_profile(exam_pairs(spark, folder))["quintiles: Competencia en Inglés"]
    return cells.filter("n > 0").select("from_bin", "to_bin", "n")


CONTRIBUTION_PROFILE_SQL = f"""{EXAM_PAIRS_SQL}, f AS (SELECT anio, 'Competencia en Inglés' AS label, yi AS y, xi AS x FROM p
      UNION ALL SELECT anio, 'Puntaje Global', yg, coalesce(xg, xc) FROM p UNION ALL SELECT anio, 'Puntaje global calculado', yc, xc FROM p),
    v AS (SELECT anio, label, (avg(y) - avg(x)) * 100 AS value FROM f GROUP BY ALL)"""


@query(f"WITH {CONTRIBUTION_PROFILE_SQL} SELECT anio, label, round(value, 5) + 0.0 AS value FROM v")
def contribution_profile_long(spark, folder):
    return rounded(profiles.contribution_profile(exam_pairs(spark, folder))["long"], "value", digits=5)


@query(
    f"""WITH {CONTRIBUTION_PROFILE_SQL} SELECT round(avg(value) FILTER (label = 'Puntaje global calculado'), 5) AS main_mean, 'Competencia en Inglés' AS best_label,
      round(avg(value) FILTER (label = 'Competencia en Inglés'), 5) AS best_label_mean, arg_max(anio, value) FILTER (label = 'Puntaje global calculado') AS best_year,
      round(max(value) FILTER (label = 'Puntaje global calculado'), 5) AS best_year_value FROM v"""
)
def contribution_profile_kpis(spark, folder):
    found = profiles.contribution_profile(exam_pairs(spark, folder))["kpis"]
    return rounded(found, "main_mean", "best_label_mean", "best_year_value", digits=5)


# ---- one exam's profile --------------------------------------------------------------------------


@query(
    """SELECT 'o_orderpriority' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL
    UNION ALL SELECT 'age', (2010 - year(o_orderdate) - ((month(o_orderdate), day(o_orderdate)) > (5, 20))::INT)::VARCHAR, count(*) FROM orders
      WHERE 2010 - year(o_orderdate) - ((month(o_orderdate), day(o_orderdate)) > (5, 20))::INT BETWEEN 10 AND 30 GROUP BY ALL"""
)
def school_profile(spark, folder):
    orders = table(spark, folder, "orders").withColumn("birth", F.date_format("o_orderdate", "d/M/yyyy"))
    tables = profiles.school_exam_profile(
        orders, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"], "2010-05-20", "birth", nationality=None
    )
    age = tables["age"].select(F.lit("age").alias("field"), F.col("edad").cast("string").alias("value"), "n")
    return tables["counts"].unionByName(age)


@query(
    """WITH d AS (SELECT o_custkey::VARCHAR AS inst, o_orderpriority AS prg, o_totalprice AS s, o_orderstatus AS st FROM orders)
    SELECT 'institutions' AS part, value, n FROM (SELECT inst AS value, count(*) AS n FROM d GROUP BY ALL ORDER BY n DESC, value LIMIT 50)
    UNION ALL SELECT 'programmes', prg, count(*) FROM d GROUP BY ALL
    UNION ALL SELECT 'payments', 'Beca', count(*) FILTER (st = 'F') FROM d UNION ALL SELECT 'total', 'rows', count(*) FROM d"""
)
def degree_profile(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("inst"),
        F.col("o_orderpriority").alias("prg"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("estu_fechanacimiento"),
        F.lit("COLOMBIA").alias("estu_nacionalidad"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", F.lit("T")).otherwise(F.lit("f")).alias("beca"),
    )
    tables = profiles.degree_exam_profile(
        orders, ["o_totalprice"], ["prg"], 2023, institution="inst", programme="prg", payments={"beca": "Beca"}
    )
    parts = [tables[p].select(F.lit(p).alias("part"), "value", "n") for p in ("institutions", "programmes")]
    flags = tables["payments"].select(F.lit("payments").alias("part"), F.col("flag").alias("value"), "n")
    total = tables["total"].select(F.lit("total").alias("part"), F.lit("rows").alias("value"), "n")
    return parts[0].unionByName(parts[1]).unionByName(flags).unionByName(total)


# ---- prediction quality and the executive summary ------------------------------------------------


def exam_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Price predictions under the names of an exam module, scaled to 0-1."""
    return predictions(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("split") == "A", F.lit("test")).otherwise(F.lit("train")).alias("split"),
        (F.col("price_real") / 100).alias("ingles_real"),
        (F.col("price_pred") / 100).alias("ingles_pred"),
    )


@query(
    f"""WITH {PREDICTIONS_SQL}, e AS (SELECT price_real / 100 - price_pred / 100 AS error FROM pred WHERE split = 'A'),
    {histogram_sql('e', 'error', 60)} SELECT bin, round(low, 9) + 0.0 AS low, round(high, 9) + 0.0 AS high, n FROM h"""
)
def residual_histogram(spark, folder):
    test = filters.prediction_slice(exam_predictions(spark, folder), split="test")
    return rounded(profiles.prediction_quality(test, "ingles")["residuals"], "low", "high", digits=9)


@query(
    f"""WITH {NORMS_SQL}, b AS (SELECT inst FROM norms GROUP BY ALL ORDER BY avg(g) DESC, inst LIMIT 1),
    l AS (SELECT round(count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) * 100.0 / count(*), 1)::DOUBLE AS r FROM orders),
    k AS (SELECT 'kpi_registros' AS item, 'Registros analizados' AS label, (SELECT count(*) FROM orders)::VARCHAR AS value
      UNION ALL SELECT 'kpi_universidades', 'Universidades', count(DISTINCT inst)::VARCHAR FROM norms
      UNION ALL SELECT 'kpi_programas', 'Programas académicos', (SELECT count(DISTINCT l_linestatus) FROM lineitem)::VARCHAR
      UNION ALL SELECT 'kpi_tasa', 'Tasa de profesionalización', r::VARCHAR FROM l
      UNION ALL SELECT 'kpi_mejor', 'Mejor universidad (Global)', inst FROM b)
    SELECT 'resumen' AS section, item, 'kpi' AS kind, label, value, 'indicator' AS tag FROM k"""
)
def executive_indicators(spark, folder):
    tables = continuation(spark, folder)
    norms = profiles.consolidated_norms(norm_tables(spark, folder))
    people = socio(spark, folder)
    return profiles.executive_summary(
        norms, people, people, tables["funnel"], tables["arrivals"], exam_predictions(spark, folder)
    )["kpis"]
