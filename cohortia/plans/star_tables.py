"""Queries on shaping, filters, frequency tables, cross-tables, rankings, places and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.functions import classes, dates, numbers, text
from cohortia.operators import conform, crosstab, filters, frequency, geo, link, ranking, summary
from cohortia.plans import schemas
from cohortia.plans.registry import query, table
from cohortia.sources import readers

TRUTH = ("1", "1.0", "true", "t", "yes", "y", "si", "sí", "s")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# ---- sources -------------------------------------------------------------------------------------


@query(
    """SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations"""
)
def row_counts(spark, folder):
    names = ["orders", "lineitem", "events", "documents", "pages", "conversations"]
    return conform.union_by_name(
        [
            readers.row_count(spark, f"{folder}/{n}.parquet").select(F.lit(n).alias("name"), "rows")
            for n in names
        ]
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def column_read(spark, folder):
    return readers.read_parquet(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_orderpriority"])


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_returnflag FROM lineitem")
def text_read(spark, folder):
    wanted = ["l_orderkey", "absent", "l_linenumber", "l_returnflag"]
    return readers.pick(table(spark, folder, "lineitem"), wanted, as_string=True)


@query("SELECT 'orders' AS name, 'o_comment' AS missing, count(*) AS rows FROM orders")
def table_contract(spark, folder):
    orders = table(spark, folder, "orders")
    missing = readers.table_contract(orders, ["o_orderkey", "o_comment"])
    rows = readers.row_count(spark, f"{folder}/orders.parquet")
    return rows.select(F.lit("orders").alias("name"), F.lit(",".join(missing)).alias("missing"), "rows")


# ---- projection and union of drifting tables -----------------------------------------------------

ORDER_CONTRACT = schemas.contract("o_orderkey o_orderpriority o_clerk", "o_totalprice")


def drifting_orders(spark: SparkSession, folder: str) -> dict[int, DataFrame]:
    """Orders as yearly tables: 1996 and before has the price under an old name, as text with bad
    entries; 1997 has no priority; 1998 has both price columns, the current one with gaps."""
    orders = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    old = orders.filter(year <= 1996).select(
        "o_orderkey",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a"))
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
        .alias("o_price"),
    )
    gap = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return {
        1996: old,
        1997: orders.filter(year == 1997).select("o_orderkey", "o_totalprice"),
        1998: orders.filter(year == 1998).select(
            "o_orderkey", "o_orderpriority", gap.alias("o_totalprice"), F.col("o_totalprice").alias("o_price")
        ),
        1999: orders.filter(year >= 1999),
    }


@query(
    """SELECT least(greatest(year(o_orderdate), 1996), 1999)::INT AS anio, o_orderkey::VARCHAR AS o_orderkey,
      CASE WHEN year(o_orderdate) <> 1997 THEN o_orderpriority END AS o_orderpriority, NULL::VARCHAR AS o_clerk,
      CASE WHEN year(o_orderdate) > 1996 OR o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders"""
)
def drift_union(spark, folder):
    return conform.union_years(drifting_orders(spark, folder), ORDER_CONTRACT, {"o_price": "o_totalprice"})


@query(
    """SELECT n_name, n_regionkey AS n_regionkey_x, n_nationkey AS code FROM nation"""
)
def suffix_rename(spark, folder):
    return conform.suffix(table(spark, folder, "nation"), "_x", keep=["n_name"], rename={"n_nationkey": "code"})


@query(
    """WITH t AS (SELECT l_discount, CASE l_linenumber % 4 WHEN 0 THEN ' ' || l_quantity::INT::VARCHAR || ' '
        WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE l_quantity::INT::VARCHAR || 'd' END AS raw, l_linenumber, l_quantity FROM lineitem)
    SELECT l_linenumber, count(*) AS n, count(CASE WHEN l_linenumber % 4 = 0 THEN l_quantity END) AS numbers,
           sum(CASE WHEN l_linenumber % 4 = 0 THEN l_quantity END) AS total FROM t GROUP BY ALL"""
)
def coerced_numbers(spark, folder):
    whole = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), whole, F.lit(" ")))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.lit("abc"))
        .otherwise(F.concat(whole, F.lit("d")))
    )
    value = table(spark, folder, "lineitem").select("l_linenumber", numbers.to_number(raw).alias("value"))
    return value.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("numbers"), F.sum("value").alias("total")
    )


@query(
    """WITH f AS (SELECT CASE l_linenumber % 8 WHEN 0 THEN 'true' WHEN 1 THEN ' T ' WHEN 2 THEN '1.0' WHEN 3 THEN 'Sí'
        WHEN 4 THEN 'no' WHEN 5 THEN 'YES' WHEN 6 THEN '0' END AS raw FROM lineitem)
    SELECT raw, coalesce(lower(trim(raw)) IN ('1','1.0','true','t','yes','y','si','sí','s'), false) AS flag, count(*) AS n
    FROM f GROUP BY ALL"""
)
def truth_flags(spark, folder):
    kind = F.col("l_linenumber") % 8
    raw = F
    for i, answer in enumerate(["true", " T ", "1.0", "Sí", "no", "YES", "0"]):
        raw = raw.when(kind == i, F.lit(answer))
    flagged = table(spark, folder, "lineitem").select(raw.alias("raw"))
    return counted(flagged.withColumn("flag", numbers.to_flag("raw", TRUTH)), "raw", "flag")


# ---- dates ---------------------------------------------------------------------------------------

BIRTHS_SQL = """births AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS birth FROM orders)"""


def births(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as birth-date text in three layouts, with junk in every fourth row."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(day, "d-M-yyyy"))
        .otherwise(F.lit("31/02/19x"))
    )
    return table(spark, folder, "orders").select("o_orderkey", dates.parse_date(raw).alias("birth"))


@query(
    f"""WITH {BIRTHS_SQL} SELECT (2020 - year(birth) - ((month(birth), day(birth)) > (6, 30))::INT)::INT AS age_fixed,
      (2021 - year(birth) - ((month(birth), day(birth)) > (3, 15))::INT)::INT AS age_as_of,
      (2006 - year(birth))::INT AS age_year, count(*) AS n FROM births GROUP BY ALL"""
)
def ages(spark, folder):
    rows = births(spark, folder).select(
        dates.age_at("birth", 2020).alias("age_fixed"),
        dates.age_on("birth", "2021-03-15").alias("age_as_of"),
        dates.age_from_year(F.year("birth"), 2006).alias("age_year"),
    )
    return counted(rows, "age_fixed", "age_as_of", "age_year")


@query(
    f"""WITH {BIRTHS_SQL}, a AS (SELECT (2020 - year(birth) - ((month(birth), day(birth)) > (6, 30))::INT)::INT AS edad FROM births)
    SELECT edad, count(*) AS n FROM a WHERE edad BETWEEN 20 AND 23 GROUP BY ALL"""
)
def age_range(spark, folder):
    rows = births(spark, folder).select(dates.age_at("birth", 2020).alias("edad"))
    return counted(filters.between(rows, "edad", 20, 23), "edad")


# ---- text ----------------------------------------------------------------------------------------


@query(
    """SELECT replace(p_name, ' ', '  ') AS raw, upper(replace(p_name, ' ', ' A ')) || '-' || p_type AS name, count(*) AS n
    FROM part GROUP BY ALL"""
)
def clean_names(spark, folder):
    quoted = F.concat(
        F.lit('  """'), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(' ""A""  '))), F.lit(" -"), F.col("p_type"), F.lit('"" ')
    )
    rows = table(spark, folder, "part").select(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")).alias("raw"), text.clean_name(quoted).alias("name")
    )
    return counted(rows, "raw", "name")


PLACE_SQL = "translate(lower(n_name), 'aeiotn', 'áéíótñ')"


def accented(c: str):
    return F.translate(F.lower(c), "aeiotn", "áéíótñ")


@query(
    f"""WITH p AS (SELECT {PLACE_SQL} AS place, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT strip_accents(upper(trim(place))) AS key, count(*) AS n FROM p GROUP BY ALL"""
)
def place_keys(spark, folder):
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return counted(rows.select(text.place_key(accented("n_name")).alias("key")), "key")


INSTITUTION_SQL = "p_brand || ' ' || p_name || CASE p_size % 3 WHEN 0 THEN '' ELSE ' - ' || lower(p_type) END"


def institutions(spark: SparkSession, folder: str) -> DataFrame:
    """Parts under institution-like names, some with a campus after a dash."""
    tail = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" - "), F.lower("p_type")))
    name = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), tail)
    return table(spark, folder, "part").withColumn("institution", name)


@query(
    f"""WITH i AS (SELECT p_partkey, {INSTITUTION_SQL} AS name FROM part)
    SELECT p_partkey, contains(lower(name), 'brand#1 ') AS named, CASE WHEN NOT contains(lower(name), 'brand#1 ') THEN ''
      WHEN contains(name, '-') THEN upper(trim(split_part(name, '-', -1))) ELSE 'SIN SEDE' END AS campus FROM i"""
)
def campuses(spark, folder):
    return institutions(spark, folder).select(
        "p_partkey",
        text.has_token("institution", "Brand#1 ").alias("named"),
        text.campus("institution", "Brand#1 ").alias("campus"),
    )


@query(
    f"""WITH i AS (SELECT {INSTITUTION_SQL} AS name FROM part)
    SELECT DISTINCT CASE WHEN contains(name, '-') THEN upper(trim(split_part(name, '-', -1))) ELSE 'SIN SEDE' END AS value
    FROM i WHERE contains(lower(name), 'brand#1 ')"""
)
def campus_options(spark, folder):
    return filters.campus_options(institutions(spark, folder), "institution", "Brand#1 ")


@query(
    """WITH e AS (SELECT CASE WHEN event_type = 'view' THEN ' Ninguno ' WHEN event_type = 'click' THEN 'NO SABE' ELSE ' ' || event_type END AS edu,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'Sin Estrato' ELSE event_type END AS stratum,
        CASE WHEN user_id % 2 = 0 THEN 'M' WHEN user_id % 3 = 0 THEN 'F' ELSE 'X' END AS sex FROM events)
    SELECT CASE WHEN lower(trim(edu)) IN ('ninguno', 'no sabe', 'no aplica') THEN 'No aplica' ELSE trim(edu) END AS edu,
      CASE WHEN stratum IS NULL OR lower(stratum) = 'sin estrato' THEN 'No reporta' ELSE stratum END AS stratum,
      CASE sex WHEN 'M' THEN 'Masculino' WHEN 'F' THEN 'Femenino' ELSE sex END AS sex, count(*) AS n FROM e GROUP BY ALL"""
)
def answer_labels(spark, folder):
    kind, user = F.col("event_type"), F.col("user_id")
    edu = F.when(kind == "view", F.lit(" Ninguno ")).when(kind == "click", F.lit("NO SABE")).otherwise(F.concat(F.lit(" "), kind))
    stratum = F.when(kind == "signup", F.lit("Sin Estrato")).when(kind != "error", kind)
    sex = F.when(user % 2 == 0, F.lit("M")).when(user % 3 == 0, F.lit("F")).otherwise(F.lit("X"))
    rows = table(spark, folder, "events").select(
        text.lump(edu, ["ninguno", "no sabe", "no aplica"], "No aplica").alias("edu"),
        text.null_label(stratum, "No reporta", ["sin estrato"]).alias("stratum"),
        text.relabel(sex, {"M": "Masculino", "F": "Femenino"}).alias("sex"),
    )
    return counted(rows, "edu", "stratum", "sex")


@query(
    """SELECT (l_linenumber % 4)::VARCHAR AS value, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 3 GROUP BY ALL
    UNION ALL SELECT 'NSE' , count(*) FROM lineitem WHERE l_linenumber % 4 = 3"""
)
def code_totals(spark, folder):
    code = F.col("l_linenumber") % 4
    raw = F.when(code == 3, F.lit("NSE")).otherwise(
        F.when(F.col("l_returnflag") == "A", code.cast("double").cast("string")).otherwise(code.cast("string"))
    )
    return frequency.code_totals(table(spark, folder, "lineitem").select(raw.alias("code")), "code")


COUNTRY_SQL = """country AS (SELECT CASE WHEN n_nationkey IN (1, 2) THEN NULL WHEN n_nationkey = 3 THEN ' nation_0 '
    WHEN n_nationkey = 4 THEN 'NATION_0 (X)' ELSE n_name END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def countries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("n_nationkey")
    country = (
        F.when(key == 3, F.lit(" nation_0 ")).when(key == 4, F.lit("NATION_0 (X)")).when(~key.isin(1, 2), F.col("n_name"))
    )
    return rows.select(country.alias("c"))


@query(
    f"""WITH {COUNTRY_SQL}, k AS (SELECT coalesce(upper(trim(c)), 'NATION_0') AS c FROM country)
    SELECT 'exact' AS rule, count(*) FILTER (c = 'NATION_0') AS domestic, count(*) FILTER (c <> 'NATION_0') AS "foreign" FROM k
    UNION ALL SELECT 'prefix', count(*) FILTER (starts_with(c, 'NATION_0')), count(*) FILTER (NOT starts_with(c, 'NATION_0')) FROM k"""
)
def domestic_split(spark, folder):
    rows = countries(spark, folder)
    exact = frequency.domestic_split(rows, "c", "NATION_0").select(F.lit("exact").alias("rule"), "domestic", "foreign")
    prefix = frequency.domestic_split(rows, "c", "NATION_0", prefix=True)
    return exact.unionByName(prefix.select(F.lit("prefix").alias("rule"), "domestic", "foreign"))


@query(
    f"""WITH {COUNTRY_SQL}, k AS (SELECT coalesce(upper(trim(c)), 'NATION_0') AS value FROM country),
    f AS (SELECT value, count(*) AS n FROM k WHERE value <> 'NATION_0' GROUP BY ALL ORDER BY n DESC, value LIMIT 8)
    SELECT 'NATION_0' AS value, count(*) AS n FROM k WHERE value = 'NATION_0' UNION ALL SELECT * FROM f"""
)
def domestic_and_foreign(spark, folder):
    return frequency.domestic_and_foreign(countries(spark, folder), "c", "NATION_0", 8)


@query(
    """SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'A' ELSE 'B' END AS value, count(*) AS n FROM part
    WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY ALL"""
)
def class_totals(spark, folder):
    rows = table(spark, folder, "part").select(F.concat(F.lit(" "), F.lower("p_type")).alias("origin"))
    return frequency.class_totals(rows, "origin", {"A": ("ECONOMY", "SMALL"), "B": ("LARGE",), "C": ("NONE",)})


@query(
    """SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 'low' WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN 'mid'
      WHEN c_acctbal >= 5000 AND c_acctbal < 9000 THEN 'high' END AS band, count(*) AS n FROM customer GROUP BY ALL"""
)
def bands(spark, folder):
    banded = classes.band("c_acctbal", (0.0, 2500.0, 5000.0, 9000.0), ("low", "mid", "high"))
    return counted(table(spark, folder, "customer").select(banded.alias("band")), "band")


# ---- filters and choices -------------------------------------------------------------------------


@query(
    f"""WITH i AS (SELECT *, {INSTITUTION_SQL} AS name FROM part)
    SELECT p_partkey, p_type FROM i WHERE p_size = 5 AND p_type = 'SMALL' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
    UNION ALL SELECT p_partkey, p_type FROM i WHERE contains(lower(name), 'widget') AND upper(trim(split_part(name, '-', -1))) = 'SMALL'
      AND p_size % 2 = 1 AND p_type IN ('SMALL', 'LARGE')"""
)
def filtered(spark, folder):
    rows = institutions(spark, folder).withColumn("odd", F.when(F.col("p_size") % 2 == 1, F.lit("Sí")))
    first = filters.apply_filters(
        rows,
        equals={"p_size": 5, "p_name": None, "absent": "x"},
        trimmed={"p_type": "SMALL", "p_brand": ""},
        isin={"p_brand": ["Brand#1", "Brand#2", "Brand#3"], "p_type": []},
    )
    second = filters.apply_filters(
        rows,
        token=("institution", "WIDGET"),
        campus_of=("institution", "widget", "SMALL"),
        flag="odd",
        truth=TRUTH,
        sets=("p_type", ("SMALL", "LARGE")),
    )
    return first.select("p_partkey", "p_type").unionByName(second.select("p_partkey", "p_type"))


@query(
    """SELECT 'one' AS slice, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_linestatus = 'O'
    UNION ALL SELECT 'all', count(*) FROM lineitem WHERE l_linenumber = 1"""
)
def prediction_slices(spark, folder):
    columns = ("l_linenumber", "method", "l_returnflag", "l_linestatus")
    rows = table(spark, folder, "lineitem")
    one = filters.prediction_slice(rows, 1, None, "A", "O", columns=columns)
    both = filters.prediction_slice(rows, 1, None, "todos", "__TODAS__", columns=columns)
    count = F.count(F.lit(1)).alias("n")
    return (
        one.agg(count)
        .select(F.lit("one").alias("slice"), "n")
        .unionByName(both.agg(count).select(F.lit("all").alias("slice"), "n"))
    )


@query(
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'O' GROUP BY ALL"""
)
def kept_levels(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status")
    )
    return counted(filters.keep_levels(rows, {"flag": ["A", "R"], "status": ["O"]}), "flag", "status")


@query("SELECT DISTINCT trim(p_name) AS value FROM part WHERE p_brand = 'Brand#1' AND trim(p_name) <> ''")
def options(spark, folder):
    rows = filters.apply_filters(table(spark, folder, "part"), isin={"p_brand": ["Brand#1"]})
    return filters.options(rows, "p_name")


@query(
    """WITH o AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size > 3)
    SELECT value, position FROM o JOIN (VALUES ('SMALL', 1), ('NONE', 2), ('LARGE', 3), ('ECONOMY', 4), ('STANDARD', 5)) v(t, position)
    ON value = t ORDER BY position LIMIT 3"""
)
def valid_choices(spark, folder):
    offered = filters.options(table(spark, folder, "part").filter("p_size > 3"), "p_type")
    return filters.valid_choices(["SMALL", "NONE", "LARGE", "ECONOMY", "STANDARD"], offered, 3)


@query("SELECT l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, value LIMIT 40")
def top_institutions(spark, folder):
    return frequency.frequency(table(spark, folder, "lineitem"), "l_suppkey", 40)


# ---- frequency -----------------------------------------------------------------------------------


@query(
    """SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL
    UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY ALL
    UNION ALL SELECT 'props', trim(props), count(*) FROM events WHERE trim(props) <> '' GROUP BY ALL"""
)
def frequency_profile(spark, folder):
    return frequency.frequency_many(table(spark, folder, "events"), ["event_type", "user_id", "props"])


@query(
    """WITH f AS (SELECT 'user_id' AS field, user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY ALL
      UNION ALL SELECT 'props', trim(props), count(*) FROM events WHERE trim(props) <> '' GROUP BY ALL)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 12"""
)
def frequency_top(spark, folder):
    return frequency.frequency_many(table(spark, folder, "events"), ["user_id", "props"], top=12)


@query(
    """WITH f AS (SELECT upper(trim(p_name)) AS value, count(*) AS n FROM part GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r FROM f),
    p AS (SELECT * FROM r WHERE contains(value, 'GREEN') ORDER BY r LIMIT 1)
    SELECT value, n, false AS pinned FROM r WHERE r <= 20 UNION ALL
    SELECT value, n, true FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r <= 20 AND contains(value, 'GREEN'))"""
)
def top_pinned(spark, folder):
    return frequency.top_pinned(table(spark, folder, "part"), "p_name", 20, "GREEN")


@query(
    """SELECT o_orderpriority AS value, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL
    ORDER BY avg(o_totalprice) DESC, value LIMIT 3"""
)
def top_mean(spark, folder):
    return rounded(frequency.top_mean(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", 3), "mean", digits=4)


@query(
    """SELECT 'p_brand' AS field, count(DISTINCT p_brand) AS n_distinct FROM part UNION ALL
    SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part"""
)
def distinct_counts(spark, folder):
    return frequency.distinct_counts(table(spark, folder, "part"), ["p_brand", "p_name", "p_retailprice"])


@query(
    """SELECT 'l_orderkey' AS field, count(DISTINCT l_orderkey) AS n_distinct, true AS close FROM lineitem
    UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), true FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), true FROM lineitem"""
)
def distinct_counts_approx(spark, folder):
    """The exact counts, and whether the sketches come within three standard deviations of them."""
    rows, columns = table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    sketched = frequency.distinct_counts_approx(rows, columns, 0.01).withColumnRenamed("n_distinct", "_about")
    both = frequency.distinct_counts(rows, columns).join(sketched, "field")
    close = F.abs(F.col("_about") - F.col("n_distinct")) <= F.col("n_distinct") * 0.03
    return both.select("field", "n_distinct", close.alias("close"))


@query(
    """WITH long AS (SELECT l_returnflag, l_linestatus, unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS field,
      unnest([l_orderkey, l_partkey, l_suppkey]) AS v FROM lineitem)
    SELECT field, l_returnflag, count(DISTINCT v) AS n_distinct, true AS close FROM long GROUP BY ALL
    UNION ALL SELECT field, 'open', count(DISTINCT v), true FROM long WHERE l_linestatus = 'O' GROUP BY ALL"""
)
def distinct_counts_sliced(spark, folder):
    """Exact counts per flag and of the open rows, and whether unions of kept sketches come within four standard deviations."""
    rows, columns = table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    sketches = frequency.distinct_sketches(rows, ["l_returnflag", "l_linestatus"], columns)
    flag, is_open = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    about = frequency.union_counts(sketches, ["l_returnflag"]).unionByName(
        frequency.union_counts(sketches.filter(is_open)).withColumn("l_returnflag", F.lit("open"))
    )
    exact = [
        frequency.distinct_counts(rows.filter(flag == f), columns).withColumn("l_returnflag", F.lit(f)) for f in ("A", "N", "R")
    ] + [frequency.distinct_counts(rows.filter(is_open), columns).withColumn("l_returnflag", F.lit("open"))]
    both = conform.union_by_name(exact).join(about.withColumnRenamed("n_distinct", "_about"), ["field", "l_returnflag"])
    close = F.abs(F.col("_about") - F.col("n_distinct")) <= F.greatest(F.col("n_distinct") * 0.065, F.lit(1.0))
    return both.select("field", "l_returnflag", "n_distinct", close.alias("close"))


@query(
    """SELECT 'l_quantity' AS score, round(min(l_quantity), 4) AS min, round(max(l_quantity), 4) AS max, round(avg(l_quantity), 4) AS mean FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round(min(l_extendedprice), 4), round(max(l_extendedprice), 4), round(avg(l_extendedprice), 4) FROM lineitem
    UNION ALL SELECT 'l_discount', round(min(l_discount) + 0.0, 4), round(max(l_discount), 4), round(avg(l_discount), 4) FROM lineitem"""
)
def score_stats(spark, folder):
    stats = frequency.score_stats(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(stats, "min", "max", "mean", digits=4)


@query(
    """SELECT 'Quantity' AS label, round(avg(l_quantity), 3) AS mean FROM lineitem
    UNION ALL SELECT 'Tax', round(avg(l_tax), 3) FROM lineitem"""
)
def mean_profile(spark, folder):
    return frequency.mean_profile(table(spark, folder, "lineitem"), {"l_quantity": "Quantity", "l_tax": "Tax"}, 3)


@query("SELECT year(o_orderdate)::INT AS year, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def group_mean(spark, folder):
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(frequency.group_mean(rows, "year", "o_totalprice"), "mean", digits=4)


# ---- cross-tables --------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'MACHINERY' AND c_nationkey::VARCHAR = '7' GROUP BY ALL),
    s AS (SELECT *, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS probability FROM c)
    SELECT *, row_number() OVER (ORDER BY probability DESC, value) = 1 AS most_likely FROM s"""
)
def conditional_share(spark, folder):
    rows = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    given = {"c_mktsegment": "MACHINERY", "nation": "7", "o_orderstatus": None}
    nation = rows.withColumn("nation", F.col("c_nationkey").cast("string"))
    return crosstab.conditional_share(nation, "o_orderpriority", given)


LEVELS = ["L1", "L2", "L3", "L4", "L5"]
LEVELS_SQL = """levels AS (SELECT 'L' || (1 + floor(l_quantity / 10))::INT AS a,
    'L' || (1 + floor(l_extendedprice / 20000))::INT AS b FROM lineitem)"""


@query(
    f"""WITH {LEVELS_SQL}, c AS (SELECT a, b, count(*) AS n FROM levels WHERE a <= 'L5' AND b <= 'L5' GROUP BY ALL),
    g AS (SELECT 'L' || i AS a, 'L' || j AS b FROM range(1, 6) t(i), range(1, 6) u(j)),
    s AS (SELECT a, b, n, n * 100.0 / sum(n) OVER (PARTITION BY a) AS pct FROM c)
    SELECT g.a AS from_level, g.b AS to_level, coalesce(n, 0) AS n, round(coalesce(pct, 0), 6)::DOUBLE AS pct
    FROM g LEFT JOIN s ON g.a = s.a AND g.b = s.b"""
)
def level_transition(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit(" L"), (1 + F.floor(F.col("l_quantity") / 10)).cast("string")).alias("a"),
        F.concat(F.lit("L"), (1 + F.floor(F.col("l_extendedprice") / 20000)).cast("string")).alias("b"),
    )
    return rounded(crosstab.transition(rows, "a", "b", LEVELS, LEVELS), "pct")


@query(
    """SELECT y AS year, s AS status, coalesce(n, 0) AS n FROM range(1994, 2003) t(y), (VALUES ('F'), ('O'), ('P')) v(s)
    LEFT JOIN (SELECT year(o_orderdate) AS oy, o_orderstatus AS os, count(*) AS n FROM orders GROUP BY ALL) ON y = oy AND s = os"""
)
def dense_grid(spark, folder):
    counts = counted(
        table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")),
        "year",
        "status",
    )
    cells = crosstab.dense(counts, {"year": list(range(1994, 2003)), "status": ["F", "O", "P"]}, {"n": 0})
    return cells.select(F.col("year").cast("bigint").alias("year"), "status", "n")


FLAGS = {"discount": "Discount", "tax": "Tax", "returned": "Returned", "open": "Open"}
FLAGS_SQL = """flags AS (SELECT l_linenumber, l_discount > 0.05 AS "Discount", l_tax > 0.04 AS "Tax",
    l_returnflag = 'R' AS "Returned", l_linestatus = 'O' AS "Open" FROM lineitem)"""


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Flags as text answers, read back as booleans."""
    rows = table(spark, folder, "lineitem")
    answers = {
        "discount": F.col("l_discount") > 0.05,
        "tax": F.col("l_tax") > 0.04,
        "returned": F.col("l_returnflag") == "R",
        "open": F.col("l_linestatus") == "O",
    }
    text_flags = {c: F.when(v, F.lit("Sí")).otherwise(F.lit("no")) for c, v in answers.items()}
    return rows.withColumns({c: numbers.to_flag(v, TRUTH) for c, v in text_flags.items()})


@query(
    f"""WITH {FLAGS_SQL} SELECT flag, n FROM (SELECT count(*) FILTER ("Discount") AS "Discount", count(*) FILTER ("Tax") AS "Tax",
      count(*) FILTER ("Returned") AS "Returned", count(*) FILTER ("Open") AS "Open" FROM flags) UNPIVOT (n FOR flag IN ("Discount", "Tax", "Returned", "Open"))"""
)
def flag_totals(spark, folder):
    return crosstab.flag_totals(flagged(spark, folder), FLAGS)


@query(
    f"""WITH {FLAGS_SQL}, l AS (SELECT rowid, flag, v FROM (SELECT row_number() OVER () AS rowid, "Discount", "Tax", "Returned", "Open" FROM flags)
        UNPIVOT (v FOR flag IN ("Discount", "Tax", "Returned", "Open")))
    SELECT a.flag AS flag_a, b.flag AS flag_b, count(*) AS n FROM l a JOIN l b ON a.rowid = b.rowid AND a.v AND b.v GROUP BY ALL"""
)
def flag_cooccurrence(spark, folder):
    return crosstab.flag_cooccurrence(flagged(spark, folder), FLAGS)


@query(
    f"""WITH {FLAGS_SQL} SELECT CASE WHEN l_linenumber = 7 THEN 'No reporta' ELSE l_linenumber::VARCHAR END AS stratum,
      count(*) FILTER ("Discount") AS "Discount", count(*) FILTER ("Tax") AS "Tax", count(*) FILTER ("Returned") AS "Returned",
      count(*) FILTER ("Open") AS "Open" FROM flags GROUP BY 1"""
)
def flag_by_group(spark, folder):
    rows = flagged(spark, folder).withColumn("stratum", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")))
    return crosstab.flag_by_group(rows, "stratum", FLAGS)


# ---- rankings ------------------------------------------------------------------------------------

SCORES = ["quantity", "price", "tax"]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Line items by nation of their supplier, as institution scores."""
    rows = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return rows.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("inst"),
        F.when(F.col("s_nationkey") != 5, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
    )


SCORED_SQL = """scored AS (SELECT 'N' || s_nationkey AS inst, CASE WHEN s_nationkey <> 5 THEN l_quantity END AS quantity,
    l_extendedprice AS price, l_tax AS tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    means AS (SELECT inst, avg(quantity) AS quantity, avg(price) AS price, avg(tax) AS tax FROM scored GROUP BY ALL)"""
SELECTED = ["N7", "N5", "N99", "N3", "N1", "N11"]
MATRIX_SQL = f"""{SCORED_SQL}, matrix AS (SELECT position::INT AS position, v.inst, quantity, price, tax
    FROM (VALUES ('N7', 1), ('N5', 2), ('N99', 3), ('N3', 4), ('N1', 5), ('N11', 6)) v(inst, position) LEFT JOIN means USING (inst))"""


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.compare_groups(scored(spark, folder), "inst", SELECTED, SCORES)


@query(
    f"""WITH {SCORED_SQL} SELECT row_number() OVER (ORDER BY quantity DESC, inst)::INT AS position, inst, round(quantity, 4) AS quantity
    FROM means WHERE quantity IS NOT NULL ORDER BY position LIMIT 10"""
)
def group_rank(spark, folder):
    means = ranking.group_means(scored(spark, folder), "inst", ["quantity", "price"])
    return ranking.ranking(means, "inst", "quantity", 10, 4)


@query(
    f"""WITH {SCORED_SQL} SELECT 'quantity' AS score, arg_max(inst, quantity) AS best, round(max(quantity), 4) AS value FROM means
    UNION ALL SELECT 'price', arg_max(inst, price), round(max(price), 4) FROM means"""
)
def group_best(spark, folder):
    means = ranking.group_means(scored(spark, folder), "inst", ["quantity", "price"])
    return rounded(ranking.best(means, "inst", ["quantity", "price"]), "value", digits=4)


@query(f"WITH {MATRIX_SQL} SELECT position, inst, round(quantity, 4) AS quantity, round(price, 4) AS price, round(tax, 6) AS tax FROM matrix")
def group_compare(spark, folder):
    return rounded(rounded(matrix(spark, folder), "quantity", "price", digits=4), "tax")


LONG_SQL = f"""{MATRIX_SQL}, long AS (SELECT position, inst, 'quantity' AS score, quantity AS value FROM matrix
    UNION ALL SELECT position, inst, 'price', price FROM matrix UNION ALL SELECT position, inst, 'tax', tax FROM matrix)"""


@query(
    f"""WITH {LONG_SQL} SELECT a.inst AS first, b.inst AS second, score, round(a.value, 4) AS first_value, round(b.value, 4) AS second_value
    FROM long a JOIN long b USING (score) WHERE a.position < b.position"""
)
def pair_compare(spark, folder):
    return rounded(
        ranking.pair_compare(matrix(spark, folder), "inst", SCORES), "first_value", "second_value", digits=4
    )


@query(
    f"""WITH {LONG_SQL}, r AS (SELECT inst, score, round(value, 2) AS value FROM long),
    e AS (SELECT *, max(value) OVER (PARTITION BY score) AS hi, min(value) OVER (PARTITION BY score) AS lo FROM r)
    SELECT inst, score, value, coalesce(value = hi, false) AS is_best, coalesce(value = lo AND lo <> hi, false) AS is_worst FROM e"""
)
def group_extremes(spark, folder):
    return ranking.mark_extremes(matrix(spark, folder), "inst", SCORES)


@query(f"WITH {MATRIX_SQL} SELECT round(min(price), 4) AS low, round(max(price), 4) AS high, round(max(price) - min(price), 4) AS spread FROM matrix")
def group_spread(spark, folder):
    return rounded(ranking.spread(matrix(spark, folder), "price"), "low", "high", "spread", digits=4)


@query(
    f"""WITH {LONG_SQL}, s AS (SELECT score, avg(value) AS m, arg_max(inst, value) AS b, max(value) AS hi, min(value) AS lo FROM long GROUP BY ALL)
    SELECT max(b) FILTER (score = 'price') AS best_key, round(max(hi) FILTER (score = 'price'), 4) AS best_value, arg_max(score, m) AS best_score,
      round(max(m), 4) AS best_score_mean, round(max(hi - lo) FILTER (score = 'price'), 4) AS spread FROM s"""
)
def comparison_facts(spark, folder):
    marked = ranking.mark_extremes(matrix(spark, folder), "inst", SCORES, None)
    return rounded(summary.comparison_facts(marked, "inst", "price"), "best_value", "best_score_mean", "spread", digits=4)


# ---- places --------------------------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT {PLACE_SQL} AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    d AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
    SELECT value, n, n_name, r_name FROM p JOIN d ON strip_accents(upper(trim(value))) = n_name"""
)
def geo_counts(spark, folder):
    nation = table(spark, folder, "nation")
    rows = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    dimension = nation.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter(
        "r_name <> 'ASIA'"
    )
    return geo.geo_counts(rows.select(accented("n_name").alias("place")), "place", dimension, "n_name", ["r_name"])


@query(
    """WITH p AS (SELECT CASE s_nationkey % 4 WHEN 0 THEN 'bogota' WHEN 1 THEN 'Medellín' WHEN 2 THEN 'CALI' ELSE 'Nowhere' END AS value, count(*) AS n
      FROM supplier GROUP BY ALL)
    SELECT value, n, name, lat, lon FROM p JOIN (VALUES ('bogota', 'BOGOTÁ', 4.711::DOUBLE, -74.0721::DOUBLE),
      ('Medellín', 'MEDELLÍN', 6.2442, -75.5812), ('CALI', 'CALI', 3.4516, -76.5319)) d(k, name, lat, lon) ON value = k"""
)
def geo_coordinates(spark, folder):
    from cohortia.plans.constants import TOWN_COORDINATES

    town = F.col("s_nationkey") % 4
    place = F.when(town == 0, F.lit("bogota")).when(town == 1, F.lit("Medellín")).when(town == 2, F.lit("CALI")).otherwise(F.lit("Nowhere"))
    rows = table(spark, folder, "supplier").select(place.alias("place"))
    return geo.geo_counts(rows, "place", geo.coordinates(spark, TOWN_COORDINATES), "name", ["lat", "lon"], top=60)


# ---- joins ---------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice AS global_pred FROM lineitem
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey"""
)
def attach(spark, folder):
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    extra = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    return link.attach(rows, extra, "l_orderkey", {"o_totalprice": "global_pred"})


# ---- summaries -----------------------------------------------------------------------------------

COUNTS_SQL = "counts AS (SELECT event_type AS item, count(*) AS n FROM events GROUP BY ALL)"


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.frequency(table(spark, folder, "events"), "event_type")


@query(
    f"""WITH {COUNTS_SQL} SELECT sum(n)::BIGINT AS total, round(avg(n), 4) AS mean, first(item ORDER BY n DESC, item) AS max_item, max(n) AS max_value,
      first(item ORDER BY n, item) AS min_item, min(n) AS min_value FROM counts"""
)
def series_summary(spark, folder):
    return rounded(summary.series_summary(event_counts(spark, folder), "value", "n"), "mean", digits=4)


@query(
    f"""WITH {COUNTS_SQL} SELECT sum(n)::BIGINT AS total, count(*) AS categories, first(item ORDER BY n DESC, item) AS max_item,
      round(max(n) * 100.0 / sum(n), 6)::DOUBLE AS max_share, first(item ORDER BY n, item) AS min_item,
      round(min(n) * 100.0 / sum(n), 6)::DOUBLE AS min_share FROM counts"""
)
def share_summary(spark, folder):
    return rounded(summary.share_summary(event_counts(spark, folder), "value", "n"), "max_share", "min_share")


CELLS_SQL = """cells AS (SELECT o_orderpriority AS r, year(o_orderdate)::VARCHAR AS c,
    round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 4) AS v FROM orders GROUP BY ALL)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    mean = orders.agg(F.avg("o_totalprice")).scalar()
    return orders.groupBy(F.col("o_orderpriority").alias("r"), F.year("o_orderdate").cast("string").alias("c")).agg(
        F.round(F.avg("o_totalprice") - mean, 4).alias("v")
    )


@query(
    f"""WITH {CELLS_SQL} SELECT first(r ORDER BY v DESC, r, c) AS max_row, first(c ORDER BY v DESC, r, c) AS max_col, max(v) AS max_value,
      first(r ORDER BY v, r, c) AS min_row, first(c ORDER BY v, r, c) AS min_col, min(v) AS min_value, min(v) < 0 AS is_signed FROM cells"""
)
def matrix_extrema(spark, folder):
    return summary.matrix_extrema(cells(spark, folder), "r", "c", "v")


@query(
    f"""WITH {CELLS_SQL}, s AS (SELECT r, avg(v) AS v FROM cells GROUP BY ALL)
    SELECT arg_max(r, v) AS max_series, round(max(v), 3) AS max_value, arg_min(r, v) AS min_series, round(min(v), 3) AS min_value,
      (max(v) - min(v)) / greatest(abs(max(v)), abs(min(v)), 1e-9) <= 0.02 AS similar FROM s"""
)
def compare_series(spark, folder):
    return rounded(summary.compare_series(cells(spark, folder), "r", "v", averaged=True), "max_value", "min_value", digits=3)


@query(
    """WITH k AS (SELECT 'desercion' AS section, 'kpi_total' AS item, 'Members' AS label, count(*)::VARCHAR AS value FROM orders
      UNION ALL SELECT 'desercion', 'kpi_trend', 'Years', count(DISTINCT year(o_orderdate))::VARCHAR FROM orders
      UNION ALL SELECT 'socio', 'kpi_total', 'Top', (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      UNION ALL SELECT 'socio', 'kpi_none', 'None', '—')
    SELECT *, 'kpi' AS kind, CASE WHEN section || '::' || item = 'desercion::kpi_trend' THEN 'estimator' ELSE 'indicator' END AS tag FROM k"""
)
def kpi_long(spark, folder):
    from cohortia.plans.constants import ESTIMATOR_KEYS

    orders = table(spark, folder, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct(F.year("o_orderdate")).alias("years")
    )
    top = frequency.frequency(table(spark, folder, "events"), "event_type", 1).withColumn("none", F.lit(None).cast("string"))
    return summary.kpi_long(
        [
            summary.indicators(orders, "desercion", {"kpi_total=total": "Members", "kpi_trend=years": "Years"}),
            summary.indicators(top, "socio", {"kpi_total=value": "Top", "kpi_none=none": "None"}),
        ],
        ESTIMATOR_KEYS,
    )
