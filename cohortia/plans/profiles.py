"""Ready-made result sets: each function takes prepared tables and returns named DataFrames.

A profile's table is put together when it is asked for and runs when it is used. Counts of many columns
share one scan and one aggregation, so a profile is a handful of jobs, not one per chart. ``table_of``
picks one column out of such a shared table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.functions import classes, dates, numbers, text
from cohortia.operators import (
    conform,
    crosstab,
    filters,
    frequency,
    geo,
    histogram,
    link,
    paired,
    prediction,
    ranking,
    summary,
    trend,
)
from cohortia.plans import constants as fixed
from cohortia.plans import schemas


class Profile(Mapping[str, DataFrame]):
    """Named result tables, each put together on first access."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = {name: cache(build) for name, build in builders.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def table_of(counts: DataFrame, field: str, order: str = "count", top: int | None = None) -> DataFrame:
    """One column's frequency table out of a shared (field, value, n) table, sorted."""
    one = frequency.ordered(counts.filter(F.col("field") == field).select("value", "n"), order)
    return one if top is None else one.limit(top)


Keep = Callable[[str, DataFrame], DataFrame]


def as_is(name: str, df: DataFrame) -> DataFrame:
    """The default for ``keep``: a table that other tables build on is used as it is, so each of them
    repeats its joins. A caller may write it and read it back instead, for example with
    ``lambda name, df: materialize(spark, f"{folder}/{name}", lambda: df)``."""
    return df


def _map_of(
    counts: DataFrame, field: str, places: DataFrame, name: str, columns: Sequence[str] = (), top: int | None = None
) -> DataFrame:
    return geo.match_places(table_of(counts, field, top=top), places, name, columns)


# ---- preparation of the yearly tables -----------------------------------------------------------


def consolidated_scores(tables: conform.Yearly) -> DataFrame:
    return conform.union_years(tables, schemas.DEGREE_SCORES)


def consolidated_norms(tables: conform.Yearly) -> DataFrame:
    """Normalized scores of all years with clean institution names."""
    united = conform.union_years(tables, schemas.DEGREE_NORM)
    return united.withColumn("inst_nombre_institucion", text.clean_name("inst_nombre_institucion"))


def consolidated_socio(tables: conform.Yearly) -> DataFrame:
    """Socio-economic table of all years: flags as booleans, age on 30 June of the exam year, clean
    institution names."""
    united = conform.union_years(tables, schemas.DEGREE_SOCIO)
    flags = [*fixed.PAYMENT_LABELS, "fami_tieneinternet", "fami_tienecomputador"]
    return united.withColumns(
        {
            **{c: numbers.to_flag(c, fixed.TRUTH_SHORT) for c in flags},
            "edad": dates.age_at(dates.parse_date("estu_fechanacimiento"), "anio"),
            "inst_nombre_institucion": text.clean_name("inst_nombre_institucion"),
        }
    )


def paired_scores(degree: conform.Yearly, links: DataFrame, school: conform.Yearly) -> DataFrame:
    """One row per linked pair of a degree exam and a school exam, with the degree exam's year."""
    later = conform.union_years(degree, schemas.DEGREE_PAIRED)
    earlier = conform.union_years(school, schemas.SCHOOL_SCORES, schemas.SCHOOL_SCORE_ALIASES).drop("anio")
    keys = conform.conform(links, schemas.LINK)
    return link.pair(
        later,
        keys,
        earlier,
        left_key="estu_consecutivo",
        right_key="estu_consecutivo",
        link_left="estu_consecutivo_sbpro",
        link_right="estu_consecutivo_sb11",
    )


def exam_filters(df: DataFrame, **picked) -> DataFrame:
    """The dashboard's filter set by name: anio, periodo, genero, estrato, depto, mcpio, prgm, grupo,
    token, sede, pago, origen. Unset ones are skipped."""
    names = {"anio": "anio", "periodo": "periodo", "genero": "estu_genero", "estrato": "fami_estratovivienda"}
    trimmed = {
        "depto": "estu_depto_reside",
        "mcpio": "estu_mcpio_reside",
        "prgm": "estu_prgm_academico",
        "grupo": "gruporeferencia",
    }
    institution = "inst_nombre_institucion"
    token, sede, origin = picked.get("token"), picked.get("sede"), picked.get("origen")
    return filters.apply_filters(
        df,
        equals={c: picked.get(n) for n, c in names.items()},
        trimmed={c: picked.get(n) for n, c in trimmed.items()},
        token=(institution, token) if token else None,
        campus_of=(institution, token, sede) if token and sede else None,
        flag=picked.get("pago"),
        truth=fixed.TRUTH_LONG,
        sets=("inst_origen", fixed.ORIGIN_TYPES.get(origin, ())) if origin else None,
    )


# ---- one exam's profile -------------------------------------------------------------------------


def _aged(df: DataFrame, age, ages: tuple[int, int]) -> DataFrame:
    rows = df.select(age.cast("int").alias("edad"))
    return filters.between(rows, "edad", *ages).groupBy("edad").agg(F.count(F.lit(1)).alias("n"))


def school_exam_profile(
    df: DataFrame,
    scores: Sequence[str],
    columns: Sequence[str],
    as_of: str | None = None,
    birth: str = "estu_fechanacimiento",
    nationality: str | None = "estu_nacionalidad",
    wanted_institution: str | None = None,
    pin: str = "",
    top: int = 20,
) -> Profile:
    """Profile of one school exam: answer counts, age, nationality, score range, wanted institutions. ``top``
    is how many countries and institutions the page lists."""
    tables = {
        "counts": lambda: frequency.frequency_many(df, columns),
        "age": lambda: _aged(df, dates.age_on(dates.parse_date(birth), as_of), fixed.SCHOOL_AGES),
        "scores": lambda: frequency.score_stats(df, scores, 1),
        "total": lambda: df.agg(F.count(F.lit(1)).alias("n")),
    }
    if nationality:
        tables["nationality"] = lambda: frequency.domestic_and_foreign(df, nationality, fixed.HOME_COUNTRY, top)
    if wanted_institution:
        tables["wanted_institution"] = lambda: frequency.top_pinned(df, wanted_institution, top, pin)
    return Profile(tables)


def degree_exam_profile(
    df: DataFrame,
    scores: Sequence[str],
    columns: Sequence[str],
    ref_year: int,
    birth: str | None = "estu_fechanacimiento",
    birth_year: str | None = None,
    nationality: str = "estu_nacionalidad",
    country_prefix: bool = False,
    institution: str = "inst_nombre_institucion",
    programme: str = "estu_prgm_academico",
    payments: Mapping[str, str] | None = None,
    top: int | None = 50,
    top_foreign: int = 25,
) -> Profile:
    """Profile of one degree exam: answer counts, age, nationality, top institutions and programmes
    (all with None), payment flags, score range."""
    if birth_year:
        age = dates.age_from_year(numbers.to_number(birth_year), ref_year)
    else:
        age = dates.age_at(dates.parse_date(birth), ref_year)
    tables = {
        "counts": lambda: frequency.frequency_many(df, columns),
        "age": lambda: _aged(df, age, fixed.DEGREE_AGES),
        "nationality": lambda: frequency.domestic_split(df, nationality, fixed.HOME_COUNTRY, country_prefix),
        "foreign": lambda: frequency.foreign_top(df, nationality, fixed.HOME_COUNTRY, top_foreign, country_prefix),
        "institutions": lambda: frequency.frequency(df, institution, top),
        "programmes": lambda: frequency.frequency(df, programme, top),
        "scores": lambda: frequency.score_stats(df, scores, 1),
        "total": lambda: df.agg(F.count(F.lit(1)).alias("n")),
    }
    if payments:
        flags = {c: numbers.to_flag(c, fixed.TRUTH_SHORT) for c in payments}
        tables["payments"] = lambda: crosstab.flag_totals(df.withColumns(flags), payments)
    return Profile(tables)


# ---- fixed values: columns counted in the socio-economic profile --------------------------------
SOCIO_COLUMNS = (
    "periodo",
    "estu_genero",
    "estu_depto_reside",
    "estu_mcpio_reside",
    "estu_depto_presentacion",
    "estu_mcpio_presentacion",
    "estu_areareside",
    "estu_semestrecursa",
    "fami_educacionpadre",
    "fami_educacionmadre",
    "fami_ocupacionpadre",
    "fami_ocupacionmadre",
    "fami_estratovivienda",
    "fami_tieneinternet",
    "fami_tienecomputador",
    "inst_caracter_academico",
    "inst_origen",
    "estu_nivel_prgm_academico",
    "estu_metodo_prgm",
    "gruporeferencia",
    "estu_prgm_departamento",
    "inst_nombre_institucion",
    "estu_prgm_academico",
    "estu_nucleo_pregrado",
)


def _socio_fields(df: DataFrame) -> DataFrame:
    """Every answer of the page as a text column: the counted columns, and derived ones whose names begin with an at sign."""
    country, flags = "estu_nacionalidad", list(fixed.PAYMENT_LABELS)
    home = text.is_domestic(country, fixed.HOME_COUNTRY)
    stratum = F.coalesce(F.col("fami_estratovivienda").cast("string"), F.lit(fixed.NOT_REPORTED))
    derived = {
        "@total": F.lit("rows"),
        "@home": F.when(home, F.lit("domestic")).otherwise(F.lit("foreign")),
        "@foreign": F.when(~home, F.upper(country)),
        "@age": F.when(F.col("edad").between(*fixed.DEGREE_AGES), F.col("edad").cast("int").cast("string")),
        "@level": text.code_text("estu_nse_individual"),
        "@origin": classes.classify_sets("inst_origen", fixed.ORIGIN_TYPES),
        # the index as it is, since the limits of its bins are its least and greatest value
        "@index": numbers.nan_to_null("estu_inse_individual").cast("string"),
        "@stratum": F.concat(F.lit("="), stratum, F.lit("=")),
    }
    for i, a in enumerate(flags):
        derived[f"@stratum_{i}"] = F.when(F.col(a), F.concat(F.lit("="), stratum, F.lit("=")))
        for j in range(i, len(flags)):
            derived[f"@flags_{i}_{j}"] = F.when(F.col(a) & F.col(flags[j]), F.lit("true"))
    return df.select(*SOCIO_COLUMNS, *[value.alias(name) for name, value in derived.items()])


def socioeconomic_profile(
    df: DataFrame,
    departments: DataFrame | None = None,
    department_name: str = "name",
    keep: Keep = as_is,
    tops: Mapping[str, int | None] | None = None,
    top_foreign: int = 25,
) -> Profile:
    """All tables of the socio-economic page for an already filtered consolidated table.

    One aggregation counts everything on the page: answers, ages, countries, levels, index bins, flags and their pairs are
    (field, value, n) rows of one table, which each table cuts its part from. So the rows are read once and dealt once, and with a
    ``keep`` that writes the counts nothing else is read. ``tops`` overrides how many rows a list shows, None for all. Maps show every
    place that is known. ``departments`` is the dimension of map names; the built-in coordinates serve when left out.
    """
    spark = df.sparkSession
    if departments is None:
        departments = geo.coordinates(spark, fixed.DEPARTMENT_COORDINATES)
    towns = geo.coordinates(spark, fixed.TOWN_COORDINATES)
    fields = _socio_fields(df)
    everything = keep("socio_counts", frequency.frequency_many(fields, fields.columns))
    counts = everything.filter(~F.col("field").startswith("@"))
    flags = list(fixed.PAYMENT_LABELS.values())

    def part(field: str) -> DataFrame:
        return everything.filter(F.col("field") == field).select("value", "n")

    def one_row(found: DataFrame, names: Mapping[str, str], column: str = "value") -> DataFrame:
        """One row with the counts of the named values, 0 where there is none."""
        return found.agg(*[F.coalesce(F.sum(F.when(F.col(column) == value, F.col("n"))), F.lit(0)).alias(name) for name, value in names.items()])

    def flag_pairs(diagonal: bool) -> DataFrame:
        pairs = {(i, j): f"@flags_{min(i, j)}_{max(i, j)}" for i in range(len(flags)) for j in range(len(flags)) if not diagonal or i == j}
        row = one_row(everything, {field: field for field in pairs.values()}, "field")
        if diagonal:
            cells = [F.struct(F.lit(flags[i]).alias("flag"), F.col(f"`{field}`").alias("n")) for (i, _), field in pairs.items()]
        else:
            cells = [
                F.struct(F.lit(flags[i]).alias("flag_a"), F.lit(flags[j]).alias("flag_b"), F.col(f"`{field}`").alias("n"))
                for (i, j), field in pairs.items()
            ]
        return row.select(F.inline(F.array(*cells)))

    def stratum_payment() -> DataFrame:
        found = everything.filter(F.col("field").startswith("@stratum"))
        name = F.expr("substring(value, 2, length(value) - 2)").alias("fami_estratovivienda")
        sums = [F.coalesce(F.sum(F.when(F.col("field") == f"@stratum_{i}", F.col("n"))), F.lit(0)).alias(label) for i, label in enumerate(flags)]
        return found.groupBy(name).agg(*sums)

    def index_bins() -> DataFrame:
        found = part("@index").select(F.col("value").cast("double").alias("value"), "n")
        return histogram.banded_histogram(found, "value", fixed.INDEX_BINS, fixed.INDEX_EDGES, fixed.INDEX_LABELS, fixed.INDEX_RANGE, "n")

    tables = {
        "counts": lambda: counts,
        "total": lambda: one_row(part("@total"), {"n": "rows"}),
        "sex": lambda: table_of(counts, "estu_genero").withColumn("label", text.relabel("value", fixed.SEX_LABELS)),
        "nationality": lambda: one_row(part("@home"), {"domestic": "domestic", "foreign": "foreign"}),
        "foreign": lambda: frequency.ordered(part("@foreign")).limit(top_foreign),
        "age": lambda: part("@age").select(F.col("value").cast("int").alias("edad"), "n"),
        "index": index_bins,
        "level": lambda: part("@level").withColumn("label", text.relabel("value", fixed.LEVEL_LABELS)),
        "origin_type": lambda: part("@origin"),
        "payments": lambda: flag_pairs(diagonal=True),
        "payment_pairs": lambda: flag_pairs(diagonal=False),
        "stratum_payment": stratum_payment,
    }
    for name, column, top in (
        ("top_department_home", "estu_depto_reside", 10),
        ("top_town_home", "estu_mcpio_reside", 10),
        ("top_department_exam", "estu_depto_presentacion", 10),
        ("top_town_exam", "estu_mcpio_presentacion", 10),
        ("occupation_father", "fami_ocupacionpadre", 20),
        ("occupation_mother", "fami_ocupacionmadre", 20),
        ("reference_group", "gruporeferencia", 20),
        ("institutions", "inst_nombre_institucion", 30),
        ("programmes", "estu_prgm_academico", 30),
        ("nucleus", "estu_nucleo_pregrado", 25),
    ):
        tables[name] = partial(table_of, counts, column, top=(tops or {}).get(name, top))
    for name, column in (
        ("map_department_home", "estu_depto_reside"),
        ("map_department_exam", "estu_depto_presentacion"),
        ("map_department_programme", "estu_prgm_departamento"),
    ):
        tables[name] = partial(_map_of, counts, column, departments, department_name)
    for name, column in (("map_town_home", "estu_mcpio_reside"), ("map_town_exam", "estu_mcpio_presentacion")):
        tables[name] = partial(_map_of, counts, column, towns, "name", ["lat", "lon"])
    return Profile(tables)


def score_profile(df: DataFrame, bins: int = 40) -> Profile:
    """Histograms of the six scores from one pass, counts of the five levels from another."""
    return Profile(
        {
            "total": lambda: df.agg(F.count(F.lit(1)).alias("n")),
            "histograms": lambda: histogram.histograms(df, {c: bins for c in schemas.MODULE_SCORES}),
            "levels": lambda: frequency.frequency_many(df, schemas.MODULE_LEVELS),
        }
    )


def paired_profile(df: DataFrame, keep: Keep = as_is) -> Profile:
    """Trend, difference, density and quintile tables of the six pairs, the English transition and
    the correlations of five, and of all six for the densities.

    ``deltas`` and ``delta_histograms`` hold all pairs, from one and two passes; the tables of a single pair are cut out
    of them. Every table reads the paired rows: at scale give a ``keep`` that writes them, so that they are joined once."""
    df = keep("paired_rows", df)
    pairs = {label: (y, x) for label, y, x in fixed.ALL_SCORE_PAIRS}
    differences = df.select(*[(F.col(y) - F.col(x)).alias(label) for label, (y, x) in pairs.items()])
    deltas = cache(lambda: paired.delta_summaries(df, pairs))
    delta_bins = cache(lambda: histogram.histograms(differences, {label: 50 for label in pairs}))
    tables = {
        "trend": lambda: paired.paired_trends(df, "anio", pairs),
        "english": lambda: crosstab.transition(
            df, "desemp_ingles_sb11", "mod_ingles_desem", fixed.ENGLISH_SCHOOL, fixed.ENGLISH_DEGREE
        ),
        "correlations": lambda: paired.correlations(df, {label: (y, x) for label, y, x in fixed.SCORE_PAIRS}, 3),
        "density_correlations": lambda: paired.correlations(df, pairs, 3),
        "deltas": deltas,
        "delta_histograms": delta_bins,
    }

    def of(table: Callable[[], DataFrame], field: str, label: str) -> DataFrame:
        return table().filter(F.col(field) == label).drop(field)

    for label, (y, x) in pairs.items():
        tables[f"density: {label}"] = partial(histogram.density2d, df, x, y, 50)
        tables[f"quintiles: {label}"] = partial(paired.quantile_transition, df, x, y, 5)
        tables[f"delta: {label}"] = partial(of, deltas, "label", label)
        tables[f"delta histogram: {label}"] = partial(of, delta_bins, "field", label)
    return Profile(tables)


def contribution_profile(df: DataFrame) -> Profile:
    """Contribution by year and competence and its indicators; the official global score is filled
    from the computed one on the school side."""
    pairs = {label: (y, x) for label, y, x in fixed.ALL_SCORE_PAIRS}
    official, computed = fixed.AGGREGATE_LABELS
    fallback = {official: fixed.COMPUTED_GLOBAL_PAIR[2]}
    long = paired.contribution(df, "anio", pairs, fallback)
    return Profile(
        {
            "long": lambda: long,
            "matrix": lambda: paired.contribution_matrix(df, "anio", pairs, fallback),
            "kpis": lambda: paired.contribution_kpis(long, "anio", fixed.AGGREGATE_LABELS, computed),
            "extremes": lambda: summary.matrix_extrema(long, "anio", "label", "value"),
        }
    )


def institution_comparison(df: DataFrame, selected: Sequence[str]) -> Profile:
    """Rankings and best institutions of the filtered rows, and the comparison of the selected ones."""
    key = "inst_nombre_institucion"
    means = ranking.group_means(df, key, ["punt_global_norm", "punt_global_calc_norm"])
    tables = {
        "ranking": lambda: ranking.ranking(means, key, "punt_global_norm"),
        "ranking_computed": lambda: ranking.ranking(means, key, "punt_global_calc_norm"),
        "best": lambda: ranking.best(means, key, ["punt_global_norm", "punt_global_calc_norm"]),
    }
    if len(selected) >= 2:
        matrix = ranking.compare_groups(df, key, selected, list(fixed.COMPETENCES))
        marked = ranking.mark_extremes(matrix, key, list(fixed.COMPETENCES))
        tables |= {
            "matrix": lambda: matrix,
            "pairs": lambda: ranking.pair_compare(matrix, key, fixed.COMPETENCES),
            "marked": lambda: marked,
            "spread": lambda: ranking.spread(matrix, "punt_global_norm"),
            "facts": lambda: summary.comparison_facts(marked, key, "punt_global_norm"),
        }
    return Profile(tables)


def cohort_continuation(
    school: conform.Yearly,
    links: DataFrame,
    degree: conform.Yearly,
    cohort: int | None = None,
    group: str | None = None,
    distinct: bool = True,
    keep: Keep = as_is,
) -> Profile:
    """Funnel, trend, unlinked detail and arrival timing of all cohorts, or of one cohort and group."""
    members = conform.union_years(school, schemas.SCHOOL_EXAM, year="anio_cohorte")
    events = conform.union_years(degree, schemas.DEGREE_EXAM)
    keys = conform.conform(links, schemas.LINK)
    funnel = keep(
        "cohort_funnel",
        link.cohort_funnel(members, keys, "anio_cohorte", "estu_consecutivo", "estu_consecutivo_sb11", distinct),
    )
    arrivals = link.arrival_counts(
        members,
        keys,
        events,
        cohort="anio_cohorte",
        key="estu_consecutivo",
        link_member="estu_consecutivo_sb11",
        link_event="estu_consecutivo_sbpro",
        event_key="estu_consecutivo",
        period="periodo",
        group="gruporeferencia",
        no_group=fixed.NO_GROUP,
    )
    arrivals = keep("cohort_arrival", arrivals)
    years = {k: y for k, _, y in fixed.GROUP_STANDARDS}
    picked_group = group if group in years else None
    standard_years = years.get(picked_group, fixed.GENERAL_STANDARD_YEARS)
    standard = round(standard_years * 2)
    picked = filters.apply_filters(arrivals, equals={"cohort": cohort, "group": picked_group})
    missing = link.unlinked(members, keys, "estu_consecutivo", "estu_consecutivo_sb11")
    missing = filters.apply_filters(missing, equals={"anio_cohorte": cohort})
    labelled = missing.select(
        text.null_label("fami_estratovivienda", fixed.NOT_REPORTED, fixed.NO_STRATUM).alias("fami_estratovivienda"),
        *[text.null_label(c, fixed.NOT_REPORTED).alias(c) for c in schemas.UNLINKED_ATTRIBUTES[1:]],
    )
    return Profile(
        {
            "funnel": lambda: funnel,
            "total": lambda: link.funnel_total(funnel),
            "trend": lambda: trend.linear_trend(funnel, "anio_cohorte", "unlinked_rate"),
            "linked_trend": lambda: trend.linear_trend(
                funnel.withColumn("linked_share", F.lit(100) - F.col("unlinked_rate")), "anio_cohorte", "linked_share"
            ),
            "trend_kpi": lambda: trend.trend_kpi(funnel, "anio_cohorte", "unlinked_rate"),
            "change": lambda: trend.year_change(funnel, "anio_cohorte", "unlinked_rate"),
            "shares": lambda: trend.stacked_share(funnel, "anio_cohorte", ["linked", "unlinked"]),
            "unlinked_counts": lambda: frequency.frequency_many(labelled, schemas.UNLINKED_ATTRIBUTES),
            "arrivals": lambda: arrivals,
            "timing": lambda: link.arrival_timing(picked, standard),
            "arrival_years": lambda: link.arrival_by_year(picked, None if cohort is None else standard_years),
            "arrival_deviations": lambda: link.arrival_by_deviation(picked, standard),
        }
    )


def cohort_continuation_csv(members: DataFrame, unlinked_rows: DataFrame, digits: int = 2) -> Profile:
    """Continuation of one cohort given as two files: everybody, and those that did not go on."""
    found = [conform.find_column(unlinked_rows, [c]) for c in schemas.UNLINKED_ATTRIBUTES]
    columns = [c for c in found if c]
    labelled = unlinked_rows.select(*[text.null_label(c, fixed.NOT_REPORTED).alias(c) for c in columns])
    return Profile(
        {
            "cohort": lambda: dates.cohort_year(members, "periodo"),
            "funnel": lambda: link.funnel_of_counts(members, unlinked_rows, digits),
            "unlinked_counts": lambda: frequency.frequency_many(labelled, columns),
        }
    )


def prediction_quality(
    df: DataFrame,
    module: str,
    level: str = "95%",
    metrics: DataFrame | None = None,
    sample_key: Sequence[str] = (),
    sample: int | None = None,
    sweep: DataFrame | None = None,
    forms: Sequence[str] = ("forma1", "forma2"),
    methods: Sequence[str] = (),
) -> Profile:
    """Quality of one module on an already filtered slice of predictions.

    ``points`` are all classified points; a page that draws fewer gives ``sample`` (fixed.SCATTER_POINTS).
    ``metrics`` (method, form, target, mae, mse, ...) adds the forms by MAE and MSE and, with
    ``methods``, their comparison per form. ``sweep`` adds the numbers of clusters with the chosen one.
    """
    found = prediction.module_columns(df, list(fixed.MODULES))
    real, pred = found[module]
    confidence = fixed.CONFIDENCE_LEVELS[level]
    points = prediction.classify_points(df, real, pred, confidence)
    errors = df.dropna(subset=[real, pred]).select((F.col(real) - F.col(pred)).alias("error"))
    tables = {
        "metrics": lambda: prediction.error_metrics(df, real, pred),
        "modules": lambda: prediction.error_metrics_by_module(df, found),
        "sigma": lambda: prediction.sigma_stats(df, real, pred),
        "residuals": lambda: histogram.histogram(errors, "error", 60),
        "distribution": lambda: histogram.histograms(df.dropna(subset=[real, pred]), {real: 40, pred: 40}),
        "ellipse": lambda: prediction.ellipse(df, real, pred, confidence),
        "classes": lambda: points.groupBy("point_class").agg(F.count(F.lit(1)).alias("n")),
        "points": lambda: prediction.sample_points(points, list(sample_key) or [real, pred], sample),
    }
    if metrics is not None:
        tables["forms"] = lambda: prediction.compare_metrics(metrics, "target", "form", forms)
        tables["forms_mse"] = lambda: prediction.compare_metrics(metrics, "target", "form", forms, "mse")
        if methods:
            tables["methods"] = lambda: prediction.compare_metrics(metrics, "target", "method", methods)
    if sweep is not None:
        tables["sweep"] = lambda: prediction.choose_k(sweep)
    return Profile(tables)


def stratum_probability(df: DataFrame, father: str | None = None, mother: str | None = None) -> Profile:
    """Distribution of the stratum given the parents' education, answers lumped."""
    rows = conform.conform(df, schemas.EDUCATION_STRATUM)
    lumped = rows.withColumns(
        {
            c: text.lump(c, fixed.NOT_APPLICABLE_ANSWERS, fixed.NOT_APPLICABLE)
            for c in ("fami_educacionpadre", "fami_educacionmadre")
        }
    )
    return Profile(
        {
            "father_options": lambda: filters.options(lumped, "fami_educacionpadre"),
            "mother_options": lambda: filters.options(lumped, "fami_educacionmadre"),
            "probability": lambda: crosstab.conditional_share(
                lumped, "fami_estratovivienda", {"fami_educacionpadre": father, "fami_educacionmadre": mother}
            ),
        }
    )


def executive_summary(
    norms: DataFrame,
    scores: DataFrame,
    socio: DataFrame,
    funnel: DataFrame,
    arrivals: DataFrame,
    predictions: DataFrame,
    unlinked_counts: DataFrame | None = None,
    metrics: DataFrame | None = None,
    top: int = 10,
    forms: Sequence[str] = ("forma1", "forma2"),
) -> Profile:
    """The landing page's tables and indicators, from the consolidated tables.

    ``unlinked_counts`` (field, value, n) of the continuation bundle adds the tables of those that did not
    go on; stored ``metrics`` (form, target, mae, mse, rmse, r2) add form 1 against form 2.
    """
    inst = "inst_nombre_institucion"
    modules = prediction.module_columns(predictions, list(fixed.MODULES))
    socio_counts = frequency.frequency_many(
        socio,
        [
            "estu_genero",
            "fami_estratovivienda",
            "fami_educacionmadre",
            "estu_nse_individual",
            inst,
            "estu_prgm_academico",
            "estu_nucleo_pregrado",
        ],
    )
    top_institutions = frequency.top_mean(norms, inst, "punt_global_norm", top)
    tables = {
        "top_institutions": lambda: top_institutions,
        "top_institutions_computed": lambda: frequency.top_mean(norms, inst, "punt_global_calc_norm", top),
        "top_departments": lambda: frequency.top_mean(norms, "estu_prgm_departamento", "punt_global_norm", top),
        "top_groups": lambda: frequency.top_mean(norms, "gruporeferencia", "punt_global_norm", top),
        "global_histograms": lambda: histogram.histograms(norms, {"punt_global_norm": 40, "punt_global_calc_norm": 40}),
        "competences": lambda: frequency.mean_profile(
            norms, {c: lab for c, lab in fixed.COMPETENCES.items() if c != "punt_global_calc_norm"}, 3
        ),
        "global_by_year": lambda: frequency.group_mean(norms, "anio", "punt_global_norm"),
        "score_histograms": lambda: histogram.histograms(scores, {c: 40 for c in schemas.MODULE_SCORES}),
        "score_by_year": lambda: frequency.group_mean(scores, "anio", "punt_global"),
        "english_levels": lambda: frequency.frequency(scores, "mod_ingles_desem"),
        "socio_counts": lambda: socio_counts,
        "age_histogram": lambda: histogram.histogram(socio, "edad", 35),
        "rates": lambda: funnel.select(
            "anio_cohorte", F.round("linked_rate", 1).alias("linked_rate"), F.round("unlinked_rate", 1).alias("unlinked_rate")
        ),
        "change": lambda: trend.year_change(
            funnel.withColumn("rate", F.lit(100) - F.round("linked_rate", 1)), "anio_cohorte", "rate", 1
        ),
        "timing": lambda: link.arrival_timing(arrivals, 10),
    }
    if unlinked_counts is not None:
        for column in schemas.UNLINKED_ATTRIBUTES:
            shown = top if column == "estu_depto_presentacion" else None
            tables[f"unlinked: {column}"] = partial(table_of, unlinked_counts, column, top=shown)
    if metrics is not None:
        for value in ("mae", "mse", "r2"):
            tables[f"forms: {value}"] = partial(prediction.compare_metrics, metrics, "target", "form", forms, value)
    test = predictions.filter(F.col("split") == "test")
    for module, (real, pred) in modules.items():
        tables[f"density: {module}"] = partial(histogram.density2d, test, real, pred, 45)
    distinct = frequency.distinct_counts(norms, [inst, "estu_prgm_academico"])
    wide = distinct.agg(
        F.max(F.when(F.col("field") == inst, F.col("n_distinct"))).alias("universidades"),
        F.max(F.when(F.col("field") == "estu_prgm_academico", F.col("n_distinct"))).alias("programas"),
    )
    total = link.funnel_total(funnel, 1)
    section = "resumen"
    tables["kpis"] = lambda: summary.kpi_long(
        [
            summary.indicators(
                socio.agg(F.count(F.lit(1)).alias("registros")), section, {"kpi_registros=registros": "Registros analizados"}
            ),
            summary.indicators(
                wide,
                section,
                {"kpi_universidades=universidades": "Universidades", "kpi_programas=programas": "Programas académicos"},
            ),
            summary.indicators(total, section, {"kpi_tasa=linked_rate": "Tasa de profesionalización"}),
            summary.indicators(
                top_institutions.limit(1), section, {"kpi_mejor=value": "Mejor universidad (Global)"}
            ),
        ],
        fixed.ESTIMATOR_KEYS,
    )
    return Profile(tables)


def residual_classes(errors: DataFrame) -> DataFrame:
    """Strength words of a one-row metrics table."""
    return errors.withColumn("fit", classes.fit_class("r2"))
