"""Column contracts of the logical tables. Column names are fixed values of the exam files."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def contract(text: str = "", number: str = "") -> StructType:
    """A contract from blank-separated names: text columns first, then numbers."""
    fields = [StructField(n, StringType()) for n in text.split()]
    fields += [StructField(n, DoubleType()) for n in number.split()]
    return StructType(fields)


# ---- fixed values: column names ----------------------------------------------------------------
SCHOOL_EXAM = StructType(
    [
        StructField("estu_consecutivo", StringType()),
        StructField("fami_estratovivienda", StringType()),
        StructField("cole_naturaleza", StringType()),
        StructField("cole_area_ubicacion", StringType()),
        StructField("estu_depto_presentacion", StringType()),
    ]
)
UNLINKED_ATTRIBUTES = [
    "fami_estratovivienda",
    "cole_naturaleza",
    "cole_area_ubicacion",
    "estu_depto_presentacion",
]

SCHOOL_SCORES = StructType(
    [
        StructField("estu_consecutivo", StringType()),
        StructField("desemp_ingles", StringType()),
        StructField("punt_matematicas", DoubleType()),
        StructField("punt_matematicas_norm", DoubleType()),
        StructField("punt_lectura_critica", DoubleType()),
        StructField("punt_lectura_critica_norm", DoubleType()),
        StructField("punt_sociales_ciudadanas", DoubleType()),
        StructField("punt_sociales_ciudadanas_norm", DoubleType()),
        StructField("punt_ingles", DoubleType()),
        StructField("punt_ingles_norm", DoubleType()),
        StructField("punt_global", DoubleType()),
        StructField("punt_global_norm", DoubleType()),
        StructField("punt_global_calc_norm", DoubleType()),
    ]
)
# old column name -> current one
SCHOOL_SCORE_ALIASES = {
    "punt_lenguaje_norm": "punt_lectura_critica_norm",
    "punt_ciencias_sociales_norm": "punt_sociales_ciudadanas_norm",
}

LINK = StructType(
    [
        StructField("estu_consecutivo_sbpro", StringType()),
        StructField("estu_consecutivo_sb11", StringType()),
    ]
)

DEGREE_EXAM = StructType(
    [
        StructField("estu_consecutivo", StringType()),
        StructField("periodo", StringType()),
        StructField("gruporeferencia", StringType()),
    ]
)

DEGREE_SCORES = StructType(
    [
        StructField("periodo", StringType()),
        StructField("estu_genero", StringType()),
        StructField("estu_depto_reside", StringType()),
        StructField("estu_mcpio_reside", StringType()),
        StructField("fami_estratovivienda", StringType()),
        StructField("inst_nombre_institucion", StringType()),
        StructField("inst_origen", StringType()),
        StructField("gruporeferencia", StringType()),
        StructField("estu_pagomatriculabeca", StringType()),
        StructField("estu_pagomatriculacredito", StringType()),
        StructField("estu_pagomatriculapadres", StringType()),
        StructField("estu_pagomatriculapropio", StringType()),
        StructField("mod_razona_cuantitat_desem", StringType()),
        StructField("mod_lectura_critica_desem", StringType()),
        StructField("mod_competen_ciudada_desem", StringType()),
        StructField("mod_ingles_desem", StringType()),
        StructField("mod_comuni_escrita_desem", StringType()),
        StructField("mod_razona_cuantitat_punt", DoubleType()),
        StructField("mod_lectura_critica_punt", DoubleType()),
        StructField("mod_competen_ciudada_punt", DoubleType()),
        StructField("mod_ingles_punt", DoubleType()),
        StructField("mod_comuni_escrita_punt", DoubleType()),
        StructField("punt_global", DoubleType()),
    ]
)
MODULE_SCORES = [
    "mod_razona_cuantitat_punt",
    "mod_lectura_critica_punt",
    "mod_competen_ciudada_punt",
    "mod_ingles_punt",
    "mod_comuni_escrita_punt",
    "punt_global",
]
MODULE_LEVELS = [
    "mod_razona_cuantitat_desem",
    "mod_lectura_critica_desem",
    "mod_competen_ciudada_desem",
    "mod_ingles_desem",
    "mod_comuni_escrita_desem",
]

DEGREE_PAIRED = StructType(
    [
        StructField("estu_consecutivo", StringType()),
        StructField("periodo", StringType()),
        StructField("estu_genero", StringType()),
        StructField("fami_estratovivienda", StringType()),
        StructField("estu_depto_reside", StringType()),
        StructField("estu_mcpio_reside", StringType()),
        StructField("inst_nombre_institucion", StringType()),
        StructField("inst_origen", StringType()),
        StructField("gruporeferencia", StringType()),
        StructField("estu_pagomatriculabeca", StringType()),
        StructField("estu_pagomatriculacredito", StringType()),
        StructField("estu_pagomatriculapadres", StringType()),
        StructField("estu_pagomatriculapropio", StringType()),
        StructField("mod_ingles_desem", StringType()),
        StructField("mod_razona_cuantitat_punt", DoubleType()),
        StructField("mod_razona_cuantitat_punt_norm", DoubleType()),
        StructField("mod_lectura_critica_punt", DoubleType()),
        StructField("mod_lectura_critica_punt_norm", DoubleType()),
        StructField("mod_competen_ciudada_punt", DoubleType()),
        StructField("mod_competen_ciudada_punt_norm", DoubleType()),
        StructField("mod_ingles_punt", DoubleType()),
        StructField("mod_ingles_punt_norm", DoubleType()),
        StructField("punt_global", DoubleType()),
        StructField("punt_global_norm", DoubleType()),
        StructField("punt_global_calc_norm", DoubleType()),
    ]
)

DEGREE_SOCIO = StructType(
    [
        StructField("periodo", StringType()),
        StructField("estu_genero", StringType()),
        StructField("estu_fechanacimiento", StringType()),
        StructField("estu_nacionalidad", StringType()),
        StructField("estu_depto_reside", StringType()),
        StructField("estu_mcpio_reside", StringType()),
        StructField("estu_areareside", StringType()),
        StructField("estu_depto_presentacion", StringType()),
        StructField("estu_mcpio_presentacion", StringType()),
        StructField("estu_semestrecursa", StringType()),
        StructField("fami_educacionpadre", StringType()),
        StructField("fami_educacionmadre", StringType()),
        StructField("fami_ocupacionpadre", StringType()),
        StructField("fami_ocupacionmadre", StringType()),
        StructField("fami_estratovivienda", StringType()),
        StructField("fami_tieneinternet", StringType()),
        StructField("fami_tienecomputador", StringType()),
        StructField("estu_nse_individual", StringType()),
        StructField("inst_nombre_institucion", StringType()),
        StructField("inst_caracter_academico", StringType()),
        StructField("inst_origen", StringType()),
        StructField("estu_prgm_academico", StringType()),
        StructField("estu_nucleo_pregrado", StringType()),
        StructField("estu_nivel_prgm_academico", StringType()),
        StructField("estu_metodo_prgm", StringType()),
        StructField("estu_prgm_departamento", StringType()),
        StructField("gruporeferencia", StringType()),
        StructField("estu_pagomatriculabeca", StringType()),
        StructField("estu_pagomatriculacredito", StringType()),
        StructField("estu_pagomatriculapadres", StringType()),
        StructField("estu_pagomatriculapropio", StringType()),
        StructField("estu_horassemanatrabaja", DoubleType()),
        StructField("estu_inse_individual", DoubleType()),
    ]
)

DEGREE_NORM = StructType(
    [
        StructField("inst_nombre_institucion", StringType()),
        StructField("estu_prgm_academico", StringType()),
        StructField("gruporeferencia", StringType()),
        StructField("estu_prgm_departamento", StringType()),
        StructField("mod_razona_cuantitat_punt_norm", DoubleType()),
        StructField("mod_lectura_critica_punt_norm", DoubleType()),
        StructField("mod_competen_ciudada_punt_norm", DoubleType()),
        StructField("mod_ingles_punt_norm", DoubleType()),
        StructField("punt_global_norm", DoubleType()),
        StructField("punt_global_calc_norm", DoubleType()),
    ]
)

EDUCATION_STRATUM = StructType(
    [
        StructField("fami_educacionpadre", StringType()),
        StructField("fami_educacionmadre", StringType()),
        StructField("fami_estratovivienda", StringType()),
    ]
)
