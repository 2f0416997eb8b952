"""Labels, sets, standards, bands, coordinates and column names of the exam data.

Everything in this file is a plain value that results depend on; there is no logic here.
"""

# ---- fixed values: truth texts ---------------------------------------------------------------
TRUTH_SHORT = ("true", "t", "1", "si", "s")
TRUTH_LONG = ("1", "1.0", "true", "t", "yes", "y", "si", "sí", "s")

# ---- fixed values: missing answers -----------------------------------------------------------
NOT_REPORTED = "No reporta"
NO_STRATUM = ("sin estrato",)
NOT_APPLICABLE = "No aplica"
NOT_APPLICABLE_ANSWERS = ("ninguno", "no sabe", "no aplica")
NO_GROUP = "(sin grupo)"
NO_CAMPUS = "SIN SEDE"
HOME_COUNTRY = "COLOMBIA"

# ---- fixed values: display labels ------------------------------------------------------------
SEX_LABELS = {"M": "Masculino", "F": "Femenino"}
BILINGUAL_LABELS = {"S": "Bilingüe", "N": "No bilingüe"}
AREA_LABELS = {"U": "Urbano", "R": "Rural"}
SCHOLARSHIP_LABELS = {"S": "Con beca Pilo Paga", "N": "Sin beca Pilo Paga"}
YES_NO_LABELS = {"true": "Sí", "false": "No"}
LEVEL_LABELS = {
    "1": "1 — Nivel socioeconómico bajo",
    "2": "2 — Nivel socioeconómico medio-bajo",
    "3": "3 — Nivel socioeconómico medio-alto",
    "4": "4 — Nivel socioeconómico alto",
}

# ---- fixed values: institution types by origin text -------------------------------------------
ORIGIN_TYPES = {
    "Pública": ("OFICIAL DEPARTAMENTAL", "OFICIAL MUNICIPAL", "OFICIAL NACIONAL"),
    "Privada": (
        "NO OFICIAL - FUNDACIÓN",
        "NO OFICIAL - CORPORACIÓN",
        "NO OFICIAL - FUNDACION",
        "NO OFICIAL - CORPORACION",
    ),
    "Régimen especial": ("REGIMEN ESPECIAL",),
}

# ---- fixed values: socio-economic index bands --------------------------------------------------
INDEX_EDGES = (0.0, 41.1, 51.2, 64.1, 100.1)
INDEX_LABELS = ("Bajo", "Medio-bajo", "Medio-alto", "Alto")
INDEX_RANGE = (0.0, 100.0)
INDEX_BINS = 40

# ---- fixed values: age ranges ------------------------------------------------------------------
DEGREE_AGES = (15, 60)
SCHOOL_AGES = (10, 30)

# ---- fixed values: standard duration of each reference group, in years -------------------------
GENERAL_STANDARD_YEARS = 5.0
GROUP_STANDARDS = (
    ("ADMINISTRACIÓN Y AFINES", "Administración y afines", 4.5),
    ("ARQUITECTURA Y URBANISMO", "Arquitectura y urbanismo", 5.0),
    ("BELLAS ARTES Y DISEÑO", "Bellas artes y diseño", 4.0),
    ("CIENCIAS AGROPECUARIAS", "Ciencias agropecuarias", 4.5),
    ("CIENCIAS MILITARES Y NAVALES", "Ciencias militares y navales", 4.0),
    ("CIENCIAS NATURALES Y EXACTAS", "Ciencias naturales y exactas", 4.5),
    ("CIENCIAS SOCIALES", "Ciencias sociales", 4.0),
    ("COMUNICACIÓN, PERIODISMO Y PUBLICIDAD", "Comunicación, periodismo y publicidad", 4.0),
    ("CONTADURÍA Y AFINES", "Contaduría y afines", 4.5),
    ("DERECHO", "Derecho", 5.0),
    ("ECONOMÍA", "Economía", 4.5),
    ("EDUCACIÓN", "Educación", 4.0),
    ("ENFERMERÍA", "Enfermería", 4.5),
    ("GRUPO REFERENCIA NACIONAL UNIVERSITARIO", "Grupo referencia nacional universitario", 4.0),
    ("HUMANIDADES", "Humanidades", 4.0),
    ("INGENIERÍA", "Ingeniería", 5.0),
    ("MEDICINA", "Medicina", 6.0),
    ("PSICOLOGÍA", "Psicología", 5.0),
    ("RECREACIÓN Y DEPORTES", "Recreación y deportes", 4.0),
    ("SALUD", "Salud", 4.5),
)

# ---- fixed values: English levels, in order ----------------------------------------------------
ENGLISH_SCHOOL = ("A-", "A1", "A2", "B1", "B+")
ENGLISH_DEGREE = ("-A1", "A1", "A2", "B1", "B2")

# ---- fixed values: payment flags ---------------------------------------------------------------
PAYMENT_LABELS = {
    "estu_pagomatriculabeca": "Beca",
    "estu_pagomatriculacredito": "Crédito",
    "estu_pagomatriculapadres": "Padres",
    "estu_pagomatriculapropio": "Recursos propios",
}

# ---- fixed values: score pairs (label, degree score, school score) ------------------------------
SCORE_PAIRS = (
    ("Competencia lógico-cuantitativa", "mod_razona_cuantitat_punt_norm", "punt_matematicas_norm_sb11"),
    ("Competencia lectora-comunicativa", "mod_lectura_critica_punt_norm", "punt_lectura_critica_norm_sb11"),
    ("Competencia ciudadana-cívica", "mod_competen_ciudada_punt_norm", "punt_sociales_ciudadanas_norm_sb11"),
    ("Competencia en Inglés", "mod_ingles_punt_norm", "punt_ingles_norm_sb11"),
    ("Puntaje Global", "punt_global_norm", "punt_global_norm_sb11"),
)
COMPUTED_GLOBAL_PAIR = ("Puntaje global calculado", "punt_global_calc_norm", "punt_global_calc_norm_sb11")
ALL_SCORE_PAIRS = SCORE_PAIRS + (COMPUTED_GLOBAL_PAIR,)
AGGREGATE_LABELS = ("Puntaje Global", "Puntaje global calculado")

# ---- fixed values: competences compared between institutions -----------------------------------
COMPETENCES = {
    "mod_razona_cuantitat_punt_norm": "Competencia lógico-cuantitativa",
    "mod_lectura_critica_punt_norm": "Competencia lectora-comunicativa",
    "mod_competen_ciudada_punt_norm": "Competencia ciudadana-cívica",
    "mod_ingles_punt_norm": "Competencia en Inglés",
    "punt_global_norm": "Puntaje Global",
    "punt_global_calc_norm": "Puntaje global calculado",
}

# ---- fixed values: prediction modules and their keys in the metrics files ----------------------
MODULES = {
    "razona_cuantitat": "Razonamiento Cuantitativo",
    "lectura_critica": "Lectura Crítica",
    "competen_ciudada": "Competencias Ciudadanas",
    "ingles": "Inglés",
    "global": "Puntaje Global",
}
CONFIDENCE_LEVELS = {"90%": 0.90, "95%": 0.95, "99%": 0.99}
SCATTER_POINTS = 6000
ALL_SPLITS = "todos"
ALL_INSTITUTIONS = "__TODAS__"
INSTITUTION_CHOICES = 400

# ---- fixed values: indicators that are estimates of a model or a statistic ---------------------
ESTIMATOR_KEYS = (
    "rna::kpi_mae",
    "rna::kpi_mse",
    "rna::kpi_rmse",
    "rna::kpi_r2",
    "rna::kpi_sesgo",
    "kmeans::kpi_mae",
    "kmeans::kpi_mse",
    "kmeans::kpi_rmse",
    "kmeans::kpi_r2",
    "kmeans::kpi_sesgo",
    "desercion::kpi_trend",
    "probestrato::kpi_best",
    "probestrato::kpi_prob",
)

# ---- fixed values: town coordinates (latitude, longitude) --------------------------------------
TOWN_COORDINATES = {
    "BOGOTÁ": (4.711, -74.0721),
    "BOGOTÁ D.C.": (4.711, -74.0721),
    "MEDELLÍN": (6.2442, -75.5812),
    "CALI": (3.4516, -76.5319),
    "BARRANQUILLA": (10.9685, -74.7813),
    "CARTAGENA": (10.3910, -75.4794),
    "BUCARAMANGA": (7.1193, -73.1227),
    "PEREIRA": (4.8133, -75.6961),
    "MANIZALES": (5.0703, -75.5138),
    "IBAGUÉ": (4.4389, -75.2322),
    "CÚCUTA": (7.8939, -72.5078),
    "VILLAVICENCIO": (4.1420, -73.6266),
    "PASTO": (1.2136, -77.2811),
    "ARMENIA": (4.5339, -75.6811),
    "NEIVA": (2.9273, -75.2820),
    "MONTERÍA": (8.7575, -75.8851),
    "SANTA MARTA": (11.2408, -74.1990),
    "POPAYÁN": (2.4448, -76.6147),
    "VALLEDUPAR": (10.4631, -73.2532),
    "SINCELEJO": (9.3047, -75.3978),
    "FLORENCIA": (1.6144, -75.6062),
    "TUNJA": (5.5353, -73.3678),
    "QUIBDÓ": (5.6919, -76.6583),
    "RIOHACHA": (11.5444, -72.9072),
    "YOPAL": (5.3378, -72.3956),
    "LETICIA": (-4.2153, -69.9406),
    "SAN ANDRÉS": (12.5847, -81.7006),
    "BELLO": (6.3367, -75.5570),
    "SOACHA": (4.5793, -74.2179),
    "ITAGÜÍ": (6.1845, -75.5990),
    "ENVIGADO": (6.1752, -75.5838),
    "SOLEDAD": (10.9162, -74.7671),
    "BUENAVENTURA": (3.8801, -77.0311),
    "PALMIRA": (3.5394, -76.3035),
    "FLORIDABLANCA": (7.0649, -73.0893),
    "GIRARDOT": (4.3033, -74.8027),
    "SOGAMOSO": (5.7193, -72.9267),
    "DUITAMA": (5.8279, -73.0267),
    "CHÍA": (4.8629, -74.0592),
    "ZIPAQUIRÁ": (5.0231, -74.0059),
    "FUSAGASUGÁ": (4.3433, -74.3648),
    "BUGA": (3.9008, -76.2986),
    "TULÚA": (4.0847, -76.2005),
    "SAHAGÚN": (8.9516, -75.4440),
    "MOCOA": (1.1519, -76.6478),
    "ARAUCA": (7.0847, -70.7591),
    "PUERTO CARREÑO": (6.1891, -67.4856),
    "INIRIDA": (3.8653, -67.9239),
    "SAN JOSÉ DEL GUAVIARE": (2.5709, -72.6417),
    "MITÚ": (1.2478, -70.2344),
}

# ---- fixed values: department coordinates (latitude, longitude) --------------------------------
DEPARTMENT_COORDINATES = {
    "AMAZONAS": (-1.0, -71.5),
    "ANTIOQUIA": (6.85, -75.7),
    "ARAUCA": (6.55, -71.0),
    "ATLÁNTICO": (10.7, -74.9),
    "BOGOTÁ": (4.65, -74.1),
    "BOGOTÁ D.C.": (4.65, -74.1),
    "BOLÍVAR": (8.7, -74.5),
    "BOYACÁ": (5.55, -72.95),
    "CALDAS": (5.3, -75.3),
    "CAQUETÁ": (0.85, -73.9),
    "CASANARE": (5.35, -71.7),
    "CAUCA": (2.45, -76.8),
    "CESAR": (9.3, -73.65),
    "CHOCÓ": (5.7, -76.65),
    "CÓRDOBA": (8.35, -75.85),
    "CUNDINAMARCA": (5.05, -74.1),
    "GUAINÍA": (2.55, -68.5),
    "GUAVIARE": (2.1, -72.5),
    "HUILA": (2.55, -75.55),
    "LA GUAJIRA": (11.45, -72.5),
    "MAGDALENA": (10.35, -74.25),
    "META": (3.45, -73.0),
    "NARIÑO": (1.55, -77.8),
    "NORTE DE SANTANDER": (7.9, -72.9),
    "PUTUMAYO": (0.4, -76.5),
    "QUINDÍO": (4.45, -75.7),
    "RISARALDA": (5.3, -75.95),
    "SAN ANDRÉS Y PROVIDENCIA": (12.55, -81.7),
    "SAN ANDRES": (12.55, -81.7),
    "SANTANDER": (6.65, -73.1),
    "SUCRE": (9.15, -75.1),
    "TOLIMA": (4.1, -75.2),
    "VALLE DEL CAUCA": (3.9, -76.45),
    "VALLE": (3.9, -76.45),
    "VAUPÉS": (0.85, -70.6),
    "VICHADA": (4.7, -69.5),
}
