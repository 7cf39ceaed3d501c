"""Vocabularies. All of them are small constants, shipped to executors as array literals."""

from __future__ import annotations

import zipfile
from functools import cache
from pathlib import Path

import pyspark

# --- Fixed values -----------------------------------------------------------

ROLE_WORDS = [
    "SECRETARI", "DIRECTOR", "GOBERNADOR", "GOBERNADORA", "TITULAR", "JEFE DE GOBIERNO", "JEFA DE GOBIERNO", "SUBSECRETARI",
    "COORDINADOR", "COORDINADORA", "COMISIONADO", "FISCAL", "PROCURADOR", "PRESIDENTE MUNICIPAL", "PRESIDENTA MUNICIPAL", "SENADOR",
    "DIPUTADO", "EMBAJADOR", "CÓNSUL", "RECTOR", "DIRECTORA", "BENEFICIARI", "REPRESENTANTE",
]
ROLE_STEMS = [
    "SECRETARI", "SUBSECRETARI", "DIRECTOR", "SUBDIRECTOR", "GOBERNADOR", "JEFE DE GOBIERNO", "JEFA DE GOBIERNO", "JEFE DE", "JEFA DE",
    "TITULAR", "FISCAL", "PROCURADOR", "COORDINADOR", "COMISIONAD", "COMISARI", "PRESIDENT", "VOCER", "CONSEJER", "OFICIAL MAYOR",
    "ENCARGAD", "BENEFICIARI", "REPRESENTANTE", "EMBAJADOR", "CONSUL", "SENADOR", "DIPUTAD", "RECTOR",
]
PARTICLES = ["DE", "DEL", "LA", "LAS", "LOS", "Y", "SAN"]
HONORIFICS = [
    "DOCTOR", "DOCTORA", "DR", "DRA", "LICENCIADO", "LICENCIADA", "LIC", "MAESTRO", "MAESTRA", "MTRO", "MTRA", "INGENIERO", "ING",
    "GENERAL", "ALMIRANTE", "CONTRALMIRANTE", "C",
]
#: In the order in which they are tried.
STATES = [
    "CIUDAD DE MEXICO", "ESTADO DE MEXICO", "BAJA CALIFORNIA SUR", "BAJA CALIFORNIA", "SAN LUIS POTOSI", "QUINTANA ROO", "NUEVO LEON",
    "AGUASCALIENTES", "CAMPECHE", "COAHUILA", "COLIMA", "CHIAPAS", "CHIHUAHUA", "DURANGO", "GUANAJUATO", "GUERRERO", "HIDALGO", "JALISCO",
    "MICHOACAN", "MORELOS", "NAYARIT", "OAXACA", "PUEBLA", "QUERETARO", "SINALOA", "SONORA", "TABASCO", "TAMAULIPAS", "TLAXCALA",
    "VERACRUZ", "YUCATAN", "ZACATECAS",
]
MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
MANUAL_STOPS = [
    "gracias", "buenas", "buenos", "días", "tardes", "noches", "adelante", "claro", "sí", "no", "pues", "también", "entonces", "así", "ver",
    "ir", "ser", "estar", "haber", "tener", "hacer", "decir", "poder", "deber", "querer", "venir", "dar", "pasar", "llegar", "seguir",
    "méxico", "país", "año", "años", "día", "mes", "presidenta", "presidente", "gobierno", "federal", "continúa", "inicia", "finaliza",
    "proyección", "video", "enlace", "videollamada", "inaudible", "intervención",
]
PROTOCOL_STOPS = [
    "gracias", "buenos", "buenas", "días", "tardes", "noches", "muchas", "bueno", "entonces", "ahorita", "ahora", "the", "and", "of", "for",
    "señora", "señor", "parte", "caso", "tema", "temas", "manera", "vamos", "aquí", "acá", "allá", "siempre", "cosa", "cosas", "todas",
    "todos", "mismo", "misma", "méxico", "país", "gobierno", "federal", "nacional", "general", "presidenta", "presidente", "pregunta",
    "secretario", "secretaria", "subsecretario", "subsecretaria", "director", "directora", "gobernador", "gobernadora", "titular",
    "coordinador", "coordinadora", "fiscal", "procurador", "beneficiario", "beneficiaria", "representante", "doctor", "doctora",
    "licenciado", "jefe", "jefa", "enlace", "videollamada", "video", "videos", "proyección", "intervención", "inaudible", "continúa", "voz",
    "hombre", "mujer", "audio",
]
DIGEST_NAME_STOPS = ["sheinbaum", "claudia", "pardo"]
FRAMES = {
    "nosotros": ["nosotros", "nuestro", "nuestra", "nuestros", "nuestras", "pueblo", "juntos", "juntas", "colectivo", "comunidad"],
    "adversario": [
        "ellos", "oposición", "adversario", "adversaria", "manipulación", "desinformación", "fake", "calumnia", "mentira", "ataque",
    ],
    "crisis": [
        "crisis", "problema", "riesgo", "emergencia", "conflicto", "desafío", "dificultad", "amenaza", "peligro", "preocupación",
    ],
    "logro": ["avance", "logro", "resultado", "oportunidad", "beneficio", "éxito", "progreso", "meta", "objetivo", "alcanzar"],
    "ciencia": [
        "datos", "evidencia", "científico", "científica", "estudio", "análisis", "investigación", "indicador", "medición", "cifra",
    ],
}

# ----------------------------------------------------------------------------


@cache
def functional_stops() -> tuple[str, ...]:
    """The functional Spanish stop words: the list in Spark's own ML jar with its two misspelt entries set right."""
    jar = next((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar"), None)
    if jar is not None:
        with zipfile.ZipFile(jar) as z:
            words = z.read("org/apache/spark/ml/feature/stopwords/spanish.txt").decode("utf-8").split()
    else:  # Spark lies elsewhere; ask it, which needs a session
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords("spanish")
    mended = {"vosostras": "vosotras", "vosostros": "vosotros"}
    return tuple(sorted({mended.get(w, w) for w in words}))


def lexical_stops() -> list[str]:
    """Stop words of term frequencies, TF-IDF and topics."""
    return sorted({*functional_stops(), *MANUAL_STOPS})


def digest_stops(more: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Stop words of the digest, and what a day's names add."""
    return sorted({*functional_stops(), *PROTOCOL_STOPS, *DIGEST_NAME_STOPS, *more})
