"""Lemmas and parts of speech of Spanish words: a lexicon, endings, and the cheapest path of tags through a sentence.

A word of the lexicon has the analyses listed there; of any other word the
longest ending of each tag gives one. Costs are whole numbers. The path of tags
with the least sum of the words' costs and the costs of neighbouring tags is
found for all sentences of a batch at once, one place in the sentence after the
other; distinct words are analysed once a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlens.functions.lemmas import IRREGULAR, REGULAR, table

#: In the order in which ties are broken.
TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "DET", "ADP", "PRON", "CONJ", "AUX")
CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
LEAST_STEM = 2
NEVER = 1 << 20
#: What the other readings of a capitalised word within a sentence cost more.
CAPITAL = 6
WORD = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"
SENTENCE_ENDS = r"[.?!…;:\n]+"

# --- Fixed values -----------------------------------------------------------

#: (tag, cost, forms); a form may stand under several tags, and is its own lemma unless given after a slash.
CLOSED = [
    ("DET", 0, "el/el la/el los/el las/el un/uno una/uno unos/uno unas/uno este/este esta/este estos/este estas/este ese/ese esa/ese esos/ese esas/ese aquel/aquel aquella/aquel mi/mi mis/mi tu/tu su/su sus/su nuestro/nuestro nuestra/nuestro nuestros/nuestro nuestras/nuestro cada todo/todo toda/todo todos/todo todas/todo otro/otro otra/otro otros/otro otras/otro mucho/mucho mucha/mucho muchos/mucho muchas/mucho poco/poco poca/poco algún/alguno alguna/alguno algunos/alguno algunas/alguno ningún/ninguno ninguna/ninguno varios/varios dos tres cuatro cinco seis siete ocho nueve diez cien mil"),
    ("ADP", 0, "a al ante bajo con contra de del desde durante en entre hacia hasta mediante para por según sin sobre tras"),
    ("PRON", 0, "yo tú él/él ella/él ellos/él ellas/él nosotros nosotras usted ustedes me te se nos le les qué quién quiénes cuál cuáles quien quienes alguien nadie algo nada esto eso aquello"),
    ("PRON", 2, "la/él los/él las/él lo/él que este/este esta/este ese/ese esa/ese todo/todo todos/todo otro/otro otra/otro uno/uno mucho/mucho"),
    ("DET", 2, "lo/el"),
    ("CONJ", 0, "y e o u ni pero sino que aunque si porque como cuando mientras pues donde"),
    ("ADV", 0, "no sí ya muy más menos también tampoco hoy ayer mañana ahora aquí ahí allí allá siempre nunca después antes luego entonces así bien mal casi sólo solo todavía aún además cerca lejos tan tanto apenas pronto tarde temprano quizá incluso cómo cuándo dónde"),
    ("ADV", 3, "mucho/mucho poco/poco"),
    ("NOUN", 1, "lunes martes miércoles jueves viernes crisis tesis dosis virus análisis énfasis gas/gas mes/mes meses/mes país/país países/país vez/vez veces/vez voz/voz voces/voz luz/luz luces/luz paz/paz ley/ley leyes/ley mañana tarde/tarde tardes/tarde día/día días/día interés/interés intereses/interés autobús/autobús joven/joven jóvenes/joven agua/agua aguas/agua mano/mano manos/mano problema/problema problemas/problema sistema/sistema sistemas/sistema programa/programa programas/programa tema/tema temas/tema clima/clima idioma/idioma casa/casa casas/casa mujer/mujer mujeres/mujer hombre/hombre hombres/hombre parte/parte partes/parte gente/gente trabajo/trabajo trabajos/trabajo apoyo/apoyo apoyos/apoyo cambio/cambio cambios/cambio ayuda/ayuda ayudas/ayuda pregunta/pregunta preguntas/pregunta pago/pago pagos/pago uso/uso usos/uso informe/informe informes/informe bienestar salud derecho/derecho derechos/derecho hecho/hecho hechos/hecho estado/estado estados/estado sobre/sobre este/este nada/nada lugar/lugar mar/mar hogar/hogar mujer/mujer taller/taller poder/poder deber/deber"),
    ("ADJ", 1, "grande/grande grandes/grande gran/grande bueno/bueno buena/bueno buenos/bueno buenas/bueno buen/bueno malo/malo mala/malo nuevo/nuevo nueva/nuevo nuevos/nuevo nuevas/nuevo mejor/mejor mejores/mejor mayor/mayor mayores/mayor menor/menor primero/primero primera/primero primer/primero segundo/segundo segunda/segundo tercer/tercero mismo/mismo misma/mismo mismos/mismo mismas/mismo libre/libre libres/libre pobre/pobre pobres/pobre importante/importante importantes/importante bajo/bajo baja/bajo alto/alto alta/alto joven/joven jóvenes/joven indígena/indígena indígenas/indígena público/público pública/público públicos/público públicas/público"),
    ("VERB", 2, "para/parar como/comer baja/bajar sobre/sobrar hecho/hacer derecho/derechar"),
    ("VERB", 0, "sé/saber sabe/saber sabemos/saber saben/saber quiero/querer quiere/querer quieren/querer viene/venir vienen/venir da/dar dan/dar damos/dar"),
    ("VERB", 3, "este/estar"),
]
AUXILIARY = ("ser", "estar", "haber")
#: (ending, what the lemma ends in instead, tag, cost)
ENDINGS = [
    ("", "", "NOUN", 4), ("", "", "ADJ", 7), ("s", "", "NOUN", 4), ("es", "e", "NOUN", 4), ("res", "r", "NOUN", 3), ("les", "l", "NOUN", 3), ("nes", "n", "NOUN", 3), ("des", "d", "NOUN", 3),
    ("ces", "z", "NOUN", 4), ("ción", "ción", "NOUN", 0), ("ciones", "ción", "NOUN", 0), ("sión", "sión", "NOUN", 0), ("siones", "sión", "NOUN", 0), ("iones", "ión", "NOUN", 1),
    ("dad", "dad", "NOUN", 0), ("dades", "dad", "NOUN", 0), ("tud", "tud", "NOUN", 1), ("tudes", "tud", "NOUN", 1), ("miento", "miento", "NOUN", 0), ("mientos", "miento", "NOUN", 0),
    ("ismo", "ismo", "NOUN", 0), ("ista", "ista", "NOUN", 1), ("istas", "ista", "NOUN", 1), ("aje", "aje", "NOUN", 2), ("ajes", "aje", "NOUN", 2), ("eza", "eza", "NOUN", 1), ("encia", "encia", "NOUN", 0),
    ("encias", "encia", "NOUN", 0), ("ancia", "ancia", "NOUN", 0), ("ancias", "ancia", "NOUN", 0), ("dor", "dor", "NOUN", 1), ("dores", "dor", "NOUN", 1), ("dora", "dora", "NOUN", 2), ("ura", "ura", "NOUN", 2),
    ("o", "o", "ADJ", 5), ("as", "o", "ADJ", 7), ("a", "o", "ADJ", 7), ("os", "o", "ADJ", 7), ("es", "e", "ADJ", 7), ("al", "al", "ADJ", 2), ("ales", "al", "ADJ", 2), ("oso", "oso", "ADJ", 1), ("osa", "oso", "ADJ", 1), ("osos", "oso", "ADJ", 1),
    ("osas", "oso", "ADJ", 1), ("ivo", "ivo", "ADJ", 1), ("iva", "ivo", "ADJ", 1), ("ivos", "ivo", "ADJ", 1), ("ivas", "ivo", "ADJ", 1), ("able", "able", "ADJ", 1), ("ables", "able", "ADJ", 1), ("ible", "ible", "ADJ", 1),
    ("ibles", "ible", "ADJ", 1), ("ico", "ico", "ADJ", 2), ("ica", "ico", "ADJ", 2), ("icos", "ico", "ADJ", 2), ("icas", "ico", "ADJ", 2), ("ario", "ario", "ADJ", 3), ("aria", "ario", "ADJ", 3), ("ante", "ante", "ADJ", 3),
    ("ente", "ente", "ADJ", 3), ("ado", "ado", "ADJ", 4), ("ada", "ado", "ADJ", 4), ("ados", "ado", "ADJ", 4), ("adas", "ado", "ADJ", 4), ("ido", "ido", "ADJ", 4), ("ida", "ido", "ADJ", 4), ("idos", "ido", "ADJ", 4), ("idas", "ido", "ADJ", 4),
    ("mente", "mente", "ADV", 0),
    ("ar", "ar", "VERB", 1), ("er", "er", "VERB", 2), ("ir", "ir", "VERB", 2), ("ando", "ar", "VERB", 1), ("iendo", "er", "VERB", 1), ("ado", "ar", "VERB", 2), ("ido", "ir", "VERB", 3), ("aba", "ar", "VERB", 1), ("aban", "ar", "VERB", 1),
    ("ábamos", "ar", "VERB", 0), ("aron", "ar", "VERB", 1), ("ieron", "er", "VERB", 1), ("amos", "ar", "VERB", 2), ("emos", "er", "VERB", 2), ("imos", "ir", "VERB", 2), ("ará", "ar", "VERB", 1), ("arán", "ar", "VERB", 1), ("aré", "ar", "VERB", 1),
    ("aremos", "ar", "VERB", 0), ("erá", "er", "VERB", 1), ("erán", "er", "VERB", 1), ("irá", "ir", "VERB", 1), ("irán", "ir", "VERB", 1), ("aría", "ar", "VERB", 1), ("ería", "er", "VERB", 3), ("ía", "er", "VERB", 5), ("ían", "er", "VERB", 2),
    ("ó", "ar", "VERB", 2), ("ió", "er", "VERB", 2), ("é", "ar", "VERB", 4), ("an", "ar", "VERB", 4), ("en", "er", "VERB", 5), ("a", "ar", "VERB", 8), ("e", "er", "VERB", 8), ("o", "ar", "VERB", 9),
    ("arse", "ar", "VERB", 0), ("erse", "er", "VERB", 0), ("irse", "ir", "VERB", 0), ("arlo", "ar", "VERB", 1), ("arla", "ar", "VERB", 2), ("arlos", "ar", "VERB", 1),
]
#: Costs of a tag behind a tag, the start of a sentence first; one row for each tag before, in the order of TAGS.
START = (3, 3, 4, 2, 3, 0, 1, 2, 2, 3)
AFTER = (
    (6, 3, 1, 3, 4, 5, 0, 3, 1, 2),  # NOUN
    (3, 5, 3, 2, 4, 0, 0, 3, 1, 6),  # VERB
    (3, 4, 4, 4, 5, 5, 1, 4, 1, 3),  # ADJ
    (4, 1, 2, 3, 5, 2, 1, 2, 2, 2),  # ADV
    (5, 2, 4, 3, 1, 5, 1, 3, 1, 2),  # PROPN
    (0, 9, 2, 6, 2, 3, 6, 5, 8, 9),  # DET
    (1, 3, 4, 5, 2, 0, 6, 2, 4, 7),  # ADP
    (5, 0, 5, 3, 6, 4, 4, 2, 3, 1),  # PRON
    (3, 2, 4, 2, 4, 1, 2, 1, 5, 2),  # CONJ
    (3, 2, 1, 2, 5, 1, 2, 5, 4, 3),  # AUX
)
#: Costs of a tag at the end of a sentence.
END = (0, 0, 0, 0, 0, 6, 6, 1, 6, 3)

# ----------------------------------------------------------------------------


@cache
def lexicon() -> dict[str, dict[str, tuple[str, int]]]:
    """Word to tag to (lemma, cost): closed classes, common words, and the forms of known verbs; the first entry of a tag counts."""
    out: dict[str, dict[str, tuple[str, int]]] = {}
    for tag, cost, forms in CLOSED:
        for form in forms.split():
            word, _, lemma = form.partition("/")
            out.setdefault(word, {}).setdefault(tag, (lemma or word, cost))
    closed = set(out)
    for word, lemma in table(REGULAR, IRREGULAR).items():
        tag = "AUX" if lemma in AUXILIARY else "VERB"
        # a form that is also a common word of another class is the rarer reading
        out.setdefault(word, {}).setdefault(tag, (lemma, 4 if word in closed else 0))
    return out


@cache
def endings() -> dict[str, dict[str, tuple[str, int]]]:
    """Ending to tag to (what the lemma ends in, cost)."""
    out: dict[str, dict[str, tuple[str, int]]] = {}
    for ending, lemma, tag, cost in ENDINGS:
        out.setdefault(ending, {}).setdefault(tag, (lemma, cost))
    return out


def analyse(word: str) -> dict[str, tuple[str, int]]:
    """Tag to (lemma, cost) of a word in lower case: the lexicon's, else those of the longest ending of each tag behind a stem of two letters."""
    listed = lexicon().get(word)
    if listed:
        return listed
    found: dict[str, tuple[str, int]] = {}
    for size in range(max(len(word) - LEAST_STEM, 0), -1, -1):
        for tag, (end, cost) in endings().get(word[len(word) - size :], {}).items():
            found.setdefault(tag, (word[: len(word) - size] + end, cost))
    return found


def cheapest(costs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The tags of all words: the path of least cost through each sentence, the first tag in order where costs are equal.

    ``costs`` has a row for each word and a column for each tag, ``bounds`` says
    where sentences begin and end.
    """
    after, size = np.array(AFTER), np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    back = np.zeros(costs.shape, np.int8)
    state = np.zeros((len(order), len(TAGS)), np.int64)
    for at in range(int(size.max()) if len(size) else 0):
        live = int(np.searchsorted(-size, -at, side="left"))
        word = start[:live] + at
        if at == 0:
            state[:live] = np.array(START) + costs[word]
        else:
            step = state[:live, :, None] + after
            back[word] = step.argmin(1)
            state[:live] = step.min(1) + costs[word]
    out = np.zeros(len(costs), np.int64)
    tag = (state + np.array(END)).argmin(1)
    for at in range(int(size.max()) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -at, side="left"))
        word = start[:live] + at
        out[word] = tag[:live]
        tag[:live] = back[word, tag[:live]]
    return out


def tagged(words: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lemma and the place of the tag in TAGS of each word; ``bounds`` says where sentences begin and end."""
    coded = pc.utf8_lower(words).dictionary_encode()
    found = [analyse(w) for w in coded.dictionary.to_pylist()]
    table = np.full((len(found), len(TAGS)), NEVER, np.int64)
    lemmas = [None] * (len(found) * len(TAGS))
    for i, analyses in enumerate(found):
        for tag, (lemma, cost) in analyses.items():
            k = TAGS.index(tag)
            table[i, k], lemmas[i * len(TAGS) + k] = cost, lemma
    place = coded.indices.to_numpy()
    costs = table[place]
    name = np.ones(len(words), bool)
    name[bounds[:-1][bounds[:-1] < len(words)]] = False
    name &= pc.utf8_is_upper(pc.utf8_slice_codeunits(words, 0, 1)).to_numpy(zero_copy_only=False)
    name &= ~np.array([w in lexicon() for w in coded.dictionary.to_pylist()], bool)[place]
    costs[name] += CAPITAL
    costs[name, TAGS.index("PROPN")] = 0
    tags = cheapest(costs, bounds)
    # a name is its own lemma
    return pc.coalesce(pa.array(lemmas, pa.string()).take(pa.array(place * len(TAGS) + tags)), pc.utf8_lower(words)), tags


def tag_sentences(sentences: list[list[str]]) -> list[list[tuple[str, str]]]:
    """(lemma, tag) of each word of each sentence."""
    bounds = np.r_[0, np.cumsum([len(s) for s in sentences])].astype(np.int64)
    lemmas, tags = tagged(pa.array([w for s in sentences for w in s], pa.string()), bounds)
    pairs = list(zip(lemmas.to_pylist(), [TAGS[t] for t in tags], strict=True))
    return [pairs[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sentences(text: Column) -> Column:
    """The sentences of a text, each as an array of its words as they are written."""
    parts = F.transform(F.split(text, SENTENCE_ENDS), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    return F.filter(parts, lambda w: F.size(w) > 0)


def tagger() -> Callable[[Column], Column]:
    """A function of a column of sentences (arrays of words without nulls) that gives an array of (lemma, tag); a null sentence has none."""

    @arrow_udf("array<struct<lemma:string,tag:string>>")
    def lemmas(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        bounds = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        found, tags = tagged(words.flatten(), bounds.astype(np.int64))
        both = pa.StructArray.from_arrays([found, pa.array(TAGS).take(pa.array(tags))], ["lemma", "tag"])
        return pa.ListArray.from_arrays(pa.array(bounds), both)

    return lemmas
