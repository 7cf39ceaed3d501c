"""Lemmas and parts of speech: tagged sentences, and the cheapest path against all paths."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.functions import morphology as M
from turnlens.operators import terms

TAGGED = [
    "El/DET/el lunes/NOUN/lunes presentamos/VERB/presentar los/DET/el programas/NOUN/programa de/ADP/de bienestar/NOUN/bienestar para/ADP/para las/DET/el mujeres/NOUN/mujer",
    "Los/DET/el jóvenes/NOUN/joven reciben/VERB/recibir una/DET/uno beca/NOUN/beca mensual/ADJ/mensual",
    "Las/DET/el inversiones/NOUN/inversión públicas/ADJ/público garantizan/VERB/garantizar el/DET/el desarrollo/NOUN/desarrollo económico/ADJ/económico",
    "La/DET/el mañana/NOUN/mañana llegó/VERB/llegar temprano/ADV/temprano",
    "El/DET/el informe/NOUN/informe se/PRON/se entrega/VERB/entregar mañana/ADV/mañana",
    "Rápidamente/ADV/rápidamente resolvieron/VERB/resolver los/DET/el problemas/NOUN/problema graves/ADJ/grave",
    "Con/ADP/con la/DET/el ayuda/NOUN/ayuda de/ADP/de Claudia/PROPN/claudia terminaron/VERB/terminar las/DET/el obras/NOUN/obra",
    "Ya/ADV/ya está/AUX/estar funcionando/VERB/funcionar el/DET/el nuevo/ADJ/nuevo tren/NOUN/tren interoceánico/ADJ/interoceánico",
    "Vamos/VERB/ir a/ADP/a construir/VERB/construir hospitales/NOUN/hospital en/ADP/en el/DET/el estado/NOUN/estado de/ADP/de Sonora/PROPN/sonora",
]


@pytest.mark.parametrize("sentence", TAGGED)
def test_tagged_sentences(sentence):
    words = [w.split("/") for w in sentence.split()]
    assert M.tag_sentences([[w[0] for w in words]])[0] == [(lemma, tag) for _, tag, lemma in words]


def test_cheapest_path_is_that_of_all_paths():
    rng, n = random.Random(2), len(M.TAGS)
    sentences = [[[rng.randrange(4) if rng.random() < 0.4 else M.NEVER for _ in range(n)] for _ in range(size)] for size in (1, 4, 0, 3, 5, 1, 2)]
    for s in sentences:
        for costs in s:
            costs[rng.randrange(n)] = 1
    bounds = np.r_[0, np.cumsum([len(s) for s in sentences])]
    got = M.cheapest(np.array([c for s in sentences for c in s]), bounds)

    def cost(s, path):
        return M.START[path[0]] + sum(s[i][t] for i, t in enumerate(path)) + sum(M.AFTER[a][b] for a, b in zip(path, path[1:])) + M.END[path[-1]]

    for s, a, b in zip(sentences, bounds[:-1], bounds[1:], strict=True):
        if s:
            paths = itertools.product(*[[t for t in range(n) if c[t] < M.NEVER] for c in s])
            # the last word's tag breaks ties first, as paths are walked backwards
            assert tuple(got[a:b]) == min(paths, key=lambda p: (cost(s, p), p[::-1]))


def test_fixed_values_are_consistent():
    assert len(M.START) == len(M.END) == len(M.AFTER) == len(M.TAGS) and all(len(row) == len(M.TAGS) for row in M.AFTER)
    assert {t for found in [*M.lexicon().values(), *M.endings().values()] for t in found} <= set(M.TAGS)
    assert all(M.analyse(w) for w in ("", "x", "xy", "de", "zzz"))


@pytest.mark.parametrize("word,tag,lemma", [("canciones", "NOUN", "canción"), ("ciudades", "NOUN", "ciudad"), ("hizo", "VERB", "hacer"), ("dijeron", "VERB", "decir"), ("lunes", "NOUN", "lunes"), ("voces", "NOUN", "voz"), ("amable", "ADJ", "amable"), ("lentamente", "ADV", "lentamente")])
def test_analyses(word, tag, lemma):
    assert M.analyse(word)[tag][0] == lemma


def test_frame(spark):
    rows = [("a", "Los lunes trabajamos. Las canciones hacen ruido; ¿Qué hizo Pedro?"), ("b", None), ("a", ""), ("a", " .. \n"), ("c", "Trabajamos\nTRABAJAMOS")]
    frame = spark.createDataFrame(rows, "g string, t string").repartition(3)
    words = terms.tagged_words(frame, ["g"], "t").orderBy("g", "sentence", "pos").collect()
    assert [(r.sentence, r.pos, r.word, r.lemma, r.tag) for r in words if r.g == "a"][:5] == [
        (0, 0, "Los", "el", "DET"), (0, 1, "lunes", "lunes", "NOUN"), (0, 2, "trabajamos", "trabajar", "VERB"), (1, 0, "Las", "el", "DET"), (1, 1, "canciones", "canción", "NOUN"),
    ]
    found = terms.top_lemmas(frame, F.col("g"), "t", ["hacer", "canciones"]).collect()
    assert {(r.grp, r.term, r.n) for r in found} == {("a", "lunes", 1), ("a", "trabajar", 1), ("a", "ruido", 1), ("c", "trabajar", 2)}
    assert terms.tagged_words(frame.limit(0), ["g"], "t").collect() == []
    upper = terms.tagged_words(frame, ["g"], "t", tagger=lambda w: F.transform(w, lambda x: F.struct(F.upper(x).alias("lemma"), F.lit("NOUN").alias("tag"))))
    assert {r.lemma for r in upper.where("g = 'c'").collect()} == {"TRABAJAMOS"}


def test_one_long_sentence():
    assert len(M.tag_sentences([["palabra"] * 30_000])[0]) == 30_000
