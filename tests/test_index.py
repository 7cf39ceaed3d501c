"""The inverted index against the search through all texts."""

import random

import pytest

from turnlens.operators import index, kwic

TEXTS = [
    None, "", " ", "agua", "El agua, el AGUA; agua-agua y aguas", "la la la la", "x de la la casa", "de  la de\nla de la", "2024 y 19 de mayo de 2024", "ñandú árbol",
    "é" * 200 + " agua " + "ü" * 200, "agua\U0001f600agua el\tagua el agua.", "covid-19 covid-19x covid-191 acovid-19",
]
TERMS = ["agua", "el agua", "la la", "de la", "de la la", "19 de mayo", "2024", "covid-19", "ñandú", "nada", "agua, el agua", "x de la la casa", "-19"]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(4)
    rows = [(f"d{i}", i, t) for i, t in enumerate(TEXTS)]
    rows += [("r", i, "".join(rng.choice(["la ", "de ", "la,", "agua", " ", "el "]) for _ in range(rng.randrange(40)))) for i in range(60)]
    return spark.createDataFrame(rows, "conv_id string, turno int, texto string").repartition(3)


@pytest.fixture(scope="module")
def path(turns, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write(turns, ["conv_id", "turno"], path)
    return path


@pytest.mark.parametrize("term", TERMS)
def test_same_hits(spark, turns, path, term):
    rows = lambda frame: sorted((r.conv_id, r.turno, r.at, r.ctx) for r in frame.collect())
    assert rows(index.search(spark.read.parquet(path), turns, ["conv_id", "turno"], term)) == rows(kwic.hits(turns, term))


def test_only_the_words_folders_are_read(spark, turns, path):
    plan = index.matches(spark.read.parquet(path), ["conv_id", "turno"], "de la")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and plan.count("PushedFilters: [IsNotNull(word), EqualTo(word") == 2


def test_postings(spark):
    frame = spark.createDataFrame([(1, "b a\nb  B"), (2, None), (3, "--")], "k int, texto string")
    got = sorted((r.word, r.k, r.places, r.offsets) for r in index.postings(frame, ["k"]).collect())
    assert got == [("a", 1, [1], [2]), ("b", 1, [0, 2, 1], [0, 4, 3])]
    assert index.postings(frame.limit(0), ["k"]).collect() == []
