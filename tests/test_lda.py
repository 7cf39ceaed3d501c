"""The batch fit of topics against a plain version turn by turn, and its shares against MLlib's."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from turnlens.operators import lda, topics

PLANTED = [["agua", "río", "presa", "pozo"], ["tren", "vía", "riel", "vagón"], ["beca", "aula", "libro", "mesa"]]


def turns(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(rng.choice(PLANTED) if rng.random() < 0.2 else PLANTED[i % 3]) for _ in range(rng.randrange(1, 60))) for i in range(150)]
    texts += ["", "nada", "agua", "agua río " * 400]
    rows = [(i, f"2025-0{1 + i % 2}-{1 + i % 9:02d}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, fecha string, texto string")


def digamma(x):
    low = 0.0
    while x < 30:
        low, x = low - 1 / x, x + 1
    return low + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def plain(rows, weights, passes):
    """The weights after some passes, turn by turn, word by word."""
    size, k = len(weights), len(weights[0])
    for _ in range(passes):
        sums = [sum(row[t] for row in weights) for t in range(k)]
        likely = [[math.exp(digamma(row[t]) - digamma(sums[t])) for t in range(k)] for row in weights]
        new = [[1 / k] * k for _ in range(size)]
        for counts in rows:
            found = list(zip(map(int, counts.indices), counts.values, strict=True))
            gamma, change = [1.0] * k, 1.0
            theta = [math.exp(digamma(g)) for g in gamma]
            while change > lda.SETTLED:
                last = gamma
                mixed = {w: sum(a * b for a, b in zip(theta, likely[w], strict=True)) for w, _ in found}
                gamma = [1 / k + theta[t] * sum(n / mixed[w] * likely[w][t] for w, n in found) for t in range(k)]
                theta = [math.exp(digamma(g)) for g in gamma]
                change = sum(abs(a - b) for a, b in zip(gamma, last, strict=True)) / k
            for w, n in found:
                mixed = sum(a * b for a, b in zip(theta, likely[w], strict=True))
                for t in range(k):
                    new[w][t] += n * theta[t] * likely[w][t] / mixed
        weights = new
    return np.array(weights)


def test_digamma():
    x = np.array([1e-4, 0.1, 0.5, 1.0, 7.3, 1e6, 1e9])
    assert np.log(lda.exp_digamma(x[1:])) == pytest.approx([digamma(v) for v in x[1:]], abs=1e-9)
    assert lda.exp_digamma(x)[0] == 0 and np.log(lda.exp_digamma(x[3])) == pytest.approx(-np.euler_gamma, abs=1e-10)


def test_every_turn_counts_once_in_each_pass(spark, monkeypatch):
    monkeypatch.setattr(topics, "TURNS", 60)
    monkeypatch.setattr(topics, "ITERATIONS", 3)
    _, model, counted = topics.fit(turns(spark), [], 3)
    rows = [r["counts"] for r in counted.collect()]
    drawn = LDA(k=3, maxIter=0, seed=topics.SEED, featuresCol="counts", optimizer="online").fit(counted)
    start = drawn.topicsMatrix().toArray()
    assert model.topicsMatrix().toArray() == pytest.approx(plain(rows, start.tolist(), 3), abs=1e-4)
    # all words of all turns are dealt among the topics, and nothing else
    assert model.weights.sum() - model.weights.size / 3 == pytest.approx(sum(r.values.sum() for r in rows), abs=1e-4)


def test_blocks_and_batches_do_not_matter(spark, monkeypatch):
    _, model, counted = topics.fit(turns(spark), [], 3)
    indices = [list(map(int, r["counts"].indices)) for r in counted.collect()]
    values = [list(r["counts"].values) for r in counted.collect()]
    vectors = lda.pa.StructArray.from_arrays([lda.pa.array(indices, lda.pa.list_(lda.pa.int32())), lda.pa.array(values, lda.pa.list_(lda.pa.float64()))], ["indices", "values"])
    likely = lda._likely(model.weights)

    def gammas():
        out = np.empty((len(indices), 3))
        for rows, gamma, *_ in lda._settled(vectors, likely):
            out[rows] = gamma
        return out

    whole = gammas()
    monkeypatch.setattr(lda, "PLACES", 20)
    assert gammas() == pytest.approx(whole, abs=1e-9)
    batch = lda.pa.RecordBatch.from_arrays([vectors], ["counts"])
    monkeypatch.setattr(lda, "TURNS", 4)
    parts = list(lda._gathered(iter([batch.slice(i, 3) for i in range(0, batch.num_rows, 3)])))
    assert sum(p.num_rows for p in parts) == batch.num_rows and max(p.num_rows for p in parts) == 6
    assert lda.pa.concat_batches(parts).equals(batch)


def test_other_turns_take_the_place_of_settled_ones(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 13, 600)
    indices = [np.sort(rng.choice(40, s, False)).astype(np.int32) for s in sizes]
    vectors = lda.pa.StructArray.from_arrays([lda.pa.array(indices, lda.pa.list_(lda.pa.int32())), lda.pa.array([np.ones(s) for s in sizes], lda.pa.list_(lda.pa.float64()))], ["indices", "values"])
    likely, steps, plain_digamma = lda._likely(rng.gamma(0.5, 20, (40, 5)) + 0.2), [], lda.exp_digamma
    monkeypatch.setattr(lda, "PLACES", 600)
    monkeypatch.setattr(lda, "exp_digamma", lambda x: steps.append(len(x)) or plain_digamma(x))
    found = np.concatenate([rows for rows, *_ in lda._settled(vectors, likely)])
    assert sorted(found) == list(range(600))
    # 50 turns or more at a time but for the last ones; not a few slow ones of each block
    assert np.mean(steps) > 25


def test_shares_are_those_of_mllib(spark):
    counted = topics.fit(turns(spark), [], 3)[2]
    mllib = LDA(k=3, maxIter=10, seed=1, featuresCol="counts", docConcentration=[1 / 3] * 3, optimizeDocConcentration=False).fit(counted)
    shares = lambda model: {r["id"]: r["v"] for r in model.transform(counted).select("id", vector_to_array("topicDistribution").alias("v")).collect()}
    theirs, own = shares(mllib), shares(lda.Topics(mllib.topicsMatrix().toArray()))
    assert theirs.keys() == own.keys() and len(own) == 154
    for i, v in theirs.items():
        assert own[i] == pytest.approx(v if sum(v) else [1 / 3] * 3, abs=5e-3)
    assert sum(sum(v) == 0 for v in theirs.values()) == 2


def test_months_take_the_shares_of_the_batch_fit(spark, monkeypatch):
    monkeypatch.setattr(topics, "TURNS", 60)
    frame = turns(spark)
    _, model, counted = topics.fit(frame, [], 3)
    rows = model.transform(counted).select("fecha", vector_to_array("topicDistribution").alias("v")).collect()
    days = {}
    for r in rows:
        days.setdefault(r["fecha"], []).append(r["v"])
    want = {}
    for day, held in days.items():
        want.setdefault(day[:7], []).append(np.round(np.mean(held, 0), 4))
    for r in topics.percent_pivot(topics.by_month(topics.by_date(model, counted)), 3).collect():
        assert [r["t0"], r["t1"], r["t2"]] == pytest.approx(100 * np.mean(want.pop(r["mes"]), 0), abs=0.51)
    assert not want
    # a vector of no words, and one turn in a table of its own
    alone = spark.createDataFrame([(1, SparseVector(len(model.weights), {}))], ["id", "counts"])
    assert model.transform(alone).select(vector_to_array("topicDistribution").alias("v")).first()["v"] == pytest.approx([1 / 3] * 3)


def test_labels_are_words_by_weight(spark):
    _, model, _ = topics.fit(turns(spark), [], 3)
    vectorizer = CountVectorizerModel.from_vocabulary([f"w{i}" for i in range(len(model.weights))], "tokens", "counts")
    for t in range(3):
        found = [r["termino"] for r in topics.labels(vectorizer, model, 4).where(F.col("topico") == t).orderBy("rank").collect()]
        assert found == [f"w{i}" for i in np.argsort(-model.weights[:, t], kind="stable")[:4]]
