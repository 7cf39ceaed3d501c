"""The toxicity classifier: n-gram counts, ratios and weights against plain versions, and held-out accuracy."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from turnlens.llm import kernel, queries, toxicity

ODD = [None, "", " \n ", "!!!", "a", "Ab", "a--b", "ÉÑ x", "x" * 300, "日本語 😀 İ", "stupid moron", "stupid moron", "the end\n" * 40]


def bucket(gram):
    value = kernel.mix(np.array([ord(c) for c in gram], np.uint64) + np.uint64(1))
    total = 0
    for v in value:
        total = (total * int(toxicity._BASE) + int(v)) % (1 << 64)
    return int(kernel.mix(np.array([(total + len(gram)) % (1 << 64)], np.uint64))[0]) >> (64 - toxicity.BITS)


def grams(text):
    plain = " " + re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", pc.utf8_lower(text or "").as_py()) + " "
    plain = re.sub(" +", " ", plain)
    return [bucket(plain[i : i + n]) for n in toxicity.LENGTHS for i in range(len(plain) - n + 1)]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_counts(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    want = [collections.Counter(grams(t)) for t in ODD]
    known = sorted(set().union(*want))[::2]
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    text, feature, n = toxicity.counted(pa.array(ODD), place, len(known))
    got = collections.defaultdict(dict)
    for t, f, k in zip(text.tolist(), feature.tolist(), n.tolist()):
        got[t][known[f]] = k
    assert [got[i] for i in range(len(ODD))] == [{b: k for b, k in c.items() if b in set(known)} for c in want]


def test_ratios(spark):
    rows = [(i % 2, t) for i, t in enumerate(ODD * 3) if t is not None]
    held = [collections.Counter(b for y, t in rows if y == label for b in set(grams(t))) for label in (0, 1)]
    size = [sum(y == label for y, _ in rows) for label in (0, 1)]
    want = {}
    for b in held[0] | held[1]:
        if held[0][b] + held[1][b] >= toxicity.LEAST:
            want[b] = math.log((held[1][b] + 0.5) / (size[1] + 1)) - math.log((held[0][b] + 0.5) / (size[0] + 1))
    frame = spark.createDataFrame(rows, "toxic int, text string").repartition(3)
    got = toxicity.ratios(frame, features=10**6)
    assert {b: round(r, 9) for b, r in got} == {b: round(r, 9) for b, r in want.items()}
    strength = [abs(r) * math.sqrt(held[0][b] + held[1][b]) for b, r in got]
    assert all(x >= y - 1e-9 for x, y in zip(strength, strength[1:]))
    assert toxicity.ratios(frame, features=5) == got[:5]


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(5)
    dense = rng.random((60, 8)) * (rng.random((60, 8)) < 0.4)
    y = (dense[:, 0] + rng.normal(0, 0.3, 60) > 0.2).astype(float)
    row, feature = np.nonzero(dense)
    weights, b = toxicity.logistic(np.searchsorted(row, np.arange(61)), feature, dense[row, feature], y, 8, ridge=0.5)
    x = np.zeros(9)
    full = np.c_[dense, np.ones(60)]
    keep = np.diag([0.5] * 8 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ x))
        x -= np.linalg.solve(full.T * (p * (1 - p)) @ full + keep, full.T @ (p - y) + keep @ x)
    assert np.allclose(np.r_[weights, b], x, atol=0.02)


def test_score_is_a_sum_over_counts():
    known = sorted(set(grams("stupid moron")))
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    model = toxicity.Model(place, np.linspace(-1, 1, len(known)), -0.3)
    want = []
    for t in ODD:
        n = collections.Counter(grams(t))
        want.append(1 / (1 + math.exp(0.3 - sum(math.log1p(n[b]) * w for b, w in zip(known, model.weights) if n[b]))))
    assert np.allclose(toxicity.score(model, pa.array(ODD)), want)


def test_corners(spark):
    docs = spark.createDataFrame([(i, t, 9.0, 7) for i, t in enumerate(ODD)] + [(None, "x", 0.0, 1), (3, "twice", 0.0, 1)], "doc_id bigint, text string, score double, _own0 int")
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2) for i in range(40)] + [(10, 1), (None, 1)], "doc_id bigint, toxic int")
    for y in (labels, labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.train(docs, y)
        out = toxicity.scored(docs, model).collect()
        assert len(out) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
        assert out[0].score == out[1].score == out[2].score == out[3].score and out[0]["_own0"] == 7
        assert len({r.score for r in out if r.text == "stupid moron"}) == 1
    assert toxicity.digest(docs.limit(0), labels).collect() == []
    assert {r.held_out for r in toxicity.digest(docs, labels).where("doc_id IS NULL").collect()} == {False}


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = queries.op13_toxicity(spark, data).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r.toxic, r.predicted): r.n for r in out}
    # about 2 percent of the labels contradict their texts
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0)) and n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0])
