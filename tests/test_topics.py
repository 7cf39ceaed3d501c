"""Topics: shares of given ones step by step, and planted ones found again."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from turnlens.operators import topics

LEXICONS = {"agua": ["agua", "río", "mar"], "casa": ["casa", "techo"], "paz": ["paz", "mar"]}


def shares(text, words, weights):
    tokens = re.findall("[a-záéíóúüñ]+", (text or "").lower())
    n = [tokens.count(w) for w in words]
    theta = [1 / len(weights)] * len(weights)
    for _ in range(topics.STEPS):
        mixed = [sum(t * row[w] for t, row in zip(theta, weights)) for w in range(len(words))]
        theta = [
            (t * sum(n[w] / mixed[w] * row[w] for w in range(len(words))) + topics.PRIOR) / (sum(n) + len(weights) * topics.PRIOR) for t, row in zip(theta, weights)
        ]
    return theta


def test_given_topics(spark):
    words, weights = topics.matrix(LEXICONS)
    assert all(abs(sum(row) - 1) < 1e-12 for row in weights)
    texts = [None, "", "nada", "Agua, AGUA mar", "mar paz mar", "casa techo casa paz", "agua " * 500]
    rows = [("2025-01-01" if i < 5 else "2025-01-02", t, 7) for i, t in enumerate(texts)]
    out = topics.infer(spark.createDataFrame(rows, "fecha string, texto string, v0 int").repartition(2), words, weights)
    assert out.columns == ["fecha", "texto", "v0", "v"]
    found = {r["texto"]: r["v"] for r in out.collect()}
    for t in texts[1:]:
        assert found[t] == pytest.approx(shares(t, words, weights), abs=1e-9) and sum(found[t]) == pytest.approx(1)
    means = {(r["fecha"], r["topico"]): r["peso"] for r in topics.means(out).collect()}
    want = [sum(x) / 2 for x in zip(*(shares(t, words, weights) for t in texts[5:]))]
    assert [means["2025-01-02", k] for k in range(3)] == pytest.approx(want, abs=1e-4)
    assert topics.means(topics.infer(spark.createDataFrame([], "fecha string, texto string"), words, weights)).collect() == []


def test_planted_topics_are_found(spark):
    rng = random.Random(9)
    planted = [["agua", "río", "lluvia", "presa", "pozo"], ["tren", "vía", "riel", "vagón", "estación"], ["beca", "escuela", "aula", "maestra", "libro"]]
    rows = []
    for i in range(300):
        own = planted[i % 3]
        rows.append((f"2025-01-{1 + i % 28:02d}", " ".join(rng.choice(own if rng.random() < 0.9 else rng.choice(planted)) for _ in range(30)), i % 3))
    frame = spark.createDataFrame(rows, "fecha string, texto string, kind int")
    vectorizer, model, counted = topics.fit(frame, [], 3)
    found = topics.labels(vectorizer, model, 5).groupBy("topico").agg(F.collect_set("termino").alias("w")).collect()
    words = {r["topico"]: set(r["w"]) for r in found}
    # the best matching of planted and found topics
    best = max(itertools.permutations(range(3)), key=lambda p: sum(len(words[t] & set(planted[k])) for k, t in enumerate(p)))
    assert sum(len(words[t] & set(planted[k])) for k, t in enumerate(best)) == 15
    weights = model.transform(counted).select("kind", F.posexplode(topics.vector_to_array("topicDistribution")).alias("t", "p")).groupBy("kind", "t").agg(F.avg("p").alias("p"))
    share = {(r["kind"], r["t"]): r["p"] for r in weights.collect()}
    assert all(share[k, best[k]] > 0.7 for k in range(3))


def planted(spark):
    rng = random.Random(3)
    words = ["agua", "río", "presa", "tren", "vía", "riel", "beca", "aula", "libro", "el"]
    rows = [(i, f"2025-0{1 + i % 2}-{1 + i % 28:02d}", " ".join(rng.choice(words[i % 3 * 3 :][:4]) for _ in range(12))) for i in range(240)]
    return spark.createDataFrame([*rows, (240, "2025-01-01", "solo")], "id int, fecha string, texto string")


def test_fit_is_spread_and_reads_stored_counts(spark, monkeypatch):
    monkeypatch.setattr(topics, "TURNS", 100)
    whole = planted(spark).coalesce(1)
    vectorizer, model, counted = topics.fit(whole, ["el"], 3)
    assert counted.columns == ["id", "fecha", "counts"] and counted.count() == 241
    assert len(counted.select(F.spark_partition_id().alias("p")).distinct().collect()) == 3
    assert "regexp" not in counted._jdf.queryExecution().optimizedPlan().toString()
    # another layout of the same turns gives the same topics
    again = topics.fit(whole.orderBy(F.desc("id")).repartition(5), ["el"], 3)
    assert again[0].vocabulary == vectorizer.vocabulary
    rows = lambda found: [tuple(r) for r in topics.labels(found[0], found[1]).collect()]
    assert rows(again) == rows((vectorizer, model))


def test_months_read_stored_counts(spark, monkeypatch):
    monkeypatch.setattr(topics, "TURNS", 100)
    _, model, counted = topics.fit(planted(spark), ["el"], 3)
    days = topics.by_date(model, counted)
    months = topics.by_month(days)
    assert "regexp" not in months._jdf.queryExecution().optimizedPlan().toString()
    held = {}
    for r in days.collect():
        held.setdefault((r["fecha"][:7], r["topico"]), []).append(r["peso"])
    found = {(r["mes"], r["topico"]): r["peso"] for r in months.collect()}
    assert found == pytest.approx({k: sum(v) / len(v) for k, v in held.items()}, abs=1e-4) and len(found) == 6
    assert {r["mes"] for r in topics.percent_pivot(months, 3).collect()} == {"2025-01", "2025-02"}


def test_vocabulary_of_several_tasks(spark):
    tokens = planted(spark).select(F.split("texto", " ").alias("tokens"))
    one, several = topics.vocabulary(tokens.coalesce(1), 1), topics.vocabulary(tokens, 3)
    held = [r["tokens"] for r in tokens.collect()]
    n = lambda w: sum(t.count(w) for t in held)
    want = sorted({w for t in held for w in t if sum(w in u for u in held) >= topics.MIN_DF}, key=lambda w: (-n(w), w))
    assert several.vocabulary == want and set(one.vocabulary) == set(want) and "solo" not in want
    counts = lambda v: sorted(sorted((v.vocabulary[int(i)], x) for i, x in zip(r["counts"].indices, r["counts"].values)) for r in v.transform(tokens).collect())
    assert counts(one) == counts(several)
    assert topics.vocabulary(tokens.limit(3), 2) is None
