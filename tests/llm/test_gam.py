"""The additive model against plain versions: scores as sums of table entries, one boosting step as a search over all splits."""

import bisect
import math

import numpy as np
import pytest

from turnlens.llm import gam, rules


def plain_score(model, row):
    z = model.intercept
    for f, v in enumerate(row):
        z += model.tables[f][bisect.bisect_right(list(model.edges[f]), v)]
    for (a, b), grid in zip(model.pairs, model.grids, strict=True):
        z += grid[bisect.bisect_right(list(model.coarse[a]), row[a])][bisect.bisect_right(list(model.coarse[b]), row[b])]
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_tree(g, w, depth, smooth):
    """The split of the largest gain, the first of equal ones, found by trying every cut."""
    whole = sum(g) ** 2 / (sum(w) + smooth)
    best = None
    for cut in range(1, len(g)) if depth else ():
        gain = sum(g[:cut]) ** 2 / (sum(w[:cut]) + smooth) + sum(g[cut:]) ** 2 / (sum(w[cut:]) + smooth)
        if gain > whole + 1e-12 and (best is None or gain > best[0] + 1e-12):
            best = gain, cut
    if best is None:
        return [sum(g) / (sum(w) + smooth)] * len(g)
    cut = best[1]
    return plain_tree(g[:cut], w[:cut], depth - 1, smooth) + plain_tree(g[cut:], w[cut:], depth - 1, smooth)


@pytest.mark.parametrize("bins", [1, 2, 5, 12])
def test_tree_of_one_feature(bins):
    rng = np.random.default_rng(bins)
    for _ in range(100):
        g, w = rng.normal(size=bins), rng.uniform(0, 3, bins)
        for depth in (0, 1, 2):
            assert np.allclose(gam._tree(g, w, depth, 2.0), plain_tree(g.tolist(), w.tolist(), depth, 2.0))
    assert gam._tree(np.zeros(bins), np.ones(bins), 2, 2.0).tolist() == [0.0] * bins


@pytest.mark.parametrize("shape", [(2, 2), (3, 7), (8, 8), (1, 4), (4, 1)])
def test_quadrants_of_a_pair(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(50):
        g, w = rng.normal(size=shape), rng.uniform(0, 3, shape)
        best, values = -1.0, np.zeros(shape)
        for i in range(1, shape[0]):
            for j in range(1, shape[1]):
                parts = [np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:]]
                gain = sum(g[p].sum() ** 2 / (w[p].sum() + 2.0) for p in parts)
                if gain > best + 1e-12:
                    best, values = gain, np.zeros(shape)
                    for p in parts:
                        values[p] = g[p].sum() / (w[p].sum() + 2.0)
        found, gain = gam._cross(g, w, 2.0)
        assert np.allclose(found, values) and math.isclose(gain, best, rel_tol=1e-9)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in {tuple(sorted(p)) for p in model.pairs}
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    alone = model._replace(pairs=[], grids=[])
    assert ((alone.score(x) >= 0.5) == y).mean() < 0.7


def test_query_against_sums_of_table_entries(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 50_000), (-3, "x " * 50_000)], docs.select("doc_id", "text").schema)
    docs = docs.select("doc_id", "text").union(odd)
    model = gam.train(docs, labels)
    table = rules.measured(docs, "text").select("doc_id", *rules.MEASURES).toPandas()
    rows = gam.features({m: table[m].to_numpy() for m in rules.MEASURES})
    want = sorted((int(i), plain_score(model, row)) for i, row in zip(table["doc_id"], rows.tolist(), strict=True))
    found = sorted((r["doc_id"], r["score"], r["predicted"]) for r in gam.digest(docs, labels).collect())
    assert [i for i, _ in want] == [i for i, _, _ in found] and len(found) > 100
    assert np.allclose([s for _, s in want], [s for _, s, _ in found], rtol=0, atol=1e-9)
    assert all(p == (s >= 0.5) for _, s, p in found)
