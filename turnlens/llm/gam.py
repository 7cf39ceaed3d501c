"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature (then one pair of features)
at a time, with a small step; the sum of a feature's trees is a lookup table
over its bins, so scoring is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel, rules

#: At most this many labelled rows, those with the smallest hashes of their ids, are fitted on.
SAMPLE = 20_000
SEED = 7


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """Measurements (see rules.MEASURES) to a matrix of ratios; all of an empty text's are 0."""
    at = lambda k: m[k].astype(np.float64)
    words, chars = np.maximum(at("n_words"), 1), np.maximum(at("n_chars_all"), 1)
    letters = np.maximum(at("n_upper") + at("n_lower") + at("n_wide"), 1)
    return np.stack(
        [
            np.log1p(at("n_words")),
            at("word_chars") / words,
            at("n_symbols") / words,
            at("n_dup_lines") / np.maximum(at("n_lines"), 1),
            at("n_repeat_words") / words,
            at("n_upper") / letters,
            at("n_digits") / chars,
            at("n_stops") / words,
            at("n_punct") / words,
            at("n_bangs") / words,
            at("n_pipes") / words,
            at("n_wide") / letters,
            at("n_distinct_words") / np.maximum(at("n_alnum_words"), 1),
            at("n_single_words") / np.maximum(at("n_alnum_words"), 1),
            at("n_words") / np.maximum(at("n_lines"), 1),
            at("max_word_chars"),
        ],
        axis=1,
    )


class Model(NamedTuple):
    """Bin edges of each feature, a table for each feature and one for each pair, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: additions of table entries."""
        z = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, f], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """A shallow regression tree over consecutive bins, as the value of each bin."""
    total_g, total_w = gradient.sum(), weight.sum()
    out = np.full(len(gradient), total_g / (total_w + smooth))
    if depth == 0 or len(gradient) < 2:
        return out
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gain = g**2 / (w + smooth) + (total_g - g) ** 2 / (total_w - w + smooth)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= total_g**2 / (total_w + smooth) + 1e-12:
        return out
    return np.concatenate([_tree(gradient[:cut], weight[:cut], depth - 1, smooth), _tree(gradient[cut:], weight[cut:], depth - 1, smooth)])


def _cross(gradient: np.ndarray, weight: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The best split of a grid into four quadrants, as values, and its gain."""
    corner = lambda t: np.cumsum(np.cumsum(t, 0), 1)
    G, W = corner(gradient), corner(weight)
    best, values = -1.0, np.zeros_like(gradient)
    for i in range(gradient.shape[0] - 1):
        g = np.stack([G[i, :-1], G[i, -1] - G[i, :-1], G[-1, :-1] - G[i, :-1], G[-1, -1] - G[i, -1] - G[-1, :-1] + G[i, :-1]])
        w = np.stack([W[i, :-1], W[i, -1] - W[i, :-1], W[-1, :-1] - W[i, :-1], W[-1, -1] - W[i, -1] - W[-1, :-1] + W[i, :-1]])
        gain = (g**2 / (w + smooth)).sum(0)
        j = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[j] > best:
            best = gain[j]
            v = g[:, j] / (w[:, j] + smooth)
            values = np.empty_like(gradient)
            values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = v
    return values, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, n_pairs: int = 4, smooth: float = 2.0) -> Model:
    """Cyclic boosting of depth-2 trees on one feature each, then of quadrant trees on the strongest pairs.

    Without rows every score is 0.5; with one class only, its smoothed share.
    """
    n = x.shape[1]
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if len(v) else np.zeros(0)
    edges, coarse = [quantiles(x[:, f], bins) for f in range(n)], [quantiles(x[:, f], 8) for f in range(n)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [], float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    z = np.full(len(y), model.intercept)
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    state = lambda: (1 / (1 + np.exp(-z)))
    for _ in range(rounds):
        for f in range(n):
            p = state()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), 2, smooth)
            model.tables[f][:] += step
            z += step[at[f]]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = state(), (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        fill = lambda v: np.bincount(cell, v, shape[0] * shape[1]).reshape(shape)
        return fill(y - p), fill(p * (1 - p))

    gains = sorted(((_cross(*grid(a, b), smooth)[1], a, b) for a in range(n) for b in range(a)), reverse=True)
    for _, a, b in gains[:n_pairs]:
        model.pairs.append((a, b))
        model.grids.append(np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)))
    for _ in range(rounds // 4):
        for (a, b), table in zip(model.pairs, model.grids, strict=True):
            step = rate * _cross(*grid(a, b), smooth)[0]
            table += step
            z += step[low[a], low[b]]
    return model


def _fold(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the features of at most ``sample`` labelled rows whose crc32(id) mod 3 is not 1.

    Rows are taken in the order of a hash of their ids, so the choice is random
    but repeatable. Null labels, ids and texts are left out. An id counts once: of
    its labels the more frequent one, else 0, and of its texts the smallest one.
    """
    known = labels.where((_fold(id_col) != 1) & F.col("quality").isNotNull()).select(id_col, F.col("quality").cast("int").alias("quality"))
    known = known.groupBy(id_col).agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.where(F.col(text_col).isNotNull() & (_fold(id_col) != 1)).select(id_col, text_col)
    # at most sample rows of ids, and as many texts of each task
    rows = rows.join(F.broadcast(known), id_col).groupBy(id_col, "quality").agg(F.min(text_col).alias(text_col))
    found = rules.measured(rows, text_col).select("quality", *rules.MEASURES)
    table = found.toPandas().sort_values(found.columns)
    return fit(features({m: table[m].to_numpy() for m in rules.MEASURES}), table["quality"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``score`` and ``predicted`` appended (replacing such columns).

    Every text, null and empty ones (scored alike) included, gets a score from its whole length.
    """
    kernel.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    out = docs.drop("score", "predicted").withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names = batch.schema.names
            found = [own.score(features(rules.measure(part))) for part in kernel.slices(batch.column(names.index(text_col)))]
            new = {"score": pa.array(np.concatenate(found))} if found else {}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents predicted to be of label 1, with their own columns, whatever these are named.

    Null and empty texts are scored alike; repeated rows stay or go together.
    """
    own, text = kernel.shielded(docs, text_col)
    return scored(own, model, text).where(F.col("predicted") == 1).select(*own.columns).toDF(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
