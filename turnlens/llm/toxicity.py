"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, runs of characters that are neither letters nor digits
(of ASCII) become one blank, and the n-grams of two to six characters, blanks
and both ends included, are hashed to 2 ** BITS buckets. Spark counts the
documents of each class that hold a bucket; of the buckets with the strongest
log-count ratios, a document's features are the logarithms of its counts times
the ratios, and logistic regression weighs them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import checkpointed

#: At most this many labelled rows, those with the smallest hashes of their ids, are fitted on.
SAMPLE = 20_000
#: Buckets that the classifier keeps, and the fewest documents that hold one of them.
FEATURES = 1 << 13
LEAST = 3
BITS = 20
LENGTHS = (2, 3, 4, 5, 6)
THRESHOLD = 0.7
#: Characters worked on at a time; a longer text takes several blocks.
BLOCK = 1 << 20
_BASE = np.uint64(0xD1342543DE82EF95)
_BLANK = np.array([not chr(c).isalnum() for c in range(128)])


class Model(NamedTuple):
    """The place of each bucket among the features or -1, the features' scaled weights, and the intercept."""

    place: np.ndarray
    weights: np.ndarray
    intercept: float


def _characters(part: kernel.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice as code points, each with a blank before and behind, and the text that each belongs to."""
    data, offsets = part.data, part.offsets
    inner = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    counts = np.diff(inner[offsets])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.r_[0, np.cumsum(counts + 2)]
    out = np.full(bounds[-1], 32, np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts + 2)
    held = np.ones(len(out), bool)
    held[bounds[:-1]] = False
    held[bounds[1:] - 1] = False
    out[held] = points
    out[(out < 128) & _BLANK[np.minimum(out, 127)]] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (owner[1:] != owner[:-1])
    return out[keep], owner[keep]


def buckets(column: pa.Array) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For stretches of texts, in several goes for long ones: for each n the ascending texts and the buckets of the n-grams.

    Texts without letters and digits, null and empty ones among them, have no n-grams.
    """
    for part in kernel.slices(pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column)):
        points, owner = _characters(part)
        for lo in range(0, len(points), BLOCK):
            block = points[lo : lo + BLOCK + max(LENGTHS) - 1].astype(np.uint64)
            own = owner[lo : lo + BLOCK + max(LENGTHS) - 1]
            value = kernel.mix(block + np.uint64(1))
            hashes, owners, rolled = [], [], value
            for n in range(2, max(LENGTHS) + 1):
                rolled = rolled[:-1] * _BASE + value[n - 1 :]
                if n in LENGTHS and len(rolled):
                    # windows that start in this block and end in their own text
                    inside = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :])
                    inside = inside[inside < BLOCK]
                    hashes.append((kernel.mix(rolled[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
                    owners.append(own[inside] + part.lo)
            yield owners, hashes


def counted(column: pa.Array, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of a column of texts, by text and feature; ``place`` gives the feature of a bucket or -1."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owners, hashes in buckets(column):
        found = []
        for owner, bucket in zip(owners, hashes, strict=True):
            feature = place[bucket]
            known = np.flatnonzero(feature >= 0)
            found.append(owner[known] * size + feature[known])
        key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        keys.append(key)
        counts.append(n)
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
    return keys // size, keys % size, total


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text."""
    text, feature, n = counted(column, model.place, max(len(model.weights), 1))
    z = model.intercept + np.bincount(text, np.log1p(n) * model.weights[feature], len(column))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(bounds: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.1, steps: int = 100, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and intercept of ridge-penalised logistic regression on sparse rows, by limited-memory quasi-Newton steps."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * x[feature], len(y)) + x[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.r_[np.bincount(feature, value * off[row], size) + ridge * x[:-1], off.sum()]
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * x[:-1] @ x[:-1]), slope

    share = (y.sum() + 0.5) / (len(y) + 1)
    x = np.r_[np.zeros(size), np.log(share / (1 - share))]
    if not len(y) or y.min() == y.max():
        return x[:-1], float(x[-1])
    now, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, parts = slope.copy(), []
        for s, d in reversed(past):
            parts.append(s @ step / (s @ d))
            step -= parts[-1] * d
        step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(slope), 1)
        for s, d in past:
            step += s * (parts.pop() - d @ step / (s @ d))
        rate = 1.0
        while True:
            new, new_slope = loss(x - rate * step)
            if new <= now - 1e-4 * rate * (slope @ step) or rate < 1e-8:
                break
            rate /= 2
        if new >= now:
            break
        if (s := -rate * step) @ (d := new_slope - slope) > 1e-12:
            past = [*past, (s, d)][-memory:]
        done = now - new < 1e-6 * now
        x, now, slope = x - rate * step, new, new_slope
        if done:
            break
    return x[:-1], float(x[-1])


def _fold(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def _sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, sample: int) -> DataFrame:
    """(toxic, text) of the labelled rows to fit on, one row an id."""
    known = labels.where((_fold(id_col) != 1) & F.col("toxic").isNotNull()).select(id_col, F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy(id_col).agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.where(F.col(text_col).isNotNull() & (_fold(id_col) != 1)).select(id_col, text_col)
    # at most sample rows of ids, and as many texts of each task
    rows = rows.join(F.broadcast(known), id_col).groupBy(id_col, "toxic").agg(F.min(text_col).alias("text"))
    return rows.select("toxic", "text")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, n): how many documents of a task hold a bucket."""
    held = np.zeros((2, 1 << BITS), np.int32)
    # the last text that held a bucket, and where it last stood in that
    last, at, before = np.full(1 << BITS, -1, np.int64), np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for owners, hashes in buckets(batch.column(1)):
            cuts = [np.searchsorted(o, np.arange(batch.num_rows + 1)) for o in owners]
            for text in np.flatnonzero(np.any([c[1:] > c[:-1] for c in cuts], axis=0)) if cuts else []:
                one = np.concatenate([h[c[text] : c[text + 1]] for h, c in zip(hashes, cuts, strict=True)])
                one = one[last[one] != before + text]
                place = np.arange(len(one))
                at[one] = place
                one = one[at[one] == place]
                last[one] = before + text
                held[toxic[text], one] += 1
        before += batch.num_rows
    for label in (0, 1):
        at = np.flatnonzero(held[label])
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), label, np.int32)), pa.array(held[label][part], pa.int32())], names=["bucket", "toxic", "n"])
    kernel.release()


def ratios(rows: DataFrame, features: int = FEATURES, least: int = LEAST) -> list[tuple[int, float]]:
    """The strongest buckets of (toxic, text) rows with their log-count ratios, by strength and then by bucket.

    A bucket's ratio compares the smoothed shares of the two classes' documents
    that hold it; its strength is the ratio times the root of the documents.
    """
    size = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in size}
    by = rows.mapInArrow(_document_counts, "bucket int, toxic int, n int")
    by = by.groupBy("bucket").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(toxic = 1, 0, n)")).alias("neg"))
    smooth = lambda c, k: (F.col(c) + 0.5) / F.lit(n.get(k, 0) + 1.0)
    by = by.where(F.col("pos") + F.col("neg") >= least).withColumn("ratio", F.log(smooth("pos", 1)) - F.log(smooth("neg", 0)))
    by = by.orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("pos") + F.col("neg"))), "bucket").limit(features)
    return [(r["bucket"], r["ratio"]) for r in by.select("bucket", "ratio").collect()]


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the texts of at most ``sample`` labelled rows whose crc32(id) mod 3 is not 1.

    Rows are taken in the order of a hash of their ids, so the choice is random
    but repeatable. Null labels, ids and texts are left out. An id counts once: of
    its labels the more frequent one, else 0, and of its texts the smallest one.
    Without rows every score is 0.5; with one class only, its smoothed share.
    """
    kernel.tune(docs.sparkSession)
    rows = checkpointed(_sample(docs, labels, text_col, id_col, sample))
    found = ratios(rows)
    place = np.full(1 << BITS, -1, np.int32)
    place[[b for b, _ in found]] = np.arange(len(found))
    ratio = np.array([r for _, r in found])
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, feature, n = counted(batch.column(1), shared.value, max(len(found), 1))
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            pack = lambda v: pa.array([v[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pack(feature), pack(n)], names=["toxic", "features", "counts"])

    # bounded by sample and FEATURES; sorted, so that sums don't depend on the order of tasks
    table = sorted((r["toxic"], bytes(r["features"]), bytes(r["counts"])) for r in rows.mapInArrow(sparse, "toxic int, features binary, counts binary").collect())
    bounds = np.r_[0, np.cumsum([len(r[1]) // 4 for r in table])].astype(np.int64)
    y = np.array([r[0] for r in table], np.float64)
    feature, n = (np.frombuffer(b"".join(r[i] for r in table), "<i4") for i in (1, 2))
    del table
    weights, intercept = logistic(bounds, feature.astype(np.int64), np.log1p(n) * ratio[feature] if len(feature) else np.zeros(0), y, len(ratio))
    return Model(place, weights * ratio, intercept)


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``score`` and ``predicted`` (score >= threshold) appended (replacing such columns).

    Every text, null and empty ones (scored alike) included, gets a score from its
    whole length; repeated rows get the same one; other columns are kept.
    """
    kernel.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    out = docs.drop("score", "predicted").withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            names = batch.schema.names
            new = {"score": pa.array(score(own, batch.column(names.index(text_col))))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
