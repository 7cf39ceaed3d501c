"""Latent Dirichlet allocation by batch variational inference: a Spark job a pass, every turn in each."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is settled when its parameters change by no more than this on average.
SETTLED = 1e-3
#: Turns and bytes gathered at a time, and places of words (turns times the words of the longest) worked on at a time.
TURNS, BYTES, PLACES = 1 << 13, 1 << 26, 1 << 15
#: The part of the turns worked on that is settled when others take their place.
LEAVE = 0.2
#: Tasks' sums are added as whole multiples of 1 / UNIT, so that their order does not matter.
UNIT = 1 << 24
_TINY = 1e-100


class Topics(NamedTuple):
    """The weights of topics, a row a word and a column a topic; the prior of a turn's share is 1 / k."""

    weights: np.ndarray

    def topicsMatrix(self) -> DenseMatrix:  # noqa: N802, as MLlib's models have it
        return DenseMatrix(*self.weights.shape, self.weights.ravel(order="F"))

    def transform(self, counted: DataFrame) -> DataFrame:
        """``counted`` with ``topicDistribution``, the shares of each turn, instead of ``counts``."""
        likely, kept = _likely(self.weights), [c for c in counted.columns if c != "counts"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches):
                shares = np.empty((batch.num_rows, likely.shape[1]))
                for rows, gamma, _, _, _ in _settled(batch.column("counts"), likely):
                    shares[rows] = gamma / gamma.sum(1, keepdims=True)
                bounds = np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(bounds, shares.ravel())], [*kept, "topicDistribution"])

        schema = counted.select(*kept, F.array(F.lit(0.0)).alias("topicDistribution")).schema
        return counted.mapInArrow(run, schema).withColumn("topicDistribution", array_to_vector("topicDistribution"))

    def next(self, counted: DataFrame) -> Topics:
        """The topics after one more pass over all turns; at most a row a word comes to the driver."""
        likely = _likely(self.weights)
        size, k = likely.shape
        names = [f"t{t}" for t in range(k)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, size))
            for batch in _gathered(batches):
                for _, _, places, theta, rate in _settled(batch.column("counts"), likely):
                    for t in range(k):
                        total[t] += np.bincount(places.ravel(), (rate * theta[:, t, None]).ravel(), size)
            held = np.flatnonzero(total.any(0))
            whole = np.rint(total[:, held] * likely[held].T * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *map(pa.array, whole)], ["word", *names])

        parts = counted.select("counts").mapInArrow(run, "word int, " + ", ".join(f"{n} bigint" for n in names))
        weights = np.full((size, k), 1.0 / k)
        for r in parts.groupBy("word").agg(*[F.sum(n) for n in names]).collect():
            weights[r[0]] += np.array(r[1:]) / UNIT
        return Topics(weights)


def _likely(weights: np.ndarray) -> np.ndarray:
    """exp E[log p(word | topic)]."""
    return exp_digamma(weights) / exp_digamma(weights.sum(0))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) of positive numbers: six steps up, their reciprocals as one fraction, then the asymptotic series."""
    z, y = x * (x + 5), x + 6
    steps = (2 * x + 5) * (z * (3 * z + 20) + 24) / (z * (z * (z + 10) + 24))
    r = 1 / y
    s = r * r
    return y * np.exp(-steps - 0.5 * r - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132)))))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about TURNS rows or BYTES: the last turns of a block to settle have its steps to themselves."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TURNS or sum(b.nbytes for b in held) >= BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _settled(counts: pa.StructArray, likely: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, gamma, places of words, theta, count / norm of each word) of turns, given as sparse vectors, some at a time as they settle.

    At most PLACES words are worked on at once, and other turns take the place of those
    that are settled, the shortest first: a slow one is padded to the width of the longer
    ones it is left with, and few steps are made for slow ones alone but at the end.
    """
    indices, values = counts.field("indices"), counts.field("values")
    starts = indices.offsets.to_numpy()
    # a place behind the last for turns without words
    words, held = np.r_[indices.values.to_numpy(), 0], np.r_[values.values.to_numpy(), 0.0]
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    widths = np.maximum(sizes[order], 1)
    lo, k = 0, likely.shape[1]
    rows, places, n, near, gamma = order[:0], np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, k, 0)), np.ones((0, k))
    while lo < len(order) or len(rows):
        taken = np.count_nonzero((len(rows) + np.arange(1, len(order) - lo + 1)) * widths[lo:] <= PLACES)
        new = order[lo : lo + max(taken, not len(rows))]
        if len(new):
            lo += len(new)
            width = np.arange(widths[lo - 1])
            at = np.where(width < sizes[new, None], starts[new, None] + width, len(words) - 1)
            rows, gamma = np.r_[rows, new], np.r_[gamma, np.ones((len(new), k))]
            places, n = _below(places, words[at]), _below(n, held[at])
            near = _below(near, likely[words[at]].transpose(0, 2, 1))
        gamma, theta, settled = _settle(near, n, gamma)
        yield rows[settled], gamma[settled], places[settled], theta[settled], _rate(near[settled], n[settled], theta[settled])
        rows, places, n, near, gamma = (x[~settled] for x in (rows, places, n, near, gamma))


def _below(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The rows of ``old``, filled up with zeros to the width of ``new``, and those of ``new``."""
    both = np.zeros((len(old) + len(new), *new.shape[1:]), new.dtype)
    both[: len(old), ..., : old.shape[-1]] = old
    both[len(old) :] = new
    return both


def _settle(near: np.ndarray, n: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gamma, theta, whether settled) after steps until some turns are settled; a settled one keeps its values, whatever the others do."""
    k = gamma.shape[1]
    theta, settled = exp_digamma(gamma), np.zeros(len(n), bool)
    while np.count_nonzero(settled) < LEAVE * len(n):
        last, gamma = gamma, theta * np.matmul(near, _rate(near, n, theta)[:, :, None])[:, :, 0] + 1.0 / k
        np.copyto(gamma, last, where=settled[:, None])
        theta = exp_digamma(gamma)
        settled = np.abs(gamma - last).sum(1) <= SETTLED * k
    return gamma, theta, settled


def _rate(near: np.ndarray, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return n / (np.matmul(theta[:, None, :], near)[:, 0, :] + _TINY)
