"""Benchmark decontamination by winnowing.

Of every window of ``w`` consecutive k-grams the smallest hash is kept as a
fingerprint, with ``w + k - 1`` equal to the length of the span to be found, so
a document and a benchmark item that share a span of that length share the
fingerprint chosen inside it. Shared fingerprints are extended to the whole
spans around them, compared word by word, and every word of a matching span is
a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import checkpointed
from turnlens.llm.kernel import ALNUM

SPAN = 13
GRAM = 5
#: Bytes of benchmark text indexed at once; an index takes about ten times that.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if hits are at least this share (one in ...) of its words.
SHARE = 20


def fingerprints(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions kept by winnowing: the rightmost minimum of each window of ``width`` grams.

    ``grams`` has a hash at every position; ``starts`` are the positions where a
    whole span begins, hence where a window of ``width`` grams begins.
    """
    if not len(starts):
        return starts
    best, at = grams[starts], starts.copy()
    for j in range(1, width):
        other = grams[starts + j]
        less = other <= best
        best = np.where(less, other, best)
        at[less] = starts[less] + j
    return np.unique(at)


class Index:
    """Fingerprints, spans and items of a bounded block of benchmark texts."""

    def __init__(self, ids: list, texts: list[str]):
        keep = [(i, t) for i, t in zip(ids, texts, strict=True) if t]
        self.ids = [i for i, _ in keep]
        parts = []
        for part in kernel.slices(pa.array([t for _, t in keep], pa.large_string()), 1 << 62):
            words = kernel.split(part, ALNUM)
            parts.append((kernel.hash_words(part, words, ALNUM), words.bounds))
        self.words, self.bounds = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        counts = np.diff(self.bounds)
        owner = kernel.owners(self.bounds)
        self.classes = []
        for span in sorted({min(SPAN, int(n)) for n in counts if n}):
            rows = np.flatnonzero(counts >= SPAN) if span == SPAN else np.flatnonzero(counts == span)
            starts = kernel.window_starts(self.bounds, span)
            starts = starts[np.isin(owner[starts], rows)]
            k = min(GRAM, span)
            grams = kernel.hash_windows(self.words, k)
            spans = kernel.hash_windows(self.words, span)[starts]
            order = np.argsort(spans, kind="stable")
            spans, places = spans[order], starts[order]
            heads = np.flatnonzero(np.r_[True, spans[1:] != spans[:-1]]) if len(spans) else np.zeros(0, np.int64)
            prints = np.unique(grams[fingerprints(grams, starts, span - k + 1)])
            self.classes.append(
                {
                    "span": span,
                    "k": k,
                    "prints": prints,
                    "hashes": spans[heads],
                    "heads": np.r_[heads, len(spans)],
                    "places": places,
                    "items": owner[places],
                }
            )


def _join(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hit flag of each word, and (text, item) pairs that share a span."""
    hit = np.zeros(len(hashes), dtype=bool)
    texts, items = [], []
    owner = kernel.owners(bounds)
    for c in index.classes:
        starts = kernel.window_starts(bounds, c["span"])
        if not len(starts) or not len(c["prints"]):
            continue
        grams = kernel.hash_windows(hashes, c["k"])
        width = c["span"] - c["k"] + 1
        kept = fingerprints(grams, starts, width)
        near = np.minimum(np.searchsorted(c["prints"], grams[kept]), len(c["prints"]) - 1)
        kept = kept[c["prints"][near] == grams[kept]]
        if not len(kept):
            continue
        # every span that contains a shared fingerprint
        around = np.unique((kept[:, None] - np.arange(width)).ravel())
        around = around[np.isin(around, starts, assume_unique=True)]
        spans = kernel.hash_windows(hashes, c["span"])[around]
        near = np.minimum(np.searchsorted(c["hashes"], spans), len(c["hashes"]) - 1)
        same = c["hashes"][near] == spans
        around, near = around[same], near[same]
        steps = np.arange(c["span"])
        place = c["places"][c["heads"][near]]
        same = (hashes[around[:, None] + steps] == index.words[place[:, None] + steps]).all(axis=1)
        around, near = around[same], near[same]
        hit |= kernel.covered(around, c["span"], len(hashes))
        low, high = c["heads"][near], c["heads"][near + 1]
        # one entry for each text and distinct span, however often it occurs
        pairs = np.unique(np.stack([owner[around], near]), axis=1)
        low, high = c["heads"][pairs[1]], c["heads"][pairs[1] + 1]
        lengths = high - low
        texts.append(np.repeat(pairs[0], lengths))
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(low, lengths)
        items.append(c["items"][at])
    return hit, texts, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of about BLOCK_BYTES, dealt by a hash of the item's id."""
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(item_col), F.lit(n)) == b) if n > 1 else benchmark
        rows = part.select(F.col(item_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``hits`` (ranges of hit words) and ``items`` appended.

    The benchmark, not the documents, is brought to the workers, in blocks of
    bounded size: each block is one more narrow pass over the documents, which
    are never shuffled; between passes the rows are checkpointed. A null or
    empty text has no words; items without words match nothing; repeated items
    and documents are each reported; rows and their other columns are kept.
    Columns of ``docs`` named like the three results are replaced.
    """
    spark = docs.sparkSession
    kernel.tune(spark)
    out = docs.drop("n_words", "hits", "items").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hits": F.array().cast("array<long>"),
            "items": F.array().cast("array<string>"),
        }
    )
    schema = out.schema
    for b, (ids, texts) in enumerate(_blocks(benchmark, item_col, item_text)):
        shared = spark.sparkContext.broadcast(Index(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                names = batch.schema.names
                n_words, hits = np.zeros(batch.num_rows, np.int64), batch.column(names.index("hits")).to_pylist()
                items = batch.column(names.index("items")).to_pylist()
                for part in kernel.slices(batch.column(names.index(text_col))):
                    words = kernel.split(part, ALNUM)
                    n_words[part.lo : part.hi] = words.counts
                    hit, where, which = _join(index, kernel.hash_words(part, words, ALNUM), words.bounds)
                    owner = kernel.owners(words.bounds)
                    if hit.any():
                        edge = np.r_[True, owner[1:] != owner[:-1]]
                        first = np.flatnonzero(hit & (~np.r_[False, hit[:-1]] | edge))
                        last = np.flatnonzero(hit & (~np.r_[hit[1:], False] | np.r_[edge[1:], True])) + 1
                        for d, x, y in zip(owner[first], first, last, strict=True):
                            base = words.bounds[d]
                            hits[part.lo + d] = [*hits[part.lo + d], int(x - base), int(y - base)]
                    if where:
                        pairs = np.unique(np.stack([np.concatenate(where), np.concatenate(which)]), axis=1)
                        for d, i in pairs.T:
                            items[part.lo + d] = [*items[part.lo + d], index.ids[i]]
                new = {
                    "n_words": pa.array(n_words),
                    "hits": pa.array(hits, pa.list_(pa.int64())),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
            kernel.release()

        out = (checkpointed(out) if b else out).mapInArrow(run, schema)
    return out


def _n_hit(ranges: str) -> F.Column:
    """Length of the union of [start, end) ranges kept as a flat array."""
    pairs = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), (F.size(ranges) / 2).cast("int") - 1),
            lambda i: F.struct(F.get(ranges, i * 2).alias("s"), F.get(ranges, i * 2 + 1).alias("e")),
        )
    )
    merged = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], r["e"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(ranges) == 0, F.lit(0).cast("long")).otherwise(merged)


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """:func:`overlaps` with ``n_hit`` and ``contaminated`` (at least one word in SHARE is a hit)."""
    out = overlaps(docs, benchmark, text_col, item_col, item_text).drop("n_hit", "contaminated")
    out = out.withColumn("n_hit", _n_hit("hits"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are named.

    A null or empty text is clean; repeated rows stay or go together; an empty
    benchmark leaves everything.
    """
    own, text = kernel.shielded(docs, text_col)
    return flagged(own, benchmark, text).where(~F.col("contaminated")).select(*own.columns).toDF(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    out = flagged(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct("items"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )
