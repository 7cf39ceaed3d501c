"""Substring deduplication with fixed-block anchors.

Each text is cut into non-overlapping blocks of BLOCK words; every window of
WINDOW words holds a whole one. Blocks are the index, every rolling run of
BLOCK words of every text is a probe. Around each hit, the windows that contain
it are compared whole with all such windows elsewhere, so hits grow into the
maximal exact repeats: the union of the windows that occur more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import exchange, kernel
from turnlens.llm.kernel import BLANK

WINDOW = 35
#: The longest block of which any WINDOW words contain a whole aligned one.
BLOCK = (WINDOW + 1) // 2

_FOUND = "k1 bigint, k2 bigint, places binary"


def _keys(batch: pa.RecordBatch, part: kernel.Slice) -> bytes:
    names = batch.schema.names
    both = [batch.column(names.index(k)).to_numpy(zero_copy_only=False)[part.lo : part.hi] for k in ("k1", "k2")]
    return np.stack(both, axis=1).astype("<i8").tobytes()


def _probes(batch: pa.RecordBatch) -> Iterator[tuple[exchange.Entries, bytes]]:
    """Every rolling block of each text of at least WINDOW words; aligned ones, the index, are flagged."""
    for part in kernel.slices(batch.column(batch.schema.names.index("text"))):
        words = kernel.split(part, BLANK)
        starts = kernel.window_starts(words.bounds, BLOCK)
        owner = kernel.owners(words.bounds)[starts]
        starts = starts[words.counts[owner] >= WINDOW]
        grams = kernel.hash_windows(kernel.hash_words(part, words, BLANK), BLOCK)[starts]
        owner = kernel.owners(words.bounds)[starts]
        yield exchange.Entries(grams, starts, (starts - words.bounds[owner]) % BLOCK == 0, words.bounds), _keys(batch, part)


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[exchange.Entries, bytes]]:
    """The windows around the hits of each text."""
    names = batch.schema.names
    hits = batch.column(names.index("places"))
    for part in kernel.slices(batch.column(names.index("text"))):
        words = kernel.split(part, BLANK)
        near = np.zeros(len(words.starts) + 1, dtype=np.int64)
        for i in range(part.lo, part.hi):
            at = exchange.unpack_places(hits[i].as_py()) + words.bounds[i - part.lo]
            low = np.maximum(at - (WINDOW - BLOCK), words.bounds[i - part.lo])
            np.add.at(near, low, 1)
            np.add.at(near, at + 1, -1)
        starts = kernel.window_starts(words.bounds, WINDOW)
        starts = starts[np.cumsum(near)[starts] > 0]
        whole = kernel.hash_windows(kernel.hash_words(part, words, BLANK), WINDOW)[starts]
        yield exchange.Entries(whole, starts, np.zeros(len(starts), bool), words.bounds), _keys(batch, part)


def _by_text(bounds: np.ndarray, extra: bytes, found: exchange.Found) -> pa.RecordBatch | None:
    """The places of each text that has any, counted from the text's first word."""
    places = found.places
    if not len(places):
        return None
    keys = np.frombuffer(extra, "<i8").reshape(-1, 2)
    owner = np.searchsorted(bounds, places, side="right") - 1
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    tails = np.r_[heads[1:], len(owner)]
    blobs = [exchange.pack_places(places[h:t] - bounds[owner[h]]) for h, t in zip(heads, tails, strict=True)]
    mine = keys[owner[heads]]
    return pa.RecordBatch.from_arrays([pa.array(mine[:, 0]), pa.array(mine[:, 1]), pa.array(blobs, pa.binary())], names=["k1", "k2", "places"])


def _union(found: DataFrame) -> DataFrame:
    """One row a key: repeated rows of a text are answered alike, so any answer will do."""
    return found.groupBy("k1", "k2").agg(F.first("places").alias("places"))


def kept_words(part: kernel.Slice, words: kernel.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    bounds = np.r_[0, np.cumsum(keep)][words.bounds]
    glue = np.ones(len(starts), dtype=np.int64)
    glue[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = 0
    size = ends - starts
    total = np.r_[0, np.cumsum(size + glue)]
    out = np.full(total[-1], 0x20, dtype=np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[step + np.repeat(total[:-1], size)] = part.data[step + np.repeat(starts, size)]
    offsets = total[bounds].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) for each row of ``docs``.

    A word goes if it lies in a window of WINDOW words whose sequence also
    starts anywhere else, in another row or the same text. A null or empty text
    has no words and keeps the empty text; shorter texts than a window keep all.
    Repeated rows repeat each other, so their windows go in each of them. Other
    columns are not read.
    """
    spark = docs.sparkSession
    kernel.tune(spark)
    base = docs.select(
        F.xxhash64(id_col).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    size = exchange.n_words(base, "text")
    hits = exchange.repeated(base, _probes, _by_text, _FOUND, size, width=4, flagged=True)
    # sorted, so that chunks are the same ones should a task run again
    joined = base.join(_union(hits).hint("shuffle_hash"), ["k1", "k2"]).sortWithinPartitions("k1", "k2")
    again = _union(exchange.repeated(joined, _windows, _by_text, _FOUND, size))
    marked = base.join(again.hint("shuffle_hash"), ["k1", "k2"], "left")
    schema = f"id {kernel.field(base, 'id')}, n_words bigint, n_removed bigint, kept_text string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            places = batch.column(names.index("places"))
            for part in kernel.slices(batch.column(names.index("text"))):
                words = kernel.split(part, BLANK)
                found = [
                    exchange.unpack_places(places[i].as_py()) + words.bounds[i - part.lo] for i in range(part.lo, part.hi) if places[i].is_valid
                ]
                gone = kernel.covered(np.concatenate(found) if found else np.zeros(0, np.int64), WINDOW, len(words.starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(names.index("id")).slice(part.lo, part.hi - part.lo),
                        pa.array(words.counts),
                        pa.array(kernel.sums(gone, words.bounds)),
                        kept_words(part, words, ~gone).cast(pa.string()),
                    ],
                    names=["id", "n_words", "n_removed", "kept_text"],
                )
        kernel.release()

    return marked.mapInArrow(remove, schema).withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed and kept_sha256."""
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
