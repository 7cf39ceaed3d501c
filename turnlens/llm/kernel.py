"""Vectorised word and window kernels over Arrow string columns.

Texts are worked on as UTF-8 bytes: every separator class in use is ASCII, so
splitting bytes equals splitting code points. A column is cut into slices of a
bounded number of bytes (one longer text is a slice of its own), so a worker's
memory does not grow with the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
_PROCESS = ctypes.CDLL(None)
U64 = np.uint64
_WORD_BASE = U64(0x9E3779B97F4A7C15)
_GRAM_BASE = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xA0761D6478BD642F))
_LOWER_VALUE = _BYTE_VALUE.copy()
_LOWER_VALUE[65:91] = _BYTE_VALUE[97:123]


class WordClass(NamedTuple):
    """Which bytes belong to a word, and the hash value of each byte."""

    member: np.ndarray
    value: np.ndarray


def _members(separators) -> np.ndarray:
    member = np.ones(256, dtype=bool)
    member[list(separators)] = False
    return member


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased first.
ALNUM = WordClass(
    _members([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), _LOWER_VALUE
)
#: Words are runs of anything but ASCII white space, unchanged.
BLANK = WordClass(_members(_SPACES), _BYTE_VALUE)
#: The same with A-Z lower-cased.
BLANK_LOWER = WordClass(_members(_SPACES), _LOWER_VALUE)
#: "Words" are whole non-empty lines.
LINE = WordClass(_members([0x0A]), _BYTE_VALUE)


class Slice(NamedTuple):
    """Rows ``lo:hi`` of a batch: their bytes and ``hi - lo + 1`` offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte starts and ends of all words of a slice, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def release() -> None:
    """Give freed memory back to the system, for a worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_PROCESS, "malloc_trim"):
        _PROCESS.malloc_trim(0)


def tune(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; a null counts as an empty text."""
    if len(column) == 0:
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.string())
    wide = pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    raw = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(raw, raw[lo] + max_bytes, side="right")) - 1)
        yield Slice(lo, hi, data[raw[lo] : raw[hi]], raw[lo : hi + 1] - raw[lo])
        lo = hi


def split(part: Slice, kind: WordClass) -> Words:
    """Find the words; none spans two texts."""
    inside = kind.member[part.data]
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin = part.offsets[:-1]
        begin = begin[begin < n]
        first[begin] = inside[begin]
        end = part.offsets[1:] - 1
        end = end[end >= 0]
        last[end] = inside[end]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, part.offsets))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def hash_words(part: Slice, words: Words, kind: WordClass) -> np.ndarray:
    """One 64-bit hash for each word, the same wherever the word stands."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = words.ends - words.starts
    heads = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=heads[1:])
    value = kind.value[part.data[kind.member[part.data]]]
    place = np.arange(len(value)) - np.repeat(heads, lengths)
    value = value * powers(_WORD_BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))


def hash_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words: ``len(hashes) - k + 1`` of them, whatever k, in a few passes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power = powers(_GRAM_BASE, n)
    inverse = powers(U64(pow(int(_GRAM_BASE), -1, 1 << 64)), n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(hashes) * power, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1] + U64(k))


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which a window of k words of one text starts, ascending."""
    if not bounds[-1] - k + 1 > 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(bounds[0], bounds[-1])
    return at[at + k <= ends]


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of ``starts``."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + k, -1)
    return np.cumsum(delta[:-1]) > 0


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive bounds; empty stretches give 0."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shielded(docs: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``docs`` under private names, whatever the caller's are, and the private name of ``column``; ``toDF`` gives the names back."""
    return docs.toDF(*[f"_own{i}" for i in range(len(docs.columns))]), f"_own{docs.columns.index(column)}"


def field(frame: DataFrame, name: str) -> str:
    """The type of a column in DDL."""
    return frame.schema[name].dataType.simpleString()
