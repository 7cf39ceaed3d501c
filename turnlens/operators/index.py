"""A positional inverted index of turns: for each word the turns that hold it, with its places and offsets in them.

A turn is indexed within its row; the only shuffle clusters the postings by word.
A search reads the bucket of each of its words, and for a phrase intersects the
places of its words turn by turn. Offsets count characters of the lower-cased
text; places and offsets are stored as differences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from turnlens.functions import text as T
from turnlens.operators import kwic

BUCKETS = 64
#: Tasks that write one bucket, so that a word of very many turns isn't one task's.
SPREAD = 4
_INTS = ArrayType(IntegerType())
_POSTINGS = ArrayType(StructType().add("word", StringType()).add("places", _INTS).add("offsets", _INTS))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and how many each row has."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each value less the one before it; the first ones of their lists as they are."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out.astype(np.int32)


@arrow_udf(_POSTINGS)
def _postings(words: pa.Array, gaps: pa.Array) -> pa.Array:
    """The distinct words of each text with their places and offsets; ``gaps`` has what stands before each word, and behind the last one."""
    word, n = _lists(words)
    gap, n_gaps = _lists(gaps)
    size, before = pc.utf8_length(word).to_numpy().astype(np.int64), pc.utf8_length(gap).to_numpy().astype(np.int64)
    row, place = np.repeat(np.arange(len(n)), n), np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n)
    # of a row's gaps the last one belongs to no word
    before = before[np.arange(len(size)) + np.repeat(np.cumsum(n_gaps) - n_gaps - (np.cumsum(n) - n), n)]
    ends = np.cumsum(before + size)
    first = np.repeat(np.r_[0, ends][np.cumsum(n) - n], n)
    offset = ends - size - first
    coded = word.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((place, code, row))
    row, code, place, offset = row[order], code[order], place[order], offset[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])][: len(row)])
    bounds = pa.array(np.r_[new, len(row)], pa.int32())
    ints = lambda v: pa.ListArray.from_arrays(bounds, pa.array(_gaps(v, new)))
    held = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[new])), ints(place), ints(offset)], ["word", "places", "offsets"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(n)))], pa.int32()), held)


@arrow_udf(_INTS)
def _sums(gaps: pa.Array) -> pa.Array:
    """Differences back to values."""
    value, n = _lists(gaps)
    total = np.cumsum(value.to_numpy().astype(np.int64))
    start = np.r_[0, total][np.cumsum(n) - n]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array((total - np.repeat(start, n)).astype(np.int32)))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def postings(turns: DataFrame, keys: list[str], text: str = "texto") -> DataFrame:
    """(word, keys, places, offsets, bucket): a row for each distinct word of each turn; ``keys`` identify a turn."""
    low = F.lower(text)
    words, gaps = F.regexp_extract_all(low, F.lit(f"[{T.LETTERS}]+"), F.lit(0)), F.split(low, f"[{T.LETTERS}]+", -1)
    # without words there is one gap
    rows = turns.where(F.col(text).isNotNull()).select(*keys, F.inline(_postings(words, gaps)))
    return rows.withColumn("bucket", _bucket(F.col("word")))


def write(turns: DataFrame, keys: list[str], path: str, text: str = "texto") -> None:
    """The postings as Parquet, a folder for each bucket of words, sorted by word, so that a search skips other folders and row groups."""
    rows = postings(turns, keys, text).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "word", *keys).drop("part")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _parts(term: str) -> list[tuple[str, int]]:
    """The words of a term with their offsets in it."""
    return [(m[0], m.start()) for m in re.finditer(f"[{T.LETTERS}]+", term)]


def bucket_of(index: DataFrame, word: str) -> DataFrame:
    """The postings of one word: one folder is read."""
    spark = index.sparkSession
    number = spark.range(1).select(_bucket(F.lit(word))).first()[0]
    return index.where((F.col("bucket") == number) & (F.col("word") == word))


def _less(places: Column, n: int) -> Column:
    return F.transform(places, lambda p: p - n)


def matches(index: DataFrame, keys: list[str], term: str) -> DataFrame:
    """(keys, starts): where each turn may hold a term: its words stand one behind the other. The text between them is not looked at."""
    found = None
    parts = _parts(term)
    for i, (word, _) in enumerate(parts):
        own = bucket_of(index, word).select(*keys, _sums("places").alias(f"p{i}"), *([_sums("offsets").alias("o")] if i == 0 else []))
        found = own if found is None else found.join(own, keys)
    held = F.arrays_zip(F.col("p0").alias("p"), F.col("o").alias("o"))
    follows = F.array_intersect("p0", "p0")
    for i in range(1, len(parts)):
        follows = F.array_intersect(follows, _less(F.col(f"p{i}"), i))
    rows = found.select(*keys, held.alias("h"), F.explode(F.array(follows)).alias("f"))
    inside = F.filter("h", lambda s: F.array_contains(F.col("f"), s["p"])) if len(parts) > 1 else F.col("h")
    return rows.select(*keys, F.transform(inside, lambda s: s["o"] - parts[0][1]).alias("starts"))


def _apart(starts: Column, size: int) -> Column:
    """Of ascending starts those that don't lie in an earlier match, the first ones first."""
    zero = F.struct(F.lit(-size).alias("last"), F.array().cast("array<int>").alias("out"))
    step = lambda a, s: F.when(s >= a["last"] + size, F.struct(s.alias("last"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)
    return F.aggregate(starts, zero, step, lambda a: a["out"])


def search(index: DataFrame, turns: DataFrame, keys: list[str], term: str, around: int = kwic.WINDOW, text: str = "texto") -> DataFrame:
    """What kwic.hits finds, from the index: all columns of ``turns`` with ``at`` and ``ctx`` of each match of a word or phrase.

    Only turns that hold the words in their order are joined with the index. A
    term without a letter is not indexed, and is searched for in all texts.
    """
    if not _parts(term):
        return kwic.hits(turns, term, around)
    found = turns.join(matches(index, keys, term).where(F.size("starts") > 0), keys).withColumn("_low", F.lower(text))
    if term == _parts(term)[0][0]:
        starts = F.col("starts")
    else:
        letter = f"[{T.LETTERS}]"
        plain = lambda s: (s >= 0) & (F.substr("_low", s + 1, F.lit(len(term))) == term)
        alone = lambda s: ~F.substr("_low", s, F.when(s > 0, 1).otherwise(0)).rlike(letter) & ~F.substr("_low", s + len(term) + 1, F.lit(1)).rlike(letter)
        starts = _apart(F.filter("starts", lambda s: plain(s) & alone(s)), len(term))
    rows = found.withColumn("at", F.explode(starts)).drop("starts", "_low")
    return rows.withColumn("ctx", T.context(F.col(text), F.col("at"), len(term), around)).select(*turns.columns, "at", "ctx")
