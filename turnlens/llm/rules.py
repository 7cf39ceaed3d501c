"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the
measurements and one failure bit a rule. Policies are versioned sets of bits,
applied afterwards without reading a text again, and ablations (what a rule
removes by itself, what dropping it would give back) are bitwise aggregates of
the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.kernel import ALNUM, BLANK, LINE

REPEAT_WINDOW = 8

_table = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_STOP = _table(".?!")
_PUNCT = _table(".,;:!?")
_BANG = _table("!")
_PIPE = _table("|")
_LEAD = (np.arange(256) & 0xC0) != 0x80

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_chars_all",
    "n_lines",
    "n_upper",
    "n_lower",
    "n_digits",
    "n_stops",
    "n_punct",
    "n_bangs",
    "n_pipes",
    "n_wide",
    "n_alnum_words",
    "n_distinct_words",
    "n_single_words",
    "max_word_chars",
]


def _within(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys made distinct between texts, so that equal ones belong to one text."""
    return kernel.mix(keys ^ kernel.mix(owner.astype(np.uint64) + np.uint64(1)))


def measure(part: kernel.Slice) -> dict[str, np.ndarray]:
    """All measurements of the texts of a slice, as one long per text."""
    words = kernel.split(part, BLANK)
    hashes = kernel.hash_words(part, words, BLANK)
    data, offsets = part.data, part.offsets
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LEAD[data], out=chars[1:])
    out = {"n_words": words.counts, "n_chars_all": chars[offsets[1:]] - chars[offsets[:-1]]}
    length = chars[words.ends] - chars[words.starts]
    out["word_chars"] = kernel.sums(length, words.bounds)
    top = np.zeros(len(offsets) - 1, dtype=np.int64)
    np.maximum.at(top, kernel.owners(words.bounds), length)
    out["max_word_chars"] = top
    for name, table in (
        ("n_symbols", _SYMBOL),
        ("n_upper", _UPPER),
        ("n_lower", _LOWER),
        ("n_digits", _DIGIT),
        ("n_stops", _STOP),
        ("n_punct", _PUNCT),
        ("n_bangs", _BANG),
        ("n_pipes", _PIPE),
    ):
        out[name] = kernel.sums(table[data], offsets)
    out["n_wide"] = kernel.sums((data >= 0x80) & _LEAD[data], offsets)

    lines = kernel.split(part, LINE)
    filled = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(BLANK.member[data], out=filled[1:])
    filled = filled[lines.ends] > filled[lines.starts]
    key = _within(kernel.hash_words(part, lines, LINE), kernel.owners(lines.bounds))
    again = np.zeros(len(key), dtype=bool)
    at = np.flatnonzero(filled)
    _, first = np.unique(key[at], return_index=True)
    again[at] = True
    again[at[first]] = False
    out["n_lines"] = kernel.sums(filled, lines.bounds)
    out["n_dup_lines"] = kernel.sums(again, lines.bounds)

    starts = kernel.window_starts(words.bounds, REPEAT_WINDOW)
    repeated = np.zeros(len(hashes), dtype=bool)
    if len(starts):
        owner = kernel.owners(words.bounds)
        _, group, count = np.unique(
            _within(kernel.hash_windows(hashes, REPEAT_WINDOW)[starts], owner[starts]), return_inverse=True, return_counts=True
        )
        repeated = kernel.covered(starts[count[group] > 1], REPEAT_WINDOW, len(hashes))
    out["n_repeat_words"] = kernel.sums(repeated, words.bounds)

    plain = kernel.split(part, ALNUM)
    key = _within(kernel.hash_words(part, plain, ALNUM), kernel.owners(plain.bounds))
    _, first = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), dtype=bool)
    fresh[first] = True
    out["n_alnum_words"] = plain.counts
    out["n_distinct_words"] = kernel.sums(fresh, plain.bounds)
    out["n_single_words"] = kernel.sums((chars[plain.ends] - chars[plain.starts]) == 1, plain.bounds)
    return {k: out[k].astype(np.int64) for k in MEASURES}


class Rule(NamedTuple):
    """A rule fails where its condition, SQL over the measurements, is true."""

    name: str
    fails: str


#: The place of a rule in this list is its bit; append only.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("shouting", "n_upper > n_lower AND n_upper >= 20"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("numbers", "2 * n_digits > n_chars_all"),
    Rule("bangs", "5 * n_bangs > n_words"),
    Rule("unbroken", "max_word_chars > 1000"),
    Rule("few_distinct", "n_alnum_words >= 100 AND 20 * n_distinct_words < n_alnum_words"),
]
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


class Policy(NamedTuple):
    """A version and the rules whose failure removes a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", tuple(r.name for r in RULES))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the columns MEASURES appended (replacing columns of those names).

    A null or empty text measures 0 throughout; each row is measured by itself.
    """
    kernel.tune(docs.sparkSession)
    out = docs.drop(*MEASURES).withColumns({m: F.lit(0).cast("long") for m in MEASURES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            found = [measure(part) for part in kernel.slices(batch.column(names.index(text_col)))]
            new = {m: pa.array(np.concatenate([f[m] for f in found])) for m in MEASURES} if found else {}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`measured` with ``fail_bits``: bit i is set where RULES[i] fails. An empty text fails few_words only."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text_col).withColumn("fail_bits", bits)


def kept(policy: Policy) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if it were left out.

    One aggregate over the distinct bit patterns, of which there are few.
    """
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    n = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .select("bits", "n", "r.*")
        .groupBy("rule")
        .agg(
            n(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
            n(F.col("bits") == F.col("bit"))("failed_alone"),
            n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"),
        )
        .withColumn("version", F.lit(policy.version))
    )


def digest(docs: DataFrame) -> DataFrame:
    """Per document: the base measurements, base_failed and kept under V1."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~kept(BASE)).alias("base_failed"),
        kept(V1).alias("kept"),
        "fail_bits",
    )
