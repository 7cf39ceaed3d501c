"""Token counts with a whole-token shortcut.

Once, on the driver, every vocabulary string is encoded by itself; those that
give a single token are proven shortcuts. Counting then splits a text into
pre-tokens, adds one for each proven pre-token, and lets the library merge only
the others, each distinct one once for as long as a worker remembers it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel

#: The split of byte-level BPE vocabularies, a fixed value of the format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Merged pre-tokens a worker remembers; beyond it forgets them all and goes on.
REMEMBERED = 300_000
#: Longer pre-tokens are merged each time rather than remembered.
LONGEST = 64


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: a byte that prints stands for itself, others follow from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_shortcuts(model: str) -> frozenset[str]:
    """Vocabulary strings, as text, that the library encodes alone as one token and that are one pre-token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    alphabet = _byte_alphabet()
    texts = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(alphabet[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    whole = regex.compile(PRETOKEN)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1 and whole.fullmatch(t))


def applies(model: str) -> bool:
    """Whether the shortcut is valid for this tokenizer: byte-level BPE, the usual split, no normaliser or prefix."""
    spec = json.loads(model)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
    )


class Counter(dict):
    """Pre-token to number of tokens: proven ones from the start, others once merged."""

    def __init__(self, model: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(proven, 1))
        self.proven = proven
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in json.loads(model).get("added_tokens") or []]
        self.find = regex.compile(PRETOKEN).findall

    def __missing__(self, piece: str) -> int:
        # forgotten or too long to remember
        return self.learn([piece])[0]

    def learn(self, pieces: list[str]) -> list[int]:
        found = [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        if len(self) > REMEMBERED + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        for p, n in zip(pieces, found, strict=True):
            if len(p) <= LONGEST:
                self[p] = n
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; all pre-tokens not known yet are merged in one batch."""
        special = [any(s in t for s in self.special) for t in texts]
        pieces = [[] if s else self.find(t) for s, t in zip(special, texts, strict=True)]
        new = [p for p in set().union(*pieces).difference(self.keys()) if len(p) <= LONGEST]
        if new:
            self.learn(new)
        whole = iter(self.tokenizer.encode_batch([t for s, t in zip(special, texts, strict=True) if s], add_special_tokens=False))
        return [len(next(whole).ids) if s else sum(map(self.__getitem__, p)) for s, p in zip(special, pieces, strict=True)]


@lru_cache(maxsize=2)
def _counter(model: str, proven: frozenset[str]) -> Counter:
    """A worker's counter of a model, kept from task to task."""
    return Counter(model, proven)


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """All rows of ``docs`` with n_bytes, n_tokens and over_limit appended.

    Counts equal ``len(encode(text, add_special_tokens=False))`` of the library.
    A null or empty text has 0 bytes and 0 tokens; every row is counted by
    itself, so repeated rows are repeated; other columns are kept, and columns
    named like the results are replaced. A tokenizer for which the shortcut is
    not valid is run whole. The model file is read once, on the driver.
    """
    kernel.tune(docs.sparkSession)
    model = Path(tokenizer_path).read_text(encoding="utf-8")
    fast = applies(model)
    proven = prove_shortcuts(model) if fast else frozenset()
    shared = docs.sparkSession.sparkContext.broadcast((model, proven))
    base = docs.drop("n_bytes", "n_tokens", "over_limit")
    out = base.withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col))
            size, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for part in kernel.slices(texts):
                held = [t or "" for t in texts.slice(part.lo, part.hi - part.lo).to_pylist()]
                size[part.lo : part.hi] = np.diff(part.offsets)
                if fast:
                    tokens[part.lo : part.hi] = counter.count(held)
                else:
                    tokens[part.lo : part.hi] = [len(e.ids) for e in counter.tokenizer.encode_batch(held, add_special_tokens=False)]
            new = {"n_bytes": pa.array(size), "n_tokens": pa.array(tokens)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema).withColumn("over_limit", F.col("n_tokens") > limit)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: n_bytes, n_tokens and over_limit."""
    return count_tokens(docs.select("doc_id", "text"), tokenizer_path).select("doc_id", "n_bytes", "n_tokens", "over_limit")
