"""SentencePiece models run by the tokenizers library.

The model file is a protobuf, read here field by field; from it the library's
normaliser, metaspace marker, unigram scores or BPE merges, byte fallback and
decoder are rebuilt. If no piece holds the marker after another character, no
piece can reach from one word into the next, so texts are cut into words and
each distinct word is encoded once for as long as a worker remembers it; new
words go to the library many in a call.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED = 150_000
LONGEST = 64
#: Words that are encoded in one call.
JOINED = 256
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


codecs.register_error("mark_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Model(NamedTuple):
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool


def parse(data: bytes) -> Model:
    """Read a serialised model; absent fields have the format's defaults."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode("utf-8"), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Model(
        pieces,
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
        bool(normalizer.get(5, 1)),
    )


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, the best-scored results first."""
    vocab = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    ways = []
    for piece, i in vocab.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in vocab and right in vocab:
                ways.append((-model.pieces[i][1], i, vocab[left], vocab[right], left, right))
    return [w[4:] for w in sorted(ways)]


def build(model: Model, normalise: bool = True):
    """A tokenizers.Tokenizer that encodes as the model does; without ``normalise`` it takes marked text as it is."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("user-defined pieces are matched before all others, which this backend doesn't do")
    if model.kind == UNIGRAM:
        unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if model.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Encoder(dict):
    """Word to its ids, as the bytes of 32-bit integers; words not seen yet are encoded in batches."""

    def __init__(self, data: bytes):
        super().__init__()
        self.model = parse(data)
        marked = re.compile(f"[^{MARK}]{MARK}")
        self.by_word = (
            not self.model.charsmap
            and self.model.escape_spaces
            and not self.model.trim_spaces
            and not any(marked.search(p) for p, _, kind in self.model.pieces if kind == NORMAL)
        )
        kinds = [kind for _, _, kind in self.model.pieces]
        # merges don't reach over the start of a word, and with a piece for each byte none is unknown
        self.joined = self.by_word and self.model.kind == BPE and self.model.byte_fallback and kinds.count(BYTE) == 256
        # one of the two is enough
        self.backend = build(self.model, normalise=not self.by_word)
        self.lengths = np.array([1 if kind == BYTE else len(p.encode("utf-8")) for p, _, kind in self.model.pieces])
        self.pieces = pa.array([_bytes(p, kind) for p, _, kind in self.model.pieces], pa.large_binary())

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<i4").tobytes() for e in self.backend.encode_batch(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words that start with the marker and don't end in it, many words in one call, cut apart by their pieces' bytes."""
        groups = ["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, dtype="<i4") for e in self.backend.encode_batch_fast(groups, add_special_tokens=False)])
        reached = np.r_[0, np.cumsum(self.lengths[ids])]
        ends = np.cumsum([len(w.encode("utf-8")) for w in words])
        at = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[at] != ends).any():
            return self._each(words)
        whole, cuts = ids.tobytes(), (4 * at).tolist()
        return [whole[i:j] for i, j in zip([0, *cuts], cuts)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w[0] == MARK != w[-1]] if self.joined else []
        out = dict(zip(plain, self._together(plain), strict=True)) if plain else {}
        other = [w for w in words if w not in out]
        if other:
            out.update(zip(other, self._each(other), strict=True))
        if len(self) > REMEMBERED:
            self.clear()
        self.update((w, b) for w, b in out.items() if len(w) <= LONGEST)
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.get, words))
        new = [w for w, b in zip(words, found) if b is None]
        if not new:
            return found
        learned = self._learn(new)
        return [learned[w] if b is None else b for w, b in zip(words, found)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the bounds of each text's; a null counts as an empty text."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.by_word:
            blobs = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(blobs), "<i4"), np.r_[0, np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)]
        data, offsets, starts = _words(texts, self.model.dummy_prefix)
        if not len(starts):
            return np.zeros(0, "<i4"), np.zeros(len(texts) + 1, np.int64)
        ends = pa.py_buffer(np.r_[starts, len(data)])
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        blobs = self._ids(coded.dictionary.to_pylist())
        sizes = np.array([len(b) // 4 for b in blobs])
        index = coded.indices.to_numpy()
        counts = sizes[index]
        upto = np.r_[0, np.cumsum(counts)]
        heads = (np.cumsum(sizes) - sizes)[index]
        values = np.frombuffer(b"".join(blobs), "<i4")[np.repeat(heads - upto[:-1], counts) + np.arange(upto[-1])]
        return values, upto[np.searchsorted(starts, offsets)]

    def decode(self, values: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts that ids stand for, from their pieces' bytes, as the model's own library gives them."""
        taken = self.pieces.take(pa.array(values))
        data = taken.buffers()[2]
        whole = data.to_pybytes() if data is not None else b""
        upto = np.frombuffer(taken.buffers()[1], np.int64)[bounds].tolist() if len(values) else [0] * len(bounds)
        out = []
        for i, (start, end) in enumerate(zip(upto, upto[1:])):
            ids = map(self.model.pieces.__getitem__, values[bounds[i] : bounds[i + 1]])
            first = next((p for p, _, kind in ids if kind != CONTROL), "")
            start += self.model.dummy_prefix and first.startswith(MARK)
            out.append(whole[start:end].decode("utf-8", errors="mark_each_byte"))
        return out


def _words(texts: pa.Array, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts with markers for spaces, where each text ends, from 0 on, and where each word starts: at a marker after no marker, or with a text."""
    mark = pa.scalar(MARK, pa.large_string())
    marked = pc.replace_substring(texts, " ", MARK)
    if prefix:
        none = pa.scalar("", pa.large_string())
        marked = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(mark, marked, none))
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    held = marked.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    a, b, c = MARK.encode("utf-8")
    at = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)
    after, first = np.zeros(len(data) + 1, bool), np.zeros(len(data), bool)
    after[at + len(MARK.encode("utf-8"))] = True
    first[at[~after[at]]] = True
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return data, offsets, np.flatnonzero(first)


def _bytes(piece: str, kind: int) -> bytes:
    """What a piece adds to a decoded text."""
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    return {CONTROL: b"", UNKNOWN: " \u2047 ".encode()}.get(kind, piece.replace(MARK, " ").encode("utf-8"))


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    """A worker's encoder of a model, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Encoder(data)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``tokens`` (array of ids) appended, and ``decoded`` where asked for.

    No begin or end ids. A null or empty text has no tokens and decodes to the
    empty text. The model file is read once, on the driver; each batch is
    encoded and decoded by several threads. Rows and other columns are kept;
    columns named like the results are replaced.
    """
    spark = docs.sparkSession
    kernel.tune(spark)
    shared = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    out = docs.drop("tokens", "decoded").withColumn("tokens", F.array().cast("array<int>"))
    if decode:
        out = out.withColumn("decoded", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text_col))
            for part in kernel.slices(column):
                rows = batch.slice(part.lo, part.hi - part.lo)
                values, bounds = encoder.encode(column.slice(part.lo, part.hi - part.lo))
                new = {"tokens": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))}
                if decode:
                    new["decoded"] = pa.array(encoder.decode(values, bounds), pa.string())
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema)


def decode(encoded: DataFrame, model_path: str, tokens_col: str = "tokens") -> DataFrame:
    """All rows with ``decoded`` appended, the text that ``tokens_col`` stands for; null tokens give null."""
    spark = encoded.sparkSession
    kernel.tune(spark)
    shared = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    out = encoded.drop("decoded").withColumn("decoded", F.lit("").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index(tokens_col))
            bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
            texts = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            held = lists.is_valid().to_pylist()
            new = pa.array([t if x else None for t, x in zip(texts, held, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "decoded" else batch.column(i) for i, c in enumerate(names)], names=names)

    return out.mapInArrow(run, "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in out.schema) + ">")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 (ids joined by commas) and round_trip (decoding gives the text, its markers as spaces)."""
    out = encode(docs.select("doc_id", "text"), model_path, decode=True)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return out.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == plain).alias("round_trip"),
    )
