"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

A is a byte-level BPE run by the tokenizers library, B a SentencePiece model.
Over the bytes of a text two owner arrays say which token of A and which of B
each byte belongs to: consecutive distinct pairs of owners are overlaps, places
where both owners change are cuts, and the tokens between two cuts a group.

A single blank between two characters that are no white space always starts a
token of both (where the two vocabularies allow it, which is proven from their
files), so a text is cut there and each distinct stretch is aligned once for as
long as a worker remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm import kernel, spm, tokencount
from turnlens.llm.durable import shared_folder
from turnlens.llm.exchange import pack_numbers, unpack_numbers

#: Stretches a worker remembers; beyond it forgets them all and goes on. Longer ones than LONGEST are not remembered.
REMEMBERED = 250_000
LONGEST = 64
#: Bytes of texts whose links are packed together; one longer text is a chunk of its own.
CHUNK = 4 << 20

_NEAR_BLANKS = re.compile(r"\s | \s")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Owners:
    """Cuts, groups and overlaps of some texts whose tokens of A and B, one after the other, cover the same bytes."""

    def __init__(self, len_a: np.ndarray, len_b: np.ndarray):
        own_a, own_b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
        new_a, new_b = np.r_[True, own_a[1:] != own_a[:-1]], np.r_[True, own_b[1:] != own_b[:-1]]
        if not len(own_a):
            new_a = new_b = np.zeros(0, bool)
        group = np.cumsum(new_a & new_b) - 1
        overlap = np.flatnonzero(new_a | new_b)
        #: Overlaps as places of a token of A and one of B.
        self.overlap_a, self.overlap_b = own_a[overlap], own_b[overlap]
        #: The group of each token, and how many tokens each group has.
        self.group_a, self.group_b = group[np.flatnonzero(new_a)], group[np.flatnonzero(new_b)]
        n = int(group[-1]) + 1 if len(group) else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)


def linked(own: Owners, a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, occurrences) of the id pairs of each group, by group; key is a * n_b + b. Equal ids of a group count as one with a multiplicity."""
    of_a, times_a = np.unique(own.group_a * n_a + a, return_counts=True)
    of_b, times_b = np.unique(own.group_b * n_b + b, return_counts=True)
    group = of_a // n_a
    per_group = np.bincount(of_b // n_b, minlength=len(own.size_b))
    first = np.cumsum(per_group) - per_group
    many = per_group[group]
    left = np.repeat(np.arange(len(of_a)), many)
    right = first[group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
    return group[left], of_a[left] % n_a * n_b + of_b[right] % n_b, times_a[left] * times_b[right]


def _ints(values) -> bytes:
    return np.asarray(values).astype("<i4").tobytes()


class Aligner:
    """Aligns texts stretch by stretch and remembers what it found for each distinct one: the alignment itself if ``whole``, else its digest and links."""

    def __init__(self, a_model: str, b_model: bytes, whole: bool = True):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = whole
        self.a = Tokenizer.from_str(a_model)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = tokencount._byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.n_a = max(vocab.values()) + 1
        self.bytes_a = [b""] * self.n_a
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode("utf-8")
        model = spm.parse(b_model)
        self.n_b = len(model.pieces)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if kind == spm.BYTE else p.replace(spm.MARK, " ").encode("utf-8") for p, _, kind in model.pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        marked = re.compile(f"[^{spm.MARK}]{spm.MARK}")
        self.by_stretch = (
            tokencount.applies(a_model)
            and not model.charsmap
            and not model.trim_spaces
            and model.dummy_prefix
            and model.escape_spaces
            and not any(marked.search(p) for p, _, kind in model.pieces if kind in (spm.NORMAL, spm.USER))
        )
        size = max(self.n_a, self.n_b)
        self.printed = {end: np.array([f"{i}{end}" for i in range(size)], dtype=object) for end in ",|;"}
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all stretches but the first ``keep``."""
        if not keep:
            self.place: dict[str, int] = {}
            self.names: list[str] = []
            #: For each stretch: tokens of A, of B, groups, links; whether both tokenizers give its bytes.
            self.stats = np.zeros((1024, 5), np.int64)
            self.printed_groups: list[str] = []
            self.links: list[bytes] = []
            self.parts: list[tuple[bytes, ...]] = []
        for name in self.names[keep:]:
            del self.place[name]
        for held in (self.names, self.printed_groups, self.links, self.parts):
            del held[keep:]

    def cut(self, text: str | None) -> list[str]:
        """The stretches of a text, without the blank that each starts with; an empty text has none."""
        if not text:
            return []
        if not self.by_stretch:
            return [text]
        if text[0] == " " or text[-1] == " " or _NEAR_BLANKS.search(text):
            return _SINGLE_BLANK.split(text)
        return text.split(" ")

    def _learn(self, names: list[str]) -> None:
        at = len(self.names)
        self.place.update((name, at + i) for i, name in enumerate(names))
        self.names += names
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in names], add_special_tokens=False)]
        b = self.b.encode(names, num_threads=1)
        raw = [(" " + x).encode("utf-8") for x in names]
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)]
        a, b = [x if g else [] for x, g in zip(a, good, strict=True)], [x if g else [] for x, g in zip(b, good, strict=True)]
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        own = Owners(self.len_a[ids_a], self.len_b[ids_b])
        # every stretch ends a token of both
        of_group = np.zeros(len(own.size_a), np.int64)
        of_group[own.group_a] = np.repeat(np.arange(len(names)), n_a)
        groups = np.bincount(of_group, minlength=len(names))
        n_links = np.zeros(len(names), np.int64)
        np.add.at(n_links, of_group, own.size_a * own.size_b)
        while len(self.stats) < len(self.names):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)])
        self.stats[at : len(self.names)] = np.stack([n_a, n_b, groups, n_links, np.array(good, np.int64)], 1)
        if self.whole:
            self._keep_parts(names, own, ids_a, ids_b, n_a, n_b, groups)
            return
        group, key, times = linked(own, ids_a, ids_b, self.n_a, self.n_b)
        bounds = np.searchsorted(of_group[group], np.arange(len(names) + 1)) * 16
        blob = np.stack([key, times], 1).astype("<i8").tobytes()
        self.links += [blob[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        last_a, last_b = np.r_[own.group_a[1:] != own.group_a[:-1], True][: len(ids_a)], np.r_[own.group_b[1:] != own.group_b[:-1], True][: len(ids_b)]
        printed = np.empty(len(ids_a) + len(ids_b), object)
        printed[np.arange(len(ids_a)) + (np.cumsum(own.size_b) - own.size_b)[own.group_a]] = np.where(last_a, self.printed["|"][ids_a], self.printed[","][ids_a])
        printed[np.arange(len(ids_b)) + np.cumsum(own.size_a)[own.group_b]] = np.where(last_b, self.printed[";"][ids_b], self.printed[","][ids_b])
        ends = np.r_[0, np.cumsum(n_a + n_b)]
        self.printed_groups += ["".join(printed[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def _keep_parts(self, names: list[str], own: Owners, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, groups: np.ndarray) -> None:
        ends_a, ends_b, ends_g = (np.r_[0, np.cumsum(x)] for x in (n_a, n_b, groups))
        ends_o = np.searchsorted(np.repeat(np.arange(len(names)), n_a)[own.overlap_a], np.arange(len(names) + 1))
        for i in range(len(names)):
            a0, a1, b0, b1 = ends_a[i], ends_a[i + 1], ends_b[i], ends_b[i + 1]
            g, o = slice(ends_g[i], ends_g[i + 1]), slice(ends_o[i], ends_o[i + 1])
            self.parts.append(tuple(map(_ints, (ids_a[a0:a1], ids_b[b0:b1], own.size_a[g], own.size_b[g], own.overlap_a[o] - a0, own.overlap_b[o] - b0))))

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
        """The places of the texts' stretches (none of a text whose bytes the tokens don't give), their bounds, and how many to keep afterwards."""
        if len(self.names) > REMEMBERED:
            self.forget()
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut).difference(self.place) if cut else set()
        if short := [x for x in new if len(x) <= LONGEST]:
            self._learn(short)
        keep = len(self.names)
        if long := [x for x in new if len(x) > LONGEST]:
            self._learn(long)
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64)
        bounds = np.r_[0, np.cumsum([len(c) for c in cut])].astype(np.int64)
        bad = kernel.sums(self.stats[places, 4] == 0, bounds) > 0
        held = ~np.repeat(bad, np.diff(bounds))
        return places[held], np.r_[0, np.cumsum(np.where(bad, 0, np.diff(bounds)))], keep


@lru_cache(maxsize=1)
def _aligner(a_model: str, b_model: bytes, whole: bool) -> Aligner:
    """A worker's aligner, kept from task to task."""
    return Aligner(a_model, b_model, whole)


def _models(docs: DataFrame, a_path: str, b_path: str):
    """Both model files, read once on the driver."""
    kernel.tune(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast((Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()))


_PARTS = ("a_tokens", "b_tokens", "a_sizes", "b_sizes", "overlap_a", "overlap_b")


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the alignment of A's tokens of blank + text and B's of text appended.

    ``a_tokens`` and ``b_tokens`` are ids, ``a_sizes`` and ``b_sizes`` the tokens
    of each group, ``overlap_a`` and ``overlap_b`` the places of tokens that share
    bytes. Special strings are plain text. A null or empty text, and one whose
    bytes either tokenizer's tokens don't give back, has empty arrays. Rows and
    other columns are kept; columns named like the results are replaced.
    """
    shared = _models(docs, a_path, b_path)
    out = docs.drop(*_PARTS).withColumns({c: F.array().cast("array<int>") for c in _PARTS})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value, True)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text_col))
            for part in kernel.slices(column):
                rows = batch.slice(part.lo, part.hi - part.lo)
                places, bounds, keep = aligner.stretches(column.slice(part.lo, part.hi - part.lo).to_pylist())
                held = [aligner.parts[p] for p in places.tolist()]
                new = {}
                for k, name in enumerate(_PARTS):
                    sizes = np.array([len(h[k]) // 4 for h in held], np.int64)
                    values = np.frombuffer(b"".join(h[k] for h in held), "<i4")
                    if k > 3:
                        # places count from the text's first token
                        before = np.r_[0, np.cumsum(aligner.stats[places, k - 4])]
                        start = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
                        values = values + np.repeat(start, sizes).astype(np.int32)
                    ends = np.r_[0, np.cumsum(sizes)][bounds].astype(np.int32)
                    new[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
                aligner.forget(keep)
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(names)], names=names)
        kernel.release()

    return out.mapInArrow(run, out.schema)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(docs: DataFrame, a_path: str, b_path: str, text_col: str, id_col: str) -> DataFrame:
    """One row for the texts of about CHUNK bytes: their ids and counts, and their links as places in a list of distinct id pairs."""
    shared = _models(docs, a_path, b_path)
    kind = kernel.field(docs, id_col)
    schema = "chunk bigint, ids array<%s>, %s, groups_sha256 array<string>, pairs array<int>, places binary, times binary, keys array<bigint>, docs array<int>" % (
        kind,
        ", ".join(f"{c} array<bigint>" for c in _COUNTS),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value, False)
        room = aligner.n_a * aligner.n_b
        first = TaskContext.get().partitionId() << 33
        made = 0

        def row(held: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            stats, pairs, key, times = (np.concatenate([h[i] for h in held]) for i in (1, 3, 4, 5))
            keys, at, docs = np.unique(key, return_inverse=True, return_counts=True)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [
                pa.array([first + made], pa.int64()),
                one(ids),
                *[one(pa.array(stats[:, i])) for i in range(4)],
                one(pa.array([s for h in held for s in h[2]], pa.string())),
                one(pa.array(pairs, pa.int32())),
                pa.array([pack_numbers(at)], pa.binary()),
                pa.array([pack_numbers(times)], pa.binary()),
                one(pa.array(keys)),
                one(pa.array(docs, pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", *_COUNTS, "groups_sha256", "pairs", "places", "times", "keys", "docs"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            names = batch.schema.names
            column, own_ids = batch.column(names.index(text_col)), batch.column(names.index(id_col))
            for part in kernel.slices(column):
                places, bounds, keep = aligner.stretches(column.slice(part.lo, part.hi - part.lo).to_pylist())
                n = part.hi - part.lo
                sums = np.stack([kernel.sums(aligner.stats[places, i], bounds) for i in range(4)], 1)
                flat = places.tolist()
                printed = ("".join(map(aligner.printed_groups.__getitem__, flat[x:y]))[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True))
                shas = [hashlib.sha256(p.encode()).hexdigest() if p else "" for p in printed]
                blobs = [aligner.links[p] for p in flat]
                links = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
                doc = np.repeat(np.repeat(np.arange(n), np.diff(bounds)), np.array([len(b) // 16 for b in blobs], np.int64))
                both, at = np.unique(doc * room + links[:, 0], return_inverse=True)
                times = np.zeros(len(both), np.int64)
                np.add.at(times, at, links[:, 1])
                held.append((own_ids.slice(part.lo, n), sums, shas, np.bincount(both // room, minlength=n), both % room, times))
                aligner.forget(keep)
                size += len(part.data)
                if size >= CHUNK:
                    yield row(held)
                    held, size, made = [], 0, made + 1
        if held:
            yield row(held)
        kernel.release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _pairs(packed: DataFrame) -> DataFrame:
    """(chunk, at, key, docs) for each distinct id pair of each chunk."""
    return packed.select("chunk", F.posexplode(F.arrays_zip("keys", "docs")).alias("at", "s")).select("chunk", "at", "s.keys", "s.docs").withColumnRenamed("keys", "key")


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    aligner = _aligner(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes(), False)
    return aligner.n_a, aligner.n_b


def corpus_links(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(a, b, n, best): in how many documents tokens a and b share a group, and whether no b of this a is in more."""
    n_b = _sizes(a_path, b_path)[1]
    pairs = _pairs(_packed(docs, a_path, b_path, text_col, id_col))
    return _ranked(pairs, n_b).select("a", (F.col("key") % n_b).alias("b"), "n", "best")


def _ranked(pairs: DataFrame, n_b: int) -> DataFrame:
    """(key, a, n, best); an id of A has no more rows than B has ids."""
    counts = pairs.groupBy("key").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"key div {n_b}"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with what the corpus says of their links."""
    one = {c: left.column(c)[0] for c in left.column_names}
    at = right.column("at").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    places, times = (unpack_numbers(one[c].as_py()) for c in ("places", "times"))
    bounds = np.r_[0, np.cumsum(np.asarray(one["pairs"].values))].astype(np.int64)
    columns = {"doc_id": one["ids"].values, **{c: one[c].values for c in _COUNTS}}
    columns["n_best"] = pa.array(kernel.sums(times * best[places], bounds))
    columns["count_sum"] = pa.array(kernel.sums(times * n[places], bounds))
    return pa.table(columns | {"groups_sha256": one["groups_sha256"].values})


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The packed links are written once, to the shared folder; the distinct id pairs
    of each chunk are counted over the corpus, and the counts go back to their
    chunks. No pair is a row for each document that holds it.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/links-{uuid.uuid4().hex}"
    _packed(docs, a_path, b_path, "text", "doc_id").write.option("compression", "zstd").parquet(path)
    pairs = _pairs(spark.read.parquet(path))
    found = pairs.join(_ranked(pairs, _sizes(a_path, b_path)[1]).select("key", "n", "best"), "key").select("chunk", "at", "n", "best")
    own = spark.read.parquet(path).select("chunk", "ids", *_COUNTS, "groups_sha256", "pairs", "places", "times")
    schema = f"doc_id {kernel.field(docs, 'doc_id')}, " + ", ".join(f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return own.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_answer, schema)
