"""Finding keys that occur more than once, through a packed shuffle.

Millions of (key, place) entries would be millions of rows. Here a worker packs
the entries of about CHUNK_WORDS words into one row for each part of the key
space; a part's rows meet in one task, which says which entries have a
counterpart; the answers, and a directory row with what identifies the chunk's
texts, meet again by chunk. Entries of one chunk with equal keys are one entry
with a count, so a key that very many texts share costs its part one entry a
chunk; what is known of the others stays in the directory.

The input must give the same rows in the same order when read again (a table or
a checkpoint does), so that a chunk recomputed after a lost executor is the same
chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm import kernel

CHUNK_WORDS = 1 << 20
ENTRIES_A_PART = 1 << 20

_PACKED = "part int, chunk bigint, n int, keys binary, places binary, marks binary, counts binary, directory binary"
_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("chunk", pa.int64()),
        ("n", pa.int32()),
        ("keys", pa.binary()),
        ("places", pa.binary()),
        ("marks", pa.binary()),
        ("counts", pa.binary()),
        ("directory", pa.binary()),
    ]
)


class Entries(NamedTuple):
    """Entries of some texts: keys, ascending places counted over these texts, flags, and the texts' bounds among places."""

    keys: np.ndarray
    places: np.ndarray
    flags: np.ndarray
    bounds: np.ndarray


class Found(NamedTuple):
    """A chunk's entries that have a counterpart, by place; keys and levels only where asked for."""

    places: np.ndarray
    keys: np.ndarray
    levels: np.ndarray


def level(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, in their order: up to 128 as they are, larger ones by an eighth of a power of two."""
    high = 128 + 8 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts <= 128, counts, np.minimum(high, 255)).astype(np.uint8)


def _parts(spark, n_entries: int) -> int:
    """Parts of the key space: small enough for a task each, and several for each shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // ENTRIES_A_PART))


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0, low bytes before high ones, so that the zeros compress."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or k == 8 or values.max() < 1 << 8 * k)
    values = np.ascontiguousarray(values.astype(f"<u{size}"))
    return bytes([size]) + values.view(np.uint8).reshape(-1, size).T.tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    """The inverse of :func:`pack_numbers`."""
    size = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as differences."""
    return pack_numbers(np.diff(places, prepend=0))


def unpack_places(blob: bytes) -> np.ndarray:
    """The inverse of :func:`pack_places`."""
    return np.cumsum(unpack_numbers(blob))


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _bind(blobs: list[bytes]) -> bytes:
    """Blobs in one, each behind its length."""
    return b"".join(x for b in blobs for x in (len(b).to_bytes(8, "little"), b))


def _unbind(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _rows(chunk: int, held: list[tuple[Entries, bytes]], n_parts: int, width: int, flagged: bool, levels: bool) -> pa.RecordBatch:
    """A chunk's packed rows and its directory row.

    Entries with equal keys, which have each other as counterparts (with
    ``flagged``, only if one of them has a flag), become one with a mark; the
    directory has all their places (with ``levels`` those of the others, and
    which marked entry each belongs to), the texts' bounds, and the caller's bytes.
    """
    shift, keys, places, flags, bounds = 0, [], [], [], [np.zeros(1, np.int64)]
    for e, _ in held:
        keys.append(e.keys)
        places.append(e.places + shift)
        flags.append(e.flags)
        bounds.append(e.bounds[1:] + shift)
        shift += int(e.bounds[-1])
    keys, places, flags = np.concatenate(keys), np.concatenate(places), np.concatenate(flags)
    part = (((keys >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
    keys, part, places, flags = keys[order], part[order], places[order], flags[order]
    _, first, group, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    met = count > 1
    if flagged:
        some = np.zeros(len(count), bool)
        some[group[flags]] = True
        met &= some
    marked, lead = met[group], np.zeros(len(keys), bool)
    lead[first] = True
    keep = lead | ~marked
    if levels:
        nth = np.cumsum(keep & marked) - 1
        aside = marked & ~lead
        known = [pack_numbers(places[aside]), pack_numbers(nth[first[group[aside]]])]
    else:
        known = [pack_places(np.sort(places[marked]))]
    counts = np.where(marked, count[group], 1)[keep]
    flags |= marked
    keys, part, places, flags, marked = keys[keep], part[keep], places[keep], flags[keep], marked[keep]
    body = (keys & np.uint64(0xFFFFFFFF)).astype("<u4") if width == 4 else keys.astype("<u8")
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    tails = np.r_[heads[1:], len(part)][: len(heads)].astype(np.int64)
    rows = []
    for h, t in zip(heads, tails, strict=True):
        marks = np.packbits(marked[h:t]).tobytes() + (np.packbits(flags[h:t]).tobytes() if flagged else b"")
        times = pack_numbers(counts[h:t] - 1) if levels else None
        rows.append((int(part[h]), chunk, int(t - h), body[h:t].tobytes(), pack_places(places[h:t]), marks, times, None))
    rows.append((-1, chunk, 0, None, None, None, None, _bind([np.concatenate(bounds).astype("<i8").tobytes(), b"".join(x for _, x in held), *known])))
    return _batch(rows)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(a, b - a)
            if held and held[0].column(held[0].schema.names.index(key))[0].as_py() != column[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last one of fewer), none of which ends within a group; batches are sorted by the key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        column = table.column(key).to_numpy()
        cut = int(np.searchsorted(column, column[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _judge(table: pa.Table, width: int, flagged: bool, with_keys: bool, levels: bool) -> pa.RecordBatch:
    """For each row of a part, the entries whose key occurs twice or more (and, if ``flagged``, once with a flag), marked ones only with their level."""
    sizes = table.column("n").to_numpy()
    blobs = {k: table.column(k).to_pylist() for k in ("keys", "places", "marks", "counts")}
    keys = np.concatenate([np.frombuffer(b, f"<u{width}") for b in blobs["keys"]])
    marked = np.concatenate([_bits(b, int(n)) for b, n in zip(blobs["marks"], sizes, strict=True)])
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[heads, len(keys)])
    good = (counts > 1) | np.logical_or.reduceat(marked[order], heads)
    if flagged:
        flags = np.concatenate([_bits(b[-(-int(n) // 8) :], int(n)) for b, n in zip(blobs["marks"], sizes, strict=True)])
        good &= np.logical_or.reduceat(flags[order], heads)
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = np.repeat(good, counts)
    if levels:
        times = np.concatenate([unpack_numbers(b) for b in blobs["counts"]]) + 1
        told = np.empty(len(keys), np.uint8)
        told[order] = np.repeat(level(np.add.reduceat(times[order], heads)), counts)
    else:
        hit &= ~marked
    at, rows = 0, []
    for chunk, part, n, places in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), sizes, blobs["places"], strict=True):
        mine = hit[at : at + n]
        if mine.any():
            held = keys[at : at + n][mine].tobytes() if with_keys else None
            marks = np.packbits(marked[at : at + n][mine]).tobytes() if levels else None
            times = told[at : at + n][mine].tobytes() if levels else None
            rows.append((part, chunk, int(mine.sum()), held, pack_places(unpack_places(places)[mine]), marks, times, None))
        at += n
    return _batch(rows)


def _found(table: pa.Table, width: int, with_keys: bool, levels: bool) -> tuple[np.ndarray, bytes, Found]:
    """A chunk's bounds, the caller's bytes and the entries with a counterpart, from its answers and its directory, by part."""
    part = table.column("part").to_numpy()
    bounds, extra, *known = _unbind(table.column("directory")[int(np.flatnonzero(part < 0)[0])].as_py())
    rows = table.filter(pa.array(part >= 0))
    blobs = {k: rows.column(k).to_pylist() for k in ("keys", "places", "marks", "counts")}
    none = np.zeros(0, np.int64)
    places = np.concatenate([none, *(unpack_places(b) for b in blobs["places"])])
    keys = np.concatenate([none.view(np.uint64), *(np.frombuffer(b, f"<u{width}") for b in blobs["keys"])]) if with_keys else none.view(np.uint64)
    told = none.astype(np.uint8)
    if levels:
        told = np.concatenate([told, *(np.frombuffer(b, np.uint8) for b in blobs["counts"])])
        marked = np.concatenate([none.astype(bool), *(_bits(b, n) for b, n in zip(blobs["marks"], rows.column("n").to_pylist(), strict=True))])
        lead = np.flatnonzero(marked)[unpack_numbers(known[1])]
        places, told = np.r_[places, unpack_numbers(known[0])], np.r_[told, told[lead]]
        keys = np.r_[keys, keys[lead]] if with_keys else keys
    else:
        places = np.r_[places, unpack_places(known[0])]
    order = np.argsort(places, kind="stable")
    return np.frombuffer(bounds, "<i8"), extra, Found(places[order], keys[order] if with_keys else keys, told[order] if levels else told)


def repeated(
    docs: DataFrame,
    entries: Callable[[pa.RecordBatch], Iterator[tuple[Entries, bytes]]],
    answer: Callable[[np.ndarray, bytes, Found], pa.RecordBatch | None],
    schema: str,
    n_entries: int,
    width: int = 8,
    flagged: bool = False,
    with_keys: bool = False,
    levels: bool = False,
) -> DataFrame:
    """What ``answer`` makes of each chunk and its entries whose keys have a counterpart.

    ``entries`` turns a batch of ``docs`` into entries and bytes for the
    directory; ``answer`` gets the chunk's bounds, those bytes, and the repeated
    entries (``with_keys``, which needs ``levels``, also their keys and the
    :func:`level` of how often each occurs). With ``width`` 4 keys are compared by
    32 bits beside their part, so a few entries too many may come back. A key's
    own entry never counts as its counterpart.
    """
    spark = docs.sparkSession
    n_parts = _parts(spark, n_entries)
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_parts // 4)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, words = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for e, extra in entries(batch):
                held.append((e, extra))
                words += max(len(e.keys), int(e.bounds[-1]) // 4)
                if words >= CHUNK_WORDS:
                    yield _rows(chunk, held, n_parts, width, flagged, levels)
                    chunk, held, words = chunk + 1, [], 0
        if held:
            yield _rows(chunk, held, n_parts, width, flagged, levels)
        kernel.release()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "part"):
            if table.column("part")[0].as_py() < 0:
                yield from table.to_batches()
            else:
                yield _judge(table, width, flagged, with_keys, levels)
        kernel.release()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "chunk"):
            out = answer(*_found(table, width, with_keys, levels))
            if out is not None and out.num_rows:
                yield out
        kernel.release()

    packed = docs.mapInArrow(pack, _PACKED)
    # one part after the other, and chunks by the task they come from, so that each task has about as many
    by_chunk = ((F.shiftright("chunk", 32) + 31 * F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF))) % n_tasks).cast("int")
    dealt = packed.repartitionById(n_tasks, F.when(F.col("part") < 0, by_chunk).otherwise(F.col("part")))
    judged = dealt.sortWithinPartitions("part").mapInArrow(judge, _PACKED)
    return judged.repartitionById(n_tasks, by_chunk).sortWithinPartitions("chunk", "part").mapInArrow(unpack, schema)


def n_words(docs: DataFrame, text_col: str) -> int:
    """An upper estimate of the number of words, from the bytes of the texts."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 4
