"""Prefix trie of conversations by Patricia construction.

A turn stands for two 64-bit hashes of its role and text, a sequence of turns for
two polynomial hashes of these, so equal sequences have equal pairs wherever they
occur. Sequences are cut into blocks, distinct blocks are sorted, and neighbours
in that order tell where sequences part: these branching points, and the ends of
sequences, are the only nodes that are created. Members and subtree sums are
computed on this compressed tree; then the edges between its points are expanded,
with sums over suffixes of an edge from differences of running sums.

Sorting is by range over (conversation, turn), so one conversation may span many
tasks; what runs on from one task to the next is two summaries a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm import kernel
from turnlens.llm.durable import checkpointed, small

#: Turns of a block.
BLOCK = 32
#: With at most this many points (of 16 bytes), these are broadcast; else both sides are shuffled and hot keys split.
FEW = 1 << 17
#: Nodes of an edge that one row is expanded to at a time.
PIECE = 4096
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class State(NamedTuple):
    """What is known of a conversation's turns so far: their number, the two hashes and the bytes."""

    conv: int | None = None
    n: int = 0
    p1: int = 0
    p2: int = 0
    w: int = 0

    def then(self, other: State) -> State:
        """The state after this one's turns and then the other's."""
        if self.conv != other.conv:
            return other
        p = [(x + pow(base, self.n, 1 << 64) * y) % (1 << 64) for base, x, y in zip(_BASES, (self.p1, self.p2), (other.p1, other.p2), strict=True)]
        return State(self.conv, self.n + other.n, *p, self.w + other.w)


def _advance(state: State, conv: np.ndarray, keys: list[np.ndarray], size: np.ndarray) -> tuple[State, list[np.ndarray]]:
    """Runs of equal ``conv`` one after the other, the first one going on from ``state``: the last state, and n, p1, p2 and w at each row."""
    new = np.r_[True, conv[1:] != conv[:-1]]
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    place = np.arange(len(conv)) - head[run]
    goes_on = (run == 0) & (state.conv == int(conv[0]))
    out = [place + 1 + goes_on * state.n]
    longest = int(place.max()) + 2
    for base, key, before in zip(_BASES, keys, (state.p1, state.p2), strict=True):
        power = kernel.powers(np.uint64(base), longest)
        term = kernel.mix(key.astype(np.uint64)) * power[place + 1]
        total = np.cumsum(term)
        local = total - (total[head] - term[head])[run]
        out.append(np.where(goes_on, np.uint64(before) + np.uint64(pow(base, state.n, 1 << 64)) * local, local))
    total = np.cumsum(size)
    out.append(total - (total[head] - size[head])[run] + goes_on * state.w)
    return State(int(conv[-1]), *(int(x[-1]) for x in out)), out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    at = lambda c: batch.column(batch.schema.names.index(c)).to_numpy()
    return at("conv"), [at("k1"), at("k2")], at("bytes")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted rows: the state at the end of its first conversation and that of its last one."""
    first, state, task = None, State(), 0
    for batch in batches:
        if batch.num_rows:
            conv, keys, size = _arrays(batch)
            before, task = state, _task(batch)
            state, (n, p1, p2, w) = _advance(state, conv, keys, size)
            start = before.conv if first is None and before.conv is not None else int(conv[0])
            end = int(np.searchsorted(conv != start, True)) if conv[-1] != start else len(conv)
            if first is None and end < len(conv):
                first = State(start, *(int(x[end - 1]) for x in (n, p1, p2, w))) if end else before
    if state.conv is not None:
        rows = [first or state, state]
        # hashes as signed numbers
        signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        columns = {"task": [task] * 2, "last": [False, True], "one": [first is None] * 2}
        columns |= {c: [signed(getattr(r, c)) for r in rows] for c in State._fields}
        yield pa.RecordBatch.from_pydict(columns, pa.schema([("task", pa.int32()), ("last", pa.bool_()), ("one", pa.bool_()), *[(c, pa.int64()) for c in State._fields]]))


def running(rows: DataFrame) -> DataFrame:
    """Rows (conv, k1, k2, bytes, ...) of a checkpoint sorted by range, conversations first, with n, p1, p2 and w appended: place in the conversation, hashes and bytes up to it."""
    found: dict[int, dict[bool, tuple[State, bool]]] = {}
    for r in rows.mapInArrow(_summaries, "task int, last boolean, one boolean, " + ", ".join(f"{c} bigint" for c in State._fields)).collect():
        state = State(r["conv"], r["n"], r["p1"] % (1 << 64), r["p2"] % (1 << 64), r["w"])
        found.setdefault(r["task"], {})[r["last"]] = (state, r["one"])
    starts, state = {}, State()
    for task in sorted(found):
        starts[task] = state
        own, one = found[task][True]
        state = state.then(own) if one else own
    shared = rows.sparkSession.sparkContext.broadcast(starts)
    new = ("n", "p1", "p2", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or shared.value[_task(batch)]
                state, out = _advance(state, *_arrays(batch))
                columns = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c != "task"] + [(c, pa.array(x.view(np.int64))) for c, x in zip(new, out, strict=True)]
                yield pa.RecordBatch.from_arrays([x for _, x in columns], names=[c for c, _ in columns])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "task"]
    return rows.mapInArrow(run, ", ".join([*kept, *[f"{c} bigint" for c in new]]))


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """A checkpoint sorted by range, with the number of the task of each row: later plans may number tasks otherwise."""
    return checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id()))


def _task(batch: pa.RecordBatch) -> int:
    return batch.column(batch.schema.names.index("task"))[0].as_py()


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k1, k2, bytes, n, p1, p2, w) of all turns: ordered by turn, null first, then by hashes, so that ties and repeated rows have an order.

    Null roles and texts are empty ones; rows without a conversation's id are left out.
    """
    said = [F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))]
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("k1"),
        F.xxhash64(F.lit("second"), *said).alias("k2"),
        F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    return running(_sorted(rows, "conv", "turn", "k1", "k2").drop("turn"))


def _blocks(seq: DataFrame) -> DataFrame:
    """(j, path): the distinct runs of BLOCK sequences' hashes, each behind the hash that it starts from."""
    j = F.expr(f"n div {BLOCK}")
    # the last turn of a block is also what the next one starts from
    rows = seq.select("conv", F.explode(F.when(F.col("n") % BLOCK == 0, F.array(j - 1, j)).otherwise(F.array(j))).alias("j"), "n", "p1", "p2")
    held = rows.groupBy("conv", "j").agg(F.sort_array(F.collect_list(F.struct("n", "p1", "p2"))).alias("s"))
    path = F.flatten(F.transform("s", lambda x: F.array(x["p1"], x["p2"])))
    root = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    out = held.select("j", F.when(F.col("j") == 0, F.concat(root, path)).otherwise(path).alias("path"))
    return out.where(F.size("path") > 2).distinct()


def _partings(batches: Iterator[pa.RecordBatch], ends: list[tuple[int, int, list[int]]]) -> Iterator[pa.RecordBatch]:
    """(p1, p2) of the nodes up to which neighbours in the order of blocks agree; ``ends`` has the last block of each task."""
    width = 2 * BLOCK + 2
    before = None
    for batch in batches:
        level, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not lists:
            continue
        if before is None:
            before = next((e[1:] for e in reversed(ends) if e[0] < _task(batch)), None)
        if before:
            level, lists = [before[0], *level], [before[1], *lists]
        size = np.array([len(x) for x in lists])
        table = np.zeros((len(lists), width), np.int64)
        table[np.arange(width) < size[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in lists])
        same = (table[1:] == table[:-1]) & (np.arange(width) < np.minimum(size[1:], size[:-1])[:, None])
        equal = np.where(same.all(1), width, np.argmin(same, 1)) // 2
        level = np.array(level)
        at = np.flatnonzero((level[1:] == level[:-1]) & (equal > 0))
        node = table[at][np.arange(len(at))[:, None], 2 * equal[at][:, None] + np.array([-2, -1])]
        before = (int(level[-1]), lists[-1])
        yield pa.RecordBatch.from_arrays([pa.array(node[:, 0]), pa.array(node[:, 1])], names=["p1", "p2"])


def branches(seq: DataFrame) -> DataFrame:
    """(p1, p2) of the nodes at which sequences part (and of some ends), the root left out."""
    blocks = _sorted(_blocks(seq), "j", "path")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows:
                kept = batch.slice(batch.num_rows - 1)
        if kept is not None:
            yield kept

    # one block of each task
    ends = sorted((r["task"], r["j"], r["path"]) for r in blocks.mapInArrow(last, blocks.schema).collect())
    shared = blocks.sparkSession.sparkContext.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _partings(batches, shared.value)

    return blocks.mapInArrow(run, "p1 bigint, p2 bigint").where("p1 <> 0 OR p2 <> 0").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (p1, p2, conv) in order, the ids of each run of a batch, joined by commas."""
    for batch in batches:
        if batch.num_rows:
            p1, p2, conv = (batch.column(i).to_numpy() for i in range(3))
            cut = np.r_[0, np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1, len(p1)]
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p1[cut[:-1]]), pa.array(p2[cut[:-1]]), pa.array(conv[cut[:-1]]), pa.array(ids, pa.string())], names=["p1", "p2", "low", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, ends_sha256) of runs in order; a node's runs are hashed one by one."""
    key, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        for p1, p2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if key == (p1, p2):
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (p1, p2), hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["p1", "p2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["p1", "p2", "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the nodes at which conversations end; a node's ids are joined in many tasks and hashed as they pass."""
    runs = ends.select("p1", "p2", "conv").repartitionByRange("p1", "p2", "conv").sortWithinPartitions("p1", "p2", "conv")
    runs = runs.mapInArrow(_runs, "p1 bigint, p2 bigint, low bigint, ids string")
    return runs.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "low").mapInArrow(_hashed, "p1 bigint, p2 bigint, ends_sha256 string")


def nodes(seq: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``seq`` (see running) and of the conversations ``convs`` (conv), those without turns included.

    conv_id is the smallest member, a conversation that starts with the node's
    turns; parent_conv_id that of its parent (the root's is null); saved_tokens
    sums, over the subtree, each node's (n_convs - 1) times the bytes of its last
    text; ends_sha256 is the hash of the ids of members that end there, ascending.
    Without conversations there are no rows.
    """
    spark = seq.sparkSession
    top = convs.agg(F.count("*").alias("n"), F.min("conv").alias("m")).first()
    if not top["n"]:
        return spark.createDataFrame([], _NODES)
    last = seq.groupBy("conv").agg(F.max_by(F.struct("p1", "p2"), "n").alias("p"))
    zero = F.lit(0).cast("long")
    ends = checkpointed(convs.join(last, "conv", "left").select("conv", F.coalesce("p.p1", zero).alias("p1"), F.coalesce("p.p2", zero).alias("p2")))
    points = small(branches(seq).union(ends.select("p1", "p2").where("p1 <> 0 OR p2 <> 0")).distinct(), FEW)
    at = checkpointed(seq.join(points, ["p1", "p2"]).select("p1", "p2", "conv", "n", "bytes", "w"))
    ending = ends.groupBy("p1", "p2").agg(F.count("*").alias("ending"))
    members = at.groupBy("p1", "p2").agg(F.count("*").alias("n_convs"), F.min("conv").alias("m"))
    members = members.join(ending, ["p1", "p2"], "left").withColumn("leaf", F.coalesce(F.col("n_convs") == F.col("ending"), F.lit(False)))
    # On one conversation's path there are at most as many points as the root of twice all turns, for each
    # one needs a conversation of its own that is as long as the point is deep.
    along = Window.partitionBy("conv").orderBy("n")
    path = at.join(members, ["p1", "p2"])
    path = path.withColumn("above", F.lag(F.struct("p1", "p2", "n", "m", "w")).over(along))
    above = lambda c, default: F.coalesce(F.col(f"above.{c}"), F.lit(default).cast("long")).alias(f"above_{c}")
    path = path.select("*", above("p1", 0), above("p2", 0), above("n", 0), above("m", top["m"]), above("w", 0))
    # what a conversation owns of its path, the nodes of which it is the smallest member, is the path's end
    own = F.col("conv") == F.col("m")
    path = path.withColumn("edge", F.when(own, (F.col("n_convs") - 1) * (F.col("w") - F.col("above_w"))).otherwise(0))
    path = path.withColumn("tip", (own & F.col("leaf")).cast("long"))
    whole = Window.partitionBy("conv")
    rest = lambda c: F.sum(c).over(whole) - F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    path = path.withColumn("tips", rest("tip") + F.col("tip")).withColumn("below", rest("edge"))
    path = checkpointed(path.drop("above", "leaf", "ending"))
    sums = path.groupBy("p1", "p2").agg(F.sum("tips").alias("n_leaves"), F.sum("below").alias("below"))
    edges = path.where(own).drop("tips", "below", "edge", "tip")
    children = edges.groupBy(F.col("above_p1").alias("p1"), F.col("above_p2").alias("p2")).agg(F.count("*").alias("n_children"))
    hashes = checkpointed(_end_hashes(ends))
    children = checkpointed(children)
    found = edges.join(sums, ["p1", "p2"]).join(children, ["p1", "p2"], "left").join(hashes, ["p1", "p2"], "left")
    found = checkpointed(found.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes") + F.col("below")))
    one = lambda condition, frame, c, default: next((r[c] for r in frame.where(condition).select(c).collect()), default)
    all_sums = path.agg(F.coalesce(F.sum("edge"), zero).alias("saved"), F.coalesce(F.sum("tip"), zero).alias("leaves")).first()
    at_root = "p1 = 0 AND p2 = 0"
    n_children = one(at_root, children, "n_children", 0)
    root = (top["m"], 0, None, top["n"], n_children, all_sums["leaves"] if n_children else 1, all_sums["saved"], one(at_root, hashes, "ends_sha256", _NO_ENDS))
    return spark.createDataFrame([root], _NODES).union(_points(found)).union(_expanded(found, seq))


def _node(conv: Column, depth: Column, parent: Column, n_convs: Column, n_children: Column, n_leaves: Column, saved: Column, ends: Column) -> list[Column]:
    names = [x.split(" ")[0] for x in _NODES.split(", ")]
    return [c.alias(name) for c, name in zip((conv, depth, parent, n_convs, n_children, n_leaves, saved, ends), names, strict=True)]


def _points(found: DataFrame) -> DataFrame:
    parent = F.when(F.col("n") - F.col("above_n") > 1, F.col("m")).otherwise(F.col("above_m"))
    zero = F.lit(0).cast("long")
    return found.select(*_node(F.col("m"), F.col("n"), parent, F.col("n_convs"), F.coalesce("n_children", zero), F.col("n_leaves"), F.col("saved"), F.coalesce("ends_sha256", F.lit(_NO_ENDS))))


def _expanded(found: DataFrame, seq: DataFrame) -> DataFrame:
    """The unary nodes of the edges above points; those of more than one member need the bytes up to them."""
    edges = found.where(F.col("n") - F.col("above_n") > 1).select("m", "n", "above_n", "above_m", "n_convs", "n_leaves", "saved", "w", "bytes")
    pieces = edges.withColumn("piece", F.explode(F.expr(f"sequence(0, (n - above_n - 2) div {PIECE})")))
    # a long edge's pieces go to several tasks
    pieces = pieces.repartition("m", "n", "piece")
    deep = pieces.withColumn("depth", F.explode(F.expr(f"sequence(above_n + 1 + piece * {PIECE}, least(above_n + (piece + 1) * {PIECE}, n - 1))")))
    parent = F.when(F.col("depth") == F.col("above_n") + 1, F.col("above_m")).otherwise(F.col("m"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    node = lambda saved: _node(F.col("m"), F.col("depth"), parent, F.col("n_convs"), one, F.col("n_leaves"), saved, F.lit(_NO_ENDS))
    upto = seq.select(F.col("conv").alias("m"), F.col("n").alias("depth"), (F.col("w") - F.col("bytes")).alias("before"))
    shared = deep.where("n_convs > 1").join(upto, ["m", "depth"])
    # from this node to the one above the point
    suffix = (F.col("n_convs") - 1) * (F.col("w") - F.col("bytes") - F.col("before"))
    return deep.where("n_convs = 1").select(*node(zero)).union(shared.select(*node(F.col("saved") + suffix)))


def build(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are (see nodes)."""
    seq = turns(conversations, conv, turn, role, text)
    return nodes(seq, seq.where("n = 1").select("conv"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, conversations): each conversation c with the first h turns of c - c % 5 and its own after its first h, h being crc32(c) % 9."""
    own = turns(conversations).select("conv", "n", "k1", "k2", "bytes")
    convs = checkpointed(own.where("n = 1").select("conv"))
    h = F.crc32(F.col("conv").cast("string")) % 9
    rest = own.where((F.col("conv") % 5 == 0) | (F.col("n") > h)).withColumn("part", F.lit(1))
    heads = own.where("n <= 8").withColumnRenamed("conv", "base")
    taken = convs.where(F.col("conv") % 5 != 0).select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"))
    taken = taken.join(heads, "base").where("n <= h").withColumn("part", F.lit(0))
    columns = ["conv", "part", "n", "k1", "k2", "bytes"]
    rows = _sorted(taken.select(*columns).union(rest.select(*columns)), "conv", "part", "n")
    return running(rows.drop("part", "n")), convs


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return nodes(*rebuilt(conversations))
