"""N-gram Jaccard join with vertical partitioning.

Two sets that are similar enough share several of their first members (the
prefix) in any global order. A first pass compares prefixes in the order of
hashes, with one byte string for each part of the hashes rather than rows, and
leaves only texts that share enough of them with others. Texts with equal sets
are one node from then on.

The n-grams of the nodes have one global order, by how many nodes hold them,
rarest first; n-grams of one node alone, its first ones, can't be shared and are
left out. Whole overlaps are counted by cutting that order into fragments: each
fragment's partial overlaps are counted by themselves and summed for each pair.

Only connected components are reported, so not all pairs need a count. First
every prefix n-gram has a leader, the most typical of its nodes, which its other
nodes are compared with. Where an n-gram's nodes are still in several
components and lengths, places in the order and parity maps (whose differing
bits never outnumber differing members) allow a link between two of these, both
go to one family; families are compared whole, in pairs of blocks of bounded
size, and only edges that join components leave a task. No filter loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm import exchange, graph, kernel
from turnlens.llm.durable import checkpointed
from turnlens.llm.kernel import BLANK_LOWER, U64

N = 5
#: Similarity in percent.
LEAST = 80
#: The first pass looks at one n-gram in so many beyond the prefix, and asks for as many shared ones.
SPARE = 16
#: Fragments of the global order end with n-grams that so many nodes hold, and at its end.
CUTS = (2, 4, 16)
#: A leader's pairs are verified in blocks of about this many.
BLOCK = 1000
#: Nodes of an n-gram that a task compares by their maps; more are dealt out in pairs of blocks.
GROUP = 512
#: A block of a family holds about so many n-grams; each node counts for NODE more.
BLOCK_GRAMS = 1 << 20
NODE = 512
ROWS = 1 << 14
#: Frames are broadcast up to this many rows (of at most 40 bytes each), else joined by a shuffle.
FEW = 100_000
_MAP_WORDS = 16
_COLUMNS = 1 << 16


def shingles(part: kernel.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ordered by text then hash, and their bounds."""
    words = kernel.split(part, BLANK_LOWER)
    hashes = kernel.hash_words(part, words, BLANK_LOWER)
    starts = kernel.window_starts(words.bounds, N)
    grams, owner = kernel.hash_windows(hashes, N)[starts] if len(starts) else hashes[:0], kernel.owners(words.bounds)[starts]
    for k in range(1, N):  # a short text is one shingle
        short = np.flatnonzero(words.counts == k)
        if len(short):
            grams = np.r_[grams, kernel.hash_windows(hashes, k)[words.bounds[short]]]
            owner = np.r_[owner, short]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
        grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(words.bounds)))


def _signature(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that equal sets have in common."""
    total = np.zeros((2, len(grams) + 1), dtype=np.uint64)
    np.cumsum(kernel.mix(grams ^ U64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(kernel.mix(grams + U64(0x14057B7EF767814F)), out=total[1, 1:])
    return np.ascontiguousarray((total[:, bounds[1:]] - total[:, bounds[:-1]]).T)


def parity_maps(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1024 bits a set: each member flips one."""
    n = len(bounds) - 1
    bit = (grams >> U64(17)) % U64(64 * _MAP_WORDS)
    cell = kernel.owners(bounds) * (64 * _MAP_WORDS) + bit.astype(np.int64)
    odd = (np.bincount(cell, minlength=n * 64 * _MAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(n, _MAP_WORDS)


def need(n):
    """Members that a set of n must share with a similar one."""
    return -(-LEAST * n // 100)


def _spare(n):
    return 1 + n // SPARE


def _few(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= FEW else frame


_ABOUT = np.dtype([("id", "<i8"), ("null", "?"), ("key", "<i8"), ("n", "<i4"), ("sig", "V16")])


def screened(texts: DataFrame) -> DataFrame:
    """(id, key, n, sig, likely) for each row of ``texts`` (id, key, text).

    If the prefixes of two sets are longer by ``s`` members than one needs to be
    shared, similar sets share ``1 + s`` of these; a set that does not share as
    many as its smallest possible partner asks for isn't ``likely``.
    """

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[exchange.Entries, bytes]]:
        nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids, keys = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
        for part in kernel.slices(batch.column(2)):
            grams, bounds = shingles(part)
            n = np.diff(bounds)
            about = np.zeros(len(n), dtype=_ABOUT)
            rows = slice(part.lo, part.hi)
            about["id"], about["null"], about["key"], about["n"] = ids[rows], nulls[rows], keys[rows], n
            about["sig"] = _signature(grams, bounds).view("V16").ravel()
            owner = kernel.owners(bounds)
            place = np.arange(len(grams)) - bounds[owner]
            first = np.flatnonzero(place < (n - need(n) + _spare(n))[owner])
            # mixed again, for the first ones by hash would be of few parts
            yield exchange.Entries(kernel.mix(grams[first]), owner[first], np.zeros(len(first), bool), np.arange(len(n) + 1)), about.tobytes()

    def answer(bounds: np.ndarray, extra: bytes, found: exchange.Found) -> pa.RecordBatch:
        about = np.frombuffer(extra, _ABOUT)
        n = about["n"].astype(np.int64)
        likely = (np.bincount(found.places, minlength=len(n)) >= _spare(need(n))) & (n > 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.ascontiguousarray(about["id"]), mask=np.ascontiguousarray(about["null"])),
                pa.array(np.ascontiguousarray(about["key"])),
                pa.array(n),
                pa.array([x.tobytes() for x in about["sig"]], pa.binary()),
                pa.array(likely),
            ],
            names=["id", "key", "n", "sig", "likely"],
        )

    schema = "id bigint, key bigint, n bigint, sig binary, likely boolean"
    return exchange.repeated(texts, entries, answer, schema, exchange.n_words(texts, "text") // 3, width=4)


def _sets(texts: DataFrame) -> DataFrame:
    """(sig, n, grams) of each different set, grams by hash; ``texts``: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch.column(1)):
                grams, bounds = shingles(part)
                sig = _signature(grams, bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(np.diff(bounds)), lists], names=["sig", "n", "grams"]
                )
        kernel.release()

    found = texts.mapInArrow(run, "sig binary, n bigint, grams array<bigint>")
    return found.groupBy("sig").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def ordered(sets: DataFrame) -> DataFrame:
    """(sig, n, grams, cuts, map) of the sets that share enough members with others.

    ``grams`` are the members that other sets hold too, in the global order, the
    fragments of which end at ``cuts``. ``sets`` must be a checkpoint.
    """

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[exchange.Entries, bytes]]:
        grams, bounds = _flat(batch.column(2))
        rows = batch.num_rows
        extra = np.zeros(rows, [("sig", "V16"), ("n", "<i8")])
        extra["sig"] = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
        extra["n"] = batch.column(1).to_numpy()
        yield exchange.Entries(grams.view(np.uint64), kernel.owners(bounds), np.zeros(len(grams), bool), np.arange(rows + 1)), extra.tobytes()

    def answer(_: np.ndarray, extra: bytes, found: exchange.Found) -> pa.RecordBatch:
        about = np.frombuffer(extra, [("sig", "V16"), ("n", "<i8")])
        n = about["n"].astype(np.int64)
        enough = np.bincount(found.places, minlength=len(n)) >= need(n)
        mine = np.flatnonzero(enough[found.places])
        owner, keys, levels = found.places[mine], found.keys[mine], found.levels[mine]
        order = np.lexsort((keys, levels, owner))
        owner, keys, levels = owner[order], keys[order], levels[order]
        left = np.flatnonzero(enough)
        bounds = np.searchsorted(owner, np.r_[left, len(n)])
        fragment = np.searchsorted(CUTS, levels)
        cell = kernel.owners(bounds) * (len(CUTS) + 1) + fragment
        sizes = np.bincount(cell, minlength=len(left) * (len(CUTS) + 1)).reshape(len(left), len(CUTS) + 1)
        cuts = np.concatenate([np.zeros((len(left), 1), np.int64), np.cumsum(sizes, axis=1)], axis=1).astype(np.int32)
        lists = lambda v, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in about["sig"][left]], pa.binary()),
                pa.array(n[left]),
                lists(keys.view(np.int64), bounds),
                lists(cuts.ravel(), np.arange(len(left) + 1) * cuts.shape[1]),
                pa.array([x.tobytes() for x in parity_maps(keys, bounds)], pa.binary()),
            ],
            names=["sig", "n", "grams", "cuts", "map"],
        )

    size = int(sets.agg(F.sum("n")).first()[0] or 0)
    schema = "sig binary, n bigint, grams array<bigint>, cuts array<int>, map binary"
    return exchange.repeated(sets, entries, answer, schema, size, with_keys=True, levels=True)


def _prefix(nodes: DataFrame, *more: str) -> DataFrame:
    """(gram, node, n, at, alone): the shared members of each node's prefix, their places in the order, and its share of members without company."""
    alone = F.col("n") - F.size("grams")
    least = F.ceil(F.lit(LEAST) * F.col("n") / 100).cast("int")
    rows = nodes.select("node", "n", alone.alias("alone"), *more, F.posexplode(F.slice("grams", F.lit(1), F.size("grams") - least + 1)).alias("p", "gram"))
    return rows.withColumns({"at": F.col("alone") + F.col("p"), "alone": F.col("alone") / F.col("n")}).drop("p")


def _able(n: Column, at: Column, m: Column, bt: Column) -> Column:
    """Whether sets of n and m members may be similar that share a member with at and bt others before it."""
    length = F.lit(100) * F.least(n, m) >= LEAST * F.greatest(n, m)
    shared = F.least(at, bt) + F.least(n - at, m - bt)
    return length & ((100 + LEAST) * shared >= LEAST * (n + m))


def star(tokens: DataFrame) -> DataFrame:
    """(a, b): for each prefix n-gram, its leader (the node with the least share of members of its own) and each other node that may be similar."""
    leaders = tokens.groupBy("gram").agg(F.min(F.struct("alone", "node", "n", "at")).alias("l"), F.count("*").alias("c")).where("c > 1")
    # a checkpoint, so that AQE can split an n-gram of very many nodes in the join
    both = tokens.join(checkpointed(leaders.select("gram", "l")), "gram")
    able = _able(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at"))
    return both.where(able & (F.col("node") != F.col("l.node"))).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()


def verified(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the linked ones of ``pairs``: partial overlaps of each fragment of the order, summed for each pair."""
    fragments = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(len(CUTS) + 1)), lambda i: F.slice("grams", F.get("cuts", i - 1) + 1, F.get("cuts", i) - F.get("cuts", i - 1))))
    parts = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), fragments.alias("fragment", f"g_{k}")).where(F.size(f"g_{k}") > 0)
    size = pairs.groupBy("a").agg(F.count("*").alias("size"))
    blocked = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).alias("block"))
    leaders = blocked.select("a", "block").distinct().join(parts("a"), "a")
    members = blocked.join(parts("b"), "b")
    partial = leaders.join(members, ["a", "block", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("overlap"))
    whole = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return whole.where(100 * F.col("overlap") >= LEAST * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _company(x: dict) -> np.ndarray:
    """Which rows of a group may be similar to another one of another component, by length, place in the order and parity map."""
    n, at, comp = x["n"], x["at"], x["comp"]
    marked = np.zeros(len(n), bool)
    _, label, count = np.unique(comp, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(label != int(np.argmax(count)))
    step = max(1, (1 << 18) // len(n))
    for lo in range(0, len(rest), step):
        i = rest[lo : lo + step, None]
        both = n[i] + n
        ok = (label[i] != label) & (100 * np.minimum(n[i], n) >= LEAST * np.maximum(n[i], n))
        ok &= (100 + LEAST) * (np.minimum(at[i], at) + np.minimum(n[i] - at[i], n - at)) >= LEAST * both
        p, q = np.nonzero(ok)
        p = i[p, 0]
        for a in range(0, len(p), 1 << 16):
            u, v = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
            differ = np.bitwise_count(x["map"][u] ^ x["map"][v]).sum(axis=1, dtype=np.int64)
            # members without company differ anyway
            differ += x["own"][u] + x["own"][v]
            may = (100 + LEAST) * differ <= (100 - LEAST) * (n[u] + n[v])
            marked[u[may]] = True
            marked[v[may]] = True
    return marked


def families(tokens: DataFrame) -> DataFrame:
    """(a, b): nodes of one n-gram and several components that may hold a link, b with the first such node of its n-gram.

    ``tokens``: gram, node, n, at, own, comp, map. An n-gram of very many nodes is
    dealt out in pairs of blocks.
    """
    groups = tokens.groupBy("gram").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    groups = checkpointed(groups.select("gram", F.ceil(F.col("c") / GROUP).alias("blocks")))
    mine = tokens.join(groups, "gram").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = mine.withColumn("other", met)
    rows = rows.withColumn("cell", F.xxhash64("gram", F.least("mine", "other"), F.greatest("mine", "other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in exchange.whole_groups(batches, "cell", ROWS):
            x = {k: table.column(k).to_numpy() for k in ("cell", "node", "n", "at", "own", "comp")}
            x["map"] = np.frombuffer(b"".join(table.column("map").to_pylist()), np.uint64).reshape(-1, _MAP_WORDS)
            heads = np.flatnonzero(np.r_[True, x["cell"][1:] != x["cell"][:-1]])
            found = []
            for h, t in zip(heads, np.r_[heads[1:], table.num_rows], strict=True):
                own = {k: v[h:t] for k, v in x.items()}
                node = own["node"][_company(own)]
                found.append(np.stack([np.full(len(node), node[0]), node], axis=1) if len(node) else np.zeros((0, 2), np.int64))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        kernel.release()

    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("cell", "node", "n", "at", "own", "comp", "map")
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def _forest(grams: np.ndarray, bounds: np.ndarray, n: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between components, enough to join all that are to be joined, from whole overlaps summed over stretches of columns."""
    _, label, count = np.unique(comp, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(label != int(np.argmax(count)))
    values, column, held = np.unique(grams, return_inverse=True, return_counts=True)
    owner = kernel.owners(bounds)
    shared = held > 1
    place = np.cumsum(shared) - 1
    mine = shared[column]
    column, owner = place[column[mine]], owner[mine]
    top = list(range(len(count)))

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    edges = []
    for lo in range(0, len(rest), 256):
        some = rest[lo : lo + 256]
        overlap = np.zeros((len(some), len(n)), np.int32)
        for at in range(0, int(shared.sum()), _COLUMNS):
            inside = (column >= at) & (column < at + _COLUMNS)
            bits = np.zeros((len(n), _COLUMNS // 64), np.uint64)
            np.bitwise_or.at(bits, (owner[inside], (column[inside] - at) // 64), U64(1) << ((column[inside] - at) % 64).astype(np.uint64))
            for k, i in enumerate(some):
                overlap[k] += np.bitwise_count(bits[i] & bits).sum(axis=1, dtype=np.int32)
        linked = (100 * overlap.astype(np.int64) >= LEAST * (n[some, None] + n - overlap)) & (label[some, None] != label)
        for k, i in enumerate(some):
            found, first = np.unique(label[linked[k]], return_index=True)
            where = np.flatnonzero(linked[k])
            for c, j in zip(found.tolist(), where[first].tolist(), strict=True):
                x, y = find(int(label[i])), find(c)
                if x != y:
                    top[x] = y
                    edges.append((int(i), j))
    return edges


def settled(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links that join the components of each family; ``members``: node, family, comp.

    A large component has blocks of its own, so that pairs of blocks without
    two components are left out; the others share blocks.
    """
    own = members.join(nodes.select("node", "n", "grams"), "node").withColumn("weight", F.size("grams") + NODE)
    own = checkpointed(own)
    size = own.groupBy("family", "comp").agg(F.sum("weight").alias("weight"))
    small = F.when(F.col("weight") < BLOCK_GRAMS, F.col("weight")).otherwise(0)
    total = size.groupBy("family").agg(F.sum(small).alias("pooled"))
    cut = size.join(total, "family").select(
        "family",
        "comp",
        F.when(F.col("weight") >= BLOCK_GRAMS, F.col("comp")).otherwise(-1).alias("whose"),
        F.ceil(F.when(F.col("weight") >= BLOCK_GRAMS, F.col("weight")).otherwise(F.col("pooled")) / BLOCK_GRAMS).alias("blocks"),
    )
    spread = F.when(F.col("whose") < 0, F.xxhash64("comp")).otherwise(F.xxhash64("node"))
    dealt = own.join(checkpointed(cut), ["family", "comp"]).withColumn("block", F.struct("whose", F.pmod(spread, F.col("blocks")).alias("i")))
    blocks = checkpointed(dealt.select("family", "block").distinct())
    other = blocks.select("family", F.col("block").alias("other"))
    # pairs of blocks of a family, which are few, not of nodes
    meet = blocks.join(other, "family").where((F.col("block.whose") != F.col("other.whose")) | (F.col("block.whose") < 0))
    rows = dealt.join(meet, ["family", "block"]).withColumn("cell", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in exchange.grouped(batches, "cell"):
            grams, bounds = _flat(table.column("grams"))
            node = table.column("node").to_numpy()
            edges = _forest(grams, bounds, table.column("n").to_numpy(), table.column("comp").to_numpy())
            if edges:
                pairs = node[np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        kernel.release()

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("cell", "node", "n", "comp", "grams")
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after more links: components of the components that the links join."""
    if labels is None:
        return graph.components(links)
    of = lambda k: labels.select(F.col("node").alias(k), F.col("comp").alias(f"c_{k}"))
    high = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    top = graph.components(high.where("a <> b").distinct())
    moved = labels.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = top.join(labels, "node", "left_anti").select("node", "comp")
    return checkpointed(moved.union(fresh))


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``; ids are whole numbers, of any size, or null.

    Texts are linked when their sets of distinct N-word shingles (of lower-cased
    words; a text of fewer words is one shingle) have a Jaccard similarity of at
    least LEAST percent. A null, empty or wordless text has no shingles and is
    linked with nothing. ``component_id`` is the smallest id reachable by links;
    a row without an id links like any other, but is no one's smallest id, and
    its own is null if it reaches no id. Repeated rows, and rows that share an id,
    each get the answer for their own text. Other columns aren't read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    kernel.tune(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    about = checkpointed(screened(base))
    likely = about.where("likely")
    classes = checkpointed(likely.groupBy("sig").agg(F.min("id").alias("first"), F.min("key").alias("key")))
    chosen = base.select("key", "text").join(_few(classes.select("key").distinct()), "key")
    nodes = checkpointed(ordered(checkpointed(_sets(chosen))).withColumn("node", F.monotonically_increasing_id()))
    tokens = _prefix(nodes)
    labels = graph.components(verified(nodes, checkpointed(star(tokens))))
    # what the leaders leave open
    named = nodes.join(_few(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = _prefix(named.withColumn("own", F.col("n") - F.size("grams")), "own", "comp", "map")
    near = graph.components(families(rows))
    members = near.select("node", F.col("comp").alias("family")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labels = _merged(labels, checkpointed(settled(nodes, members)))
    # the smallest id of each component, for its classes
    of = nodes.select("node", "sig").join(_few(labels), "node").select("sig", "comp")
    named = checkpointed(classes.join(of, "sig", "left").select("sig", "first", "comp"))
    lowest = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("lowest"))
    answers = checkpointed(named.join(lowest, "comp", "left").select("sig", F.coalesce("lowest", "first").alias("lowest")))
    joined = about.join(_few(answers), "sig", "left")
    component = F.when(F.col("likely"), F.col("lowest")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component the row with the smallest id, with its own columns; all rows without links stay.

    Rows with a null id are kept as they are. Of rows with equal ids and texts one
    stays.
    """
    found = checkpointed(join(docs.where(F.col(id_col).isNotNull()), text_col, id_col))
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    kept = docs.join(_few(gone), id_col, "left_anti").select(*docs.columns)
    again = found.groupBy(id_col).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return kept
    once = kept.join(_few(again), id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(_few(again), id_col, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: n_shingles and component_id."""
    return join(docs.select("doc_id", "text"))
