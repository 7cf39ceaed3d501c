"""The prefix trie against one built turn by turn."""

import collections
import hashlib
import random
import zlib

import pytest

from turnlens.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuild(own):
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def brute(rows, rebuilt=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    said = rebuild(own) if rebuilt else own
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(said):
        for d in range(len(said[c]) + 1):
            members[tuple(said[c][:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in below[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(said[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(seed):
    """Long shared beginnings that part at random places."""
    rng = random.Random(seed)
    return [(c, t, "u" if t % 2 else "a", f"é{t if rng.random() < 0.985 else rng.randrange(3)}") for c in range(-7, 40) for t in range(rng.randrange(90))]


ODD = [(None, 0, "u", "x"), (3, None, None, None), (3, None, None, None), (70, 5, "u", "b"), (71, 0, "u", "b"), (72, None, "", "")]
COPIES = [(80 + i, t, "u", "same" * t) for i in range(9) for t in range(40)]


@pytest.fixture
def small_tasks(spark):
    """Many tasks and small batches, so that conversations run on from one to the next."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op12_prefix_trie(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.mark.parametrize("rebuilt", [True, False])
def test_partings_over_many_tasks(spark, small_tasks, rebuilt):
    rows = conversations(3) + ODD + COPIES
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(trie.digest(frame) if rebuilt else trie.build(frame)) == brute(rows, rebuilt)


def test_one_conversation_over_many_tasks(spark, small_tasks):
    rows = [(0, t, "u", f"x{t}") for t in range(900)] + [(c, t, "u", f"x{t}") for c in (1, 2) for t in range(c * 300)]
    assert nodes(trie.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_long_edges_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "u", "y" * (t % 7) + (str(c) if t > 20 + c else "")) for c in range(6) for t in range(40)]
    assert nodes(trie.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_names_of_columns_and_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(trie, "FEW", 0)
    rows = conversations(5)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv bigint, n bigint, k1 string, bytes string, p1 int, m int").repartition(3)
    assert nodes(trie.build(frame, "conv", "n", "k1", "bytes")) == brute(rows, False)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x")], [(4, 0, None, "")], [(1, 0, "u", "x")]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert nodes(trie.digest(frame)) == brute(rows)
    assert nodes(trie.build(frame)) == brute(rows, False)
