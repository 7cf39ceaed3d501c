"""Alignment of two tokenizers against plain loops over their libraries' tokens."""

import collections
import hashlib
import itertools

import pytest

from turnlens.llm import align, queries, tokencount

A, B = queries.token_file("byte_bpe_50k.json"), queries.token_file("piece_bpe_32k.model")
ODD = [
    None, "", " \n\t ", "a b c", "  a  b\n c ", "z " * 500, "<|endoftext|> it's 12　日本語 😀   end  ", "▁x", "fine ▁ not", "!" * 5000,
    "😀" * 300, "日本語" * 500, "a\x00b \x1c c \x85 d <s> </s> <unk> <0x41>", "​  é ﻿ x", " ", "x", "ab" * 3000, "x", "� ퟿",
    " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000)),
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libraries):
    """Ids of both and the offsets at which they end; None where their bytes aren't the text's."""
    a, b = libraries
    alphabet, vocab = tokencount._byte_alphabet(), {i: p for p, i in a.get_vocab().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in vocab[x]) for x in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = lambda pieces: list(itertools.accumulate(map(len, pieces)))
    return ids_a, ids_b, ends(bytes_a), ends(bytes_b)


def groups(found):
    ids_a, ids_b, ends_a, ends_b = found
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        i1, j1 = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((ids_a[i:i1], ids_b[j:j1]))
        i, j = i1, j1
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(10**6 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)


@pytest.fixture(scope="module")
def aligned(texts, libraries):
    found = {i: tokens(t, libraries) if t else None for i, t in texts}
    return {i: (f, groups(f) if f else []) for i, f in found.items()}


@pytest.fixture(scope="module")
def counts(aligned):
    return collections.Counter(k for _, g in aligned.values() for k in {(x, y) for p, q in g for x in p for y in q})


@pytest.mark.parametrize("chunk", [align.CHUNK, 1])
def test_digest(docs, aligned, counts, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    want = {}
    for i, (found, g) in aligned.items():
        links = [(x, y) for p, q in g for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        sizes = (len(found[0]), len(found[1])) if found else (0, 0)
        want[i] = (*sizes, len(g), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if found else "")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.digest(docs, A, B).collect()}
    assert got == want
    assert want[10**6 + 7][0] == want[10**6 + 8][0] == 0 and want[10**6 + 9][3] > 0


def test_align(docs, texts, aligned):
    out = align.align(docs.selectExpr("doc_id", "text", "'mine' AS a_tokens", "doc_id AS _own0"), A, B).collect()
    assert len(out) == len(texts)
    for r in out:
        found, g = aligned[r.doc_id]
        ids_a, ids_b, ends_a, ends_b = found or ([], [], [], [])
        assert (r.a_tokens, r.b_tokens, r.a_sizes, r.b_sizes) == (ids_a, ids_b, [len(p) for p, _ in g], [len(q) for _, q in g])
        starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        pairs, j = [], 0
        for i in range(len(ends_a)):
            while ends_b[j] <= starts_a[i]:
                j += 1
            pairs += [(i, k) for k in range(j, len(ends_b)) if starts_b[k] < ends_a[i]] if len(ends_b) < 3000 else []
        if len(ends_b) < 3000:
            assert list(zip(r.overlap_a, r.overlap_b, strict=True)) == pairs
        assert r["_own0"] == r.doc_id


def test_corpus_links(docs, counts):
    got = {(r.a, r.b): (r.n, r.best) for r in align.corpus_links(docs, A, B).collect()}
    assert {k: n for k, (n, _) in got.items()} == counts
    top = collections.Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    assert all(best == (n == top[a]) for (a, _), (n, best) in got.items())


def test_forgetting_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 3)
    aligner = align.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    for text in [t for t in ODD if t and len(t) < 20_000] * 2:
        places, _, keep = aligner.stretches([text])
        found = tokens(text, libraries)
        assert b"".join(aligner.parts[p][0] for p in places) == align._ints(found[0] if found else [])
        aligner.forget(keep)


def test_empty(docs):
    assert align.digest(docs.limit(0), A, B).collect() == []
    assert align.align(docs.limit(0), A, B).collect() == []
    nothing = docs.where("text IS NULL OR text = ''")
    assert [r.groups_sha256 for r in align.digest(nothing, A, B).collect()] == ["", ""]
