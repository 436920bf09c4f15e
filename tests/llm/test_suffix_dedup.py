import hashlib
import random

import numpy as np
import pytest

from quern.llm import suffix_dedup as S

TYPES = "doc_id long, text string, doc string"


def brute(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} by a dictionary of all windows."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            first.setdefault(data[s : s + length], (doc, s))
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] != (doc, s):
                gone[s : s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed, n, alphabet, passages):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(60, 400)) for _ in range(passages)]
    rows = []
    for d in range(n):
        parts = [word(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(shared))
            if r.random() < 0.5 and p:
                p[r.randrange(len(p))] = "#"
            parts += ["".join(p), word(r.randint(0, 120))]
        rows.append((d, "".join(parts)))
    rows.append((n, rows[0][1]))
    rows.append((n + 1, "ab" * 400))
    rows.append((n + 2, "é" * 160 + word(30)))
    rows += [(n + 3, ""), (n + 4, None), (n + 5, "x" * 99), (n + 6, "x" * 100), (n + 7, "x" * 350)]
    return rows


@pytest.mark.parametrize("seed,alphabet,crowd,mob", [(1, "abcdefgh ", 20000, 10), (2, "ab", 20000, 10), (3, "abcdefghijk\n ", 3, 1000), (4, "ab", 2, 1000), (5, "abcdefgh ", 2, 1), (6, "ab", 2, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet, crowd, mob):
    """All ways of dealing windows out: whole segments, blocks, single windows, and mixtures."""
    monkeypatch.setattr(S, "MOB", mob)
    rows = texts(seed, 40, alphabet, 4)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(d, t, "other") for d, t in rows], TYPES).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup_substrings(df, crowd=crowd).collect()}
    assert got == brute(rows, S.LENGTH)


def test_spans_are_real(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefghijklmnop") for _ in range(150))
    df = spark.createDataFrame([(1, "one " + passage), (2, "two " + passage + " end")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in S.dedup_substrings(df).collect()}
    assert [tuple(x) for x in out[1]["removed"]] == []
    # The blank before the passage is common too.
    assert [tuple(x) for x in out[2]["removed"]] == [(3, 154)]


def test_null_ids_repeated_rows_and_empty(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(180))
    df = spark.createDataFrame([(None, long), (5, long), (5, long)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in S.dedup_substrings(df).collect()), key=str)
    assert got == [(5, 180), (5, 180), (None, 0)]
    twice = spark.createDataFrame([(5, long), (5, long)], "doc_id long, text string")
    assert [r["n_removed"] for r in S.dedup_substrings(twice).collect()] == [0, 0]
    assert S.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("doc", [None, 7])
def test_many_different_texts_under_one_id(spark, doc):
    """Rows are told apart by more than the id and a few bits: each text has the passage at a place of its own."""
    r = random.Random(9)
    word = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    passage = word(120)
    # Of all texts the start of the passage differs, and the symbols beside it.
    rows = [(doc, word(i) + chr(0x100 + i) + passage + chr(0x1100 + i) + word(20)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["n_bytes"]: [tuple(s) for s in x["removed"]] for x in S.dedup_substrings(df).collect()}
    starts = {len(t.encode()): t.encode().index(passage.encode()) for _, t in rows}
    assert got.keys() == starts.keys()
    for size, start in starts.items():
        spans = got[size]
        if start == min(starts.values()):
            assert spans == []
        else:
            # Last bytes of the symbols beside the passage may be common as well.
            assert len(spans) == 1 and start - 1 <= spans[0][0] <= start and start + 120 <= spans[0][1] <= start + 122

@pytest.mark.parametrize("doc", [None, 7])
def test_texts_under_one_id_equal_brute_force(spark, monkeypatch, doc):
    """One id for all rows, and marks so short that rows share them: the check keeps them apart."""
    r = random.Random(10)
    word = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    shared = [word(150) for _ in range(6)]
    rows = [word(r.randint(5, 60)) + r.choice(shared) + word(r.randint(0, 50)) + str(i) for i in range(300)]
    first: dict = {}
    for t in rows:
        for s in range(len(t) - 99):
            first[t[s : s + 100]] = min(s, first.get(t[s : s + 100], s))
    xxhash64 = S.F.xxhash64
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: S.F.pmod(xxhash64(*c), S.F.lit(40)) if [x for x in c if isinstance(x, str)] == ["id", "text"] else xxhash64(*c))
    df = spark.createDataFrame([(doc, t) for t in rows], "doc_id long, text string").repartition(4)
    got = {x["kept_sha256"] for x in S.dedup_substrings(df).collect()}
    want = set()
    for t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if first[t[s : s + 100]] != s:
                gone[s : s + 100] = [True] * 100
        want.add(hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())
    assert got == want


def test_columns_with_clashing_names(spark):
    r = random.Random(12)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(180))
    df = spark.createDataFrame([(1, long, 5, "m", 9), (2, "x" + long, 6, "n", 8)], "doc_id long, text string, mark int, hash string, check int")
    assert {x["doc_id"]: x["n_removed"] for x in S.dedup_substrings(df).collect()} == {1: 0, 2: 180}


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(3)
    common = rng.integers(97, 101, 100, dtype=np.uint8)
    a = np.concatenate([rng.integers(97, 101, 500, dtype=np.uint8), common, rng.integers(97, 101, 300, dtype=np.uint8)])
    b = np.concatenate([rng.integers(97, 101, 77, dtype=np.uint8), common])
    one, two = (dict(zip((S.anchors(x, np.array([0]), np.array([len(x)]))[0] - at).tolist(), S.anchors(x, np.array([0]), np.array([len(x)]))[1].tolist())) for x, at in ((a, 500), (b, 77)))
    assert any(0 <= p <= 100 - S.GRAM and two.get(p) == h for p, h in one.items())
