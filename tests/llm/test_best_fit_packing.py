import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import best_fit_packing as B

PATH = P.path("byte_bpe_50k.json")


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_places_each_piece_once(histogram):
    places, bins = B.plan(histogram, 64, 6)
    sequences, got = defaultdict(list), Counter()
    for length, rank, count, sequence, offset in places:
        got[length] += count
        for i in range(count):
            sequences[sequence + i].append((offset, length))
    assert got == histogram and set(sequences) == set(range(bins))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    h = dict(Counter((rng.lognormal(6.5, 0.9, 5000).astype(int) % 2047 + 1).tolist()))
    assert B.plan(h)[1] <= 1.01 * sum(k * n for k, n in h.items()) / 2048


def test_configurations_do_most_of_the_packing(monkeypatch):
    """Most tokens, and sequences of several pieces, come from configurations; the result stays at the bound."""
    rng = np.random.default_rng(2)
    h = dict(Counter((rng.lognormal(6.4, 0.8, 8000).astype(int) % 2047 + 1).tolist()))
    made, real = [], B.configurations
    monkeypatch.setattr(B, "configurations", lambda sizes, *more: [made.extend([(np.dot(sizes, c), c.sum(), n)]) or (c, n) for c, n in real(sizes, *more)])
    tokens = sum(k * n for k, n in h.items())
    assert B.plan(h)[1] <= 1.003 * -(-tokens // 2048)
    assert sum(size * n for size, _, n in made) > 0.7 * tokens
    assert sum(n for _, pieces, n in made if pieces > 1) > 0.4 * sum(n for _, _, n in made)


@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0, 1)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
@settings(max_examples=40, deadline=None)
def test_best_configuration_by_the_letter(items):
    sizes, worth = zip(*items)
    best = [0.0] * 41
    for room in range(1, 41):
        best[room] = max([best[room - 1], *(best[room - s] + w for s, w in items if s <= room)])
    value, counts = B._best_configuration(list(sizes), np.array(worth), 40)
    assert abs(value - best[40]) < 1e-9 and np.dot(counts, sizes) <= 40 and abs(np.dot(counts, worth) - value) < 1e-9


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    encode = B._encoder(PATH, P.PATTERN)
    odd = ["", " ", "<|endoftext|>", "a" * 6000, " " * 6000 + "x", "\x00\x1c\x85 é", "don't  stop\n\n", "=" * 20000]
    for text in [d["text"] for d in docs] + odd:
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_pack_by_the_letter(spark, library):
    rows = [(1, "hello world " * 900), (2, None), (3, ""), (4, "short text"), (4, "short text"), (5, "a b c d " * 120), (None, "x"), (6, "w " * 4096)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, offset int")
    out = B.pack(df, PATH, P.PATTERN, capacity=256).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = Counter()
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 256 or min(len(ids), 256)
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(d, p, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    assert got == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in by.values():
        at = 0
        for o, n in sorted(content):
            assert o == at
            at += n
        assert at <= 256
    assert B.pack(df.limit(0), PATH).count() == 0
