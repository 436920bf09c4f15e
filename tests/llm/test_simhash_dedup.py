import random
import re

import numpy as np
import xxhash

from quern.llm import simhash_dedup as S


def slow_fingerprint(text):
    """The fingerprint as the rule states it, bit by bit."""
    words = [w.encode() for w in re.split("[\\x20\\x09-\\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_fingerprint_by_the_letter():
    for t in [None, "", "A", "Ab CD", "é É ß x Y z", "one two three four five six one two three four", "a\tb\nC d E f"]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_reach_covers_every_pair_within_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    ax, ay = ({(int(r), int(a)) for r, a in zip(*S.anchors_of(v.view(np.int64), 2))} for v in (x, y))
    assert all(any((i, a) in ay for j, a in ax if j == i) for i in range(len(x)))


def brute(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(25):
        base = [word() for _ in range(r.choice([3, 30, 300]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [None, "", " \n", rows[0], rows[0]]
    df = spark.createDataFrame([(i * 3 % 997, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    prints = {i * 3 % 997: S.fingerprint(t) for i, t in enumerate(rows)}
    roots = brute(set(prints.values()))
    least = {}
    for d, f in prints.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    want = {d: (f, least[roots[f]]) for d, f in prints.items()}
    for block, reach in ((S.BLOCK, None), (2, None), (S.BLOCK, S.THRESHOLD)):
        out = S.simhash_components(df, block=block, reach=reach).collect()
        assert {x["doc_id"]: (x["fp"] % (1 << 64), x["component_id"]) for x in out} == want and len(out) == len(rows)


def test_long_texts_ties_and_clashing_columns(spark):
    long = "word " * 60_000 + "tail"
    rows = [(4, long, 1, 2), (2, long, 1, 2), (9, "a b c d e f", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id int")
    out = {x["doc_id"]: (x["fp"] % (1 << 64), x["component_id"]) for x in S.simhash_components(df).collect()}
    assert out == {4: (S.fingerprint(long), 2), 2: (S.fingerprint(long), 2), 9: (S.fingerprint("a b c d e f"), 9)}


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z")], "doc_id long, text string")
    out = S.simhash_components(df).collect()
    assert sorted((str(x["doc_id"]), str(x["component_id"])) for x in out) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert S.simhash_components(df.limit(0)).count() == 0


def test_chain_is_one_component(spark):
    from quern.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    out = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[100] == out[101] == 100
