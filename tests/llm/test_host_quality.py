import random

from quern.llm import host_quality as H

TYPES = "doc_id long, text string, source string, n_words string, kept string"


def brute(text):
    words = [w for w in _split(text or "")]
    lines = [x for x in (text or "").split("\n") if _split(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in H.SYMBOLS for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def _split(text):
    out, now = [], ""
    for c in text:
        if c in " \t\n\x0b\f\r":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def sample():
    r = random.Random(1)
    vocabulary = ["aa", "bb", "çé", "d#", "e f", " ", "𝒳y"]
    rows = [None, "", " \n\t ", "one", "a a a a", "a b c a b c", "x\n\nx\nx \r\n", "\x0b\x0cw"]
    for _ in range(60):
        rows.append("".join(r.choice(vocabulary) + r.choice([" ", "\n", "  ", "\t", " "]) for _ in range(r.randint(0, 90))))
    return rows


def test_statistics_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}", "x", "y") for i, t in enumerate(rows)], TYPES)
    out = H.judge_documents(df).select("document.doc_id", *H.STATS, "kept").collect()
    assert len(out) == len(rows)
    for r in out:
        n, *_ = want = brute(rows[r["doc_id"]])
        assert tuple(r[c] for c in H.STATS[:6]) == want
        assert r["base_failed"] == (n < 50 or 100 * want[5] > 50 * n)


def test_host_verdict_needs_both_host_and_document(spark):
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    dirty = lambda: clean() + " #" * 12
    filthy = lambda: clean() + " #" * 90
    rows = [(i, clean(), "good") for i in range(40)] + [(40, dirty(), "good"), (41, filthy(), "good")]
    rows += [(100 + i, dirty(), "bad") for i in range(30)] + [(130, clean(), "bad")] + [(200, dirty(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {x["doc_id"]: x["kept"] for x in H.judge_documents(df).select("document.doc_id", "kept").collect()}
    # Where failures are rare only a document that fails by far goes, where they are common any that fails; one that passes stays.
    assert all(kept[i] for i in range(41)) and not kept[41] and kept[130]
    assert not any(kept[100 + i] for i in range(30))


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "w " * 60, "s"), (1, "w " * 60, "s"), (None, None, None)], "doc_id long, text string, source string")
    assert H.judge_documents(df.limit(0)).count() == 0
    assert sorted((x["n_words"], x["kept"]) for x in H.judge_documents(df).collect()) == [(0, False), (60, False), (60, False)]


def test_a_rule_tells_nothing_at_a_spotless_host(spark):
    levels = spark.createDataFrame([("a", 0)] * 4999 + [("a", 2)] + [("b", 2)] * 3000 + [("c", 1)] * 100 + [("c", 0)] * 900, "host string, level_symbols int")
    levels = levels.selectExpr("*", "0 as level_dup_lines", "0 as level_word_length")
    got = {r["host"]: (r["rejects_symbols"], r["rejects_dup_lines"]) for r in H.host_verdicts(levels, "host").collect()}
    assert got == {"a": (3, 3), "b": (1, 3), "c": (2, 3)}


def test_labelled_documents(spark):
    """Junk goes and documents of quality stay, beyond what the base rule decides."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = H.judge_documents(docs).select("document.doc_id", "base_failed", "kept").join(labels, "doc_id").where("not base_failed").collect()
    for quality, least in ((0, 0.95), (1, 0.99)):
        mine = [r for r in rows if r["quality"] == quality]
        assert len(mine) > 20 and sum(r["kept"] == bool(quality) for r in mine) >= least * len(mine)
