import random
from collections import Counter

import pytest

from quern.llm import license_scan as L


def brute(text, templates, least=L.DICE):
    """All templates against all runs of words: best end of each start, then from the highest value down what does not overlap."""
    words = L.normalised_words(text or "")
    found = []
    for name in sorted(templates):
        t = L.normalised_words(templates[name])
        grams, m = Counter(zip(t, t[1:])), len(t) - 1
        for a in range(len(words)):
            best = None
            for b in range(a + 2, len(words) + 1):
                own = Counter(zip(words[a:b], words[a + 1 : b]))
                common, n = sum((own & grams).values()), b - a - 1
                if 2 * common / (n + m) >= least and (best is None or 2 * common * common / (n + m) > best[0]):
                    best = (2 * common * common / (n + m), b, 2 * common / (n + m))
            if best:
                found.append((-best[0], a, name, best[1], best[2]))
    taken = []
    for _, a, name, b, dice in sorted(found):
        if all(b <= c or a >= d for _, _, c, d in taken):
            taken.append((name, dice, a, b))
    return taken


SMALL = {
    "a": "one two three four five six", "b": "one two three four nine six seven", "c": "red blue red blue red", "d": "blue red",
    "e": "six seven eight one two three four five six seven eight nine ten red",
}


@pytest.mark.parametrize("seed", range(6))
def test_passages_equal_brute_force(seed):
    r = random.Random(seed)
    pieces = [t.split() for t in SMALL.values()]
    matcher = L.Matcher(SMALL)
    for _ in range(40):
        words = []
        for _ in range(r.randint(0, 5)):
            p = list(r.choice(pieces))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = r.choice(["x", "red", "one"])
            words += p + [r.choice(["x", "y", "one", "red"]) for _ in range(r.randint(0, 3))]
        text = r.choice([" ", "\n", ", "]).join(words)
        assert matcher.passages(text) == brute(text, SMALL), text


def test_query_equals_brute_force(spark, tmp_path):
    from quern.llm import queries

    r = random.Random(4)
    short = {n: t for n, t in L.TEMPLATES.items() if len(t) < 120}
    names = sorted(short)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 3)):
            words = short[r.choice(names)].split()
            if r.random() < 0.4:
                words.insert(r.randrange(len(words)), "really")
            parts += [" ".join(words), " ".join(r.choice(["the", "of", "license", "prose", "under"]) for _ in range(r.randint(0, 5)))]
        rows.append((i, r.choice(["\n", " ", "\n\n"]).join(parts)))
    rows += [(100, rows[0][1]), (101, None), (102, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in queries.op3_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        best: dict = {}
        for name, dice, _, _ in brute(t, short):
            best[name] = max(dice, best.get(name, 0.0))
        want = sorted(best, key=lambda n: (-best[n], n))
        assert got[d]["licenses"].split(",") == (want or [""]) and got[d]["n_licenses"] == len(want), t
        assert (got[d]["license"], got[d]["dice"]) == ((want[0], best[want[0]]) if want else (None, None))


def test_every_template_is_found_inside_prose():
    r = random.Random(1)
    matcher = L.Matcher(L.TEMPLATES)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    for name, text in L.TEMPLATES.items():
        words = text.split()
        layouts = [text, text.upper(), "\n".join(words), "Copyright (c) 2020 Somebody. " + text, f"{prose(30)} {text} {prose(30)}"]
        if len(words) > 20:
            layouts.append("\n\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)))
            layouts.append(" ".join(w for k, w in enumerate(words) if k % 23))
        for layout in layouts:
            assert matcher.licenses(layout)[0][0] == name, (name, layout)
            assert len(matcher.licenses(layout)) == 1


def test_scan(spark):
    mit = L.TEMPLATES["MIT-text"]
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose."),
        (2, "Copyright 2020 Someone\n" + mit[:200] + "\n" + mit[200:]),
        (3, "licensed UNDER the gnu general public licence version 3"),
        (4, "This is prose about nothing in particular, under no terms."),
        (5, None), (6, ""), (7, "one"), (8, "Released under the MIT License.\n\nLicensed under CC BY 4.0."), (9, "word " * 200000),
        (10, "Released under the MIT License. " * 3), (10, "Released under the MIT License. " * 3), (None, mit),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, matches int, license string")
    rows_out = L.scan_licenses(df).collect()
    out = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in rows_out}
    assert out[1] == ["MIT"] and out[2] == ["MIT-text"] and out[3] == ["GPL-3.0"] and out[8] == ["CC-BY-4.0", "MIT"] and out[None] == ["MIT-text"]
    assert not any(out[i] for i in (4, 5, 6, 7, 9))
    assert [r["matches"][0]["passages"] for r in rows_out if r["doc_id"] == 10] == [3, 3]
    assert L.scan_licenses(df.limit(0)).count() == 0
    own = L.scan_licenses(df, templates={"prose": "Some prose here"}).where("doc_id = 1").first()
    assert [m["license"] for m in own["matches"]] == ["prose"]
