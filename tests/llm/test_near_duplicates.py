import random

import corpus_pipeline as P
from quern.llm import common, shingle_overlap, simhash_dedup


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def near_copies(seed=3, n=40, copies=2):
    """Texts with copies in which single words differ, some a little over and some a little under 0.8."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    rows, common = [], [word() for _ in range(12)]
    for _ in range(n):
        words = common + [word() for _ in range(r.randint(60, 300))]
        rows.append(" ".join(words))
        for _ in range(copies):
            changed = list(words)
            for _ in range(max(1, round(len(words) * r.uniform(0.005, 0.035)))):
                changed[r.randrange(12, len(words))] = word()
            rows.append(" ".join(changed))
    return list(enumerate(rows))


def brute(rows):
    root = {d: d for d, _ in rows}
    for d, t in rows:
        for e, u in rows:
            if e < d and root[d] != root[e] and jaccard(t, u) >= 0.8:
                low, high = sorted((root[d], root[e]))
                root = {x: low if y == high else y for x, y in root.items()}
    return root


def test_components_equal_brute_force(spark):
    """Small groups, and large ones down to the pairs that are compared one by one."""
    rows = near_copies()
    want = brute(rows)
    far = [(a, b) for (a, t) in rows for (b, u) in rows if a < b and jaccard(t, u) >= 0.8 and (simhash_dedup.fingerprint(t) ^ simhash_dedup.fingerprint(u)).bit_count() > simhash_dedup.THRESHOLD]
    assert len(far) > 10 and len(set(want.values())) > 45
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (shingle_overlap.GROUP, 1):
        assert {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(df, group=group).collect()} == want


def test_stage_removes_near_copies(spark):
    rows = near_copies(seed=4, n=12)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.near_duplicates(spark, df, "").collect()} == set(brute(rows).values())


def test_texts_without_words_and_empty_table(spark):
    df = spark.createDataFrame([(3, None), (2, ""), (1, " \n"), (5, "one two"), (4, "One  two"), (6, "one")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == {3: 1, 2: 1, 1: 1, 5: 4, 4: 4, 6: 6}
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_and_shingles_of_many_texts_equal_brute_force(spark):
    """Components dealt out as pairs of blocks of a few texts, and stars instead of forests."""
    rows = near_copies(seed=5, n=9, copies=7) + [(1000, None), (1001, " "), (1002, "one"), (1003, "One")]
    want = brute([(d, t or "") for d, t in rows[:-4]]) | {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group, unit in ((1024, 3), (2, 2), (1024, 4096)):
        got = simhash_dedup.near_duplicates(df, group=group, unit=unit).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_rows_grow_with_the_texts_of_a_group_only(spark):
    """Texts of one pattern below the similarity: candidates of each other all, links none."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    words, n = [word() for _ in range(120)], 150
    rows = []
    for i in range(n):
        own = list(words)
        for k in r.sample(range(120), 4):
            own[k] = word()
        rows.append((i, " ".join(own)))
    assert all(0.35 < jaccard(rows[0][1], t) < 0.8 for _, t in rows[1:])
    overlap = shingle_overlap.Overlap(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5, 0.8)
    met = shingle_overlap.connected_components(overlap._candidates())
    assert met.count() > 0.9 * n and overlap._candidates().distinct().count() < 4 * n < n * (n - 1) // 2
    assert overlap._linked(met).count() < n
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in overlap.components(spark.createDataFrame([], "a long, b long")).collect()} == want


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_stage_leaves_no_texts_in_shuffle_files(spark, tmp_path):
    """Tables too large to broadcast: neither the check of candidates nor the removal of rows shuffles all texts, and what was shuffled goes."""
    rows = near_copies(seed=7, n=100)
    text = sum(len(t) for _, t in rows)
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs, limit = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = shuffle_files(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        P.near_duplicates(spark, docs, "").write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    left = {name: n for name, n in shuffle_files(spark).items() if name not in before}
    assert sum(left.values()) < text / 4, sorted(left.items(), key=lambda x: -x[1])[:12]
    assert spark.conf.get(common.CLEANUP) == "false"
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == set(brute(rows).values())


def test_rows_among_numbers(spark, monkeypatch):
    """Also negative numbers and repeats, and sets too large to broadcast."""
    numbers = [-(1 << 63), -65, -64, -1, 0, 63, 64, (5 << 33) + 2, (1 << 63) - 1]
    rows = spark.createDataFrame([(n, str(n)) for n in {*numbers, *(n + 1 for n in numbers[:-1]), *(n - 1 for n in numbers[1:])}], "k long, v string")
    wanted = spark.createDataFrame([(n,) for n in numbers * 2], "k long")
    for words in (common.WORDS, 0):
        monkeypatch.setattr(common, "WORDS", words)
        assert sorted(r["k"] for r in common.among(rows, wanted, "left_semi").collect()) == numbers
        assert {r["k"] for r in common.among(rows, wanted, "left_anti").collect()} == {r["k"] for r in rows.collect()} - set(numbers)
        assert common.among(rows, wanted.limit(0), "left_anti").count() == rows.count()


def test_rounds_of_shingles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_overlap, "ROUND_TEXTS", 0)
    rows = near_copies(seed=9, n=12)
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def test_common_passages_of_a_large_table_join_no_texts(spark, monkeypatch):
    """A passage in one text of 20 stays out of the prefixes also where a sample of fixed size misses it; else all its texts are one component."""
    monkeypatch.setattr(shingle_overlap, "SAMPLE", 10)
    monkeypatch.setattr(shingle_overlap, "ONE_OF", 2, raising=False)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(16)]
    rows = [(i, " ".join([word() for _ in range(60)] + passage * (i % 20 == 0))) for i in range(1000)]
    overlap = shingle_overlap.Overlap(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5, 0.8, group=16)
    assert overlap._candidates().count() == 0
