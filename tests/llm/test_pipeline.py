import random
from collections import Counter

import corpus_pipeline as P
from quern.llm import best_fit_packing, queries, simhash_dedup
from quern.llm.common import materialize


def corpus(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    rows = [(i, prose(r.randint(60, 400)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", rows[i][3]) for i in range(5)]
    rows += [(200, "too short", "en", "s0"), (201, None, "en", "s1"), (202, prose(70) + ' token = "0123456789abcdef0123456789abcdef"', "en", None)]
    return spark.createDataFrame([(d, t, a, s, len(t or "")) for d, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages_decide(spark):
    docs, rows = corpus(spark)
    got = {}
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, ""), "stage")
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        got[name], docs = out.collect(), out
    assert {r["doc_id"] for r in got["quality rules"]} == {d for d, *_ in rows} - {200, 201}
    prints = {d: simhash_dedup.fingerprint(t) for d, t, *_ in rows}
    assert {r["doc_id"] for r in got["SimHash near-dedup"]} == {d for d in prints if d < 100 or d == 202}
    masked = {r["doc_id"]: r for r in got["secret scans"]}
    assert len(masked) == 61 and "0123456789abcdef" not in masked[202]["text"] and masked[202]["n_chars"] == len(masked[202]["text"])
    copies = Counter(r["doc_id"] for r in got["mixing sources to target weights"])
    assert max(copies.values()) <= 3 and set(copies) <= set(masked)
    packed = got["best-fit packing"]
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_no_clash_with_other_columns(spark):
    docs, _ = corpus(spark)
    docs = docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "source")
    assert P.quality(spark, docs, "").columns == docs.columns
    assert P.near_duplicates(spark, docs, "").columns == docs.columns


def test_near_duplicates_with_null_and_repeated_ids(spark):
    docs, _ = corpus(spark)
    texts = [r["text"] for r in docs.where("doc_id < 4").orderBy("doc_id").collect()]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (9, texts[2]), (9, texts[3])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema)
    got = sorted((str(r["doc_id"]), r["text"]) for r in P.near_duplicates(spark, df, "").collect())
    assert got == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("9", texts[3])])


def test_near_duplicates_with_clashing_columns_and_long_texts(spark):
    docs, rows = corpus(spark)
    long = " ".join(f"w{i % 9999}" for i in range(120_000))
    more = spark.createDataFrame([(300, long, "en", "s", len(long)), (301, long + " tail", "en", "s", len(long) + 5), (302, None, "en", "s", 0), (303, "", "en", "s", 0)], docs.schema)
    both = docs.unionAll(more).selectExpr("*", "1 as _n", "2 as _id", "3 as _hash", "4 as _number", "5 as name", "6 as node", "7 as `a.b`")
    out = P.near_duplicates(spark, materialize(both, "clash"), "")
    assert out.columns == both.columns
    got = {r["doc_id"] for r in out.collect()}
    # Texts without words are one group, also with the row 201 of the corpus; the long texts are another.
    assert got == {d for d, *_ in rows if d < 100 or d in (200, 201, 202)} | {300}


def test_empty_table(spark):
    docs, _ = corpus(spark)
    docs = materialize(docs.limit(0), "none")
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        docs = materialize(out, "none") if name != P.STAGES[-1][0] else docs


def test_run_over_a_table(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    packed = P.run(spark, str(tmp_path)).collect()
    room = Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    # Copies, short texts and texts without words are gone; no sequence is over its capacity.
    assert {r["doc_id"] for r in packed} <= {d for d, *_ in rows if d < 100 or d == 202} and max(room.values()) <= best_fit_packing.CAPACITY


def test_queries_run_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op3_license_scan", "op7_sharding", "op9_source_mixing", "op10_secret_scan"):
        assert queries.queries()[name](spark, sf).count() == n
