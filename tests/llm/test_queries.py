"""The registered queries, on small tables with hard rows, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_secret_scan import brute as brute_secrets
from test_simhash_dedup import brute as brute_components
from test_simhash_dedup import slow_fingerprint
from test_suffix_dedup import brute as brute_suffix
from tokenizers import Tokenizer

from quern.llm import license_scan, queries

Q = queries.queries()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(40)]
    rows = [(i, t, "en", r.choice(["s1", "s2", "ß"])) for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " Tail", "de", "s1") for i in range(20)]
    rows += [(200, None, None, None), (201, "", "en", "s2"), (202, 'x token = "' + "0f" * 20 + '"\nReleased under the MIT License.', "en", "s1"), (203, base[3] * 30, "fr", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, a, s, len(t or "")) for d, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 8))
    near = [(i, (x[i % 12] + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist(), i % 12 % 2) for i in range(30)] + [(30, None, 1), (31, [0.0] * 8, 0), (32, [1.0] * 8, None)]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate([None, "", "a" * 99, "a" * 99, "b" * 100, "b" * 100, "c" * 300])], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, {d: (t, s) for d, t, _, s in rows}


def rows_of(spark, sf, name):
    return Q[name](spark, sf[0]).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as from '{sf[0]}/{t}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
    df = Q[name](spark, sf[0])
    assert sorted(df.columns) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_licenses(spark, sf):
    got = {r["doc_id"]: r["license"] for r in rows_of(spark, sf, "op3_license_scan")}
    assert got == {d: next((m[0] for m in license_scan.Matcher(license_scan.TEMPLATES).licenses(t)), None) for d, (t, _) in sf[1].items()} and got[202] == "MIT"


def test_simhash(spark, sf):
    prints = {d: slow_fingerprint(t) for d, (t, _) in sf[1].items()}
    root, least = brute_components(set(prints.values())), {}
    for d, f in prints.items():
        least[root[f]] = min(d, least.get(root[f], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf, "op4_simhash_dedup")}
    assert got == {d: (f"{f:016x}", least[root[f]]) for d, f in prints.items()}


def test_packing(spark, sf):
    library = Tokenizer.from_file(P.path(queries.TOKENIZER))
    library.encode_special_tokens = True
    want, total = {}, 0
    for d, (t, _) in sf[1].items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want |= {(d, p): (s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(cuts, cuts[1:]))}
    out = rows_of(spark, sf, "op5_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in sequences.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))] and sum(n for _, n in content) <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_shards(spark, sf):
    out = rows_of(spark, sf, "op7_sharding")
    assert {r["doc_id"]: r["size"] for r in out} == {d: len((t or "").encode()) + 1 for d, (t, _) in sf[1].items()}
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))


def test_suffixes(spark, sf):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, sf, "op8_suffix_dedup")}
    assert got == brute_suffix([(d, t) for d, (t, _) in sf[1].items()], 100)


def test_secrets(spark, sf):
    for r in rows_of(spark, sf, "op10_secret_scan"):
        spans = brute_secrets(sf[1][r["doc_id"]][0])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text
