"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, embedding_dedup, host_quality, license_scan, secret_scan, sharding, simhash_dedup, source_mixing, suffix_dedup, warc
from .common import fresh_path, table

#: Vocabulary of the packing query.
TOKENIZER = "byte_bpe_50k.json"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_quality.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("document.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get("matches", 0)
    return out.select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"), F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("_row")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.BASE))
    return out.select("doc_id", *map(count, secret_scan.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op2_sql() -> str:
    q = host_quality
    prior, bad = [], []
    for r in q.RULES:
        prior.append(f"""
            (select m * k as a, k from (select m, least(greatest(case when b > 0 then m * (1 - m) / b - 1 else {q.PRIOR_MAX} end, {q.PRIOR_MIN}), {q.PRIOR_MAX}) as k
             from (select any_value(m) as m, sum(n * pow(f_{r} / n::double - m, 2)) / sum(n) - any_value(m) * (1 - any_value(m)) * count(*) / sum(n) as b
                   from hosts, (select sum(f_{r}) / sum(n)::double as m from hosts)))) as p_{r}""")
        rate = f"(f_{r} + p_{r}.a) / (n + p_{r}.k)"
        bad.append(f"case when {rate} >= {q.HOST_BAD} then 1 when {rate} >= {q.HOST_SPOTLESS} then 2 else 3 end as rejects_{r}")
    return rf"""
    with w as (
      select doc_id, source, coalesce(text, '') as t, {WORDS_SQL} as ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
    grams as (
      select doc_id, i, count(*) over (partition by doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as c
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from grams where c > 1) group by doc_id),
    s as (
      select w.doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::bigint as n_symbols, len(ls)::bigint as n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join rep using (doc_id)),
    f as (
      select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             case when 10 * n_symbols > 3 * n_words then 2 when 10 * n_symbols > n_words then 1 else 0 end as level_symbols,
             case when 10 * n_dup_lines > 9 * n_lines then 2 when 10 * n_dup_lines > 3 * n_lines then 1 else 0 end as level_dup_lines,
             case when word_chars < 2 * n_words or word_chars > 24 * n_words then 2
                  when word_chars < 3 * n_words or word_chars > 12 * n_words then 1 else 0 end as level_word_length from s),
    hosts as (select source, count(*) as n, {', '.join(f'sum((level_{r} > 0)::int) as f_{r}' for r in q.RULES)} from f group by source),
    v as (select source, {', '.join(bad)} from hosts, {', '.join(prior)}),
    j as (select f.*, {' or '.join(f'level_{r} >= rejects_{r}' for r in q.RULES)} as host_failed from f join v on f.source is not distinct from v.source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept, host_failed from j
    """


def _op9_sql() -> str:
    m = source_mixing
    weights = " ".join(f"when {i} then {w}" for i, w in enumerate(m.WEIGHTS))
    return f"""
    with d as (select doc_id, source, len({WORDS_SQL})::bigint as size, md5('42:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as k from documents),
    per as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source),
    cap as (select source, source_size, (case r % {len(m.WEIGHTS)} {weights} end)::double as w, source_size::double * {m.MOST_EPOCHS} as c, r from per),
    left_ as (
      select *, sum(source_size) over ()::double - coalesce(sum(c) over (order by c / w, r rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(w) over () - coalesce(sum(w) over (order by c / w, r rows between unbounded preceding and 1 preceding), 0) as open from cap),
    capped as (select *, c * open < rest * w as full_ from left_),
    t as (select source, source_size, case when full_ then c else (select first(rest / open order by c / w, r) from capped where not full_) * w end as target from capped),
    p as (select doc_id, size, source_size, target, sum(size) over (partition by d.source order by k, doc_id) - size as before_ from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target,
           (size * (case when source_size > 0 then floor(target)::bigint // source_size else 0 end)
            + greatest(0, least(size, floor(target)::bigint - (case when source_size > 0 then floor(target)::bigint // source_size else 0 end) * source_size - before_)))::bigint as taken
    from p
    """


def _op1_sql() -> str:
    return f"""
    with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
          where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
                        where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >= {embedding_dedup.THRESHOLD}),
    r(vec_id, root) as (select distinct a, a from p union select p.b, r.root from r join p on p.a = r.vec_id),
    c as (select vec_id, min(root) as root from r group by vec_id),
    l as (select a, count(*) as n from p group by a)
    select e.vec_id, coalesce(n, 0) as n_links, coalesce(root, e.vec_id) as component_id, coalesce(root, e.vec_id) = e.vec_id as kept
    from embeddings e left join c on c.vec_id = e.vec_id left join l on l.a = e.vec_id
    """


def _op6_sql() -> str:
    return f"""
    with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as h from pages),
    f as (select *, case when n >= {warc.REVISIT_FROM} then min(page_id) over (partition by h) end as first_ from p)
    select page_id, n as payload_bytes, h as payload_digest, case when page_id <> first_ then 'revisit' else 'response' end as record_type,
           case when page_id <> first_ then first_ end as refers_to
    from f
    """


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_host_quality, op3_license_scan, op4_simhash_dedup, op5_best_fit_packing,
        op6_warc, op7_sharding, op8_suffix_dedup, op9_source_mixing, op10_secret_scan,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": _op1_sql(), "op2_host_quality": _op2_sql(), "op6_warc": _op6_sql(), "op9_source_mixing": _op9_sql()}
