"""A training corpus from `documents`: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages the documents are written as
Parquet and read again, so each stage reads a table that does not change.

Edge cases: a null or empty text and one of under 50 words go in the quality
stage; very long texts are judged, compared, scanned and cut whole; of
near-duplicates, repeated rows and equal ids one row stays, by least id, then
least text hash, then the row's place in the table; null ids come last; a null
source is a source of its own; an empty table runs through to an empty result;
other columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import best_fit_packing, host_quality, secret_scan, simhash_dedup, source_mixing
from quern.llm.common import among, free_name, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return host_quality.judge_documents(docs).where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word Jaccard 0.8 or more, that of least id.

    Rows are named by (id, text hash, number in the table), and only names are
    shuffled: the numbers of the rows that go are broadcast as bits.
    """
    number = free_name(docs, "_number")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col(number).alias("number"))
    groups = simhash_dedup.near_duplicates(numbered.select(name.alias("name"), "text"), id_col="name")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id.number").alias(number))
    return among(numbered, gone, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces and their places in the training sequences."""
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SimHash classes, secret automata and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
