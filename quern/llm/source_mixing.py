"""Mixing sources to target weights, in DataFrame expressions only.

Documents get hash-random keys from their id and text, so that many rows of one
id, or of none, lie in many ranges; within a source they are ordered by the key;
word counts are summed along that order in two steps (per key range, then
within the range, so that no source is one task); the order is repeated for as
many whole epochs as the target asks and then cut at the exact budget.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; rows that repeat a doc_id have keys of their own by their texts;
identical rows are counted each on its own; equal keys go by id, then by the
text's hash; very long texts are counted whole; with no words at all every
target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialize, parts_for, spread, words_of

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Key ranges of a source, at least; their number is the next power of 16.
KEY_RANGES = 256


def source_targets(sizes: DataFrame, source: str) -> DataFrame:
    """One row per source: key, source_size, target. One task sees one row per source, never documents.

    Targets are proportional to the weights, except where a cap stops them:
    sources are ordered by cap over weight, and the ones whose cap lies below
    their share of what the earlier ones left are capped.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(source)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MOST_EPOCHS)
    whole = W.partitionBy()
    order = whole.orderBy(F.col("cap") / F.col("weight"), source)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = per.withColumns({
        "rest": F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    capped = left.withColumn("capped", F.col("cap") * F.col("open") < F.col("rest") * F.col("weight"))
    level = F.first(F.when(~F.col("capped"), F.col("rest") / F.col("open")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return capped.select(source, "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _taken(size: Column, before: Column, source_size: Column, target: Column) -> Column:
    """Words taken of a document that starts `before` words into its source's order."""
    budget = F.floor(target).cast("long")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("long")
    rest = budget - epochs * source_size
    return (size * epochs + F.greatest(F.lit(0).cast("long"), F.least(size, rest - before))).cast("long")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 42) -> DataFrame:
    """Rows (id, size, source_size, target, taken), one per row of the input, plus its row hash `_row`."""
    sizes = spread(docs.select(*(F.col(f"`{c}`") for c in (id_col, text_col, source_col)))).select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("~")).alias("_source"),
        F.size(words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_row"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))).alias("_key"),
    )
    sizes = materialize(sizes, "sizes")
    # Keys are hex digits, so a prefix of them is a range; the result does not depend on its length.
    digits = len(f"{parts_for(sizes, KEY_RANGES) - 1:x}")
    sizes = sizes.withColumn("_range", F.substring("_key", 1, digits))
    targets = source_targets(sizes, "_source")
    ranges = sizes.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    starts = ranges.select("_source", "_range", (F.sum("_sum").over(W.partitionBy("_source").orderBy("_range")) - F.col("_sum")).alias("_start"))
    starts = starts.join(targets, "_source")
    inner = W.partitionBy("_source", "_range").orderBy("_key", "doc_id", "_row", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sizes.withColumn("_upto", F.sum("size").over(inner)).join(starts, ["_source", "_range"])
    before = F.col("_start") + F.col("_upto") - F.col("size")
    return placed.select("doc_id", "size", "source_size", "target", _taken(F.col("size"), before, F.col("source_size"), F.col("target")).alias("taken"), "_row")


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix as documents: each row of the input, whole, as often as its budget comes nearest to; same columns.

    Identical rows share their copies evenly, rounded. Documents without words are never taken.
    """
    doc, row, n = (free_name(docs, x) for x in ("_doc", "_rowhash", "_copies"))
    copies = (
        mix(docs, text_col, id_col, source_col, seed).where("size > 0")
        .groupBy(F.col("doc_id").alias(doc), F.col("_row").alias(row))
        .agg(F.round(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)) / F.count("*")).cast("int").alias(n))
        .where(F.col(n) > 0)
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(row))
    joined = docs.join(copies, same)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)
