"""Quality rules with host verdicts, in DataFrame expressions only.

Document rules give levels: 0 passes, 1 fails, 2 fails by far. Failures are
summed by host (the document's source); each host's failure rate is shrunk
towards the corpus rate by a beta prior whose strength is fitted to the spread
between hosts (method of moments). The host's verdict on a rule is the least
level that rejects there: 1 at a host that fails it often, 3 (none) at a host
that hardly ever fails it, where the rule tells nothing, and else 2. A document
is rejected where it fails the base rule, or where its level reaches its host's
verdict. A document that passes the rules is never rejected for its neighbours.

Edge cases: a null text has no words and fails the base rule; a null source is
a host of its own; repeated rows are judged alike and each counts; very long
texts are counted whole; an empty table gives an empty result; other columns,
whatever their names, stay in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, join_totals, materialize, spread, words_of

SYMBOLS = "#*$%&|<>"
#: Shrunk share of failing documents from which a host fails a rule, and below which the rule tells nothing at it.
HOST_BAD, HOST_SPOTLESS = 0.2, 0.001
#: Limits of the levels 1 and 2 for each of RULES.
LIMITS = {
    "symbols": ("10 * n_symbols > n_words", "10 * n_symbols > 3 * n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines > 9 * n_lines"),
    "word_length": ("(word_chars < 3 * n_words OR word_chars > 12 * n_words)", "(word_chars < 2 * n_words OR word_chars > 24 * n_words)"),
}
RULES = tuple(LIMITS)
#: Limits for the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 10000.0


def _repeat_positions(grams: Column) -> Column:
    """Sorted window starts whose hash another window of the text shares."""
    return F.sort_array(F.transform(F.filter(grams, lambda x, k: (x["h"] == F.get(grams, k - 1)["h"]) | (x["h"] == F.get(grams, k + 1)["h"])), lambda x: x["i"]))


def text_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Three-word windows are compared by a chained 64-bit hash within one text.
    The steps are separate projections so that no array is computed twice.
    """
    taken = [c for c in df.columns if c.lower() not in {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}]
    w, ln, g, t = (free_name(df, x) for x in ("_words", "_lines", "_grams", "_text"))
    keep = [F.col(f"`{c}`") for c in taken]
    one = df.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    two = one.select(
        *keep,
        words_of(F.col(t)).alias(w),
        F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(ln),
        F.length(F.translate(F.col(t), SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    three = two.select(
        *keep, "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 4, hashes).alias(g),
    )
    pairs = F.sort_array(F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.select(*keep, *counts, F.when(F.size(F.array_distinct(g)) < F.size(g), pairs).alias(g))
    five = four.select(*keep, *counts, F.when(F.col(g).isNotNull(), _repeat_positions(F.col(g))).alias(g))
    gaps = F.transform(F.col(g), lambda s, k: F.coalesce(F.least(F.lit(3), F.get(F.col(g), k + 1) - s), F.lit(3)).cast("long"))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return five.select(*keep, *counts, F.coalesce(F.when(F.col(g).isNotNull(), covered), F.lit(0).cast("long")).alias("n_repeat_words"))


def document_levels(stats: DataFrame) -> DataFrame:
    """Adds base_failed and level_<rule> for each of RULES."""
    levels = {f"level_{r}": F.expr(f"CASE WHEN {far} THEN 2 WHEN {near} THEN 1 ELSE 0 END") for r, (near, far) in LIMITS.items()}
    return stats.withColumns({"base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"), **levels})


def host_verdicts(levels: DataFrame, host_col: str) -> DataFrame:
    """One row per host: its key, n_docs, and rejects_<rule>, the least level that is rejected, for each rule."""
    hosts = materialize(
        levels.groupBy(host_col).agg(F.count("*").alias("n_docs"), *(F.sum((F.col(f"level_{r}") > 0).cast("long")).alias(f"f_{r}") for r in RULES)), "hosts"
    )
    total = hosts.agg(F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), *(F.sum(f"f_{r}").alias(r) for r in RULES)).first()
    n = float(total["n"] or 0)
    if not n:
        return hosts.select(host_col, "n_docs", *(F.lit(3).alias(f"rejects_{r}") for r in RULES))
    mean = {r: total[r] / n for r in RULES}
    spread = hosts.agg(*(F.sum(F.col("n_docs") * F.pow(F.col(f"f_{r}") / F.col("n_docs") - F.lit(mean[r]), 2)).alias(r) for r in RULES)).first()
    verdicts = []
    for r in RULES:
        mu = mean[r]
        between = spread[r] / n - mu * (1 - mu) * total["hosts"] / n
        strength = mu * (1 - mu) / between - 1 if between > 0 else PRIOR_MAX
        strength = min(max(strength, PRIOR_MIN), PRIOR_MAX)
        rate = (F.col(f"f_{r}") + F.lit(mu * strength)) / (F.col("n_docs") + F.lit(strength))
        verdicts.append(F.when(rate >= HOST_BAD, 1).when(rate >= HOST_SPOTLESS, 2).otherwise(3).alias(f"rejects_{r}"))
    return hosts.select(host_col, "n_docs", *verdicts)


STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *(f"level_{r}" for r in RULES))


def judge_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", row_col: str = "document") -> DataFrame:
    """Adds to each row, kept whole in the struct `row_col`: the statistics, base_failed, level_<rule>, host_failed and kept.

    Rows and statistics are written once, so texts are read once and shuffled
    only if the table of hosts is too large to be broadcast by its size.
    """
    host = F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit("-"))
    carried = spread(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_body"), host.alias("_host"))
    levels = materialize(document_levels(text_stats(carried, "_body")).drop("_body"), "levels")
    hosts = host_verdicts(levels, "_host").drop("n_docs")
    failed = F.lit(False)
    for r in RULES:
        failed = failed | (F.col(f"level_{r}") >= F.col(f"rejects_{r}"))
    judged = join_totals(levels, hosts, "_host").withColumn("host_failed", failed)
    return judged.select(F.col("_row").alias(row_col), *STATS, "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
