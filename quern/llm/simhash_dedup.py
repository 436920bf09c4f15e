"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code of 64 bits: four copies of the
first-order Reed-Muller code of length 16 (covering radius 6 each, 2**20
anchors). A fingerprint goes to every anchor whose cell (the points that the
block-wise decoder maps to it) lies within half the threshold, rounded up: all
of these anchors are within covering radius plus threshold. Two fingerprints
within the threshold have a midpoint within that half of both, and the
midpoint's own anchor receives both, so no link is lost. Fingerprints are
compared per anchor; each anchor yields a spanning forest of its links, never
all pairs. Equal fingerprints are one class from the start.

Anchors with more than BLOCK fingerprints are dealt out as pairs of hash
blocks, so no task gets an unbounded group.

`near_duplicates` links by similarity instead of bits: texts whose five-word
shingle sets have a Jaccard similarity of 0.8 or more. Pairs that the anchors
find, and pairs beyond their reach (0.8 is some 10 bits) that share a rare
shingle, are candidates; `shingle_overlap` brings the texts of each component of
candidates together and checks them exactly.

`reach=threshold` gives the plain covering, which needs no midpoint: one text's
own anchor is among all anchors of the other. Both give the same links (tested).

Edge cases: texts without words (null, empty, blank) have fingerprint zero and
link like any other; a text with fewer words than a shingle is one shingle; a
null doc_id is kept, and a component of null ids only has a null component_id;
repeated rows are all returned; very long texts are one fingerprint each; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_overlap
from .common import join_totals, kept, materialize, spread
from .components import connected_components, hook
from .shingles import shingle_hashes, simhash

SHINGLE = 4
THRESHOLD = 4
#: Shingle length and similarity of `near_duplicates`.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints of one anchor that are compared in one group at most (two blocks of them).
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    return simhash(shingle_hashes(text, shingle))


def _fingerprints(batches, shingle: int):
    for b in batches:
        fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def code_words() -> np.ndarray:
    """The first-order Reed-Muller code of length 16."""
    rows = [0xFFFF] + [sum(1 << j for j in range(BLOCK_BITS) if j >> i & 1) for i in range(4)]
    code = [0]
    for r in rows:
        code += [c ^ r for c in code]
    return np.array(code, dtype=np.uint16)


def reach_table(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit value the code words whose cell is within radius, as (starts, word numbers, distances)."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    away = np.bitwise_count(values[:, None] ^ code_words()[None, :])
    cost = np.full(away.shape, radius + 1, dtype=np.uint8)
    cost[values, away.argmin(axis=1)] = 0
    for _ in range(radius):
        near = cost
        for bit in range(BLOCK_BITS):
            near = np.minimum(near, cost[values ^ np.uint16(1 << bit)] + 1)
        cost = near
    at, word = np.nonzero(cost <= radius)
    starts = np.searchsorted(at, np.arange((1 << BLOCK_BITS) + 1))
    return starts.astype(np.int64), word.astype(np.int64), cost[at, word].astype(np.int64)


def anchors_of(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for every anchor whose cell is within radius of the fingerprint."""
    starts, words, costs = kept(("reach", radius), lambda: reach_table(radius))
    row, anchor, spent = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for k in range(BLOCKS):
        value = (fp.view(np.uint64) >> np.uint64(BLOCK_BITS * k) & np.uint64(0xFFFF)).astype(np.int64)[row]
        n = starts[value + 1] - starts[value]
        of = np.repeat(np.arange(len(row)), n)
        item = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[value[of]]
        total = spent[of] + costs[item]
        fits = total <= radius
        of, item = of[fits], item[fits]
        row, anchor, spent = row[of], anchor[of] * 32 + words[item], total[fits]
    return row, anchor


def _replicas(batches, radius: int):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 2000):
            row, anchor = anchors_of(fp[i : i + 2000], radius)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[i : i + 2000][row])], names=["anchor", "fp"])


def links_within(group: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the links inside each run of equal `group`."""
    n = len(fp)
    ends = np.searchsorted(group, group, side="right")
    roots, us, vs = np.arange(n), [], []
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < ends[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= threshold]
        hit = hit[roots[hit] != roots[hit + d]]
        if len(hit):
            us.append(hit)
            vs.append(hit + d)
            hook(roots, hit, hit + d)
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _compare(batches, threshold: int):
    """Links inside each unit; rows come sorted by unit, and an unfinished unit waits for the next batch."""

    def edges(unit, fp):
        order = np.argsort(unit, kind="stable")
        unit, fp = unit[order], fp[order]
        u, v = links_within(unit, fp.view(np.uint64), threshold)
        pairs = np.unique(np.stack([fp[u], fp[v]], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held_u, held_f, rest = [], [], 0
    for b in batches:
        # Units are numbered by change of key within the sorted stream.
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        fp = b.column(3).to_numpy(zero_copy_only=False)
        if not len(fp):
            continue
        held_u.append(keys)
        held_f.append(fp)
        rest += len(fp)
        if rest < 50_000 or (held_u[0][0] == keys[-1]).all():
            continue
        keys, fp = np.concatenate(held_u), np.concatenate(held_f)
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))
        yield edges(_numbered(keys[:last]), fp[:last])
        held_u, held_f, rest = [keys[last:]], [fp[last:]], len(fp) - last
    if held_u:
        yield edges(_numbered(np.concatenate(held_u)), np.concatenate(held_f))


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, np.int64)


def links(classes: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, reach: int | None = None) -> DataFrame:
    """Edges (a, b) that span the links among distinct fingerprints (column fp).

    reach: distance to a cell up to which a fingerprint goes to its anchor; by default half the threshold.
    """
    radius = (threshold + 1) // 2 if reach is None else reach
    replicas = materialize(classes.select("fp").mapInArrow(lambda bs: _replicas(bs, radius), "anchor int, fp long"), "replicas")
    crowded = replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block).select("anchor", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = replicas.join(crowded, "anchor", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("parts"))).otherwise(0).cast("int"))
    other = F.explode(F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    units = dealt.withColumn("other", other).select("anchor", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")
    units = units.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
    return units.mapInArrow(lambda bs: _compare(bs, threshold), "a long, b long")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, block: int = BLOCK, shingle: int = SHINGLE, reach: int | None = None) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of the input; fp is the fingerprint as a signed long."""
    dtype = dict(docs.dtypes)[id_col]
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`")))
    prints = materialize(rows.mapInArrow(lambda bs: _fingerprints(bs, shingle), f"doc_id {dtype}, fp long"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(classes, threshold, block, reach))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = materialize(named, "named")
    ids = join_totals(named, named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return join_totals(prints, ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY,
    threshold: int = THRESHOLD, block: int = BLOCK, group: int = shingle_overlap.GROUP, unit: int = shingle_overlap.UNIT,
) -> DataFrame:
    """Rows (doc_id, component_id), one per row of the input; component_id is the least id that links of the similarity reach.

    doc_id may be any orderable value, also a struct that names a row exactly.
    """
    overlap = shingle_overlap.Overlap(docs, text_col, id_col, shingle, similarity, group, unit)
    classes = overlap.prints.groupBy("fp").agg(F.min("node").alias("first"))
    met = materialize(links(classes, threshold, block), "met", release=True)
    side = lambda x: classes.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node"))
    between = met.join(side("a"), "a").join(side("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    within = join_totals(overlap.prints.select("fp", "node"), classes, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return overlap.components(between.unionAll(within))
