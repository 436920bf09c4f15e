"""Jaccard similarity of word shingles for SimHash near-dedup: the pairs beyond the reach of its anchors, and the exact check of all.

Two texts are linked where |A & B| / |A | B| of their shingle sets is at least
the similarity. In one common order of all shingles, two sets of similarity t
share one of the first n - ceil(t n) + 1 of each, so the pairs that share one
there hold every link. The order puts shingles that are frequent in a bounded
sample last; any order is right, this one keeps the groups of a shingle small.

A pair that shares a rare shingle is a candidate if its sizes allow the
similarity, and if its fingerprints differ in at most FAR bits: at similarity
0.8 a bit differs with probability 0.15, so more than 22 of 64 have one of about
1e-5. Sets of fewer than FEW shingles, whose fingerprints are coarser, pass
without that test.

No pair is written. A shingle yields a spanning forest of its candidates, or,
from GROUP texts on, a star of all its texts; so both ends of a candidate lie in
one component of these edges. The texts of a component then meet in one task,
which compares their whole sets and yields a spanning forest of the links. A
component of more than UNIT texts or SHINGLES shingles is dealt out as pairs of
hash blocks, each pair of texts in one of them; nothing is capped or sampled.

Disk: each step is written and its shuffle files go before the next begins. The
prefixes are shuffled in ROUNDS parts of the shingles, one after the other. Of
the texts, only those in a component of candidates are shuffled.

Edge cases: texts without words (null, empty, blank) are one class with each
other; a text with fewer words than a shingle is one shingle; texts of equal
64-bit hash are one class; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, join_totals, materialize, spread
from .components import connected_components, hook
from .shingles import shingle_hashes, simhash

#: Texts that the order of shingles is estimated on, about: so many, and one of so many of a larger table, or else
#: shingles of ever larger groups would count as rare. Frequent shingles that are kept of them at most.
SAMPLE, ONE_OF, FREQUENT = 4000, 50, 500_000
#: Texts of a shingle up to which they are compared within one group.
GROUP = 1024
#: Fingerprint bits in which a candidate differs at most, and the size from which sets are tested so.
FAR, FEW = 22, 32
#: Texts and shingles of one block, about; a task compares two blocks at most.
UNIT, SHINGLES = 4096, 1_000_000
#: Parts of the shingles that are shuffled one after the other, and texts up to which there is one part.
ROUNDS, ROUND_TEXTS = 4, 20_000
#: Bits a text in the set that picks the texts to shuffle: one of 16 others is picked in vain.
BITS = 16


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def prefix_length(n: int, share: Fraction) -> int:
    """Shingles of a set of n of which any set of similarity `share` or more holds one, if they come first in both."""
    return n - -(-n * share.numerator // share.denominator) + 1


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample hold, ascending, and in how many."""

    def tokens(batches):
        for b in batches:
            found = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["token"])

    step = max(1, min(rows.count() // SAMPLE, ONE_OF))
    drawn = rows.where(F.pmod("node", F.lit(step)) == 0).select("text").mapInArrow(tokens, "token long")
    most = drawn.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(FREQUENT)
    most = materialize(most, "frequent", release=True).toPandas().sort_values("token")
    return most["token"].to_numpy(np.int64), most["n"].to_numpy(np.int64)


def _prints(batches, shingle: int, share: Fraction, frequent: tuple[np.ndarray, np.ndarray]):
    known, often = frequent
    for b in batches:
        sizes, prefixes, prints = [], [], []
        for text in b.column(1).to_pylist():
            hashes = shingle_hashes(text, shingle)
            prints.append(simhash(hashes))
            s = np.unique(hashes).view(np.int64)
            sizes.append(len(s))
            n = np.zeros(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                n = np.where(known[at] == s, often[at], 0)
            prefixes.append(s[np.lexsort((s, n))[: prefix_length(len(s), share)]] if len(s) else s)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
            names=["node", "fp", "n", "prefix"],
        )


def _fits(n, m, bits, share: Fraction):
    """Which pairs of set sizes and differing bits may reach the similarity."""
    small, big = np.minimum(n, m), np.maximum(n, m)
    return (small * share.denominator >= big * share.numerator) & ((small < FEW) | (bits <= FAR))


def _by_token(batches, close):
    """Hand on whole groups of rows that come sorted by their first column, many groups at a time, as arrays."""
    held, rest = [], 0
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(b.num_columns)]
        if not len(now[0]):
            continue
        held.append(now)
        rest += len(now[0])
        if rest < 200_000 or held[0][0][0] == now[0][-1]:
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        yield from close(*(x[:cut] for x in rows))
        held, rest = [[x[cut:] for x in rows]], len(rows[0]) - cut
    if held:
        yield from close(*(np.concatenate(x) for x in zip(*held)))


def _forest(batches, share: Fraction, group: int):
    """Rows (token, node, n, fp) come sorted by token: edges (a, b) that span the candidates of each token."""

    def close(token, node, n, fp):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(starts, len(token)))
        several = np.repeat(size > 1, size)
        node, n, fp, size = node[several], n[several], fp[several], size[size > 1]
        starts = np.cumsum(size) - size
        ends, large = np.repeat(starts + size, size), np.repeat(size > group, size)
        us, vs, roots = [np.flatnonzero(large)], [np.repeat(starts, size)[large]], np.arange(len(node))
        at = np.flatnonzero(~large)
        for d in range(1, group):
            at = at[at + d < ends[at]]
            if not len(at):
                break
            hit = at[_fits(n[at], n[at + d], np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)), share)]
            hit = hit[roots[hit] != roots[hit + d]]
            if len(hit):
                us.append(hit)
                vs.append(hit + d)
                hook(roots, hit, hit + d)
        pairs = np.stack([node[np.concatenate(us)], node[np.concatenate(vs)]], 1)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    yield from _by_token(batches, close)


def linked(sets: list[np.ndarray], fp: np.ndarray, part: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the links among the sets; of two parts, the links between them only."""
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(n) - n
    known, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    order = np.argsort(n, kind="stable")
    n, starts, fp, part = n[order], starts[order], fp[order], part[order]
    between = len(sets) > 0 and part.min() != part.max()
    roots, held, us, vs = np.arange(len(n)), np.zeros(len(known), bool), [], []
    for i in range(len(n)):
        last = np.searchsorted(n, n[i] * share.denominator // share.numerator, side="right")
        to = np.arange(i + 1, last)
        apart = roots[to] != roots[i]
        if between:
            apart &= part[to] != part[i]
        to = to[apart]
        to = to[_fits(n[i], n[to], np.bitwise_count((fp[i] ^ fp[to]).view(np.uint64)), share)]
        if not len(to):
            continue
        own = ids[starts[i] : starts[i] + n[i]]
        held[own] = True
        ends = np.cumsum(n[to])
        items = np.arange(ends[-1]) + np.repeat(starts[to] - ends + n[to], n[to])
        found = np.concatenate([[0], np.cumsum(held[ids[items]])])
        held[own] = False
        common = found[ends] - found[ends - n[to]]
        to = to[common * share.denominator >= share.numerator * (n[i] + n[to] - common)]
        to = to[np.unique(roots[to], return_index=True)[1]]
        if len(to):
            us.append(np.full(len(to), i))
            vs.append(to)
            merged = np.append(roots[to], roots[i])
            roots[np.isin(roots, merged)] = merged.min()
    none = np.zeros(0, np.int64)
    return (order[np.concatenate(us)], order[np.concatenate(vs)]) if us else (none, none)


class Overlap:
    """Distinct texts of a table with their shingle statistics; `node` is a text's hash."""

    def __init__(self, docs: DataFrame, text_col: str, id_col: str, shingle: int, similarity: float, group: int = GROUP, unit: int = UNIT) -> None:
        self.shingle, self.share, self.group, self.unit = shingle, Fraction(str(similarity)), group, unit
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node")))
        share, frequent = self.share, _frequent(self.rows, shingle)
        every = self.rows.select("node", "text").mapInArrow(lambda bs: _prints(bs, shingle, share, frequent), "node long, fp long, n int, prefix array<long>")
        self.prints = materialize(every.dropDuplicates(["node"]), "prints", release=True)

    def _candidates(self) -> DataFrame:
        """Edges (a, b) whose components hold both ends of each candidate."""
        share, group = self.share, self.group
        tokens = self.prints.select(F.explode("prefix").alias("token"), "node", "n", "fp")
        rounds = ROUNDS if self.prints.count() > ROUND_TEXTS else 1
        forests = []
        for k in range(rounds):
            part = tokens.where(F.pmod("token", F.lit(rounds)) == k).repartition("token").sortWithinPartitions("token", "node")
            forests.append(materialize(part.mapInArrow(lambda bs: _forest(bs, share, group), "a long, b long").distinct(), "forest", release=True))
        return reduce(DataFrame.unionAll, forests)

    def _linked(self, met: DataFrame) -> DataFrame:
        """Edges (a, b) that span the links inside the components `met` (node, root)."""
        shingle, share = self.shingle, self.share
        members = materialize(met.join(self.prints.select("node", "fp", "n"), "node"), "members", release=True)
        parts = F.ceil(F.greatest(F.count("*") / self.unit, F.sum("n") / SHINGLES)).cast("int")
        dealt = join_totals(members, members.groupBy("root").agg(parts.alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("node", "fp", "root", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        size = F.lit(64 + BITS * members.count())
        picked = among(self.rows.select("node", "text"), members.select(F.pmod("node", size).alias("place")), "left_semi", F.pmod("node", size))
        texts = picked.groupBy("node").agg(F.first("text").alias("text"))

        def compare(unit: pa.Table) -> pa.Table:
            node, fp, part = (unit.column(c).to_numpy() for c in ("node", "fp", "part"))
            sets = [shingle_set(t.as_py(), shingle) for t in unit.column("text")]
            a, b = linked(sets, fp, part, share) if len(set(part)) == len({unit["p"][0].as_py(), unit["q"][0].as_py()}) else ((), ())
            return pa.table({"a": pa.array(node[list(a)], pa.int64()), "b": pa.array(node[list(b)], pa.int64())})

        return dealt.join(texts, "node").groupBy("root", "p", "q").applyInArrow(compare, "a long, b long")

    def components(self, pairs: DataFrame) -> DataFrame:
        """Rows (doc_id, component_id), one per row of the table, by all links; `pairs` (a, b) are further candidates."""
        met = connected_components(pairs.unionAll(self._candidates()), release=True)
        roots = connected_components(self._linked(met), release=True)
        out = self.rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
        out = materialize(out, "roots", release=True)
        return join_totals(out, out.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")
