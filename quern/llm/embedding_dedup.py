"""Embedding near-duplicates by an inverted multi-index.

Vectors are normalised and halved; each half has its own k-means codebook, and
a vector's cell is its pair of nearest centroids. For a query the cells are
visited in the order of a lower bound on the distance to the cell (distances to
the bisecting planes, squared and summed over the halves) by a multi-sequence
traversal, until the bound passes a radius. The radius is fitted so that the
cells visited hold a vector at exactly the threshold with probability RECALL,
in the worst of three ways that a vector may differ: in any direction, in the
directions that the vectors themselves span, and as the real pairs of the
sample do. Both vectors of a pair look for each other, and nearer pairs are
safer. Links are verified in double precision, so none below the threshold is
returned.

Codebooks and radius are fitted on at most SAMPLE vectors, those of least
hash; every vector is indexed. Each vector length has an index of its own: the
LENGTHS most common ones are fitted, any other has one cell, which is exact.
Rows of the grid (one first-half centroid) are the units of work; both their
members and their queries are cut into hash blocks, so a crowded cell or label
is many tasks. Equal vectors of a label are one class with a weight. A unit
returns counts and a spanning forest of its links, never its pairs.

Edge cases: vectors that are null, empty, zero, or have null or non-finite
components, and rows without a label are returned without links; vectors of
different length do not link; repeated rows, equal vectors and ties at the
threshold link; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, materialize
from .components import connected_components, hook

THRESHOLD = 0.93
#: Vectors that codebooks and radius are fitted on, at most.
SAMPLE = 20000
#: Vector lengths that codebooks are fitted for, the most common ones; and vectors of the sample that are compared with all of it.
LENGTHS, PAIRS = 4, 2000
#: Share of pairs at the threshold that one direction of the search has to find.
RECALL = 0.98
#: Members per grid cell that the codebook size aims at, and its limits.
PER_CELL, FEWEST, MOST = 64, 4, 1024
#: Rows of a block in a unit.
BLOCK = 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty centroid stays where it was."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(count) - count, len(x) - 1), axis=0)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def plane_bounds(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared lower bounds on the distance to each centroid's Voronoi cell) for each row.

    A row's figures do not depend on the rows beside it, as those of a matrix product may.
    """
    d = (centroids**2).sum(axis=1) - 2 * np.einsum("nd,kd->nk", x, centroids)
    home = d.argmin(axis=1)
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)
    beyond = np.maximum(d - d[np.arange(len(x)), home][:, None], 0)
    gap = apart[home]
    return home, np.where(gap > 0, beyond / (2 * np.where(gap > 0, gap, 1)), 0) ** 2


def pairs_above(x: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the first `most` unit rows with other rows, by brute force."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for at in range(0, min(most, len(x)), 256):
        i, j = np.nonzero(x[at : min(at + 256, most)] @ x.T >= threshold)
        found.append(((i + at)[i + at != j], j[i + at != j]))
    return tuple(np.concatenate(f) for f in zip(*found))


class MultiIndex:
    """Codebooks of both halves, and the radius of the traversal (squared)."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float) -> None:
        x = unit_rows(sample)
        self.half = x.shape[1] // 2 or 1
        k = min(k, len(x))
        self.books = [kmeans(np.ascontiguousarray(x[:, : self.half]), k), kmeans(np.ascontiguousarray(x[:, self.half :]), k)]
        self.radius = float("inf")
        if recall >= 1:
            return
        _, _, a, b = self.places(x)
        rng = np.random.default_rng(7)
        rows = np.arange(len(x))
        ways = []
        for noise in (rng.standard_normal(x.shape), x[rng.permutation(len(x))] - x[rng.permutation(len(x))]):
            noise = noise - (noise * x).sum(axis=1, keepdims=True) * x
            norm = np.linalg.norm(noise, axis=1, keepdims=True)
            some = norm[:, 0] > 1e-9
            if some.any():
                y = threshold * x[some] + np.sqrt(1 - threshold**2) * noise[some] / norm[some]
                i, j, _, _ = self.places(y)
                ways.append(a[rows[some], i] + b[rows[some], j])
        at, to = pairs_above(x, threshold, PAIRS)
        if len(at):
            i, j, _, _ = self.places(x[to])
            ways.append(a[at, i] + b[at, j])
        self.radius = max((float(np.quantile(w, recall)) for w in ways), default=0.0) + 1e-12

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Home cell (i, j) of each unit row, and its bounds for both halves."""
        i, a = plane_bounds(x[:, : self.half], self.books[0])
        j, b = plane_bounds(x[:, self.half :], self.books[1]) if x.shape[1] > self.half else (np.zeros(len(x), int), np.zeros((len(x), 1)))
        return i, j, a, b

    def traverse(self, a: np.ndarray, b: np.ndarray):
        """Grid cells (i, j) in ascending a[i] + b[j], until the sum passes the radius."""
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[ia].tolist(), b[ib].tolist()
        heap = [(sa[0] + sb[0], 0, 0)]
        while heap:
            bound, p, q = heapq.heappop(heap)
            if bound > self.radius:
                return
            yield int(ia[p]), int(ib[q])
            if q + 1 < len(sb):
                heapq.heappush(heap, (sa[p] + sb[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(sa):
                heapq.heappush(heap, (sa[p + 1] + sb[0], p + 1, 0))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 2))


def _index_of(indexes: dict, dim: int) -> MultiIndex:
    """The fitted index of a vector length, or one of a single cell."""
    if dim not in indexes:
        indexes[dim] = MultiIndex(np.eye(1, dim), 1, 1.0, 1.0)
    return indexes[dim]


def _visits(frames, indexes: dict):
    """For each vector: its home cell, and per grid row that it visits the columns there."""
    for f in frames:
        out: list = [None] * len(f)
        i, j = np.zeros(len(f), int), np.zeros(len(f), int)
        for dim, at in f.groupby("dim").indices.items():
            index = _index_of(indexes, int(dim))
            i[at], j[at], a, b = index.places(unit_rows(_stack(f["vector"].iloc[at])))
            for n, r in enumerate(at.tolist()):
                rows: dict[int, list[int]] = {int(i[r]): []}
                for p, q in index.traverse(a[n], b[n]):
                    rows.setdefault(p, []).append(q)
                out[r] = [{"row": p, "home": p == i[r], "columns": qs} for p, qs in rows.items()]
        yield pd.DataFrame({"node": f["node"], "w": f["w"], "label": f["label"], "dim": f["dim"], "vector": f["vector"], "hi": i, "hj": j, "visits": out})


def _unit(members: pd.DataFrame, queries: pd.DataFrame, indexes: dict, threshold: float) -> pd.DataFrame:
    """Per vector of the unit: the links that this unit is the one to count; and forest edges, as rows (node, n, other)."""
    if not len(members) or not len(queries):
        return pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
    m, q = unit_rows(_stack(members["vector"])), unit_rows(_stack(queries["vector"]))
    index = _index_of(indexes, m.shape[1])
    mj, qi, qj = members["hj"].to_numpy(), queries["hi"].to_numpy(), queries["hj"].to_numpy()
    visited = np.zeros((len(q), max(1, len(index.books[1]))), bool)
    for r, columns in enumerate(queries["columns"]):
        visited[r, np.asarray(columns, dtype=int)] = True
    at, to = np.nonzero((q @ m.T >= threshold - 1e-9) & visited[:, mj])
    q_node, m_node = queries["node"].to_numpy(), members["node"].to_numpy()
    # The last digits of a matrix product depend on its shape; these do not, and not on the side.
    real = (q_node[at] != m_node[to]) & (np.einsum("nd,nd->n", q[at], m[to]) >= threshold)
    at, to = at[real], to[real]
    # A pair that both sides find is counted by each for itself; else the finder's unit counts for both.
    _, _, a, b = index.places(m)
    mutual = a[to, qi[at]] + b[to, qj[at]] <= index.radius
    found = np.bincount(at, weights=members["w"].to_numpy()[to], minlength=len(q)).astype(np.int64)
    given = np.bincount(to[~mutual], weights=queries["w"].to_numpy()[at[~mutual]], minlength=len(m)).astype(np.int64)
    nodes, where = np.unique(np.concatenate([q_node, m_node]), return_inverse=True)
    roots = np.arange(len(nodes))
    hook(roots, where[at], where[len(q) + to])
    joined = np.nonzero(roots != np.arange(len(nodes)))[0]
    return pd.DataFrame({
        "node": np.concatenate([q_node[found > 0], m_node[given > 0], nodes[joined]]),
        "n": np.concatenate([found[found > 0], given[given > 0], np.zeros(len(joined), int)]),
        "other": np.concatenate([q_node[found > 0], m_node[given > 0], nodes[roots[joined]]]),
    })


def fit(good: DataFrame, threshold: float, sample: int, recall: float) -> dict[int, MultiIndex]:
    """An index for each of the most common vector lengths, from at most `sample` vectors in all."""
    common = good.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    indexes = {}
    for r in common:
        drawn = good.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vector"), "node").limit(sample // len(common)).select("vector").toPandas()
        k = int(min(MOST, max(FEWEST, round((r["most"] / PER_CELL) ** 0.5))))
        indexes[r["dim"]] = MultiIndex(_stack(drawn["vector"]), k, threshold, recall)
    return indexes


def near_duplicates(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of the input."""
    dtype = dict(df.dtypes)[label_col]
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    # A node per row: repeated rows, and rows without an id, are vectors of their own. Equal vectors are told by 128 bits.
    rows = rows.select("*", F.coalesce(usable, F.lit(False)).alias("usable"), F.monotonically_increasing_id().alias("node"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    rows = materialize(rows, "vectors")
    same = ["label", "h1", "h2"]
    good = rows.where("usable").groupBy(*same).agg(F.min(F.struct("node", "vector")).alias("first"), F.count("*").alias("w"))
    good = materialize(good.select(*same, "first.node", "first.vector", F.size("first.vector").alias("dim"), "w"), "classes")
    indexes = fit(good, threshold, sample, recall)
    visits = good.select("node", "w", "label", "dim", "vector").mapInPandas(
        lambda fs: _visits(fs, indexes), f"node long, w long, label {dtype}, dim int, vector array<double>, hi int, hj int, visits array<struct<row int, home boolean, columns array<int>>>"
    )
    own = ["node", "w", "label", "dim", "vector", "hi", "hj"]
    visits = materialize(visits.select(*own, F.explode("visits").alias("v")).select(*own, "v.*"), "visits")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    cell = ["label", "dim", "row"]
    crowd = materialize(
        visits.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("m"), F.count("*").alias("q")).where("m > 0").select(*cell, blocks("m").alias("mb"), blocks("q").alias("qb")), "crowd"
    )
    dealt = join_totals(visits, crowd, cell)
    member = dealt.where("home").select(*cell, F.pmod(F.xxhash64("node"), F.col("mb")).cast("int").alias("mp"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qp"), "node", "w", "hj", "vector")
    query = dealt.where(F.size("columns") > 0).select(*cell, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mp"), F.pmod(F.xxhash64("node"), F.col("qb")).cast("int").alias("qp"), "node", "w", "hi", "hj", "vector", "columns")
    key = [*cell, "mp", "qp"]
    units = member.groupBy(*key).cogroup(query.toDF(*query.columns).groupBy(*key))
    found = materialize(units.applyInPandas(lambda m, q: _unit(m, q, indexes, threshold), "node long, n long, other long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = good.select(*same, "node", "w").join(counts, "node", "left").join(roots, "node", "left")
    classes = classes.select(*same, F.coalesce("root", "node").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    # Rows that are not usable have no class: their label or their vector does not occur in one.
    named = join_totals(rows.select("vec_id", "node", *same), classes, same, "left").select("vec_id", F.coalesce("root", "node").alias("root"), "n_links")
    named = materialize(named, "named")
    out = join_totals(named, named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
