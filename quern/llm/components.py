"""Connected components by alternating star contraction, one Spark job a round.

The centre of a star may have any share of all edges: its least neighbour is
found with map-side minima, and the join back to its edges splits hot keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, materialize


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges as hi > lo."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return join_totals(both.where("y > x"), least, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = join_totals(edges, least, "hi").where("lo > m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60, release: bool = False) -> DataFrame:
    """Rows (node, root) for the nodes of `edges` (columns a, b, comparable and not null); root is the least node reachable.

    Nodes without a link to another node are absent. Only two scalars a round
    reach the driver; each round's edges are a table in the shared folder.
    release: the shuffle files go with each round, and those of `edges` with the first.
    """
    now = materialize(_ordered(edges).distinct(), "edges", release)
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Repeated edges between the two steps do no harm.
        now = materialize(_ordered(_small_star(_ordered(_large_star(now)))).distinct(), "edges", release)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)


def hook(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components of the pairs (u, v) in `roots`, which maps each node to its root."""
    while True:
        a, b = roots[u], roots[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up
