"""Sharding: best-fit-decreasing packing of indivisible groups (equal texts).

Groups are found by digest with map-side sums. Groups of one size are alike to
the packing, so the driver gets the histogram of group sizes: n different sizes
need a table of n * n / 2 bytes at least, so 10**5 of them 5 GB, and 10**7 of
them 50 TB. Every group is packed by its own size, largest first, into the bin
with the tightest remaining capacity, found in a balanced tree; a run of equal
sizes enters a bin at once. The least capacity that needs no more than the
wished number of bins is found by bisection. As the last bin filled is short,
moves and exchanges of groups between the fullest bin and others then even the
bins out. Tasks look the shard of a group up by (size, rank among that size).

Edge cases: a null text counts as empty; repeated rows are members of one
group and each gets its own slot; a group larger than a shard is never split
and then sets the capacity; equal sizes are ranked by digest; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_totals, materialize, parts_for

#: Parts in which the slots of a shard, and the groups of a size, are numbered, at least.
SLOT_PARTS = 64
#: The capacity is found to this share of it.
PRECISION = 1 / 100_000


class CapacityTree:
    """Multiset of (remaining capacity, bin), a treap: add, and take the least entry with room for a size."""

    def __init__(self) -> None:
        self._root = None
        self._seed = 1

    def _rank(self) -> int:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        return self._seed >> 33

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._merge(a[3], b))
        return (b[0], b[1], self._merge(a, b[2]), b[3])

    def add(self, room: int, bin_id: int) -> None:
        low, high = self._split(self._root, (room, bin_id))
        self._root = self._merge(self._merge(low, ((room, bin_id), self._rank(), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with room >= size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(high, (least[0][0], least[0][1] + 1))
        self._root = self._merge(low, rest)
        return least[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins as lists of (size, count), from (size, count) in descending sizes. Larger items than the capacity get a bin alone."""
    tree, bins = CapacityTree(), []
    for size, count in sizes:
        while count:
            found = tree.take(size)
            if found is None:
                found = (max(capacity, size), len(bins))
                bins.append([])
            room, bin_id = found
            n = min(count, room // size) if size else count
            bins[bin_id].append((size, n))
            tree.add(room - n * size, bin_id)
            count -= n
    return bins


def fewest_capacity(sizes: list[tuple[int, int]], n_bins: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Packing into at most n_bins with the least capacity that best-fit-decreasing reaches by bisection, and that capacity."""
    total, largest = sum(s * n for s, n in sizes), max((s for s, _ in sizes), default=0)
    low = max(largest, -(-total // n_bins))
    # An item that fits nowhere finds every bin fuller than capacity - largest, so this much is always enough.
    high = low + largest
    best = best_fit_decreasing(sizes, high)
    while high - low > low * PRECISION:
        mid = (low + high) // 2
        packed = best_fit_decreasing(sizes, mid)
        if len(packed) <= n_bins:
            best, high = packed, mid
        else:
            low = mid + 1
    return best, high


def even_out(bins: list[list[tuple[int, int]]], n_bins: int) -> list[list[tuple[int, int]]]:
    """The bins after moves and exchanges of single items that bring the fullest or the emptiest bin nearer to another one."""
    sizes = np.array(sorted({s for b in bins for s, _ in b}), dtype=np.int64)
    counts = np.zeros((n_bins, len(sizes)), np.int64)
    for b, content in enumerate(bins):
        for s, n in content:
            counts[b, np.searchsorted(sizes, s)] += n
    load = counts @ sizes

    def closer(a: int, b: int) -> bool:
        """One move or exchange from the fuller bin a to b whose difference comes nearest to half of theirs."""
        gap = int(load[a] - load[b])
        mine = np.nonzero(counts[a])[0]
        if gap <= 1 or not len(mine):
            return False
        yours = np.nonzero(counts[b])[0]
        # Nothing in exchange is an item of size 0.
        other, names = np.append(0, sizes[yours]), np.append(-1, yours)
        want = np.searchsorted(other, sizes[mine] - gap / 2)
        best = None
        for at in (np.maximum(want - 1, 0), np.minimum(want, len(other) - 1)):
            shift = sizes[mine] - other[at]
            left = np.where((shift > 0) & (shift < gap), np.abs(gap - 2 * shift), gap)
            k = int(left.argmin())
            if left[k] < gap and (best is None or left[k] < best[0]):
                best = (int(left[k]), int(mine[k]), int(names[at[k]]), int(shift[k]))
        if best is None:
            return False
        _, x, y, shift = best
        counts[a, x] -= 1
        counts[b, x] += 1
        if y >= 0:
            counts[b, y] -= 1
            counts[a, y] += 1
        load[a] -= shift
        load[b] += shift
        return True

    while len(sizes):
        order = np.argsort(load, kind="stable").tolist()
        if not any(closer(order[-1], b) for b in order[:-1]) and not any(closer(a, order[0]) for a in order[:0:-1]):
            break
    return [[(int(s), int(n)) for s, n in zip(sizes[::-1], row[::-1]) if n] for row in counts]


def plan(histogram: dict[int, int], n_shards: int) -> list[tuple[int, int, int, int]]:
    """Rows (size, first rank, last rank, shard) for the groups of each size."""
    bins, _ = fewest_capacity(sorted(histogram.items(), reverse=True), n_shards)
    used: dict[int, int] = {}
    rows = []
    for shard_id, content in enumerate(even_out(bins, n_shards)):
        for size, n in content:
            first = used.get(size, 0)
            rows.append((size, first, first + n - 1, shard_id))
            used[size] = first + n
    return rows


def _ranked(rows: DataFrame, key: str, order: list[str], rank: str, part: Column) -> DataFrame:
    """The rows of a written table with their number among those of equal `key`, from 0, counted in parts."""
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    starts = counts.select(key, "_part", (F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_start"))
    nth = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order)) - 1
    return rows.withColumn("_nth", nth).join(starts, [key, "_part"]).withColumn(rank, (F.col("_start") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_start")


def shard(docs: DataFrame, n_shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): equal texts together, sizes near equal, slots gapless from 0."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("_group").agg(F.sum("size").alias("_size")), "groups")
    histogram = {r["_size"]: r["n"] for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(plan(histogram, n_shards), "_size long, _first long, _last long, shard int")
    ranked = _ranked(groups, "_size", ["_group"], "_rank", F.pmod(F.xxhash64("_group"), F.lit(parts_for(groups, SLOT_PARTS))))
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") <= F.col("_last"))
    where = ranked.join(places.withColumnRenamed("_size", "_of"), (F.col("_size") == F.col("_of")) & inside).select("_group", "shard")
    mapped = materialize(join_totals(rows, where, "_group").select("doc_id", "size", "text_crc32", "shard", "_row"), "mapped")
    # The row number keeps many rows of one id, or of none, from being one part.
    part = F.pmod(F.xxhash64("doc_id", "_row"), F.lit(parts_for(mapped, SLOT_PARTS)))
    return _ranked(mapped, "shard", ["doc_id", "size", "text_crc32", "_row"], "slot", part).select("doc_id", "size", "text_crc32", "shard", "slot")
