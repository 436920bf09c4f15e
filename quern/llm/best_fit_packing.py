"""Packing token sequences by a linear grouping scheme.

Only the histogram of piece lengths (at most one row per length) is planned on
the driver. Large lengths are rounded up inside groups of equal cardinality;
the few rounded sizes are packed by configurations from column generation; the
actual documents take the rounded places, by rank within their length; small
pieces then enter the tightest room that is left. Equal sequences are planned
as one run, so the plan does not grow with the input. Tasks look their place up
by (length, rank); ranks are counted in parts, so a common length is not one task.

Token ids come from the byte-level vocabulary of the tokenizer file. Where the
same vocabulary lies beside it as ranks, the faster encoder reads those; ids
are the same (tested); texts with runs of LONG_RUN go to that library. The
strings of added tokens in a text are ordinary text. Each worker holds one encoder.

Edge cases: a null text is empty and gives the end token alone; pieces of
repeated rows are packed each; very long texts are cut into full pieces after a
shorter first one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, materialize, parts_for, spread

CAPACITY = 2048
END_ID = 0
#: Rounded sizes, and the least large length as a share of the capacity: configurations hold up to three pieces.
GROUPS = 400
LARGE = 0.3
#: Rounds of column generation without any gain after which it ends.
STALE = 200
#: Parts in which the pieces of one length are ranked, at least.
RANK_PARTS = 64
#: Unbroken runs from this length on are left to the library whose merge is not quadratic in a run.
LONG_RUN = re.compile(r"\S{5000}|\s{5000}")


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _encoder(path: str, pattern: str | None):
    """Text -> ids."""
    slow = lambda text: kept(("tokenizer", path), lambda: _library(path)).encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not (pattern and os.path.exists(ranks)):
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return lambda text: slow(text) if len(text) >= 5000 and LONG_RUN.search(text) else fast.encode_ordinary(text)


def cut_points(n: int, capacity: int) -> list[int]:
    """Piece starts of n tokens, and n: full pieces after a first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def _cut(batches, path: str, pattern: str | None, capacity: int):
    encode = kept(("encoder", path, pattern), lambda: _encoder(path, pattern))
    for b in batches:
        rows, texts = [], b.column(1)
        for i in range(len(texts)):
            ids = np.array(encode(texts[i].as_py() or "") + [END_ID], dtype="<u4")
            points = cut_points(len(ids), capacity)
            rows += [(i, p, s, e - s, zlib.crc32(ids[s:e])) for p, (s, e) in enumerate(zip(points, points[1:]))]
        at, piece, start, length, crc = (pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else ([],) * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), piece, start, length, crc], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (size, gain) in enumerate(zip(sizes, worth)):
        for _ in range(capacity // size):
            value = best[:-size] + gain
            better = np.flatnonzero(value > best[size:] + 1e-12)
            if not len(better):
                break
            best[size + better], pick[size + better] = value[better], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while pick[room] >= 0:
        counts[pick[room]] += 1
        room -= sizes[pick[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities that serve at most the demand; what is left over is small."""
    m = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, dtype=float)
    use = np.linalg.solve(basis, need)
    least, stale = np.inf, 0
    while stale < STALE:
        least, stale = (use.sum(), 0) if use.sum() < least - 1e-9 else (least, stale + 1)
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, column = _best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        use = np.maximum(np.linalg.solve(basis, need), 0)
    left, out = np.array(demand), []
    for j in np.argsort(-use):
        column = np.rint(basis[:, j]).astype(np.int64)
        inside = column > 0
        times = min(int(use[j] + 1e-6), int((left[inside] // column[inside]).min())) if inside.any() else 0
        if times > 0:
            left -= column * times
            out.append((column, times))
    return out


class _Runs:
    """Pieces of a group in descending length, taken as runs (length, first rank, count)."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.runs, self.at = runs, 0

    def peek(self) -> int:
        return self.runs[self.at][2] if self.at < len(self.runs) else 0

    def take(self, n: int) -> tuple[int, int]:
        length, rank, count = self.runs[self.at]
        if n == count:
            self.at += 1
        else:
            self.runs[self.at] = [length, rank + n, count - n]
        return length, rank

    def total(self) -> int:
        return sum(c for _, _, c in self.runs[self.at :])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, first rank, count, first sequence, offset) for all pieces, and the number of sequences.

    The pieces of a length are ranked from 0; the piece of rank first + i goes to sequence first_sequence + i.
    """
    places, bins = [], 0
    open_runs: dict[int, list[list[int]]] = {}  # room -> [first sequence, count]

    def put(run: tuple[int, int, int], offset: int, sequence: int) -> None:
        places.append((run[0], run[1], run[2], sequence, offset))

    def keep(room: int, sequence: int, count: int) -> None:
        open_runs.setdefault(room, []).append([sequence, count])

    large = [[length, 0, count] for length, count in sorted(histogram.items(), reverse=True) if length > capacity * LARGE]
    small = [(length, count) for length, count in sorted(histogram.items(), reverse=True) if length <= capacity * LARGE]
    per_group = -(-sum(r[2] for r in large) // groups) or 1
    queues: list[_Runs] = []
    now: list[list[int]] = []
    for length, rank, count in large:
        while count:
            n = min(count, per_group - sum(r[2] for r in now))
            now.append([length, rank, n])
            rank, count = rank + n, count - n
            if sum(r[2] for r in now) == per_group:
                queues.append(_Runs(now))
                now = []
    if now:
        queues.append(_Runs(now))

    def fill(members: list[_Runs], times: int) -> None:
        """`times` sequences with one piece from each queue, as runs of equal actual lengths."""
        nonlocal bins
        uses = {id(q): members.count(q) for q in members}
        while times:
            n = min(times, *(max(q.peek() // uses[id(q)], 1) for q in members))
            got = []
            for q in members:
                if q.peek() < n:
                    n = q.peek()
            taken = [(q, *q.take(n)) for q in members] if all(q.peek() >= n * uses[id(q)] for q in members) else None
            if taken is None:  # a queue's run ends inside one sequence: fill that one alone
                n = 1
                taken = [(q, *q.take(1)) for q in members]
            for _, length, rank in taken:
                put((length, rank, n), sum(x[0] for x in got), bins)
                got.append((length, n))
            keep(capacity - sum(x[0] for x in got), bins, n)
            bins += n
            times -= n

    if queues:
        sizes = [q.runs[0][0] for q in queues]
        merged: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            merged.setdefault(s, []).append(i)
        distinct = sorted(merged, reverse=True)
        joined = [_Runs([r for i in merged[s] for r in queues[i].runs]) for s in distinct]
        for column, times in configurations(distinct, [q.total() for q in joined], capacity):
            fill([q for q, c in zip(joined, column) for _ in range(c)], times)
        rest = [(length, rank, count) for q in joined for length, rank, count in q.runs[q.at :]]
    else:
        rest = []

    def tightest(length: int) -> int | None:
        rooms = [r for r, runs in open_runs.items() if r >= length and runs]
        return min(rooms, default=None)

    for length, rank, count in sorted(rest, reverse=True) + [(length, 0, count) for length, count in small]:
        while count:
            room = tightest(length)
            if room is None:
                n = max(1, count // (capacity // length))
                keep(capacity, bins, n)
                bins += n
                continue
            run = open_runs[room][-1]
            n = min(count, run[1])
            put((length, rank, n), capacity - room, run[0])
            if n == run[1]:
                open_runs[room].pop()
            else:
                open_runs[room][-1] = [run[0] + n, run[1] - n]
            keep(room - length, run[0], n)
            rank, count = rank + n, count - n
    return places, bins


def pack(docs: DataFrame, tokenizer: str, pattern: str | None = None, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    tokenizer: path of the vocabulary file, the same on every machine; pattern:
    its splitting pattern, which lets ranks beside it be used.
    """
    spark = docs.sparkSession
    dtype = dict(docs.dtypes)[id_col]
    pieces = spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).mapInArrow(
        lambda bs: _cut(bs, tokenizer, pattern, capacity), f"doc_id {dtype}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = materialize(pieces, "pieces")
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(parts_for(pieces, RANK_PARTS))))
    counts = materialize(pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")), "counts")
    # At most one row per length, so at most `capacity` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places, _ = plan(histogram, capacity)
    placed = spark.createDataFrame(places, "length long, _first long, _count long, _sequence long, offset long")
    starts = counts.select("length", "_part", (F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_start"))
    nth = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("_nth", nth).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_start") + F.col("_nth"))
    # The plan's size depends on the capacity and the number of groups only.
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    out = ranked.join(F.broadcast(placed.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")
