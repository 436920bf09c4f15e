"""Suffix dedup: bytes covered by an earlier equal 100-byte string, by column-wise construction.

0. Whole texts that equal an earlier one are removed at once: all their windows
   occur there. Only first texts go on.
1. Anchors. In every window of LENGTH bytes the GRAM-byte string of least hash
   is an anchor (winnowing). Equal windows have the same anchors at the same
   offsets, so every repeated window lies around an anchor whose hash occurs
   more than once.
2. Segments. Around such an anchor up to LENGTH - GRAM bytes on both sides are
   cut from the text. Equal segments of a hash become one class with its first
   place, within a task before the shuffle and across tasks after it.
3. Column-wise construction. The classes of a hash, aligned at the anchor, are
   a collection of strings. One symbol per string is inserted each round, from
   the last column to the first: the order of the suffixes that start there (the
   transform's rows for that length) and their common prefixes are updated from
   the round before. Neighbours with LENGTH common bytes start equal windows.
4. In each document the windows that have an earlier equal are removed.

The collection is rebuilt per hash group instead of over whole documents: a
round per byte of the longest document would be 10**5 passes over all data,
and anchors bound the rounds by the segment length. The sequential files of the
method are Spark's sorted shuffle files; a task holds a bounded number of
whole groups. A hash with more than CROWD occurrences is dealt out finer: its
windows go in blocks of neighbouring starts, by the bytes that all windows of a
block have in common. From MOB times CROWD occurrences on, each window goes by
itself, and equal windows are one class without a group.

A row is known by 80 bits of its id and whole text, a mark of 64 and a check of
16, as any number of rows may have one id, or none: among 10**10 different rows
one in 10**4 tables has two that are alike in these. Anchors meet by the first
48 bits of their hash, which leaves room for the check in the shuffle; strings
are compared as such afterwards, so a chance meeting removes nothing.

Order: smaller doc_id first, then earlier start. Edge cases: a null text is
empty; a null doc_id comes before all others, and null ids are one id; rows
with the same doc_id and text are one place each and do not remove each other;
a text shorter than LENGTH loses nothing; very long texts are read whole; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_totals, utf8_buffers

LENGTH = 100
GRAM = 32
#: Occurrences of a hash from which its windows go in blocks of BLOCK starts, and times that from which they go one by one.
CROWD, MOB, BLOCK = 20000, 10, 17
#: Bytes that are hashed at a time.
CHUNK = 1 << 18
#: Classes that a task holds before it hands them on.
HELD = 20000
#: Segments that a task builds columns for at a time, whole groups.
BUNDLE = 30000
_BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram`-byte string, put together from those of the powers of two in gram."""
    part, base, width, out, done = _TABLE[raw], _BASE, 1, None, 0
    while True:
        if gram & width:
            out = part if out is None else part[: len(part) - done] * np.uint64(pow(_BASE, done, 1 << 64)) + out[width:]
            done += width
        if width * 2 > gram:
            return out ^ (out >> np.uint64(31))
        part = part[:-width] * np.uint64(base) + part[width:]
        base, width = base * base & (1 << 64) - 1, width * 2


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(x) - width + 1], out[width - done :][: len(x) - width + 1]) if done < width else out


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position in raw, hash) of all anchors of the texts raw[starts:ends], which lie one after the other."""
    width = length - gram + 1
    begin, end = int(starts[0]), int(ends[-1])
    if end - begin < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw[begin:end], gram)
    least = _sliding(h, width, np.minimum)
    # A window that leaves its text counts for nothing: no hash equals its minimum.
    outside = np.zeros(len(least) + 1, np.int32)
    for s, e in zip(starts - begin, ends - begin):
        outside[min(max(e - length + 1, s), len(least))] += 1
        outside[min(e, len(least))] -= 1
    least[np.cumsum(outside[:-1]) > 0] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, np.maximum)
    at = np.nonzero((most == h) & (h > 0))[0]
    return at + begin, h[at]


def _chunks(starts: np.ndarray, ends: np.ndarray):
    """Ranges of rows with about CHUNK bytes each."""
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        done = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right"))
        yield at, max(done, at + 1)
        at = max(done, at + 1)


def _anchors(batches, with_place: bool, length: int, gram: int):
    """First 48 bits of the hashes of all anchors; with their places: those bits and the row's check, its mark, and the place."""
    for b in batches:
        raw, starts, ends = utf8_buffers(b.column(0))
        if with_place:
            marks, checks = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        for i, j in _chunks(starts, ends):
            at, h = anchors(raw, starts[i:j], ends[i:j], length, gram)
            if not len(at):
                continue
            if not with_place:
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(CHECK_BITS)).view(np.int64))], names=["hash"])
                continue
            row = np.searchsorted(starts[i:j], at, side="right") - 1 + i
            # Empty texts share a start with the next one; the last of them holds the bytes.
            columns = [h.view(np.int64) >> CHECK_BITS << CHECK_BITS | checks[row], marks[row], at - starts[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "mark", "place"])


# How an anchor's windows are dealt out: all in one segment, in blocks, one by one. A class is named by WHOLE,
# FIRST_BLOCK + block, or the window's last byte counted from the anchor.
WHOLE, BLOCKS, SINGLE = 0, 1, 2
FIRST_BLOCK = 1 << 14
#: Bits of a row's check; a packed place has the position in 32 bits, then for candidates the check and the way, for classes the name and the check.
CHECK_BITS = 16
WAY_AT, CHECK_AT = 32 + CHECK_BITS, 47


def _lists(column, checks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, positions and ways of dealing of a column of lists of packed longs, without those of another row's check; a null is empty."""
    sizes = np.zeros(len(column) + 1, np.int64)
    sizes[1:] = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    packed = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes[1:])
    mine = (packed >> 32 & (1 << CHECK_BITS) - 1) == checks.to_numpy(zero_copy_only=False)[row]
    packed, row = packed[mine], row[mine]
    return np.searchsorted(row, np.arange(len(column) + 1)), packed & 0xFFFFFFFF, packed >> WAY_AT


def _blocks(pos: int, n: int, length: int, gram: int):
    """(block, first start, last start) of the windows around an anchor, by blocks of BLOCK starts."""
    left = pos - (length - gram)
    for k in range((length - gram) // BLOCK + 1):
        s0, s1 = max(left + k * BLOCK, 0), min(left + k * BLOCK + BLOCK - 1, pos, n - length)
        if s0 <= s1:
            yield k, s0, s1


def _deal(*parts) -> int:
    """Signed 64-bit key, the same in every process."""
    digest = xxhash.xxh64()
    for x in parts:
        digest.update(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True))
    return int.from_bytes(digest.digest(), "little", signed=True)


def _pieces(data: bytes, pos: int, h: int, way: int, length: int, gram: int):
    """(deal, offset from the anchor, way, bytes) of the strings that an anchor's windows lie in."""
    side = length - gram
    if way == WHOLE:
        first = max(pos - side, 0)
        yield h, first - pos, way, data[first : pos + length]
    elif way == BLOCKS:
        for k, s0, s1 in _blocks(pos, len(data), length, gram):
            left = pos - side + k * BLOCK
            yield _deal(h, k, data[left + BLOCK - 1 : left + length]), s0 - pos, way, data[s0 : s1 + length]
    else:
        for s in range(max(pos - side, 0), min(pos, len(data) - length) + 1):
            yield _deal(h, s - pos, data[s : s + length]), s - pos, way, data[s : s + length]


def _segments(batches, length: int, gram: int):
    """Strings around the anchors of each document. Equal ones of a task are one row, with its first place."""
    names = ["deal", "off", "way", "segment", "id", "pos", "mark", "check"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def table(held):
        rows = [(*key, *place) for key, place in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    held: dict[tuple, tuple] = {}
    for b in batches:
        ends, where, ways = _lists(b.column(4), b.column(2))
        raw, starts, stops = utf8_buffers(b.column(3))
        for i in np.nonzero(np.diff(ends))[0]:
            text, doc, mark, check = raw[starts[i] : stops[i]], *(b.column(k)[i].as_py() for k in range(3))
            data, mine = text.tobytes(), slice(int(ends[i]), int(ends[i + 1]))
            hashes = gram_hashes(text, gram)[where[mine]].view(np.int64).tolist()
            for pos, h, way in zip(where[mine].tolist(), hashes, ways[mine].tolist()):
                for key in _pieces(data, pos, h, way, length, gram):
                    old = held.get(key)
                    if old is None or (doc, pos, mark, check) < old:
                        held[key] = (doc, pos, mark, check)
            if len(held) >= HELD:
                yield table(held)
                held = {}
    if held:
        yield table(held)


def repeated_windows(group: np.ndarray, symbols: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each string, which of its windows (by start column) an equal window of a lower rank in its group has.

    group: ascending group numbers; symbols: one row of bytes per string,
    aligned; low, high: first and past-the-last valid column of each row.
    """
    n, columns = symbols.shape
    found = np.zeros((n, columns - length + 1), bool)
    order, common = np.arange(n), np.zeros(n, np.int64)
    none = np.iinfo(np.int64).max
    by_column = np.ascontiguousarray(symbols.T)
    for c in range(columns - 1, -1, -1):
        key = group[order] * 256 + by_column[c][order]
        moved = np.argsort(key, kind="stable") if (key[1:] < key[:-1]).any() else np.arange(n)
        same = key[moved[1:]] == key[moved[:-1]]
        updated = np.zeros(n, np.int64)
        lo, hi = moved[:-1][same] + 1, moved[1:][same] + 1
        # Common prefix of two neighbours: one more than the least between them in the round before.
        value = common[lo]
        wide = np.nonzero(hi - lo > 1)[0]
        if len(wide):
            bounds = np.stack([lo[wide], hi[wide]], 1).reshape(-1)
            value[wide] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
        updated[1:][same] = np.minimum(value + 1, length)
        order, common = order[moved], updated
        if c > columns - length:
            continue
        inside = (low[order] <= c) & (c + length <= high[order])
        ranks = np.where(inside, rank[order], none)
        heads = np.nonzero(common < length)[0]
        least = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, n)))
        found[order[inside & (ranks > least)], c] = True
    return found


def _columns(batches, length: int, gram: int):
    """Bit masks of repeated windows per class, null where there are none; rows (deal, off, way, segment, id, pos, mark, check) come sorted by deal.

    Single windows are classes by themselves and pass.
    """
    side, width = length - gram, 2 * length - gram

    def build(rows):
        deals, offs, ways, segments, ids, places, marks, checks = rows
        n = len(deals)
        group = np.concatenate([[0], np.cumsum(deals[1:] != deals[:-1])])
        symbols, low, high = np.zeros((n, width), np.uint8), side + offs, np.zeros(n, np.int64)
        for r, s in enumerate(segments):
            high[r] = low[r] + len(s)
            symbols[r, low[r] : high[r]] = np.frombuffer(s, np.uint8)
        # Places with equal (id, position) tie: neither is earlier.
        by = np.lexsort((places, ids))
        step = (ids[by][1:] != ids[by][:-1]) | (places[by][1:] != places[by][:-1])
        rank = np.empty(n, np.int64)
        rank[by] = np.concatenate([[0], np.cumsum(step)])
        found = repeated_windows(group, symbols, low, high, rank, length)
        masks = [m.tobytes() if some else None for m, some in zip(np.packbits(found, axis=1), found.any(axis=1).tolist())]
        return out(marks, checks << CHECK_AT | np.where(ways == BLOCKS, FIRST_BLOCK + low // BLOCK, WHOLE) << 32 | places, masks)

    def out(marks, places, masks):
        return pa.RecordBatch.from_arrays([pa.array(marks), pa.array(places.astype(np.int64)), pa.array(masks, type=pa.binary())], names=["mark", "place", "mask"])

    def rows_of(held):
        return [[x for h in held for x in h[3]] if k == 3 else np.concatenate([h[k] for h in held]) for k in range(8)]

    held, count = [], 0
    for b in batches:
        now = [b.column(k).to_pylist() if k == 3 else b.column(k).to_numpy().astype(np.int64) for k in range(8)]
        alone = now[2] == SINGLE
        if alone.any():
            yield out(now[6][alone], now[7][alone] << CHECK_AT | now[1][alone] + length << 32 | now[5][alone], [None] * int(alone.sum()))
            rest = np.nonzero(~alone)[0]
            now = [[x[r] for r in rest] if k == 3 else x[rest] for k, x in enumerate(now)]
        if not len(now[0]):
            continue
        held.append(now)
        count += len(now[0])
        if count < BUNDLE or held[0][0][0] == now[0][-1]:
            continue
        rows = rows_of(held)
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        yield build([x[:cut] for x in rows])
        held, count = [[x[cut:] for x in rows]], len(rows[0]) - cut
    if held:
        yield build(rows_of(held))


def _spans(n: int, check: int, pos: np.ndarray, ways: np.ndarray, firsts: list, length: int, gram: int) -> np.ndarray:
    """Removed bytes of a document as a mask. firsts: (check, class name and position, mask) of the classes that start here."""
    gone, side = np.zeros(n + 1, np.int32), length - gram
    bits = lambda m: np.nonzero(np.unpackbits(np.frombuffer(m or b"", np.uint8)))[0]
    own = {(f["place"] & 0xFFFFFFFF, f["place"] >> 32 & (1 << CHECK_AT - 32) - 1): f["mask"] for f in firsts if f["place"] >> CHECK_AT == check}
    first, last = np.maximum(pos - side, 0), np.minimum(pos + length, n)
    mine = [p for p, name in own if name == WHOLE]
    whole = (ways == WHOLE) & ~np.isin(pos, mine) & (last - first >= length)
    np.add.at(gone, first[whole], 1)
    np.subtract.at(gone, last[whole], 1)
    windows = [bits(own[p, WHOLE]) + p - side for p in mine]
    for p, way in zip(pos[ways != WHOLE].tolist(), ways[ways != WHOLE].tolist()):
        for k, s0, s1 in _blocks(p, n, length, gram):
            if way == SINGLE:
                windows.append(np.array([s for s in range(s0, s1 + 1) if (p, s - p + length) not in own], np.int64))
            elif (p, FIRST_BLOCK + k) in own:
                windows.append(bits(own[p, FIRST_BLOCK + k]) + p - side)
            else:
                windows.append(np.arange(s0, s1 + 1))
    if windows:
        at = np.concatenate(windows).astype(np.int64)
        np.add.at(gone, at, 1)
        np.subtract.at(gone, at + length, 1)
    return np.cumsum(gone[:n]) > 0


def _finish(batches, length: int, gram: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for b in batches:
        rows = []
        ends, pos, ways = _lists(b.column(4), b.column(2))
        for i in range(b.num_rows):
            doc, check, data, copy = b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py().encode(), b.column(6)[i].as_py()
            spans = [(0, len(data))] if copy and len(data) >= length else []
            if ends[i] < ends[i + 1]:
                mine = slice(int(ends[i]), int(ends[i + 1]))
                gone = _spans(len(data), check, pos[mine], ways[mine], b.column(5)[i].as_py() or [], length, gram)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
            at, kept = 0, []
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            kept = b"".join([*kept, data[at:]])
            rows.append((None if doc == _NO_ID else doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), one per row of the input; doc_id is an integer.

    Texts are shuffled once: all steps read the same exchange.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"))
    check = F.pmod(F.xxhash64("text", "id", F.lit(1)), F.lit(1 << CHECK_BITS)).cast("int")
    rows = rows.select("id", F.xxhash64("id", "text").alias("mark"), check.alias("check"), "text")
    digests = rows.select("id", "mark", "check", F.unhex(F.sha2("text", 256)).alias("digest"))
    earliest = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_totals(digests, earliest, "digest").where("id > first").groupBy("mark").agg(F.collect_set("check").alias("copies"))
    texts = rows.join(later.hint("shuffle_hash"), "mark", "left").select("id", "mark", "check", "text", F.coalesce(F.array_contains("copies", F.col("check")), F.lit(False)).alias("copy"))
    # The id is not needed here, but without it this would be another exchange of the texts.
    own = texts.where("not copy").select("text", "mark", "check", "id")
    hashes = own.mapInArrow(lambda bs: _anchors(bs, False, length, gram), "hash long")
    counts = hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    places = own.mapInArrow(lambda bs: _anchors(bs, True, length, gram), "key long, mark long, place long")
    way = F.when(F.col("n") > MOB * crowd, SINGLE << WAY_AT).when(F.col("n") > crowd, BLOCKS << WAY_AT).otherwise(WHOLE)
    packed = way + F.shiftleft(F.col("key").bitwiseAND((1 << CHECK_BITS) - 1), 32) + F.col("place")
    # As in join_totals, the second key gives the counts a shuffle of their own, so that a hot hash can be split.
    also = lambda h: F.pmod(F.xxhash64(h), F.lit(2))
    mine = F.shiftrightunsigned("key", CHECK_BITS)
    counts = counts.select("hash", "n", also("hash").alias("also")).hint("shuffle_hash")
    found = places.join(counts, (mine == F.col("hash")) & (also(mine) == F.col("also"))).select("mark", packed.alias("place"))
    cands = found.groupBy("mark").agg(F.collect_list("place").alias("places"))
    with_places = texts.join(cands.hint("shuffle_hash"), "mark", "left").select("id", "mark", "check", "text", "places", "copy")
    segments = with_places.select("id", "mark", "check", "text", "places").mapInArrow(
        lambda bs: _segments(bs, length, gram), "deal long, off int, way int, segment binary, id long, pos int, mark long, check int"
    )
    classes = segments.repartition("deal").groupBy("deal", "off", "way", "segment").agg(F.min(F.struct("id", "pos", "mark", "check")).alias("first"))
    classes = classes.select("deal", "off", "way", "segment", "first.*").sortWithinPartitions("deal")
    built = classes.mapInArrow(lambda bs: _columns(bs, length, gram), "mark long, place long, mask binary")
    firsts = built.groupBy("mark").agg(F.collect_list(F.struct("place", "mask")).alias("firsts"))
    whole = with_places.join(firsts.hint("shuffle_hash"), "mark", "left").select("id", "mark", "check", "text", "places", "firsts", "copy")
    return whole.mapInArrow(lambda bs: _finish(bs, length, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>")
