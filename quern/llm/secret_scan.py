"""Secret scans: all rules in one pass of a combined deterministic automaton.

The combined automaton reads every byte once and reports where a rule's sign
ends: the least part of a match that tells the rule. From there the rule's
backward automaton fixes the start and its forward automaton the longest end;
no other matcher decides a span. Spans are leftmost and non-overlapping per
rule, in code points. Signs need full counts neither in the combined automaton,
which would then have to count several runs side by side, nor per byte: a run
of bytes that all end a sign is one report.

Edge cases: a null or empty text has no spans; long texts are scanned whole;
repeated rows are scanned each; an empty table gives an empty result; other
columns pass through `redact` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton
from .common import kept, spread, utf8_buffers


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

_ASSIGN = rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?"
# Kind, sign, whole match, whole match that counts (one that is found but does not count takes its place from others).
# A sign is a beginning of every match that counts; of two signs of a rule the one that starts first ends first.
RULES = [
    ("assign", rf"{_ASSIGN}[A-Za-z0-9+/_.=-]", rf"{_ASSIGN}[A-Za-z0-9+/_.=-]+", rf"{_ASSIGN}[A-Za-z0-9+/_.=-]{{8,}}"),
    ("access", r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32}", r"[0-9a-f]{32,}", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{8}", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{4}", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[A-Za-z0-9_-]{8}", r"AIza[A-Za-z0-9_-]{35}", None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None),
]
KINDS = [r[0] for r in RULES]
BASE = KINDS[:3]
#: Texts that are scanned side by side.
SIDE_BY_SIDE = 4000


def _compile() -> tuple[Automaton, list[tuple[Automaton, Automaton, Automaton | None]]]:
    """The combined automaton of all signs; per rule the backward one of its sign, and the forward ones of whole matches."""
    one = lambda p, **how: Automaton([p], anywhere=False, **how)
    return Automaton([r[1] for r in RULES]), [(one(sign, backward=True), one(whole), one(counted) if counted else None) for _, sign, whole, counted in RULES]


def _resolve(data: bytes, hits: list[tuple[int, int]], rules: list) -> list[tuple[int, int, int]]:
    """Sorted (start, rule, end) in bytes from the hits (position, rule mask) of one text, in order."""
    spans, done = [], [0] * len(rules)
    for last, mask in hits:
        for r, (back, whole, counted) in enumerate(rules):
            if not mask >> r & 1 or last < done[r]:
                continue
            start = back.reach(data, last, done[r] - 1, -1)
            end = None if start is None else whole.reach(data, start, len(data))
            if end is None:
                continue
            done[r] = end + 1
            if counted is None or counted.reach(data, start, end + 1) == end:
                spans.append((start, r, end + 1))
    return sorted(spans)


def find_spans(column) -> dict[int, list[tuple[int, int, int]]]:
    """Byte spans (start, rule, end) by row number, for the rows of an Arrow string column that have any."""
    automaton, rules = kept(("secrets",), _compile)
    raw, starts, ends = utf8_buffers(column)
    found: dict[int, list] = {}
    for i in range(0, len(starts), SIDE_BY_SIDE):
        hits: dict[int, list] = {}
        for row, at, mask in automaton.scan(raw, starts[i : i + SIDE_BY_SIDE], ends[i : i + SIDE_BY_SIDE]):
            hits.setdefault(row + i, []).append((at - int(starts[row + i]), mask))
        for row, marks in hits.items():
            if spans := _resolve(raw[starts[row] : ends[row]].tobytes(), marks, rules):
                found[row] = spans
    return found


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda b: int(lead[b - 1]) if b else 0
    return [{"kind": KINDS[r], "start": at(s), "end": at(e), "secret": data[s:e].decode()} for s, r, e in spans]


SPANS = "array<struct<kind string, start int, end int, secret string>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))


def _scan(batches):
    for b in batches:
        texts, found = b.column(1), find_spans(b.column(1))
        out = [_points(texts[i].as_py().encode(), found[i]) if i in found else [] for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=_SPANS_ARROW)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, spans), one per row of the input; spans sorted by start, then by rule."""
    dtype = dict(docs.dtypes)[id_col]
    return spread(docs.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(_scan, f"doc_id {dtype}, spans {SPANS}")


def _mask(data: bytes, spans: list[tuple[int, int, int]], by: bytes) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [data[at:s], by]
        at = e
    return b"".join([*out, data[at:]]).decode()


def redact(docs: DataFrame, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """The input with every run of secret spans in its text replaced; same columns, same rows."""
    at, mark = docs.columns.index(text_col), by.encode()

    def run(batches):
        for b in batches:
            texts, found = b.column(at), find_spans(b.column(at))
            if found:
                values = texts.to_pylist()
                for i, spans in found.items():
                    values[i] = _mask(values[i].encode(), spans, mark)
                columns = list(b.columns)
                columns[at] = pa.array(values, type=texts.type)
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names)
            yield b

    return docs.mapInArrow(run, docs.schema)
