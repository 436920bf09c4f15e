"""Combined deterministic automaton over bytes: rule patterns -> one transition array.

Patterns use literals, escapes, classes, groups, alternation and the repeats
? * + {m} {m,} {m,n}. Subset construction runs over byte classes (bytes that no
pattern tells apart), with a fresh start at every byte; equal states are merged.
Automata without the fresh start, forward or backward, fix the ends of a match.
"""

from __future__ import annotations

import numpy as np

#: From this many texts on, a step over all of them at once is cheaper than one text at a time.
LOCKSTEP = 24
#: Bytes of a single text that are turned into a list at a time.
BLOCK = 1 << 16


class _Nfa:
    """Thompson construction; a state has an edge (byte mask, target) or empty edges."""

    def __init__(self) -> None:
        self.edge: list[tuple[int, int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edge.append(None)
        self.empty.append([])
        return len(self.edge) - 1

    def add(self, node: tuple, start: int) -> int:
        """Build a parsed node from state `start`; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.edge[mid] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def parse(pattern: str) -> tuple:
    """Syntax tree of a pattern: set, cat, alt and rep nodes."""
    node, at = _alternation(pattern, 0)
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} in {pattern!r}")
    return node


def _alternation(p: str, at: int) -> tuple[tuple, int]:
    options, parts = [], []
    while at < len(p) and p[at] != ")":
        if p[at] == "|":
            options.append(("cat", parts))
            parts, at = [], at + 1
            continue
        node, at = _atom(p, at)
        node, at = _repeat(p, at, node)
        parts.append(node)
    options.append(("cat", parts))
    return (options[0] if len(options) == 1 else ("alt", options)), at


def _atom(p: str, at: int) -> tuple[tuple, int]:
    if p[at] == "(":
        node, at = _alternation(p, at + 3 if p.startswith("(?:", at) else at + 1)
        return node, at + 1
    if p[at] == "[":
        return _class(p, at + 1)
    byte, at = _byte(p, at)
    return ("set", 1 << byte), at


def _byte(p: str, at: int) -> tuple[int, int]:
    if p[at] != "\\":
        return ord(p[at]), at + 1
    if p[at + 1] == "x":
        return int(p[at + 2 : at + 4], 16), at + 4
    return ord(p[at + 1]), at + 2


def _class(p: str, at: int) -> tuple[tuple, int]:
    mask = 0
    while p[at] != "]":
        low, at = _byte(p, at)
        high = low
        if p[at] == "-" and p[at + 1] != "]":
            high, at = _byte(p, at + 1)
        mask |= sum(1 << b for b in range(low, high + 1))
    return ("set", mask), at + 1


def _repeat(p: str, at: int, node: tuple) -> tuple[tuple, int]:
    if at < len(p) and p[at] in "?*+":
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[at]]
        return ("rep", node, least, most), at + 1
    if at < len(p) and p[at] == "{":
        end = p.index("}", at)
        low, _, high = p[at + 1 : end].partition(",")
        most = int(low) if "," not in p[at:end] else int(high) if high else None
        return ("rep", node, int(low), most), end + 1
    return node, at


def reverse(node: tuple) -> tuple:
    """The tree of the reversed strings."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    inner = [reverse(x) for x in node[1]]
    return (node[0], inner[::-1] if node[0] == "cat" else inner)


class Automaton:
    """Transition array for a list of patterns; a state at or above `accepting` has `rules[state]`, a mask of the patterns that end there.

    anywhere: a match may start at every byte; backward: the array is for the reversed strings.
    """

    def __init__(self, patterns: list[str], anywhere: bool = True, backward: bool = False) -> None:
        nfa = _Nfa()
        starts, finals = [], {}
        for i, p in enumerate(patterns):
            s = nfa.state()
            starts.append(s)
            finals[nfa.add(reverse(parse(p)) if backward else parse(p), s)] = 1 << i
        again = starts if anywhere else []
        masks = {e[0] for e in nfa.edge if e}
        kinds: dict[tuple, int] = {}
        self.classes = np.array([kinds.setdefault(tuple(m >> b & 1 for m in sorted(masks)), len(kinds)) for b in range(256)], dtype=np.int32)
        sample = [int(np.argmax(self.classes == c)) for c in range(len(kinds))]
        start = nfa.closure(starts)
        number, order, rows = {start: 0}, [start], []
        for states in order:  # grows while it is read
            row = []
            edges = [e for s in states if (e := nfa.edge[s])]
            for b in sample:
                to = nfa.closure([t for m, t in edges if m >> b & 1] + again)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows)
        accept = np.array([sum(finals[s] for s in states if s in finals) for states in order])
        self.states_before = len(order)
        self._minimise(table, accept)

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        """Refine the partition by accepted rules until successors agree; number accepting states last."""
        part = np.unique(accept, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        n = part.max() + 1
        first = np.array([int(np.argmax(part == k)) for k in range(n)])
        by_accept = np.argsort(accept[first] > 0, kind="stable")
        new = np.empty(n, np.int64)
        new[by_accept] = np.arange(n)
        self.width = table.shape[1]
        self.rules = accept[first][by_accept]
        self.accepting = int((self.rules == 0).sum())
        self.start = int(new[part[0]])
        # Entries are row starts, so a step is one addition and one look-up.
        self.table = (new[part[table[first][by_accept]]] * self.width).astype(np.int32).reshape(-1)
        stuck = (self.table.reshape(n, -1) == (np.arange(n) * self.width)[:, None]).all(axis=1) & (self.rules == 0)
        self.dead = int(np.argmax(stuck)) * self.width if stuck.any() else -1
        self._lists = self.table.tolist(), self.classes.tolist()

    def reach(self, data: bytes, at: int, stop: int, step: int = 1) -> int | None:
        """Last byte, from `at` on towards `stop` (not included), on which a string that begins at `at` is accepted."""
        table, kinds = self._lists
        state, accept, dead, last = self.start * self.width, self.accepting * self.width, self.dead, None
        for p in range(at, stop, step):
            state = table[state + kinds[data[p]]]
            if state >= accept:
                last = p
            elif state == dead:
                break
        return last

    def scan(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yield (text number, position of the last byte, rule mask) wherever a pattern ends that did not end at the byte before; each byte is read once."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        sizes, at = sizes[order], starts[order].copy()
        kinds, table, width, rules = self.classes, self.table, self.width, self.rules.tolist()
        accept = self.accepting * width
        state = np.full(len(order), self.start * width, np.int32)
        live, step = int((sizes > 0).sum()), 0
        while live >= LOCKSTEP:
            now = table[state[:live] + kinds[raw[at[:live]]]]
            if (hit := now >= accept).any():
                for i in np.nonzero(hit)[0].tolist():
                    if new := rules[now[i] // width] & ~rules[state[i] // width]:
                        yield int(order[i]), int(at[i]), new
            state[:live] = now
            step += 1
            at[:live] += 1
            while live and sizes[live - 1] <= step:
                live -= 1
        if live:
            flat = self._lists[0]
            for i in range(live):
                s, text = int(state[i]), int(order[i])
                begin, end = int(at[i]), int(ends[text])
                for block in range(begin, end, BLOCK):
                    for p, k in enumerate(kinds[raw[block : min(block + BLOCK, end)]].tolist(), block):
                        before, s = s, flat[s + k]
                        if s >= accept and (new := rules[s // width] & ~rules[before // width]):
                            yield text, p, new
