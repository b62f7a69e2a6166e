"""One deterministic automaton for many search rules.

Each rule's regex becomes an automaton that finds its leftmost, longest, non-overlapping matches and starts over
after each. Subset construction keeps the threads of a rule in the order in which they started, drops those that a
match overlaps, and marks the state that follows a match's last byte. The rules' automata are joined state by
state and the joint one is minimised, so a text is scanned once, byte by byte, for all rules. The start of a match
comes from running the rule's reversed automaton back from its end.

Syntax: literals, escapes, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}` and `(?i:...)` for ASCII letters in
either case. A rule must stay in a match until the match ends (no optional tail that can fail half-way, and no
pending earlier match beside a found one); compile() raises ValueError for others.
"""

from __future__ import annotations

import numpy as np

ANY = (1 << 256) - 1


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.i, self.edges, self.eps = pattern, 0, [], []
        self.fold = False
        self.start, self.end = self._alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {pattern!r}")

    def _node(self) -> int:
        self.edges.append([])
        self.eps.append([])
        return len(self.edges) - 1

    def _alternatives(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            parts.append(self._sequence())
        a, b = self._node(), self._node()
        for x, y in parts:
            self.eps[a].append(x)
            self.eps[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self._node()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self._repeated()
            self.eps[b].append(x)
            b = y
        return a, b

    def _repeated(self) -> tuple[int, int]:
        at = self.i
        x, y = self._atom()
        if self.i < len(self.s) and (c := self.s[self.i]) in "?*+{":
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            self.i += 1
            if c == "{":
                to = self.s.index("}", self.i)
                lo, comma, hi = self.s[self.i : to].partition(",")
                least, most, self.i = int(lo), int(hi) if hi else None if comma else int(lo), to + 1
            after, (a, b) = self.i, (self._node(),) * 2
            for k in range(max(least, most or 0) or 1):
                self.i = at
                x, y = self._atom()
                if k >= least:
                    self.eps[x].append(y)
                self.eps[b].append(x)
                b = y
            if most is None:
                self.eps[y].append(x)
            self.i = after
            return a, b
        return x, y

    def _atom(self) -> tuple[int, int]:
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            x, y = self._alternatives()
            self.fold, self.i = fold, self.i + 1
            return x, y
        mask = self._class() if c == "[" else ANY if c == "." else 1 << self._char(c)
        if self.fold:
            mask |= sum(1 << (b ^ 32) for b in range(256) if mask >> b & 1 and chr(b).isascii() and chr(b).isalpha())
        a, b = self._node(), self._node()
        self.edges[a].append((mask, b))
        return a, b

    def _char(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _class(self) -> int:
        mask, negated = 0, self.s[self.i] == "^"
        self.i += negated
        while (c := self.s[self.i]) != "]":
            self.i += 1
            low = high = self._char(c)
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 2
                high = self._char(self.s[self.i - 1])
            mask |= sum(1 << b for b in range(low, high + 1))
        self.i += 1
        return ANY & ~mask if negated else mask


class _Nfa:
    def __init__(self, start: int, end: int, edges: list, eps: list):
        self.end, self.edges = end, edges
        self.closed = []
        for n in range(len(edges)):
            seen, todo = {n}, [n]
            while todo:
                for m in eps[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            self.closed.append(frozenset(m for m in seen if edges[m] or m == end))
        self.first = self.closed[start]
        self.masks = sorted({m for e in edges for m, _ in e})

    def step(self, states: frozenset, byte: int) -> frozenset:
        return frozenset().union(*(self.closed[t] for s in states for m, t in self.edges[s] if m >> byte & 1))

    def reversed(self, start: int, eps: list) -> "_Nfa":
        edges, back = [[] for _ in self.edges], [[] for _ in self.edges]
        for s, out in enumerate(self.edges):
            for m, t in out:
                edges[t].append((m, s))
        for s, out in enumerate(eps):
            for t in out:
                back[t].append(s)
        return _Nfa(self.end, start, edges, back)


def _byte_classes(masks: list[int]) -> tuple[list[int], list[int]]:
    """Class of each byte, and a byte of each class; bytes that all masks treat alike share one."""
    of, one, seen = [], [], {}
    for b in range(256):
        key = tuple(m >> b & 1 for m in masks)
        if key not in seen:
            seen[key] = len(one)
            one.append(b)
        of.append(seen[key])
    return of, one


def minimised(moves: np.ndarray, labels: list) -> tuple[np.ndarray, list, int]:
    """Moore's partition refinement: moves (states x classes) and labels of the smallest equal automaton; state 0's new number."""
    block = np.unique([sorted(set(labels)).index(x) for x in labels], return_inverse=True)[1]
    while True:
        after = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if after.max() == block.max():
            break
        block = after
    first = np.unique(block, return_index=True)[1]
    return block[moves[first]], [labels[i] for i in first], int(block[0])


def _searcher(nfa: _Nfa, one: list[int]) -> tuple[np.ndarray, list, int]:
    """Labels: (a match ended just before the last byte read, a match is open)."""
    zero = ((), False, False)
    number, rows, todo = {zero: 0}, [], [zero]
    while todo:
        groups, found, _ = todo.pop(0)
        row = []
        for b in one:
            for again in (False, True):
                out, seen = [], set()
                for g in () if again else groups:
                    out.append(nfa.step(g, b))
                if again or not found:
                    out.append(nfa.step(nfa.first, b))
                kept = []
                for g in out:
                    g = g - seen
                    seen |= g
                    if g:
                        kept.append(g)
                if kept or not found:
                    break
            ended, hit = again, next((k for k, g in enumerate(kept) if nfa.end in g), None)
            if found and not again and hit is None:
                raise ValueError("a match can go on without matching")
            if hit:
                raise ValueError("an earlier match is pending beside a found one")
            kept = kept[:1] if hit == 0 else kept
            state = (tuple(kept), hit == 0, ended)
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            row.append(number[state])
        rows.append(row)
    return minimised(np.array(rows), [(s[2], s[1]) for s in number])


class Automaton:
    """scan(data) gives (kind, start, end) in bytes, in order of end."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.kinds = [k for k, _ in rules]
        parsed = [_Parser(p) for _, p in rules]
        nfas = [_Nfa(p.start, p.end, p.edges, p.eps) for p in parsed]
        for k, n in zip(self.kinds, nfas):
            if n.end in n.first:
                raise ValueError(f"rule {k} matches nothing at all")
        self.back = [n.reversed(p.start, p.eps) for p, n in zip(parsed, nfas)]
        self.backward: list[dict] = [{} for _ in rules]
        of, one = _byte_classes(sorted({m for n in nfas for m in n.masks}))
        single = [_searcher(n, one) for n in nfas]
        number, rows, todo = {tuple(s[2] for s in single): 0}, [], [tuple(s[2] for s in single)]
        while todo:
            state = todo.pop()
            row = []
            for c in range(len(one)):
                to = tuple(int(s[0][x, c]) for x, s in zip(state, single))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append((number[state], row))
        moves = np.array([r for _, r in sorted(rows)])
        labels = [tuple(s[1][x] for x, s in zip(state, single)) for state in number]
        self.joint = len(moves)
        self.moves, self.labels, self.start = minimised(moves, labels)
        # a row for each state: where each byte leads, then the rules whose match ended before that byte
        self.rows = [[] for _ in self.moves]
        for row, move, label in zip(self.rows, self.moves.tolist(), self.labels):
            row.extend(self.rows[move[c]] for c in of)
            row.append([k for k, (ended, _) in enumerate(label) if ended])
            row.append([k for k, (_, open_) in enumerate(label) if open_])

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        nfa, cache = self.back[rule], self.backward[rule]
        states, at, found = nfa.first, end, end
        while at > least and states:
            at -= 1
            key = (states, data[at])
            if key not in cache:
                cache[key] = nfa.step(*key)
            states = cache[key]
            if nfa.end in states:
                found = at
        return found

    def scan(self, data: bytes) -> list[tuple[str, int, int]]:
        row, ends = self.rows[self.start], []
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                ends += [(k, i) for k in row[256]]
        ends += [(k, len(data)) for k in row[257]]
        out, least = [], [0] * len(self.kinds)
        for k, end in ends:
            out.append((self.kinds[k], self._start(k, data, end, least[k]), end))
            least[k] = end
        return out
