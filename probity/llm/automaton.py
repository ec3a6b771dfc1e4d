"""Rule patterns compiled into one deterministic automaton: parse, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ALL = frozenset(range(256))


class _Parser:
    """A byte-level subset of regular expressions: literals, ., \\xHH, \\., [..], (..), |, ?, *, +, {m}, {m,}, {m,n}, (?i:..)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.edges, self.eps, self.fold = pattern, 0, [], [], [False]

    def state(self) -> int:
        self.edges.append([])
        self.eps.append([])
        return len(self.eps) - 1

    def parse(self) -> tuple[int, int]:
        out = self.either()
        if self.i < len(self.s):
            raise ValueError(f"stray {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return out

    def either(self) -> tuple[int, int]:
        arms = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            arms.append(self.sequence())
        if len(arms) == 1:
            return arms[0]
        a, b = self.state(), self.state()
        for x, y in arms:
            self.eps[a].append(x)
            self.eps[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.repeated()
            self.eps[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        part = self.atom()
        after = self.i
        low, high = 1, 1
        c = self.s[self.i : self.i + 1]
        if c in ("?", "*", "+") and c:
            low, high, self.i = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c] + (self.i + 1,)
        elif c == "{":
            end = self.s.index("}", self.i)
            lo, _, hi = self.s[self.i + 1 : end].partition(",")
            low, high = int(lo), (int(hi) if hi else None if "," in self.s[self.i : end] else int(lo))
            self.i = end + 1
        done = self.i
        if (low, high) == (1, 1):
            return part

        def again() -> tuple[int, int]:
            self.i = begin
            out = self.atom()
            assert self.i == after
            self.i = done
            return out

        a = b = self.state()
        for k in range(low if high is None else high):
            x, y = part if k == 0 else again()
            self.eps[b].append(x)
            if k >= low:
                self.eps[b].append(-1)  # may stop here; bound below
            b = y
        if high is None:
            x, y = part if low == 0 else again()
            self.eps[b].append(x)
            self.eps[y].append(x)
            end = self.state()
            self.eps[b].append(end)
            self.eps[y].append(end)
            b = end
        self.eps = [[b if t == -1 else t for t in e] for e in self.eps]
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            fold = self.fold[-1]
            if self.s.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            self.fold.append(fold)
            out = self.either()
            self.fold.pop()
            self.i += 1
            return out
        if c == "[":
            chars = self.char_class()
        elif c == ".":
            self.i += 1
            chars = ALL - {10}
        else:
            chars = frozenset([self.char()])
        if self.fold[-1]:
            chars = chars | {x ^ 32 for x in chars if 65 <= x & ~32 <= 90}
        a, b = self.state(), self.state()
        self.edges[a].append((chars, b))
        return a, b

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
            return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))
        return ord(c)

    def char_class(self) -> frozenset[int]:
        self.i += 1
        flip = self.s[self.i] == "^"
        self.i += flip
        out: set[int] = set()
        while self.s[self.i] != "]":
            a = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                out.update(range(a, self.char() + 1))
            else:
                out.add(a)
        self.i += 1
        return ALL - out if flip else frozenset(out)


class Automaton:
    """Minimal deterministic automaton of several rules; accepts[state] has bit r set where rule r ends.

    search=True puts an implied "anything" before every rule, so one pass over the bytes finds where any rule ends. backward=True reads
    rules and bytes from right to left, so that a pass finds where any rule's match begins.
    table[state * classes + byte_class[byte]] is the next state, times the number of classes.
    """

    def __init__(self, patterns: Sequence[str], search: bool = True, backward: bool = False):
        edges: list = []
        eps: list = []
        accept: dict[int, int] = {}
        entry = []
        for r, p in enumerate(patterns):
            q = _Parser(p)
            a, b = q.parse()
            n = len(eps)
            edges += [[(c, t + n) for c, t in e] for e in q.edges]
            eps += [[t + n for t in e] for e in q.eps]
            entry.append(b + n if backward else a + n)
            accept[a + n if backward else b + n] = 1 << r
        if backward:
            turned: tuple[list, list] = ([[] for _ in eps], [[] for _ in eps])
            for s, (e, z) in enumerate(zip(edges, eps)):
                for c, t in e:
                    turned[0][t].append((c, s))
                for t in z:
                    turned[1][t].append(s)
            edges, eps = turned
        # bytes that no rule tells apart are one class
        signature: dict[tuple, int] = {}
        sets = list({c for e in edges for c, _ in e})
        cls = np.zeros(256, np.int64)
        sample: list[int] = []
        for byte in range(256):
            key = tuple(byte in c for c in sets)
            if key not in signature:
                signature[key] = len(signature)
                sample.append(byte)
            cls[byte] = signature[key]
        m = len(sample)

        def closure(states) -> frozenset[int]:
            out, todo = set(states), list(states)
            while todo:
                for t in eps[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(out)

        start = closure(entry)
        ids, todo, rows = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            row = []
            for byte in sample:
                to = closure([t for s in now for c, t in edges[s] if byte in c] + (entry if search else []))
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        table = np.array(rows, np.int64).reshape(len(ids), m)
        ends = np.zeros(len(ids), np.int64)
        for s, k in ids.items():
            for q in s & accept.keys():
                ends[k] |= accept[q]
        # partition refinement until no class splits
        part = np.unique(ends, return_inverse=True)[1].reshape(-1)
        while True:
            new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        first = np.unique(part, return_index=True)[1]
        order = np.argsort(first)  # the start state stays 0
        name = np.empty_like(order)
        name[order] = np.arange(len(order))
        part, first = name[part], first[order]
        self.classes, self.byte_class = m, cls.astype(np.uint8)
        self.next = part[table[first]].astype(np.int32)
        self.accepts = ends[first]
        self.table = (self.next * m).astype(np.int32).ravel()
        self.accept_at = np.repeat(self.accepts, 1)
        #: Bytes that lead every state back to the start, so that texts can be cut after them.
        self.reset = (self.next == 0).all(axis=0)[cls]
        dead = [s for s in range(len(self.next)) if not self.accepts[s] and (self.next[s] == s).all()]
        self.dead = dead[0] if dead and not search else -1

    def begins(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place in buf, bits of the rules) wherever a match begins in a piece buf[starts[i]:ends[i]], by piece and place
        (search, backward). One pass: pieces go a byte at a time together, longest first, those that have ended leave; very long ones go alone."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        long = int((size > 4096).sum())
        hot = self.accepts != 0
        piece, place, bits = [], [], []
        symbols = self.byte_class[buf].astype(np.int32)
        rows, flags = self.table.tolist(), np.repeat(hot, self.classes).tolist()
        for p in order[:long].tolist():
            a, state, at = int(starts[p]), 0, []
            seen = []
            for i, x in enumerate(reversed(symbols[a : int(ends[p])].tolist()), 1):
                state = rows[state + x]
                if flags[state]:
                    at.append(i)
                    seen.append(state)
            piece.append(np.full(len(at), p))
            place.append(int(ends[p]) - np.array(at, np.int64))
            bits.append(self.accepts[np.array(seen, np.int64) // self.classes])
        order = order[long:]
        size, at = size[order], ends[order] - 1
        live, t, state = int((size > 0).sum()), 0, np.zeros(len(order), np.int32)
        hot_at = np.repeat(hot, self.classes)
        upto = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
        while live:
            state = self.table.take(state[:live] + symbols.take(at[:live] - t))
            i = np.flatnonzero(hot_at.take(state))
            if len(i):
                piece.append(order[i])
                place.append(at[i] - t)
                bits.append(self.accepts[state[i] // self.classes])
            t += 1
            live = int(upto[t]) if t < len(upto) else 0
        if not piece:
            none = np.empty(0, np.int64)
            return none, none, none
        piece, place, bits = np.concatenate(piece), np.concatenate(place), np.concatenate(bits)
        by = np.argsort(place, kind="stable")
        return piece[by], place[by], bits[by]

    def longest(self, raw: bytes, at: int) -> int:
        """End of the longest match that starts at `at` (search=False), or -1."""
        s, end = 0, -1
        for i in range(at, len(raw)):
            s = int(self.next[s, self.byte_class[raw[i]]])
            if self.accepts[s]:
                end = i + 1
            elif s == self.dead:
                break
        return end
