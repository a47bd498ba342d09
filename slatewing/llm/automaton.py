"""One deterministic automaton for many patterns, run over many chunks at once.

Patterns (literals, classes, groups, alternatives, ``?``, ``*``, ``+`` and ``{m,n}``) become one NFA,
subset construction makes it a DFA with a table over character classes. :meth:`Automaton.scan` cuts texts
into overlapping chunks and steps all chunks in lockstep, one table lookup a character position.
A match is reported where it ends. The overlap brings a chunk nearly always to the state that the chunk
before it ends in; where a long match keeps it from that, the chunk is stepped again from the true state,
so matches of any length are found. Hits lie at absolute positions, once each.
"""

from __future__ import annotations

import numpy as np

#: Code points from here on share one class.
_OTHER = 128


class _Parser:
    """Thompson construction. ``nfa[state]`` is (set of code points or None, targets)."""

    def __init__(self):
        self.sets: list[frozenset[int] | None] = []
        self.next: list[list[int]] = []

    def state(self, chars: frozenset[int] | None = None) -> int:
        self.sets.append(chars)
        self.next.append([])
        return len(self.sets) - 1

    def pattern(self, text: str, folded: bool) -> tuple[int, int, int]:
        self.text, self.at, self.folded = text, 0, folded
        made = self.alternatives()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} in {text!r}")
        return made

    def alternatives(self) -> tuple[int, int, int]:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        a, b = self.state(), self.state()
        for x, y, _ in branches:
            self.next[a].append(x)
            self.next[y].append(b)
        return a, b, max(n for _, _, n in branches)

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def sequence(self) -> tuple[int, int, int]:
        a = b = self.state()
        length = 0
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            x, y, n = self.atom()
            if self.peek() == "*" or self.peek() == "+":
                end = self.state()
                self.next[b].extend([x] if self.peek() == "+" else [x, end])
                self.next[y].extend([x, end])
                self.at += 1
                b, length = end, length + n
                continue
            low, high = self.counts()
            stop = self.at
            length += n * (high if high else 1)
            for k in range(max(high, 1)):
                if k:
                    self.at = begin
                    x, y, _ = self.atom()
                    self.at = stop
                self.next[b].append(x)
                end = self.state()
                self.next[y].append(end)
                if k >= low:
                    self.next[b].append(end)
                b = end
        return a, b, length

    def counts(self) -> tuple[int, int]:
        c = self.peek()
        if c == "?":
            self.at += 1
            return 0, 1
        if c == "{":
            stop = self.text.index("}", self.at)
            low, _, high = self.text[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            return int(low), int(high or low)
        return 1, 1

    def atom(self) -> tuple[int, int, int]:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            made = self.alternatives()
            self.at += 1
            return made
        if c == "[":
            chars = self.klass()
        elif c == "\\":
            chars = self.escape()
        else:
            chars = {ord(c)}
        if self.folded:
            chars = chars | {ord(x) for v in chars if v < _OTHER for x in (chr(v).lower(), chr(v).upper())}
        a, b = self.state(frozenset(min(v, _OTHER) for v in chars)), self.state()
        self.next[a].append(b)
        return a, b, 1

    def escape(self) -> set[int]:
        c = self.text[self.at]
        self.at += 1
        if c == "s":
            return {9, 10, 11, 12, 13, 32}
        if c == "w":
            return {*range(48, 58), *range(65, 91), *range(97, 123), 95}
        if c == "n":
            return {10}
        return {ord(c)}

    def klass(self) -> set[int]:
        negated = self.peek() == "^"
        self.at += negated
        chars: set[int] = set()
        while self.peek() != "]":
            c = self.text[self.at]
            self.at += 1
            one = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.text[self.at + 1] != "]" and len(one) == 1:
                self.at += 1
                high = self.text[self.at]
                self.at += 1
                one = set(range(min(one), ord(high) + 1))
            chars |= one
        self.at += 1
        return set(range(1, _OTHER + 1)) - chars if negated else chars  # texts are joined by code point 0


class Automaton:
    """``patterns``: name to (pattern, ignore case). At most 62."""

    def __init__(self, patterns: dict[str, tuple[str, bool]], chunk: int = 512):
        self.names = list(patterns)
        parser = _Parser()
        start = parser.state()
        final: dict[int, int] = {}
        bound = 1
        for bit, (text, folded) in enumerate(patterns.values()):
            a, b, n = parser.pattern(text, folded)
            parser.next[start].append(a)
            final[b] = 1 << bit
            bound = max(bound, n)
        self.overlap, self.chunk = bound, chunk

        # sets of NFA states are bits of an integer; closures over empty moves are made once a state
        count = len(parser.sets)
        reach = [0] * count
        for s in range(count):
            todo, seen = [s], {s}
            while todo:
                here = todo.pop()
                if parser.sets[here] is None:
                    todo.extend(t for t in parser.next[here] if t not in seen)
                    seen.update(parser.next[here])
            reach[s] = sum(1 << t for t in seen if parser.sets[t] is not None or t in final)
        step = [0] * count
        for s in range(count):
            if parser.sets[s] is not None:
                for t in parser.next[s]:
                    step[s] |= reach[t]
        members = [s for s in range(count) if parser.sets[s] is not None]
        keys: dict[tuple, int] = {}
        self.klass = np.zeros(_OTHER + 1, np.uint8)
        for v in range(_OTHER + 1):
            key = tuple(s for s in members if v in parser.sets[s])
            self.klass[v] = keys.setdefault(key, len(keys))
        alive = [sum(1 << s for s in key) for key in keys]
        accepting = sum(1 << s for s in final)
        begin = reach[start]
        # the start's own moves are the same from every state
        again = [0] * len(alive)

        def moved(states: int) -> int:
            to = 0
            while states:
                low = states & -states
                to |= step[low.bit_length() - 1]
                states ^= low
            return to

        for c, mask in enumerate(alive):
            again[c] = moved(begin & mask) | begin
        ids, rows, accept, todo = {begin: 0}, [], [], [begin]
        for here in todo:
            bits, ends = 0, here & accepting
            while ends:
                low = ends & -ends
                bits |= final[low.bit_length() - 1]
                ends ^= low
            accept.append(bits)
            row = []
            for c, mask in enumerate(alive):
                to = again[c] | moved(here & mask & ~begin)
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        self.classes = len(alive)
        # states are kept premultiplied by the number of classes: one addition and one lookup a step
        self.table = (np.array(rows, np.int32) * self.classes).ravel()
        self.accept = np.zeros(len(rows) * self.classes, np.int64)
        self.accept[np.arange(len(rows)) * self.classes] = accept
        self.hot = self.accept != 0

    def _step(self, steps: np.ndarray, state: np.ndarray, lap: int, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
        """States behind the overlap and at the end, and the ends and pattern bits of the hits behind the overlap."""
        begin = state
        ends, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, codes in enumerate(steps):
            if i == lap:
                begin = state.copy()
            state = self.table[state + codes]
            hit = self.hot[state]
            if i >= lap and hit.any():
                at = np.flatnonzero(hit)
                ends.append(chunks[at] * self.chunk + (i - lap) + 1)
                kinds.append(self.accept[state[at]])
        return begin, state, np.concatenate(ends), np.concatenate(kinds)

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text number, offset behind the match, pattern bits)`` of all hits, ordered.

        A pattern that may end at several positions is reported at each of them.
        """
        joined = "\x00".join(texts)
        if not joined:
            return (np.zeros(0, np.int64),) * 3
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.klass[np.minimum(codes, _OTHER)]
        size, lap = self.chunk, self.overlap
        width = -(-len(codes) // size)
        padded = np.zeros(lap + width * size, np.uint8)
        padded[lap : lap + len(codes)] = codes
        # column k holds the overlap and then chunk k
        view = np.lib.stride_tricks.as_strided(padded, (width, lap + size), (size, 1))
        steps = np.ascontiguousarray(view.T)
        begin, last, end, bits = self._step(steps, np.zeros(width, np.int32), lap, np.arange(width))
        while len(wrong := np.flatnonzero(begin[1:] != last[:-1]) + 1):
            begin[wrong] = last[wrong - 1]
            _, last[wrong], more, kinds = self._step(steps[lap:, wrong], begin[wrong], 0, wrong)
            kept = ~np.isin((end - 1) // size, wrong)
            end, bits = np.concatenate((end[kept], more)), np.concatenate((bits[kept], kinds))
        order = np.argsort(end, kind="stable")
        end, bits = end[order], bits[order]
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        text = np.searchsorted(begins, end - 1, side="right") - 1
        return text, end - begins[text], bits
