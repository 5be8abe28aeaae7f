"""Byte regexes to minimal deterministic automata: parsing, subset construction, minimisation, transition arrays.

Syntax: literals, escapes (``\\xHH``, ``\\d``, ``\\w``, ``\\s``, escaped punctuation), classes, groups, ``|``, ``? * +`` and
``{m}``, ``{m,}``, ``{m,n}``; ``(?i:...)`` matches ASCII letters in either case. Patterns are over bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

_NAMED = {
    "d": frozenset(range(48, 58)),
    "w": frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)]),
    "s": frozenset([9, 10, 11, 12, 13, 32]),
}


def _fold(chars: frozenset[int]) -> frozenset[int]:
    return chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}


class _Parser:
    """Regex text to a tree: ('set', bytes) | ('cat', parts) | ('alt', parts) | ('rep', part, low, high)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self._alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.p}")
        return tree

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _repeated(self, tree):
        while (c := self._peek()) and c in "?*+{":
            self._take()
            if c == "{":
                body, _, rest = self.p[self.i :].partition("}")
                self.i = len(self.p) - len(rest)
                low, comma, high = body.partition(",")
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def _atom(self):
        c = self._take()
        if c == "(":
            before = self.fold
            if self._peek() == "?":
                head, _, rest = self.p[self.i :].partition(":")
                self.i = len(self.p) - len(rest)
                self.fold = self.fold or "i" in head
            tree = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"unbalanced pattern: {self.p}")
            self._take()
            self.fold = before
            return tree
        if c == "[":
            return self._set(self._class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return self._set(self._escape() if c == "\\" else frozenset([ord(c)]))

    def _set(self, chars: frozenset[int]):
        return ("set", _fold(chars) if self.fold else chars)

    def _escape(self) -> frozenset[int]:
        c = self._take()
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _NAMED.get(c) or frozenset([{"n": 10, "t": 9, "r": 13}.get(c, ord(c))])

    def _class(self) -> frozenset[int]:
        negate = self._peek() == "^"
        if negate:
            self._take()
        chars: set[int] = set()
        first = True
        while first or self._peek() != "]":
            first, c = False, self._take()
            one = self._escape() if c == "\\" else frozenset([ord(c)])
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self._take()
                c = self._take()
                end = self._escape() if c == "\\" else frozenset([ord(c)])
                one = frozenset(range(min(one), max(end) + 1))
            chars |= one
        self._take()
        return frozenset(range(256)) - chars if negate else frozenset(chars)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.owner: list[int] = [0]  # the pattern of each state

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Add ``tree`` after ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            step = self.state()
            self.empty[start].append(step)
            self.moves[step] = (tree[1], end)
            return end
        if kind == "cat":
            return reduce(lambda at, t: self.add(t, at), tree[1], start)
        end = self.state()
        if kind == "alt":
            for t in tree[1]:
                self.empty[self.add(t, start)].append(end)
            return end
        _, part, low, high = tree
        at = reduce(lambda at, _: self.add(part, at), range(low), start)
        if high is None:
            loop = self.state()
            if not low:  # the first round apart from the others, so that a start is told from what goes on
                self.empty[at].append(end)
                at = self.add(part, at)
            self.empty[at].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.add(part, at)
                self.empty[at].append(end)
        return end


class Automaton:
    """``step[state * 256 + byte]`` is the next state, ``accept[state]`` the bit mask of patterns that end there.

    ``open[state]`` is the bit mask of patterns of which a match may have begun: without a pattern's bit, no match of it
    that began before goes on. State 0 is the start. Without ``search`` a dead state exists, and ``dead`` is its number.
    """

    def __init__(self, patterns: list[str], search: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends = []
        for p in patterns:
            before = len(nfa.moves)
            ends.append(nfa.add(_Parser(p).parse(), start))
            nfa.owner += [len(ends) - 1] * (len(nfa.moves) - before)
        step, accept, begun = self._subsets(nfa, start, ends, search)
        self.step, self.accept, self.open = self._minimal(step, accept, begun)
        flat = self.step
        loops = [s for s in range(len(flat)) if not self.accept[s] and (flat[s] == s).all()]
        self.dead = loops[0] if loops else -1
        self.size = len(flat)
        self.step = np.ascontiguousarray(flat.reshape(-1).astype(np.int32))

    @staticmethod
    def _subsets(nfa: _Nfa, start: int, ends: list[int], search: bool):
        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for s in nfa.empty[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(s for s in seen if nfa.moves[s] or s in end_of)

        end_of = {e: i for i, e in enumerate(ends)}
        # bytes that no set tells apart move alike
        sets = list({m[0] for m in nfa.moves if m})
        kinds: dict[tuple[bool, ...], int] = {}
        of_byte = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        sample = [of_byte.index(k) for k in range(len(kinds))]
        first = closure([start])
        number, todo, rows = {first: 0}, [first], []
        while todo:
            now = todo.pop(0)
            row = []
            for b in sample:
                to = closure([nfa.moves[s][1] for s in now if nfa.moves[s] and b in nfa.moves[s][0]])
                to = to | first if search else to
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        accept, begun = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for states, n in number.items():
            accept[n] = sum(1 << end_of[s] for s in states if s in end_of)
            begun[n] = sum(1 << k for k in {nfa.owner[s] for s in states - first})
        return np.array(rows)[:, of_byte], accept, begun

    @staticmethod
    def _minimal(step: np.ndarray, accept: np.ndarray, begun: np.ndarray):
        """Partition refinement until no block splits; the start keeps number 0."""
        _, block = np.unique(np.column_stack([accept, begun]), axis=0, return_inverse=True)
        block = block.reshape(-1)
        while True:
            _, columns = np.unique(step, axis=1, return_index=True)
            _, finer = np.unique(np.column_stack([block, block[step[:, columns]]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        for n, b in enumerate(dict.fromkeys([block[0], *block])):
            order[b] = n
        block = order[block]
        _, members = np.unique(block, return_index=True)
        return block[step[members]], accept[members], begun[members]
