"""Secret scan: all rules in one combined deterministic automaton, one byte pass over each text.

The rules' regexes become one minimal automaton (``automata``). A pass advances many pieces of texts side by side, one byte
of each at a time, by one gather from the transition array, and keeps the state after each byte. The states say for each
rule where a match may have begun and where one ends: a stretch of bytes in which a rule is open and that holds an end
has its spans, all others have none. In a stretch, an exact check cuts the leftmost, longest, non-overlapping matches.
Long texts are cut into pieces of ``PIECE`` bytes that run at the same time; a piece that was begun in another state than
the one before it ended in is run again from there until both runs agree. The job is map-only.

Defined results: a null text counts as empty (no spans); rows with a null doc_id and repeated rows are scanned as they
come; an empty table gives no rows; other columns are not read. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import bound_batches

#: Bytes of a pass, and of a piece of a text.
BATCH_BYTES, PIECE = 8_000_000, 4096


@dataclass(frozen=True)
class Rule:
    """``shortest`` is the least length of a match, or of what follows ``head`` in it; shorter matches are dropped."""

    kind: str
    pattern: str
    shortest: int
    head: str = ""
    base: bool = False


_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", 12, _ASSIGN_HEAD, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", "[0-9a-f]{16,}", 16, base=True),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]+", 24),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], search=True)
        self.match = [Automaton([r.pattern]) for r in rules]
        self.heads = [Automaton([r.head]) if r.head else None for r in rules]

    def states(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The state after each byte of the texts that begin at ``starts`` and lie one behind the other: one pass."""
        ends = np.append(starts[1:], len(data))
        pieces = np.maximum(-(-(ends - starts) // PIECE), 1)
        of = np.repeat(np.arange(len(starts)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[of] + number * PIECE
        length = np.minimum(ends[of] - first, PIECE)
        out = np.zeros(len(data), np.uint16 if self.all.size <= 1 << 16 else np.int32)
        order = np.argsort(-length, kind="stable")
        self._advance(data, out, first[order], length[order], np.zeros(len(of), np.int64), False)
        follows = np.flatnonzero(number > 0)
        known = np.zeros(len(of), np.int64)  # the state in which each piece was begun
        while True:
            begun = out[first[follows] - 1].astype(np.int64)
            wrong = np.flatnonzero(begun != known[follows])
            if not len(wrong):
                return out
            again = follows[wrong]
            known[again] = begun[wrong]
            self._advance(data, out, first[again], length[again], begun[wrong], True)

    def _advance(self, data: np.ndarray, out: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray, until_same: bool) -> None:
        """Run pieces side by side, longest first, from ``state``; ``until_same``: each until ``out`` has its state already."""
        step = self.all.step
        if not until_same:
            live = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
            for t, n in enumerate(live.tolist()):
                at = first[:n] + t
                s = step[(state[:n] << 8) | data[at]]
                state[:n] = s
                out[at] = s
            return
        t = 0
        while len(first):
            at = first + t
            state = step[(state << 8) | data[at]].astype(np.int64)
            t += 1
            going = (out[at] != state) & (length > t)
            out[at] = state
            first, length, state = first[going], length[going], state[going]

    @staticmethod
    def _longest(machine: Automaton, data: bytes, at: int) -> int:
        """End of the longest match of ``machine`` from ``at``, or -1."""
        step, accept, state, end = machine.step, machine.accept, 0, -1
        for i in range(at, len(data)):
            state = step[(state << 8) | data[i]]
            if state == machine.dead:
                break
            if accept[state]:
                end = i + 1
        return end

    def _cut(self, k: int, data: bytes) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping byte spans of rule ``k`` in a stretch."""
        rule, head, out, at = self.rules[k], self.heads[k], [], 0
        while at < len(data):
            end = self._longest(self.match[k], data, at)
            if end < 0:
                at += 1
                continue
            if end - (self._longest(head, data, at) if head else at) >= rule.shortest:
                out.append((at, end))
            at = end
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, end, rule) in code points, by start, then rule."""
        raw = [t.encode() for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        filled = np.flatnonzero(size)
        if not len(filled):
            return out
        joined = b"".join(raw)
        starts = (np.cumsum(size) - size)[filled]
        state = self.states(np.frombuffer(joined, np.uint8), starts)
        begins = np.zeros(len(joined), bool)
        begins[starts] = True
        for k in range(len(self.rules)):
            hits = np.flatnonzero((self.all.accept >> k & 1).astype(bool)[state])
            if not len(hits):
                continue
            # a stretch ends where the rule is not open, and at the end of its text
            opened = (self.all.open >> k & 1).astype(bool)[state]
            edge = np.flatnonzero(~opened | begins)  # in a text's first byte nothing goes on
            low = edge[np.searchsorted(edge, hits, side="right") - 1]
            low = np.where(opened[low], low, low + 1)
            later = np.append(edge, len(joined))[np.searchsorted(edge, hits, side="right")]
            for a, b in np.unique(np.column_stack([low, later]), axis=0).tolist():
                t = int(filled[np.searchsorted(starts, a, side="right") - 1])
                base = int(starts[np.searchsorted(starts, a, side="right") - 1])
                out[t] += [(a - base + x, a - base + y, k) for x, y in self._cut(k, joined[a:b])]
        for t, spans in enumerate(out):
            if spans and len(raw[t]) != len(texts[t]):
                first = np.concatenate([[0], np.cumsum((np.frombuffer(raw[t], np.uint8) & 0xC0) != 0x80)])
                spans[:] = [(int(first[a]), int(first[b]), k) for a, b, k in spans]
            spans.sort(key=lambda s: (s[0], s[2]))
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner_for(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SCHEMA = "id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs``: counts of the base kinds, their digest, and all spans as kind:start:end.

    The driver compiles the rules once; what it broadcasts depends on the rules alone (some MB).
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner_for(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = shared.value
        name = [r.kind for r in rules]
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            rows, first = [], 0
            while first < len(texts):  # several passes of bounded size
                size, last = 0, first
                while last < len(texts) and (size == 0 or size + len(texts[last]) <= BATCH_BYTES):
                    size += len(texts[last])
                    last += 1
                for spans in scanner.scan(texts[first:last]):
                    said = [f"{name[k]}:{a}:{b}" for a, b, k in spans]
                    base = [x for x, (_, _, k) in zip(said, spans, strict=True) if rules[k].base]
                    counts = [sum(name[k] == kind for _, _, k in spans) for kind in ("assign", "access", "hex")]
                    rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)))
                first = last
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "id", pdf["doc_id"].to_numpy())
            yield out

    # an id passes through Python as a string: beside a null, pandas would make it a float
    scanned = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
    return scanned.select(F.col("id").cast("long").alias("doc_id"), *scanned.columns[1:])
