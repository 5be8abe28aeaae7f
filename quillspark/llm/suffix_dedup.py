"""Exact substring dedup with suffix arrays by grouping construction.

Every byte goes that a ``LENGTH``-byte string covers which also starts earlier. To spread one suffix array over a
cluster, windows of that length are dealt out by their minimiser (least hash of the GRAM-byte strings inside), which
depends on their content alone: equal windows meet. Consecutive windows of one minimiser travel as one run. Hashes only
deal out; what repeats is read off suffix arrays (``grouping_sort``): neighbours that agree in LENGTH bytes.

1. Map: runs of each document, without text. Equal runs of one chunk (byte for byte) are combined: the first goes on, the
   others are covered, so a passage that a third of all documents share leaves each chunk once.
2. A run that is alone with its minimiser and holds it once can't repeat and is done. All others get their text: the runs of
   hot minimisers (below) in a second scan, which finds them again and shuffles no text, the rest by a join.
3. The runs of each minimiser are sorted, equal ones as one with all its places. Tasks read them in the order of the
   minimisers, a few MB at a time.
4. Covered spans are merged for each document.

A minimiser with more than ``HOT_RUNS`` runs is hot; there is at most one for each HOT_RUNS runs, so they are broadcast. It is first dealt out again, in rounds: a salt splits its runs into parts, each
part is sorted, what repeats there throughout goes, and the rest is dealt out under a longer key: the windows of a run
are halved by where the minimiser stands in them, and each half is known in more bytes around it (67, then 84, up to all
100, where every run under a key is the same window and a part keeps one). So no task holds more than some thousand runs.

Defined results: a null text counts as empty; rows with a null doc_id are returned whole and repeat nobody; rows that
repeat a doc_id with the same text are one document; with different texts they are different documents, of which the one
with the lesser hash of its text counts as the earlier; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small, with_text_id
from .grouping_sort import suffix_arrays

LENGTH, GRAM = 100, 32
LONGEST_RUN, CHUNK_BYTES, HOT_RUNS = 100, 1_500_000, 20_000
#: Text that a task sorts at a time; a minimiser's runs are not parted.
SORTED_BYTES = 3_000_000
HASHED_BYTES = 32_768
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = "key long, doc long, part long, start long, n int, twin boolean"
_TEXT_RUN = "key long, doc long, part long, start long, n int, at int, low int, high int, text binary"
_PLACE = ["key", "doc", "part", "start"]
_SPAN = "doc long, part long, start long, stop long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


def _join(a: np.ndarray, b: np.ndarray, length_a: int, length_b: int) -> np.ndarray:
    """Hashes of strings of length_a + length_b from those of both parts."""
    n = len(b) - length_a
    return a[:n] * _power(length_b) + b[length_a : length_a + n]


def _sliding(pick, x: np.ndarray, span: int) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``span`` neighbours."""
    wide = 1
    while 2 * wide <= span:
        x = pick(x[:-wide], x[wide:])
        wide *= 2
    return pick(x[: len(x) - (span - wide)], x[span - wide :]) if wide < span else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The gram hashes of ``window_hashes`` alone."""
    parts = []
    for a in range(0, max(1, len(data) - GRAM + 1), HASHED_BYTES):
        h = _BYTE[data[a : a + HASHED_BYTES + GRAM - 1]]
        for n in (1, 2, 4, 8, 16):
            h = _join(h, h, n, n)
        parts.append(_mixed(h))
    return np.concatenate(parts)


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least gram hash and content hash of each LENGTH-byte window of ``data``, and the gram hashes; in blocks that a cache holds."""
    parts = []
    for a in range(0, max(1, len(data) - LENGTH + 1), HASHED_BYTES):
        block = data[a : a + HASHED_BYTES + LENGTH - 1]
        h = {1: _BYTE[block]}
        for n in (1, 2, 4, 8, 16, 32):
            h[2 * n] = _join(h[n], h[n], n, n)
        grams = _mixed(h[GRAM])
        content = _join(_join(h[64], h[32], 64, 32), h[4], 96, 4)
        last = a + HASHED_BYTES + LENGTH - 1 >= len(data)
        parts.append((_sliding(np.minimum, grams, LENGTH - GRAM + 1), content, grams if last else grams[:HASHED_BYTES]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _twins(least: np.ndarray, grams: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a run holds its minimiser twice, so that a window may repeat within it."""
    span = LENGTH - GRAM
    edge = np.zeros(span, np.uint64)
    places = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), span + 1) == grams)
    pair = np.flatnonzero((grams[places[1:]] == grams[places[:-1]]) & (places[1:] - places[:-1] < LENGTH))
    a, b = places[pair], places[pair + 1]
    out = np.zeros(len(first), bool)
    for k in range(2):  # the last two runs that begin at or before the first of the pair, for runs cut at their longest
        run = np.searchsorted(first, a, side="right") - 1 - k
        fits = (run >= 0) & (b <= first[run] + n[run] - 1 + span)
        out[run[fits]] = True
    return out


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each entry, ``count`` of them."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _repeats(group: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of each window of the runs that equals an earlier one of its group, in order.

    Runs come by group, and in it in the order that says what is earlier. Equal runs enter the group's suffix array once:
    the first stands for all, and all windows of the others repeat.
    """
    seen: set[tuple[int, bytes]] = set()
    copy = np.zeros(len(texts), bool)
    for k, entry in enumerate(zip(group.tolist(), texts, strict=True)):
        if entry in seen:
            copy[k] = True
        else:
            seen.add(entry)
    own = np.flatnonzero(~copy)
    run, window = _sorted_repeats(group[own], n[own], [texts[k] for k in own.tolist()])
    count = n[copy].astype(np.int64)
    run = np.concatenate([own[run], np.repeat(np.flatnonzero(copy), count)])
    window = np.concatenate([window, _ragged(np.zeros(len(count), np.int64), count)])
    order = np.argsort(run, kind="stable")
    return run[order], window[order]


def _sorted_repeats(group: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``_repeats`` of different runs, read off the suffix array of each group."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    new = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.cumsum(size + 1 + new) - size - 1  # a guard before each group, a separator after each run
    data = np.zeros(int(at[-1] + size[-1]) + 1, np.uint8)
    data[_ragged(at, size)] = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.flatnonzero(new)
    order = suffix_arrays(data, at[begins], np.add.reduceat(size + 1, begins))
    run_at = np.full(len(data), -1, np.int64)
    run_at[_ragged(at, n.astype(np.int64))] = np.repeat(np.arange(len(n)), n)
    order = order[order >= 0]
    order = order[run_at[order] >= 0]
    of_group = (np.cumsum(new) - 1)[run_at[order]]
    words = np.zeros(len(data), np.uint64)  # eight bytes from each place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    equal = np.flatnonzero(of_group[1:] == of_group[:-1])
    for k in (LENGTH - 8, *range(0, LENGTH - 8, 8)):
        equal = equal[words[order[equal] + k] == words[order[equal + 1] + k]]
    first = np.ones(len(order), bool)
    first[equal + 1] = False
    begins = np.flatnonzero(first)
    earliest = np.repeat(np.minimum.reduceat(order, begins), np.diff(np.concatenate([begins, [len(order)]])))
    later = np.sort(order[order != earliest])
    run = run_at[later]
    return run, later - at[run]


def _spans(run: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged (run, begin, end) of repeated windows, which come in order."""
    if not len(run):
        return run, window, window
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (window[1:] > window[:-1] + LENGTH)])
    last = np.concatenate([new[1:], [True]])
    return run[new], window[new], window[last] + LENGTH


def _once(*columns: np.ndarray) -> np.ndarray:
    """Which of sorted entries differ from the one before: a document in several rows brings each run several times."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, (x[1:] != x[:-1] for x in columns))
    return new


def _runs(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> pd.DataFrame:
    """Runs of a chunk of pieces of documents, equal ones once; the copies leave as spans (n < 0: minus their length).

    ``at`` is where a run begins in the joined pieces (-1 for spans).
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = b"".join(pieces)
    least, content, grams = window_hashes(np.frombuffer(data, np.uint8))
    begin = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(least)]
    at = np.arange(len(least))
    valid = at + LENGTH <= (begin + lengths)[piece]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])])
    first = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - first) % LONGEST_RUN == 0
    first = np.flatnonzero(new & valid)
    n_valid = np.concatenate([[0], np.cumsum(valid)])
    stop = np.concatenate([np.flatnonzero(new), [len(least)]])
    stop = stop[np.searchsorted(stop, first, side="right")]
    n = n_valid[stop] - n_valid[first]
    key, c = least[first], _mixed(content[first] * _BASE + _mixed(content[first + n - 1]) + n.astype(np.uint64))
    twin = _twins(least, grams, first, n)
    doc, part, start = docs[piece[first]], parts[piece[first]], starts[piece[first]] + first - begin[piece[first]]
    order = np.lexsort([start, part, doc, c, key])
    own = _once(*(x[order] for x in (key, doc, part, start)))
    key, c, doc, part, start, n, first, twin = (x[order][own] for x in (key, c, doc, part, start, n, first, twin))
    alike = np.concatenate([[False], (c[1:] == c[:-1]) & (key[1:] == key[:-1]), [False]])
    some = np.flatnonzero(alike[1:] | alike[:-1])
    kept = np.ones(len(key), bool)
    stem = b""  # the first of the runs that are alike
    for k, a, count, again in zip(some.tolist(), first[some].tolist(), n[some].tolist(), alike[:-1][some].tolist(), strict=True):
        text = data[a : a + count + LENGTH - 1]
        if not again:
            stem = text
        elif text == stem:
            kept[k] = False
    run = np.flatnonzero(~kept)
    run = run[np.lexsort([start[run], part[run], doc[run]])]  # runs of a document end in the order in which they begin
    stop = start[run] + n[run] + LENGTH - 1
    new = np.concatenate([[True], (doc[run][1:] != doc[run][:-1]) | (part[run][1:] != part[run][:-1]) | (start[run][1:] > stop[:-1])])[: len(run)]
    stop = stop[np.concatenate([new[1:], [True]])[: len(run)]]
    run = run[new]
    return pd.DataFrame(
        {
            "key": np.concatenate([key[kept], _mixed(key[run] + run.astype(np.uint64))]).view("i8"),
            "doc": np.concatenate([doc[kept], doc[run]]),
            "part": np.concatenate([part[kept], part[run]]),
            "start": np.concatenate([start[kept], start[run]]),
            "n": np.concatenate([n[kept], start[run] - stop]).astype("i4"),
            "twin": np.concatenate([twin[kept], np.zeros(len(run), bool)]),
            "at": np.concatenate([first[kept], np.full(len(run), -1)]),
        }
    )


_Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]


def _chunks(pieces: Iterator[tuple[int, int, int, bytes]]) -> Iterator[_Chunk]:
    """Pieces of documents (doc, part, start and bytes), about CHUNK_BYTES at a time."""
    held, size = [], 0

    def chunk() -> _Chunk:
        docs, parts, starts, data = zip(*held, strict=True)
        return np.array(docs, np.int64), np.array(parts, np.int64), np.array(starts, np.int64), list(data)

    for piece in pieces:
        held.append(piece)
        size += len(piece[3])
        if size >= CHUNK_BYTES:
            yield chunk()
            held, size = [], 0
    if held:
        yield chunk()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int, bytes]]:
    for pdf in batches:
        for doc_id, part, text in zip(pdf["doc_id"], pdf["part"], pdf["text"], strict=True):
            data = (text or "").encode()
            for a in range(0, max(0, len(data) - LENGTH + 1), CHUNK_BYTES):
                yield doc_id, part, a, data[a : a + CHUNK_BYTES + LENGTH - 1]


def _find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for chunk in _chunks(_pieces(batches)):
        yield _runs(*chunk).drop(columns="at")


class _Hot:
    """Minimisers, looked up by their low bits first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.low = np.zeros(1 << 16, bool)
        self.low[self.keys & np.uint64(0xFFFF)] = True

    def holds(self, x: np.ndarray) -> np.ndarray:
        return self.keys[np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)] == x

    def places(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.low[x & np.uint64(0xFFFF)])
        return at[self.holds(x[at])]


def _stretches(hot: _Hot, docs: np.ndarray, parts: np.ndarray, starts: np.ndarray, pieces: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """The bytes of all windows that hold a gram of ``hot``: each such window lies whole in one stretch."""
    length = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(length) - length
    data = b"".join(pieces)
    at = hot.places(gram_hashes(np.frombuffer(data, np.uint8)))
    piece = np.searchsorted(begin, at, side="right") - 1
    inside = at + GRAM <= (begin + length)[piece]
    at, piece = at[inside], piece[inside]
    low, high = np.maximum(at - (LENGTH - GRAM), begin[piece]), np.minimum(at + LENGTH, (begin + length)[piece])
    new = np.ones(len(at), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (low[1:] > high[:-1] - LENGTH + 1)  # windows that follow each other stay together
    last = np.ones(len(at), bool)
    last[:-1] = new[1:]
    low, high, piece = low[new], high[last], piece[new]
    for doc, part, start, a, b in zip(docs[piece].tolist(), parts[piece].tolist(), (starts[piece] + low - begin[piece]).tolist(), low.tolist(), high.tolist(), strict=True):
        yield doc, part, start, data[a:b]


def _hot_runs(batches: Iterator[pd.DataFrame], hot: _Hot) -> Iterator[pd.DataFrame]:
    """The runs of hot minimisers with their text, equal ones of a chunk once, and the others as spans (n < 0)."""
    near = (s for chunk in _chunks(_pieces(batches)) for s in _stretches(hot, *chunk))
    for chunk in _chunks(near):
        runs, data = _runs(*chunk), b"".join(chunk[3])
        runs = runs[(runs["n"].to_numpy() < 0) | hot.holds(runs["key"].to_numpy().view("u8"))]
        run = runs["n"].to_numpy() > 0
        texts = [data[a : a + n + LENGTH - 1] if n > 0 else b"" for a, n in zip(runs["at"].tolist(), runs["n"].tolist(), strict=True)]
        yield runs.drop(columns="twin").assign(at=-1, low=0, high=np.where(run, LENGTH - GRAM + 1, 0), text=texts)


def _with_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of each document with their text; of equal ones in a batch the first, and the others as spans (n < 0)."""
    for pdf in batches:
        found: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        doc_of, part_of, start_of, length_of = [], [], [], []
        for doc, part, text, runs in zip(pdf["doc_id"], pdf["part"], pdf["text"], pdf["runs"], strict=True):
            if runs is None:
                continue
            data = (text or "").encode()
            for r in runs:
                start, n = r["start"], r["n"]
                place = (doc, part, start, n)
                entry = (r["key"], data[start : start + n + LENGTH - 1])
                before = found.setdefault(entry, place)
                if before != place:
                    if place < before:
                        found[entry], place = place, before
                    doc_of.append(place[0])
                    part_of.append(place[1])
                    start_of.append(place[2])
                    length_of.append(-(n + LENGTH - 1))
        rows = [(key, *place, text) for (key, text), place in found.items()]
        yield pd.DataFrame(rows, columns=["key", "doc", "part", "start", "n", "text"]).assign(at=-1, low=0, high=LENGTH - GRAM + 1)
        covered = pd.DataFrame({"doc": doc_of, "part": part_of, "start": start_of, "n": length_of}, dtype=np.int64)
        yield covered.assign(key=_mixed(covered["start"].to_numpy(np.int64).view(np.uint64) + covered["doc"].to_numpy(np.int64).view(np.uint64)).view(np.int64), at=-1, low=0, high=0, text=b"")


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, some MB at a time, no group parted."""
    held, size = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += int(pdf["text"].map(len).sum()) + 8 * len(pdf)
        if size >= SORTED_BYTES:
            both = pd.concat(held, ignore_index=True)
            differs = np.zeros(len(both) - 1, bool)
            for k in keys:
                v = both[k].to_numpy()
                differs |= v[1:] != v[:-1]
            edges = np.flatnonzero(differs)
            if len(edges):
                yield both.iloc[: edges[-1] + 1]
                both = both.iloc[edges[-1] + 1 :]
            held, size = [both], int(both["text"].map(len).sum())
    if held:
        yield pd.concat(held, ignore_index=True)


def _numbers(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), np.int64)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _sort_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _by_group(batches, ["key"]):
        covered = pdf[pdf["n"] < 0]
        yield covered[["doc", "part", "start"]].assign(stop=covered["start"] - covered["n"])
        pdf = pdf[pdf["n"] > 0]
        pdf = pdf[_once(*(pdf[k].to_numpy() for k in _PLACE))]
        if not len(pdf):
            continue
        run, low, high = _spans(*_repeats(_numbers(pdf, ["key"]), pdf["n"].to_numpy(), pdf["text"].tolist()))
        start = pdf["start"].to_numpy()[run]
        yield pd.DataFrame({"doc": pdf["doc"].to_numpy()[run], "part": pdf["part"].to_numpy()[run], "start": start + low, "stop": start + high})


def _halves(key: int, n: int, at: int, low: int, high: int, text: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """(key, first window, n, at, low, high) of the parts of a run under longer keys.

    ``at`` is the minimiser's place in the run (-1: not looked for yet), ``low <= at - window < high`` for its windows;
    all windows of such a range share the bytes from ``at - low`` to ``at - high + LENGTH + 1``.
    """
    if at < 0:  # each window under the first minimiser in it
        _, _, grams = window_hashes(np.frombuffer(text, np.uint8))
        places = np.flatnonzero(grams == np.array([key], np.int64).view(np.uint64)[0])
        own = places[np.searchsorted(places, np.arange(n))]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
        runs = [(a, b - a, int(own[a]) - a) for a, b in zip(edges, edges[1:], strict=False)]
    else:
        runs = [(0, n, at)]
    middle = (low + high) // 2
    out = []
    for a, k, place in runs:
        cut = min(max(place - middle + 1, 0), k)  # windows before it have the minimiser at ``middle`` or later
        for w, count, lo, hi in ((a, cut, middle, high), (a + cut, k - cut, low, middle)):
            if count and hi > lo:
                p = place - (w - a)
                known = text[w + p - lo : w + p - hi + LENGTH + 1]
                digest = hashlib.blake2b(known, digest_size=8, salt=lo.to_bytes(4, "big") + hi.to_bytes(4, "big")).digest()
                out.append((int.from_bytes(digest, "big", signed=True), w, count, p, lo, hi))
    return out


def _sort_and_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One round for the parts of hot keys: spans (n < 0), and what is left under longer keys."""
    for pdf in _by_group(batches, ["key", "salt"]):
        pdf = pdf[_once(*(pdf[k].to_numpy() for k in _PLACE))]
        n, texts = pdf["n"].to_numpy(), pdf["text"].tolist()
        run, window = _repeats(_numbers(pdf, ["key", "salt"]), n, texts)
        whole = np.bincount(run, minlength=len(n)) == n
        rows, records = [], list(pdf[["key", "doc", "part", "start", "n", "at", "low", "high"]].itertuples(index=False, name=None))
        for k, a, b in zip(*(x.tolist() for x in _spans(run, window)), strict=True):
            key, doc, part, start = records[k][:4]
            rows.append((key, doc, part, start + a, a - b, -1, 0, 0, b""))
        for k in np.flatnonzero(~whole).tolist():
            key, doc, part, start, count, at, low, high = records[k]
            if high - low == 1:
                rows.append((*records[k], texts[k]))
                continue
            for new, w, c, p, lo, hi in _halves(key, count, at, low, high, texts[k]):
                rows.append((new, doc, part, start + w, c, p, lo, hi, texts[k][w : w + c + LENGTH - 1]))
        yield pd.DataFrame(rows, columns=["key", "doc", "part", "start", "n", "at", "low", "high", "text"])


def _deal_hot(runs: DataFrame, spans: list[DataFrame]) -> DataFrame:
    """``runs`` of hot keys, dealt out until no key has more than ``HOT_RUNS``; what is covered on the way goes to ``spans``."""
    while True:
        hot = cut_lineage(runs.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT_RUNS))
        if hot.isEmpty():
            return runs
        hot = small(hot)
        salted = runs.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("doc", "part", "start"), F.ceil(F.col("m") * 2 / HOT_RUNS)).cast("int")).drop("m")
        done = cut_lineage(salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "part", "start").mapInPandas(_sort_and_split, _TEXT_RUN))
        spans.append(done.where("n < 0").select("doc", "part", "start", (F.col("start") - F.col("n")).alias("stop")))
        runs = cut_lineage(runs.join(hot.select("key"), "key", "left_anti").unionByName(done.where("n > 0")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (start and end of removed bytes, merged) for each row of ``docs``."""
    texts = with_text_id(docs)
    runs = texts.where("doc_id IS NOT NULL").mapInPandas(_find_runs, _RUN)
    counted = runs.withColumn("m", F.count("*").over(Window.partitionBy("key")))
    settled = cut_lineage(counted.where("n < 0 OR m > 1 OR twin").select("key", "doc", "part", "start", "n", (F.col("m") > HOT_RUNS).alias("hot")))

    listed = settled.where("n > 0 AND NOT hot").groupBy(F.col("doc").alias("d"), F.col("part").alias("p")).agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))
    joined = texts.join(listed, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p")), "left")  # as below, so that the texts are shuffled once
    spans = [settled.where("n < 0").select("doc", "part", "start", (F.col("start") - F.col("n")).alias("stop"))]
    sets = [joined.select("doc_id", "part", F.when(F.col("runs").isNotNull(), F.col("text")).alias("text"), "runs").mapInPandas(_with_text, _TEXT_RUN)]
    keys = [r.key for r in settled.where("n > 0 AND hot").select("key").distinct().toLocalIterator()]
    if keys:
        shared = docs.sparkSession.sparkContext.broadcast(_Hot(np.array(keys, np.int64).view(np.uint64)))
        hot = cut_lineage(texts.where("doc_id IS NOT NULL").mapInPandas(lambda batches: _hot_runs(batches, shared.value), _TEXT_RUN))
        spans.append(hot.where("n < 0").select("doc", "part", "start", (F.col("start") - F.col("n")).alias("stop")))
        sets.append(_deal_hot(hot.where("n > 0"), spans))
    spans += [x.repartition("key").sortWithinPartitions("key", "doc", "part", "start").mapInPandas(_sort_runs, _SPAN) for x in sets]
    listed = reduce(DataFrame.unionByName, spans).groupBy(F.col("doc").alias("d"), F.col("part").alias("p")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(listed, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p")), "left").select("doc_id", "text", "spans")


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``data`` without ``spans``, and how many they are once merged."""
    kept, at, n = [], 0, 0
    for a, b in sorted(spans):
        if not n or a > at:
            n += 1
            kept.append(data[at:a])
        at = max(at, b)
    return b"".join([*kept, data[at:]]), n


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; ``with_kept`` adds the remaining bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                data = (text or "").encode()
                kept, n_spans = _cut(data, [] if spans is None else [(s["start"], s["stop"]) for s in spans])
                row = (doc, len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_kept else row)
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    schema = "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    # an id passes through Python as a string: beside a null, pandas would make it a float
    found = repeated_spans(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans").mapInPandas(run, schema)
    return found.select(F.col("id").cast("long").alias("doc_id"), *found.columns[1:])
