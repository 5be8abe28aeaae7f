"""Benchmark decontamination: an FM-index for each training shard, searched backwards for the test phrases.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). A shard is a run of whole
documents of one scan partition, about ``SHARD_BYTES`` of text; all its words are in its index, numbered by the shard's own
vocabulary. All windows are searched together, each occurrence is located by sampled suffix positions, and occurrences
merge into removal spans. The job is map-only; only the benchmark is broadcast, in blocks of at most ``BLOCK_CHARS``
characters on average. A shard is indexed once and searched for the windows of every block, one block after the other, so
the number of blocks changes no result.

Defined results: a null or empty text has no words, a null item no windows; rows with a null doc_id and repeated rows are
searched as they come, each alone; other columns are not read, and pass through ``without_phrases`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, give_back, keep_only
from .fm_index import FMIndex

WINDOW, SHARD_BYTES, BLOCK_CHARS = 10, 4_000_000, 32_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "n_words long, spans array<array<int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of one block of items, as word numbers from 1."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.word: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in words_of(text)]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                pairs.add((number.setdefault(tuple(ids[a : a + window]), len(number)), k))
        of_length: dict[int, list[tuple[int, ...]]] = {}
        for w in number:
            of_length.setdefault(len(w), []).append(w)
        #: For each length: the windows, and the number of each.
        self.groups = [(n, np.array(ws, np.int64), np.array([number[w] for w in ws])) for n, ws in sorted(of_length.items())]
        owned = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.owner = owned[:, 1]
        self.owner_from = np.searchsorted(owned[:, 0], np.arange(len(number) + 1))


def search_shard(words: list[list[bytes]], blocks: list[Phrases]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document its merged spans of hit words (end exclusive) and the items found in it."""
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in words]
    number: dict[bytes, int] = {}
    runs = [np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int64, len(ws)) for ws in words]
    if not number or not any(p.groups for p in blocks):
        return out
    index = FMIndex(runs)
    found, base = [], 0
    for phrases in blocks:
        of_word = np.zeros(len(phrases.word) + 1, np.int64)  # 0: not in this shard
        for w, k in phrases.word.items():
            of_word[k] = number.get(w, 0)
        for n, windows, window_number in phrases.groups:
            windows = of_word[windows]
            here = np.flatnonzero((windows > 0).all(axis=1))
            first, last = index.search(windows[here])
            hit = np.flatnonzero(last > first)
            count = (last - first)[hit]
            if len(hit):
                rows = np.repeat(first[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = index.locate(rows)
                run = np.searchsorted(index.starts, at, side="right") - 1
                start = at - index.starts[run]
                found.append(np.column_stack([run, start, start + n, base + np.repeat(window_number[here][hit], count)]))
        base += len(phrases.owner_from) - 1
    if not found:
        return out
    found = np.concatenate(found)
    found = found[np.lexsort([found[:, 1], found[:, 0]])]
    bounds = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
    bases = np.cumsum([0] + [len(p.owner_from) - 1 for p in blocks])
    for a, b in zip(bounds, [*bounds[1:], len(found)], strict=True):
        spans, items = out[found[a, 0]]
        for _, start, end, _ in found[a:b].tolist():
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        for w in np.unique(found[a:b, 3]).tolist():
            k = int(np.searchsorted(bases, w, side="right")) - 1
            p, w = blocks[k], w - int(bases[k])
            items.update(p.items[i] for i in p.owner[p.owner_from[w] : p.owner_from[w + 1]])
    return out


def _block_count(benchmark: DataFrame) -> int:
    total = benchmark.agg(F.sum(F.length(F.col("text")))).first()[0] or 0
    return max(1, -(-total // BLOCK_CHARS))


def _blocks(benchmark: DataFrame, window: int, n: int) -> Iterator[Phrases]:
    """Phrases of ``n`` blocks of items: each is collected alone, and its size is bounded by ``BLOCK_CHARS`` on average."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield Phrases([(r.i, r.t) for r in block.toLocalIterator()], window)


def _shared_blocks(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """A broadcast for each block of items: the driver holds one block at a time, a worker those that it has read."""
    bound_batches(benchmark.sparkSession)
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(p) for p in _blocks(benchmark, window, _block_count(benchmark))]


def _shards(batches: Iterator[pd.Series]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, a shard at a time."""
    keep_only()
    words: list[list[bytes]] = []
    size = 0
    for texts in batches:
        for text in texts:
            words.append(words_of(text))
            size += len(text or "")
            if size >= SHARD_BYTES:
                yield words
                words, size = [], 0
    if words:  # a frame without rows has no type for its lists
        yield words
    words = []
    give_back()


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (word numbers, end exclusive) and items, for each row of ``docs``. Only texts go to Python."""
    shared = _shared_blocks(benchmark, window)

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in _shards(batches):
            found = search_shard(words, [b.value for b in shared])
            yield pd.DataFrame({"n_words": np.fromiter(map(len, words), np.int64, len(words)), "spans": [s for s, _ in found], "items": [sorted(i) for _, i in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), search("text").alias("f")).select("doc_id", "f.*")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find_spans(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _cut(text: str, spans: list) -> tuple[str, bool]:
    """The text without the spans of its words, and whether a word is left."""
    data, at, out = text.encode(), 0, []
    places = [m.span() for m in _WORD.finditer(data)]
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode(), sum(b - a for a, b in spans) < len(places)


def without_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with each removal span cut from the text, from its first word to its last.

    All columns stay; ``n_chars`` follows the text. A text that loses its last word is dropped, others are kept.
    """
    shared = _shared_blocks(benchmark, window)

    @F.pandas_udf("text string, hit boolean, stays boolean")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        texts: list[str | None] = []

        def noted() -> Iterator[pd.Series]:
            for batch in batches:
                texts.extend(batch)
                yield batch

        for words in _shards(noted()):
            own = texts[: len(words)]
            del texts[: len(words)]
            spans = [s for s, _ in search_shard(words, [b.value for b in shared])]
            done = [_cut(t, s) if s else (t, True) for t, s in zip(own, spans, strict=True)]
            yield pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "hit": [bool(s) for s in spans], "stays": [k for _, k in done]})

    name = free_name(docs, "cut")
    cut = cut.asNondeterministic()  # else the filter moves below and cuts every text a second time, in workers of its own
    found = docs.withColumn(name, cut("text")).where(F.col(name)["stays"])

    def column(c: str) -> Column:
        if c == "text":
            return F.col(name)["text"].alias(c)
        if c == "n_chars":
            return F.when(F.col(name)["hit"], F.length(F.col(name)["text"])).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return found.select(*map(column, docs.columns))
