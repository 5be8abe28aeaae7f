"""Cost-balanced packing of documents into sequences of at most ``SEQUENCE`` tokens.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections and attention inside the piece). Each scan
partition packs its own documents as they stream by, in shards of bounded size: pieces in descending length go to the
lowest-cost sequence with room; one that fits nowhere is cut over the cheapest sequences with room left. A shard opens
only as many sequences as it fills, the rest is carried into the next one, and the last rest of a partition is cut into
sequences whose lengths are powers of two, which need no padding. The job is map-only: nothing is shuffled, memory is
bounded by a shard, and a lost task repeats its partition alone with the same result.

Defined results: a null or empty text is the closing id alone; rows with a null doc_id and repeated rows are packed like
others; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, keep_only
from .tokenizing import load, word_cache

SEQUENCE, CLOSING_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SHARD_TOKENS = 4_000_000
SCHEMA = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def balance(pieces: list[tuple[int, int, int]], size: int = SEQUENCE) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """pieces (document, start, length) -> full sequences, and the pieces that fill none."""
    whole: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []
    for doc, start, length in pieces:
        while length >= size:
            whole.append([(doc, start, size)])
            start, length = start + size, length - size
        if length:
            pool.append((doc, start, length))
    n = sum(p[2] for p in pool) // size
    if not n:
        return whole, pool
    pool.sort(key=lambda p: (-p[2], p[0], p[1]))
    room, paid, bins, rest = np.full(n, size), np.zeros(n), [[] for _ in range(n)], []
    for doc, start, length in pool:
        fits = np.where(room >= length, paid, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:  # cut it over the cheapest sequences that have room
            while length and room.any():
                b = int(np.where(room > 0, paid, np.inf).argmin())
                part = min(length, int(room[b]))
                bins[b].append((doc, start, part))
                room[b] -= part
                paid[b] += cost(part)
                start, length = start + part, length - part
            if length:
                rest.append((doc, start, length))
            continue
        bins[b].append((doc, start, length))
        room[b] -= length
        paid[b] += cost(length)
    return whole + bins, rest


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, largest first."""
    left, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            doc, start, length = pieces.pop()
            part = min(want, length)
            out[-1].append((doc, start, part))
            want -= part
            if part < length:
                pieces.append((doc, start + part, length - part))
    return out


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the piece's ids (array<int>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = keep_only(f"ids {path}", lambda: word_cache(load(path)))
        closing = CLOSING_ID.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        kept: dict[int, tuple[object, bytes]] = {}  # the shard's documents
        pieces: list[tuple[int, int, int]] = []
        waiting = number = 0

        def rows(sequences) -> pd.DataFrame:
            nonlocal sequence
            out = []
            for s in sequences:
                offset = 0
                for k, start, length in s:
                    doc_id, ids = kept[k]
                    part = memoryview(ids)[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset)
                    out.append((*row, np.frombuffer(part, "<u4").astype("i4")) if with_ids else row)
                    offset += length
                sequence += 1
            return pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = b"".join(encoder.values_of((text or "").encode().split())) + closing
                kept[number] = (doc_id, ids)
                pieces.append((number, 0, len(ids) // 4))
                waiting += len(ids) // 4
                number += 1
                if waiting >= shard_tokens:
                    sequences, pieces = balance(pieces, size)
                    yield rows(sequences)
                    waiting = sum(p[2] for p in pieces)
                    kept = {k: kept[k] for k in {p[0] for p in pieces}}
        sequences, pieces = balance(pieces, size)
        yield rows(sequences + powers(pieces))
        kept = {}
        give_back()

    bound_batches(docs.sparkSession)
    # an id passes through Python as a string: beside a null, pandas would make it a float
    packed = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA + ", ids array<int>" * with_ids)
    return packed.select(F.col("id").cast("long").alias("doc_id"), *packed.columns[1:])
