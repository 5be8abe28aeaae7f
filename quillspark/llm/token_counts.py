"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches.

A bounded sample of texts yields the frequent pre-tokens and their lengths in ids (at most ``TABLE_ENTRIES``, in a compact
hash table, so the broadcast is bounded whatever the input). A worker splits each chunk of text that it hasn't counted
yet into pre-tokens and looks them up; a miss is encoded by the library once for the worker's cache. No pre-token is
shuffled. The sample only decides what is looked up faster: counts are exact for every text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows with a null doc_id and repeated rows are
counted as they come; other columns are not read. A special string inside a text is one token, the library's default.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokenizing import ChunkCache, LengthTable, byte_level_chunks, byte_level_counter, load, pre_tokens

#: The sample: the first texts that a scan finds (of the first partitions only), and the characters read of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
TABLE_ENTRIES, TABLE_CHARS, LIMIT_TOKENS = 32_768, 32, 1024
SCHEMA = "id string, n_bytes long, n_tokens long, over_limit boolean"

_caches: dict[str, ChunkCache] = {}


def _special(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> LengthTable:
    """Lengths of the most frequent pre-tokens of at most ``sample_docs`` texts, at most ``entries`` of them."""
    rows = docs.where(F.col("text").isNotNull()).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).take(sample_docs)
    seen = Counter(t for r in rows for c in byte_level_chunks(r.text) for t in pre_tokens(c))
    frequent = [t for t, n in seen.most_common(entries) if n > 1 and len(t) <= TABLE_CHARS]
    return LengthTable(dict(zip(frequent, map(byte_level_counter(load(path)), frequent), strict=True)))


def count_tokens(docs: DataFrame, path: str, limit_tokens: int = LIMIT_TOKENS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        special = _special(tokenizer)
        cache = _caches.get(path)
        if cache is None:
            cache = _caches[path] = ChunkCache(byte_level_counter(tokenizer, table.value))

        def tokens(text: str) -> int:
            if any(s in text for s in special):
                return len(tokenizer.encode(text, add_special_tokens=False))
            return sum(cache.values_of(byte_level_chunks(text)))

        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            n = pd.Series([tokens(t) for t in texts], dtype="int64", index=pdf.index)
            yield pd.DataFrame({"id": pdf["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit_tokens})

    # an id passes through Python as a string: beside a null, pandas would make it a float
    counted = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(count, SCHEMA)
    return counted.select(F.col("id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
