"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. Without one, a cluster is refused: its executors and driver share
    no other folder. A single-process session (``local[...]``) uses a folder in its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch on its way to Python, for texts that can be long. Spark's own bounds (10 000 rows, 64 MB
#: or more) let two workers and their batches outgrow a small executor.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to these bounds; lower ones stay as they are. Results don't depend on it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "").removesuffix("b")  # Spark writes bytes as 67108864b
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: What adaptive execution merges small shuffle partitions up to. With Spark's 64 MB, a task fetches blocks of over 2 MB where
#: mappers are few, and these are memory-mapped beside the heap until a collection.
MERGED_BYTES = 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def bound_reads(spark: SparkSession) -> None:
    """Lower what adaptive execution merges to ``MERGED_BYTES``; a lower setting stays. Results don't depend on it."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = (spark.conf.get(key, None) or "").strip().lower()
    digits = now.rstrip("bkmg")
    if not digits.isdigit() or int(digits) * _UNITS.get(now[len(digits) :], MERGED_BYTES) > MERGED_BYTES:
        spark.conf.set(key, str(MERGED_BYTES))


def give_back() -> None:
    """At the end of a Python task: free memory goes back to the system, as the worker stays for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_kept: dict[str, Any] = {}


def keep_only(name: str | None = None, make: Callable[[], Any] | None = None) -> Any:
    """What this Python worker keeps from task to task under ``name``, made once. What it keeps under any other name goes: a
    worker outlives the stage that filled a cache, and the caches of two stages beside each other outgrow a small executor."""
    gone = [k for k in _kept if k != name]
    for k in gone:
        del _kept[k]
    if gone:
        gc.collect()  # a cache may hold itself
        give_back()
    if name is not None and name not in _kept:
        _kept[name] = make()
    return _kept.get(name)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: Catalyst then can't copy it into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions."""
    return df.repartition(*keys)


#: Rows of a side that may be broadcast; beyond it, the join shuffles.
SMALL_ROWS = 300_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is. For checkpointed frames."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_part(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``, which tells apart rows that share a doc_id: 0 where all rows of the doc_id have one
    text, else the text's XXH64. Rows equal in both are one document.

    Only two hashes for each doc_id are aggregated; the repeated doc_ids, hardly any, come back by a broadcast if counted small.
    """
    again = free_name(docs, "again")
    own, h = docs.select(F.col("doc_id").cast("long").alias(again), F.xxhash64("text").alias("h")), F.xxhash64("text")
    several = own.where(F.col(again).isNotNull()).groupBy(again).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(again)
    joined = docs.join(small(cut_lineage(several)), F.col("doc_id").cast("long") == F.col(again), "left")
    return joined.select(*docs.columns, F.when(F.col(again).isNull(), F.lit(0).cast("long")).otherwise(h).alias(name))


def with_text_id(docs: DataFrame) -> DataFrame:
    """doc_id (as long), text and part (``add_part``)."""
    return add_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "part")
