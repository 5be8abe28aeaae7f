"""Freshness and incremental reading of a notes folder with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_stale(files: DataFrame, count: int, indexed_at) -> bool:
    """Whether to index again: the number of notes changed, or one is newer than the last index (path, mtime)."""
    now = files.agg(F.count("*").alias("n"), F.max("mtime").alias("newest")).first()
    return now.n != count or (now.newest is not None and (indexed_at is None or now.newest > indexed_at))


def new_notes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of note files (path, raw, mtime), each once; renamed or rewritten files come as new ones."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), F.col("modificationTime").alias("mtime"))


def index_available(spark: SparkSession, root: str, checkpoint: str, write_batch) -> int:
    """Hand what is new to ``write_batch(frame, batch_id)`` and stop; the rows handed over. Restarts resume from ``checkpoint``."""
    rows = spark.sparkContext.accumulator(0)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        rows.add(df.count())
        write_batch(df, batch_id)
        df.unpersist()

    new_notes(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.value
