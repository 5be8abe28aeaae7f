"""State kept over snapshots: what is to do, upserts, renames, sync of claims with changed notes, stale records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def todo(current: DataFrame, stored: DataFrame, key: str, state: str) -> DataFrame:
    """Rows of ``current`` whose state differs from the stored one, or that have none (null-safe)."""
    known = stored.select(F.col(key).alias("__key"), F.col(state).alias("__state"))
    return current.join(known, F.col(key) == F.col("__key"), "left").where(F.col("__key").isNull() | ~F.col(state).eqNullSafe(F.col("__state"))).drop("__key", "__state")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key (by ``order``; a tie goes to the new row)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__rn", rank).where("__rn = 1").drop("__rn", "__new")


def renames(previous: DataFrame, current: DataFrame) -> DataFrame:
    """old_id, new_id: a new id with the content of one that is gone, one to one (id, hash in both)."""
    gone = previous.join(current.select("id"), "id", "left_anti")
    fresh = current.join(previous.select("id"), "id", "left_anti")
    number = lambda df, name: df.select(F.col("id").alias(name), "hash", F.row_number().over(Window.partitionBy("hash").orderBy("id")).alias("k"))
    # contents that several gone notes have: one of them is followed (the last), as one row stands for a content
    last = gone.groupBy("hash").agg(F.max("id").alias("old_id"))
    return last.join(number(fresh, "new_id").where("k = 1").drop("k"), "hash").select("old_id", "new_id")


def carry_over(knowledge: DataFrame, renamed: DataFrame, key: str) -> DataFrame:
    """``knowledge`` with the keys of renamed notes rewritten."""
    return knowledge.join(renamed, F.col(key) == F.col("old_id"), "left").withColumn(key, F.coalesce("new_id", F.col(key))).drop("old_id", "new_id")


def sync_claims(claims: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """Claims after the notes changed: id, note, note_revision, status.

    claims: id, note, note_revision, status, passage. previous: id, hash. current: id, hash, text. Renames are followed;
    a passage that is still there keeps its status, one that is gone makes a live claim stale, a removed note makes it
    source_missing (unless rejected or superseded).
    """
    moved = carry_over(claims, renames(previous, current.select("id", "hash")), "note")
    notes = current.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.regexp_replace(F.lower("text"), r"(?U)\s+", " ").alias("__text"))
    joined = moved.join(notes, F.col("note") == F.col("__id"), "left")
    same = F.col("note_revision").eqNullSafe(F.col("__hash"))
    there = F.contains("__text", F.regexp_replace(F.lower("passage"), r"(?U)\s+", " "))
    status = (
        F.when(F.col("__id").isNull(), F.when(F.col("status").isin("rejected", "superseded"), F.col("status")).otherwise("source_missing"))
        .when(same | F.coalesce(there, F.lit(False)), F.col("status"))
        .when(F.col("status").isin("proposed", "accepted", "deferred"), "stale")
        .otherwise(F.col("status"))
    )
    revision = F.when(F.col("__id").isNotNull() & ~same & F.coalesce(there, F.lit(False)), F.col("__hash")).otherwise(F.col("note_revision"))
    return joined.select("id", "note", revision.alias("note_revision"), status.alias("status"))


def stale_records(records: DataFrame, claims: DataFrame) -> DataFrame:
    """id, dead: records (id, status, inputs), neither rejected nor stale, with an input that is not a live claim."""
    live = claims.where("status IN ('proposed', 'accepted', 'deferred')").select(F.col("id").alias("input"))
    inputs = records.where("coalesce(status, '') NOT IN ('rejected', 'stale')").select("id", F.explode("inputs").alias("input"))
    return inputs.join(live, "input", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("input")).alias("dead"))


def merge_claims(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, status: reproduced claims keep a review; reviewed ones that were not reproduced stay; others go."""
    both = existing.select("id", F.col("status").alias("old")).join(fresh.select("id", F.col("status").alias("new")), "id", "full")
    reviewed = F.col("old") != "proposed"
    return both.where(F.col("new").isNotNull() | reviewed).select("id", F.when(reviewed, F.col("old")).otherwise(F.coalesce("new", "old")).alias("status"))


def persist_checks(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """id, outcome (created, updated, unchanged, deleted, stale): produced (id, digest) against stored (id, digest, status)."""
    both = produced.select("id", F.col("digest").alias("p")).join(stored.select("id", F.col("digest").alias("s"), "status"), "id", "full")
    outcome = (
        F.when(F.col("s").isNull(), "created").when(F.col("p").isNull(), F.when(F.col("status") == "proposed", "deleted").otherwise("stale"))
        .when(F.col("p") == F.col("s"), "unchanged").otherwise("updated")
    )
    return both.select("id", outcome.alias("outcome"))


def review(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claims (id, status) after decisions (id, action, at): the latest of accept, reject, defer counts."""
    last = decisions.groupBy("id").agg(F.max_by("action", "at").alias("action"))
    to = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "defer", "deferred").otherwise(F.col("status"))
    return claims.join(last, "id", "left").withColumn("status", to).drop("action")


def reuse_topics(groups: DataFrame, previous: DataFrame, reuse: float = 0.4, fresh: float = 0.8) -> DataFrame:
    """grp, old, jaccard, stale: each group takes over the best unused earlier topic (largest group first).

    groups and previous: (grp | topic, member). Overlaps are counted by a join on members. As ``reuse`` is above a third,
    at most two groups overlap a topic enough, and two topics a group, so what the greedy choice reads on the driver is
    bounded by twice the number of topics.
    """
    size_g, size_t = groups.groupBy("grp").agg(F.count("*").alias("ng")), previous.groupBy("topic").agg(F.count("*").alias("nt"))
    shared = groups.join(previous, "member").groupBy("grp", "topic").agg(F.count("*").alias("n"))
    scored = shared.join(size_g, "grp").join(size_t, "topic").select("grp", "topic", "ng", (F.col("n") / (F.col("ng") + F.col("nt") - F.col("n"))).alias("j")).where(F.col("j") >= reuse)
    used, rows = set(), {}
    for r in scored.orderBy(F.desc("ng"), "grp", F.desc("j"), "topic").toLocalIterator():
        if r.grp not in rows and r.topic not in used:
            used.add(r.topic)
            rows[r.grp] = (r.grp, r.topic, round(r.j, 6), r.j < fresh)
    g, t = groups.schema["grp"].dataType.simpleString(), previous.schema["topic"].dataType.simpleString()
    return groups.sparkSession.createDataFrame(list(rows.values()), f"grp {g}, old {t}, jaccard double, stale boolean")
