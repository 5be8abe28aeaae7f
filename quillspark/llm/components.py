"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all distributed.

A hub's edges are only ever aggregated (map-side combined) or joined, so adaptive execution can split them; each
round is checkpointed in the shared folder. Nothing is collected but two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MAX_ROUNDS = 60


def _edge(u: str, v: str):
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(_edge("u", "v"), _edge("v", "u"))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(_edge("v", "m"), _edge("u", "m"))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, root: each node of an edge but the roots themselves, with the least node that it reaches."""
    edges = cut_lineage(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        before = state
        edges = cut_lineage(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
