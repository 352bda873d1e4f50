"""Connected components of a graph that no task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import Stages


def connected_components(edges: DataFrame, a: str, b: str, stages: Stages) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``; nodes without an edge are absent.

    Alternating star contraction: every node first links its larger neighbours to its smallest
    neighbour, then its smaller neighbours and itself. The graph keeps its components and
    flattens to stars in a logarithmic number of rounds, and never has more edges than nodes
    and edges at the start. Rounds are written to the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = now.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    now, round_ = stages.write("cc0", now), 0
    total = _sum(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            least.select("u", F.col("m").alias("v"))
        )
        round_ += 1
        new = stages.write(f"cc{round_}", small.distinct())
        stages.drop(f"cc{round_ - 1}")
        before, total, now = total, _sum(new), new
        if total == before:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
            )


def _sum(edges: DataFrame):
    """A number that changes whenever a round changes the graph."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)
