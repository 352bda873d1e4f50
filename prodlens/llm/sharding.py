"""Rendezvous hashing of records over weighted shards, by DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.llm.storage import Stages


def rendezvous(key: Column, weights: Sequence[float], salt: int = 0) -> Column:
    """The shard with the highest score for ``key``; shard ``i`` has weight ``weights[i]``.

    Shard ``i`` scores ``-weight / ln(u)`` with ``u`` in (0, 1) drawn from a hash of (key, i), so a
    shard wins with probability proportional to its weight, and a change of one shard's weight
    moves records only into or out of that shard. Ties go to the larger number; a null key is
    hashed as a value of its own; a weight of 0 gets nothing.
    """
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and one must be positive")

    def score(i: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i), F.lit(salt)), 11).cast("double")
        u = (bits + 0.5) / F.lit(2.0**53)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(i).alias("shard"))

    drawn = [score(i, w) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["shard"]


def add_slots(df: DataFrame, group: str, order: list[str], stages: Stages, out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the given order.

    Rows are range-sorted by (group, order) and written, so their partition is fixed; a count
    per (group, partition) gives each partition its first number. No group meets in one task.
    Rows alike in all of ``order`` take their places in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, F.col(group), *[F.col(c) for c in order])
    placed = stages.write("ranged", placed.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy(group, "_part")
        .agg(F.count("*").alias("_n"))
        .select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = placed.join(F.broadcast(first) if parts <= 10_000 else first, [group, "_part"])
    return numbered.withColumn(out, F.col("_first") + F.row_number().over(within) - 1).drop("_part", "_first")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Place every document by its ``doc_id``.

    Returns doc_id, size (UTF-8 bytes of the text and 16 for the record; a null text has none),
    text_crc32 (of the UTF-8 bytes; 0 for a null or empty text), law, shard, slot (its place in
    the shard, by doc_id), and grown_shard (the shard under the weights ``grown``; null without them).
    Repeated doc_ids go to the same shard and take different slots; extra columns are ignored.
    """
    text = F.col("text").cast("string")
    body = F.coalesce(text.cast("binary"), F.lit(b""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
    ).select(
        "*",
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    stages = Stages(docs.sparkSession, "sharding")
    out = add_slots(placed, "shard", ["doc_id", "text_crc32", "size"], stages)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
