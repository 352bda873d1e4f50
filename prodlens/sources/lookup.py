"""Reading entity shards: one entity, or many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.common import broadcast_if_small
from prodlens.plans.enrich import MONTH, WELL
from prodlens.sources.sinks import BUCKETS, bucket_of


def entity_history(
    spark: SparkSession, path: str, entity: int, key: str = WELL, at: str = MONTH, buckets: int = BUCKETS
) -> DataFrame:
    """One entity's rows in date order: one bucket folder is listed, row groups are skipped by id."""
    rows = spark.read.parquet(path)
    return (
        rows.where((F.col("bucket") == entity % buckets) & (F.col(key) == entity)).drop("bucket").orderBy(at)
    )


def entity_histories(
    spark: SparkSession, path: str, entities: DataFrame, key: str = WELL, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of every listed entity. The join is on the bucket too, so the planner prunes the bucket
    folders at run time by the entities it has found, and nothing is collected before."""
    wanted = entities.select(key).distinct().withColumn("bucket", bucket_of(key, buckets))
    # the planner prunes by a side that it takes to be selective, which a comparison makes it
    wanted = wanted.where(F.col("bucket").between(0, buckets - 1))
    size = wanted.count()
    # two numbers an entity
    wanted = broadcast_if_small(wanted, (size, 16 * size))
    return spark.read.parquet(path).join(wanted, ["bucket", key], "left_semi").drop("bucket")
