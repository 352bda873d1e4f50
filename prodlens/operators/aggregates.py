"""Small aggregate operators: domains, most frequent names, top-k, folds and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.common import pack


def domain_counts(df: DataFrame, dims: list[str], no_data: str | None = None) -> DataFrame:
    """Values of several columns with their row counts, in one pass over the table."""
    value = lambda d: F.coalesce(F.col(d).cast("string"), F.lit(no_data)) if no_data else F.col(d).cast("string")
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("dim"), value(d).alias("value")) for d in dims])
        ).alias("x")
    )
    return pairs.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value per key; of equally common ones the first in order."""
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    counted = known.groupBy(key, value).agg((-F.count("*")).alias("_n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct("_n", value)).alias(value))


def code_names(df: DataFrame, code: str, name: str) -> DataFrame:
    """Code to spelled-out name, by the commonest pairing."""
    return most_frequent(df, code, name)


def rank_order(df: DataFrame, dim: str, measures: list[str]) -> DataFrame:
    """Total of the measures per value of ``dim``, NULL counted as nothing.

    Taken over the whole table, so an order built on it does not change with a filter.
    """
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in measures[1:]), F.coalesce(F.col(measures[0]), F.lit(0.0)))
    return df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum(total).alias("total"))


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False, tie_break: list[str] | None = None) -> DataFrame:
    """The k rows with the largest (or smallest) value; rows without a value are left out."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.where(F.col(by).isNotNull()).orderBy(order, *(tie_break or [])).limit(k)


def top_values(df: DataFrame, dim: str, measure: str, k: int) -> DataFrame:
    """The k values of ``dim`` with the largest total: at most k rows, safe to broadcast."""
    totals = df.groupBy(dim).agg(F.sum(F.coalesce(F.col(measure), F.lit(0.0))).alias("_total"))
    return totals.orderBy(F.col("_total").desc(), F.col(dim).asc_nulls_last()).limit(k).select(dim)


def top_k_with_other(df: DataFrame, time: str, dim: str, measure: str, k: int = 8) -> DataFrame:
    """Series of the k largest values; everything else is added up as ``Other``."""
    series = df.groupBy(time, dim).agg(F.sum(F.coalesce(F.col(measure), F.lit(0.0))).alias("_v"))
    top = top_values(df, dim, measure, k).select(
        F.col(dim).alias("_top"), F.lit(True).alias("_is_top")
    )
    folded = series.join(F.broadcast(top), F.col(dim).eqNullSafe(F.col("_top")), "left").select(
        time, F.when(F.col("_is_top"), F.col(dim)).otherwise(F.lit("Other")).alias(dim), "_v"
    )
    return folded.groupBy(time, dim).agg(F.sum("_v").alias(measure))


def dense_top_series(df: DataFrame, time: str, dim: str, measure: str, k: int = 6) -> DataFrame:
    """The k largest values on every month that occurs, missing cells as zero, no fold.

    The months carry the (at most k) values as an array and explode it, so months and values
    are never joined without a key.
    """
    cells = df.groupBy(time, dim).agg(F.sum(measure).alias("_v"))
    top = top_values(df, dim, measure, k).agg(F.collect_list(F.struct(dim)).alias("t")).scalar()
    months = df.select(F.col(time).alias("_time")).distinct().withColumn("_top", top)
    grid = months.select("_time", F.explode("_top").alias("_t")).select(
        "_time", F.col("_t")[dim].alias("_dim")
    )
    on = (F.col("_time") == F.col(time)) & F.col("_dim").eqNullSafe(F.col(dim))
    return grid.join(cells, on, "left").select(
        F.col("_time").alias(time),
        F.col("_dim").alias(dim),
        F.coalesce("_v", F.lit(0.0)).alias(measure),
    )


def share_of_total(df: DataFrame, measure: str, out: str, scale: float = 100.0) -> DataFrame:
    """Each row's part of the total of an aggregated table; NULL if the total is zero."""
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(out, F.col(measure) / F.nullif(total, F.lit(0.0)) * scale)


def share_by_month(part: DataFrame, whole: DataFrame, time: str, measure: str, out: str) -> DataFrame:
    """Part against whole for each month of the whole, in percent; NULL if the whole is zero."""
    sums = whole.groupBy(time).agg(F.sum(measure).alias("_whole"))
    return sums.join(part, time, "left").withColumn(
        out,
        F.coalesce(F.col(measure), F.lit(0.0)) / F.nullif(F.col("_whole"), F.lit(0.0)) * 100,
    )


def distinct_by_entity(
    df: DataFrame, keys: list[str], entity: str, sums: dict[str, str], producing: Column
) -> DataFrame:
    """Counts of distinct entities, all and producing, with sums, in two plain aggregates.

    Two ``count(DISTINCT)`` with different conditions would make Spark expand every row
    three times. Reducing to (cell, entity) first gives the same counts, spreads a cell that
    holds a large part of the rows over its entities, and needs no new shuffle when the rows
    already lie partitioned by entity.
    """
    per_entity = df.groupBy(*keys, entity).agg(
        F.max(producing.cast("int")).alias("_producing"),
        *[F.sum(c).alias(o) for c, o in sums.items()],
    )
    return per_entity.groupBy(*keys).agg(
        F.count(entity).alias("wells"),
        F.count_if((F.col("_producing") == 1) & F.col(entity).isNotNull()).alias("wells_producing"),
        *[F.sum(o).alias(o) for o in sums.values()],
    )


def dedupe_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return (
        df.groupBy(pack(keys).alias("_k"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("_k.*", "n")
    )

