"""Global and grouped order statistics without a single-task sort.

A window without partitions, or ``percentile`` over one huge group, puts a whole group in
one task. Here every value first gets a bucket that depends on the value alone: the bucket
limits come from approximate quantiles of the column, so each bucket holds about the same
number of rows and recomputing a lost task always gives the same bucket. Then

1. equal values are collapsed to (group, bucket, value, count), with a map-side combine,
   so one value held by a third of the rows is one row per group afterwards;
2. bucket totals (at most ``buckets`` rows per group) give each bucket its offset;
3. ranks and running sums are finished inside (group, bucket).

Ranks are exact; only the bucket limits are approximate, and they only affect balance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodlens.common import broadcast_if_small, finite, pack, pin


def default_buckets(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class BucketLimits:
    """Inner bucket limits of one or more numeric columns."""

    limits: dict[str, tuple[float, ...]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> BucketLimits:
        """One pass over ``cols``; the driver receives at most ``buckets`` numbers per column."""
        n = buckets or default_buckets(df)
        steps = [i / n for i in range(1, n)]
        numbers = df.select(*[finite(c).alias(c) for c in cols])
        found = numbers.approxQuantile(list(cols), steps, 1 / (2 * n))
        return cls({c: tuple(sorted(set(q))) for c, q in zip(cols, found)})

    def tag(self, df: DataFrame, col: str, out: str, like: str | None = None) -> DataFrame:
        """Add the bucket number of ``col``; a missing value has no bucket."""
        inner = self.limits[like or col]
        if not inner:
            return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0)))
        splits = [float("-inf"), *inner, float("inf")]
        tagged = Bucketizer(splits=splits, inputCol=col, outputCol=out).transform(df)
        return tagged.withColumn(out, F.col(out).cast("int"))


def _offsets(counted: DataFrame, value: str) -> DataFrame:
    """Rows and sums before each bucket of a group, and the group totals."""
    per_bucket = counted.groupBy("_k", "_b").agg(
        F.sum("n").alias("bn"), F.sum(F.col("n") * F.col(value)).alias("bs")
    )
    group = Window.partitionBy("_k")
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        "_k",
        "_b",
        "bn",
        F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bs").over(earlier), F.lit(0.0)).alias("s_before"),
        F.sum("bn").over(group).alias("n_total"),
        F.sum("bs").over(group).alias("s_total"),
    )


def ranked_values(
    df: DataFrame,
    keys: list[str],
    value: str,
    limits: BucketLimits | None = None,
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Distinct values of each group in rank order; ``weight`` counts a row several times.

    Columns: the keys, ``value``, ``n`` (rows with that value), ``n_before`` / ``s_before``
    (rows and sum of smaller values), ``n_total`` / ``s_total`` of the group. Missing
    values take no part.
    """
    times = F.col(weight) if weight else F.lit(1)
    src = df.select(
        pack(keys).alias("_k"), finite(value).alias("_v"), times.cast("long").alias("_w")
    ).where(F.col("_v").isNotNull())
    limits = limits or BucketLimits.fit(src, ["_v"], buckets)
    # the planner would add this condition below one side of the join only, and the two
    # passes over the counts could then not share their shuffle
    tagged = limits.tag(src, "_v", "_b", like=next(iter(limits.limits))).where(
        F.col("_b").isNotNull()
    )
    counted = tagged.groupBy("_k", "_b", "_v").agg(F.sum("_w").alias("n"))
    within = (
        Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = (
        counted.join(_offsets(counted, "_v"), ["_k", "_b"])
        .withColumn("n_in", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .withColumn(
            "s_in", F.coalesce(F.sum(F.col("n") * F.col("_v")).over(within), F.lit(0.0))
        )
    )
    return ranked.select(
        *[F.col("_k")[k].alias(k) for k in keys],
        F.col("_v").alias(value),
        "n",
        (F.col("n_before") + F.col("n_in")).alias("n_before"),
        (F.col("s_before") + F.col("s_in")).alias("s_before"),
        "n_total",
        "s_total",
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    """Rank of every distinct value, ties sharing the mean of their places."""
    r = ranked_values(df, keys, value, **kw)
    return r.select(
        *keys, value, "n", "n_total", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


# bytes of one row of edges, which hold numbers only
EDGE_BYTES = 96


def carried_ranks(records: DataFrame, group: str, value: str, weight: str, spread: list[str], rank: str, total: str) -> DataFrame:
    """Adds to every record the average rank of its value in its group, and the group's total weight.

    Records are range-partitioned by group, value and ``spread``, so even one value that half of
    all records hold is cut over many tasks. Each task counts its own records up to a value; the
    totals and the edge values of all tasks (a row per task and group) tell what lies before
    it and how often an edge value occurs in other tasks. The rank thus travels with the record and nothing is
    joined on values.
    """
    n = default_buckets(records)
    dealt = records.repartitionByRange(n, group, value, *spread).withColumn("_p", F.spark_partition_id())
    part = Window.partitionBy("_p", group)
    local = pin(
        dealt.withColumn("_upto", F.sum(weight).over(part.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_same", F.sum(weight).over(Window.partitionBy("_p", group, value)))
    )
    ends = local.groupBy("_p", group).agg(
        F.sum(weight).alias("_t"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.min_by("_same", value).alias("_nlo"), F.max_by("_same", value).alias("_nhi"),
    )
    tasks = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_t").over(tasks), F.lit(0))).withColumn(total, F.sum("_t").over(Window.partitionBy(group)))
    low, high = [F.struct(F.lit(at).alias("hi"), F.col(f"_{'hi' if at else 'lo'}").alias("v"), F.col(f"_n{'hi' if at else 'lo'}").alias("n")) for at in (False, True)]
    edges = ends.withColumn("_e", F.explode(F.when(F.col("_lo") == F.col("_hi"), F.array(low)).otherwise(F.array(low, high))))
    like = Window.partitionBy(group, "_e.v")
    edges = edges.withColumn("_earlier", F.coalesce(F.sum("_e.n").over(like.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = edges.withColumn("_all", F.sum("_e.n").over(like))
    of = lambda c, hi: F.max(F.when(F.col("_e.hi") == F.lit(hi), F.col(c)))
    known = pin(
        edges.groupBy(group, "_p").agg(
            *[F.first(c).alias(c) for c in ("_before", total, "_lo", "_hi")],
            of("_earlier", False).alias("_elo"), of("_earlier", True).alias("_ehi"), of("_all", False).alias("_alo"), of("_all", True).alias("_ahi"),
        )
    )
    rows = known.count()
    joined = local.join(broadcast_if_small(known, (rows, rows * EDGE_BYTES)), ["_p", group])
    v, same = F.col(value), F.col("_same")
    earlier = F.when(v == F.col("_lo"), F.col("_elo")).when(v == F.col("_hi"), F.col("_ehi")).otherwise(0)
    ties = F.when(v == F.col("_lo"), F.col("_alo")).when(v == F.col("_hi"), F.col("_ahi")).otherwise(same)
    place = F.col("_before") + F.col("_upto") - same - earlier + (ties + 1) / 2
    return joined.select(*records.columns, place.alias(rank), total)


def percent(q: float) -> str:
    """A probability as it stands in a column name: 0.5 is 50, 0.995 is 99_5."""
    return f"{q * 100:.10g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    cols: Sequence[str],
    probs: Sequence[float],
    digits: int | None = None,
    buckets: int | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of several columns per group.

    Output columns are ``<name>_p<percent>`` (``p50``, ``p99_5``) with ``name`` from ``names`` (default: the
    column). NULLs are skipped; a group with no value in a column has NULL there, and a
    group with no value in any column is absent. After the bucket totals are known, only
    the buckets that hold a wanted rank are sorted.
    """
    cols, names = list(cols), names or {}
    src = df.select(pack(keys).alias("_k"), *[finite(c).alias(c) for c in cols])
    limits = BucketLimits.fit(src, cols, buckets)
    tagged = src
    for c in cols:
        tagged = limits.tag(tagged, c, f"_b_{c}")
    long = tagged.select(
        "_k",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("m"), F.col(f"_b_{c}").alias("b"), F.col(c).alias("v")
                    )
                    for i, c in enumerate(cols)
                ]
            )
        ).alias("x"),
    ).where(F.col("x.v").isNotNull() & F.col("x.b").isNotNull())
    counted = long.groupBy(
        F.struct(F.col("_k").alias("g"), F.col("x.m").alias("m")).alias("_k"),
        F.col("x.b").alias("_b"),
        F.col("x.v").alias("v"),
    ).agg(F.count("*").alias("n"))

    pos = lambda q: (F.col("n_total") - 1) * F.lit(q)
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("q"), F.lit(side).alias("hi"), edge(pos(q)).alias("rank"))
            for i, q in enumerate(probs)
            for side, edge in ((False, F.floor), (True, F.ceil))
        ]
    )
    n_end = F.col("n_before") + F.col("bn")
    needed = (
        _offsets(counted, "v")
        .withColumn(
            "wanted",
            F.filter(wanted, lambda w: (w["rank"] >= F.col("n_before")) & (w["rank"] < n_end)),
        )
        .where(F.size("wanted") > 0)
        .select("_k", "_b", "n_before", "n_total", "wanted")
    )
    within = (
        Window.partitionBy("_k", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("n_before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    hits = (
        counted.join(needed, ["_k", "_b"])
        .withColumn("first", first)
        .withColumn(
            "hit",
            F.explode(
                F.filter(
                    "wanted",
                    lambda w: (w["rank"] >= F.col("first"))
                    & (w["rank"] < F.col("first") + F.col("n")),
                )
            ),
        )
    )
    out = []
    for i, c in enumerate(cols):
        for j, q in enumerate(probs):
            here = (F.col("_k.m") == i) & (F.col("hit.q") == j)
            low = F.max(F.when(here & ~F.col("hit.hi"), F.col("v")))
            high = F.max(F.when(here & F.col("hit.hi"), F.col("v")))
            place = (F.max(F.when(here, F.col("n_total"))) - 1) * F.lit(q)
            est = low + (high - low) * (place - F.floor(place))
            name = f"{names.get(c, c)}_p{percent(q)}"
            out.append((F.round(est, digits) if digits is not None else est).alias(name))
    found = hits.groupBy(F.col("_k.g").alias("_g")).agg(*out)
    return found.select(*[F.col("_g")[k].alias(k) for k in keys], *found.columns[1:])


def ordered_index(df: DataFrame, keys: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Zero-based place of every distinct value inside its group, for any sortable type.

    Values are range-partitioned by (keys, value) and written with their partition number,
    so that number is fixed; per-partition counts then give the offsets.
    """
    n = partitions or default_buckets(df)
    blocks = pin(
        df.select(*keys, value)
        .where(F.col(value).isNotNull())
        .distinct()
        .repartitionByRange(n, *keys, value)
        .withColumn("_p", F.spark_partition_id())
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(*keys, "_p")
        .agg(F.count("*").alias("c"))
        .withColumn("offset", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        .drop("c")
    )
    within = Window.partitionBy(*keys, "_p").orderBy(value)
    place = F.col("offset") + F.row_number().over(within) - 1
    return pin(blocks.join(offsets, [*keys, "_p"]).select(*keys, value, place.cast("int").alias("code")))
