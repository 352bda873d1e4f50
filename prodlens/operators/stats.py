"""Descriptive statistics, histograms, concentration and correlation.

p10 is the low value. NULL, NaN and infinities are missing, never zero.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.common import finite, pack
from prodlens.operators.ranking import (
    BucketLimits,
    carried_ranks,
    exact_quantiles,
    ranked_values,
)

DESCRIBE_PROBS = (0.10, 0.25, 0.50, 0.75, 0.90)


def describe(df: DataFrame, value: str, keys: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """n, missing, sum, mean, sample sd, min, max and five quantiles, per group if asked.

    sd is 0 for a single value; the sum of nothing is 0 and the other figures are NULL.
    """
    keys = keys or []
    src = df.select(*keys, finite(value).alias("v"))
    n = F.count("v")
    sd = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp("v"))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    moments = src.groupBy(pack(keys).alias("_k")).agg(
        n.alias("n"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        r(F.coalesce(F.sum("v"), F.lit(0.0))).alias("sum"),
        r(F.avg("v")).alias("mean"),
        r(sd).alias("sd"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    q = exact_quantiles(src, keys, ["v"], DESCRIBE_PROBS, digits=digits, names={"v": "_q"})
    quantiles = q.select(
        pack(keys).alias("_k"), *[F.col(f"_q_p{p}").alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    )
    return moments.join(quantiles, "_k", "left").select(
        *[F.col("_k")[k].alias(k) for k in keys],
        *["n", "missing", "sum", "mean", "sd", "min", "p10", "p25", "p50", "p75", "p90", "max"],
    )


def describe_by_group(
    df: DataFrame, value: str, group: str, all_label: str, no_data: str, digits: int | None = None
) -> DataFrame:
    """The whole selection as one row, then every group; order by ``place``, then ``n`` descending."""
    labelled = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit(no_data)))
    overall = describe(df, value, digits=digits).select(
        F.lit(0).alias("place"), F.lit(all_label).alias(group), "*"
    )
    groups = describe(labelled, value, [group], digits=digits).select(F.lit(1).alias("place"), "*")
    return overall.unionByName(groups)


def histogram(df: DataFrame, value: str, log: bool = False, max_bins: int = 60) -> DataFrame:
    """Freedman-Diaconis bins ``(bin, x0, x1, n)``, empty bins included.

    Falls back to a twentieth of the range when the interquartile range is zero, and to a
    width of one when all values are equal. Fewer than two values give no bins.
    """
    v = finite(value)
    v = F.when(v > 0, F.log10(v)) if log else v
    src = df.select(v.alias("v")).where(F.col("v").isNotNull())
    quartiles = exact_quantiles(src, [], ["v"], [0.25, 0.75])
    iqr = quartiles.select(F.col("v_p75") - F.col("v_p25")).scalar()
    span = F.col("hi") - F.col("lo")
    by_iqr = F.when(iqr > 0, 2 * iqr * F.pow(F.col("cnt"), F.lit(-1.0 / 3)))
    by_range = F.when(span > 0, span / 20).otherwise(F.lit(1.0))
    ends = src.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("cnt")
    ).where(F.col("cnt") >= 2)
    raw = ends.select("lo", "hi", F.coalesce(by_iqr, by_range).alias("w"))
    wide = raw.select("lo", "hi", "w", F.ceil(span / F.col("w")).alias("k"))
    limits = wide.select(
        "lo",
        F.when(F.col("k") > max_bins, span / max_bins).otherwise(F.col("w")).alias("w"),
        F.greatest(F.least("k", F.lit(max_bins)), F.lit(1)).cast("int").alias("k"),
    )
    one = limits.select(F.struct("lo", "w", "k").alias("s")).scalar()
    place = F.floor((F.col("v") - F.col("s.lo")) / F.col("s.w"))
    counts = (
        src.withColumn("s", one)
        .where(F.col("s").isNotNull())
        .select(F.greatest(F.least(place, F.col("s.k") - 1), F.lit(0)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    edges = limits.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "lo", "w")
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("x0"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("x1"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _positive(df: DataFrame, value: str) -> DataFrame:
    v = finite(value)
    return df.select(F.when(v > 0, v).alias("v"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row ``(n, gini)`` over the positive values; gini is NULL below two of them."""
    r = ranked_values(_positive(df, value), [], "v")
    n, v = F.col("n"), F.col("v")
    # area of the trapezoids of n equal values that start at s_before
    area = (2 * n * F.col("s_before") + n * n * v) / (2 * F.col("n_total") * F.col("s_total"))
    found = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(area).alias("a"))
    return found.select("n", F.when(F.col("n") >= 2, 1 - 2 * F.col("a")).alias("gini"))


def lorenz_curve(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """``(pct_entities, pct_total)`` from (0, 0), lowest values first.

    A point at every ``max(1, n // points)``-th value and at the last one: the number of
    points depends on ``points``, not on the data. Values inside a run of ties get their
    own points.
    """
    r = ranked_values(_positive(df, value), [], "v").where(F.col("n_total") >= 2)
    step = F.greatest(F.lit(1), F.floor(F.col("n_total") / points))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    lowest = F.ceil(first / step) * step
    on_step = F.when(lowest <= last, F.sequence(lowest, last, step)).otherwise(F.array().cast("array<bigint>"))
    ends = F.when(last == F.col("n_total") - 1, F.array(last)).otherwise(F.array().cast("array<bigint>"))
    marked = r.withColumn("i", F.explode(F.array_union(on_step, ends)))
    curve = marked.select(
        ((F.col("i") + 1) / F.col("n_total") * 100).alias("pct_entities"),
        (
            (F.col("s_before") + (F.col("i") - F.col("n_before") + 1) * F.col("v"))
            / F.col("s_total")
            * 100
        ).alias("pct_total"),
    )
    return _origin(r).unionByName(curve)


def _origin(r: DataFrame) -> DataFrame:
    """The point (0, 0), present only if there is a curve."""
    return (
        r.agg(F.count("*").alias("c"))
        .where(F.col("c") > 0)
        .select(F.lit(0.0).alias("pct_entities"), F.lit(0.0).alias("pct_total"))
    )


def top_share(df: DataFrame, value: str, frac: float = 0.05, floor_rule: bool = False) -> DataFrame:
    """One row ``(share, wells, of)``: percent of the total held by the top ``frac``.

    The number of top entities is ``max(1, round(n * frac))``; with ``floor_rule`` it is the
    number of places not above ``n * frac``, which may be none.
    """
    r = ranked_values(_positive(df, value), [], "v")
    n_total = F.col("n_total")
    k = F.floor(n_total * frac) if floor_rule else F.greatest(F.lit(1), F.floor(n_total * frac + 0.5))
    above = n_total - F.col("n_before") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - above))
    found = r.agg(
        F.sum(taken * F.col("v")).alias("top"),
        F.max("s_total").alias("total"),
        F.max(k).alias("wells"),
        F.max("n_total").alias("of"),
    )
    return found.where(F.col("of").isNotNull()).select(
        (F.col("top") / F.col("total") * 100).alias("share"), "wells", "of"
    )


def pearson(x: str, y: str) -> Column:
    """Pearson over complete pairs; NULL below three pairs or without spread.

    Built from the moments, because ``corr`` fails on a column without spread in ANSI mode.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.when(F.count_if(both) >= 3, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(var_x, var_y, pearson)`` for every pair, from one pass over the table."""
    src = df.select(*[finite(c).alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    row = src.agg(*[pearson(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), F.col(f"r{i}").alias("pearson")
                    )
                    for i, (x, y) in enumerate(pairs)
                ]
            )
        ).alias("p")
    ).select("p.*")


def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(var_x, var_y, n, spearman)`` for every pair.

    Each row yields one record per pair of columns in which both values are present, and all
    pairs are ranked together with the pair as group key. Records are collapsed to distinct
    (pair, x, y); they then carry the rank of x and the rank of y along, one after the other.
    """
    pairs = list(combinations(cols, 2))
    src = df.select(*[finite(c).alias(c) for c in cols])
    records = (
        src.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"))
                        for i, (x, y) in enumerate(pairs)
                    ]
                )
            ).alias("r")
        )
        .select("r.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(F.count("*").alias("w"))
    )
    for value, other in (("x", "y"), ("y", "x")):
        ranked = carried_ranks(records, "pair", value, "w", [other], "_r", "_n")
        records = ranked.withColumn(f"d{value}", F.col("_r") - (F.col("_n") + 1) / 2).drop("_r", "_n")
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    sums = records.groupBy("pair").agg(
        F.sum("w").alias("n"),
        F.sum(w * dx * dy).alias("sxy"),
        F.sum(w * dx * dx).alias("sxx"),
        F.sum(w * dy * dy).alias("syy"),
    )
    names = F.array(
        *[F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y")) for x, y in pairs]
    )
    rho = F.when(
        (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0),
        F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")),
    )
    every = (
        df.sparkSession.range(len(pairs))
        .select(F.col("id").cast("int").alias("pair"))
        .withColumn("p", names[F.col("pair")])
    )
    return every.join(sums, "pair", "left").select(
        "p.*", F.coalesce("n", F.lit(0)).alias("n"), rho.alias("spearman")
    )


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Both coefficients side by side for every pair."""
    return pearson_matrix(df, cols).join(spearman_matrix(df, cols), ["var_x", "var_y"])
