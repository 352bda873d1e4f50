"""Type curves: the distribution of monthly volumes against months since first production."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.common import broadcast_if_small, pack, pin
from prodlens.functions.dates import months_between_starts
from prodlens.functions.text import or_label
from prodlens.operators.ranking import exact_quantiles, percent
from prodlens.plans.enrich import MONTH, WELL

CURVE_DIMS = ["trajectory", "subtype", "cuenca", "operator", "formation", "area"]
CURVE_KEYS = [*CURVE_DIMS, "vintage", "month_on_prod"]
FLUIDS = {"prod_pet": "oil", "prod_gas": "gas", "prod_agua": "water"}
PROBS = (0.10, 0.50, 0.90)
MIN_WELLS = 5
LAST_MONTH = 119


def curve_rows(fact: DataFrame, attrs: DataFrame, last_month: int = LAST_MONTH) -> DataFrame:
    """The fact from first production on, indexed by months on production."""
    side = attrs.where(F.col("first_prod_month").isNotNull()).select(
        WELL,
        "first_prod_month",
        "trajectory",
        or_label("sub_tipo_recurso").alias("subtype"),
        "cuenca",
        or_label("operator_latest").alias("operator"),
        or_label("formprod").alias("formation"),
        or_label("area").alias("area"),
        F.year("first_prod_month").alias("vintage"),
    )
    joined = fact.select(WELL, MONTH, *FLUIDS).join(side, WELL)
    return (
        joined.where(F.col(MONTH) >= F.col("first_prod_month"))
        .withColumn("month_on_prod", months_between_starts("first_prod_month", MONTH))
        .where(F.col("month_on_prod").between(0, last_month))
    )


def type_curve(
    rows: DataFrame,
    keys: Sequence[str] = tuple(CURVE_KEYS),
    min_wells: int = MIN_WELLS,
    digits: int | None = 2,
) -> DataFrame:
    """P10, P50 and P90 of oil, gas and water per group, small groups suppressed.

    With fewer keys the same function gives exact percentiles of pooled groups.
    """
    keys = list(keys)
    per_well = rows.groupBy(*keys, WELL).agg(F.lit(1).alias("one"))
    sizes = pin(per_well.groupBy(pack(keys).alias("_k")).agg(F.count(WELL).alias("wells")))
    big = F.col("wells") >= min_wells
    key_bytes = F.octet_length(F.to_json("_k"))
    found = sizes.agg(F.count_if(~big).alias("small"), F.count_if(big).alias("n"), F.coalesce(F.sum(F.when(big, key_bytes)), F.lit(0)).alias("bytes")).first()
    values = rows.select(pack(keys).alias("_k"), *FLUIDS)
    if found.small:
        # only the values of groups that stay are sorted; a hot key joins no group's rows, it
        # only meets its one size, which is sent to all tasks while it is proven small
        stay = broadcast_if_small(sizes.where(big).select("_k"), (found.n, found.bytes))
        values = values.join(stay, "_k", "left_semi")
    bands = exact_quantiles(values, ["_k"], list(FLUIDS), PROBS, digits=digits, names=FLUIDS)
    joined = sizes.where(big).join(bands, "_k", "left")
    return joined.select(*[F.col("_k")[k].alias(k) for k in keys], "wells", *[c for c in bands.columns if c != "_k"])


def pooled_curve(curve: DataFrame, split: str, fluid: str) -> DataFrame:
    """Approximate pooling: the plain mean of the groups' percentiles, and their wells added.

    Exact only where one group remains; ``type_curve`` over the rows gives the exact figures.
    """
    return curve.groupBy("month_on_prod", split).agg(
        *[F.avg(f"{fluid}_p{p}").alias(f"p{p}") for p in (10, 50, 90)],
        F.sum("wells").alias("wells"),
    )


def newest_vintages(curve: DataFrame, k: int = 6) -> DataFrame:
    """The k latest vintages present: k rows."""
    found = curve.select("vintage").where(F.col("vintage").isNotNull()).distinct()
    return found.orderBy(F.col("vintage").desc()).limit(k)


# Sketches of this size place a quantile within RANK_ERROR of its rank (a part of the number of values).
SKETCH_K = 800
RANK_ERROR = 0.01


def curve_sketches(rows: DataFrame, keys: Sequence[str] = tuple(CURVE_KEYS), k: int = SKETCH_K) -> DataFrame:
    """The stored form of type curves that can be pooled: per group its wells and a quantile sketch for
    each fluid. No group is suppressed, because a pool of small groups may be large."""
    keys = list(keys)
    per_well = rows.groupBy(*keys, WELL).agg(*[F.first(c).alias(c) for c in FLUIDS], F.count("*").alias("_n"))
    # a well has one row per month and so one per group; a second one would be lost here
    per_well = per_well.withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(F.lit("a well has two rows in one month"))))
    sketches = [F.kll_sketch_agg_double(F.col(c), k).alias(f"{f}_sketch") for c, f in FLUIDS.items()]
    return per_well.groupBy(*keys).agg(F.sum("_n").alias("wells"), *sketches)


def pool_sketches(curve: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS, k: int = SKETCH_K) -> DataFrame:
    """Approximate percentiles of any union of groups, within ``RANK_ERROR`` of the exact ranks; ``type_curve`` over the
    rows gives exact ones. ``<fluid>_n`` counts the values; without any the percentiles are NULL.

    The groups' dimensions are attributes of a well, so wells add up over them within a month on production.
    """
    merged = curve.groupBy(*keys).agg(
        F.sum("wells").alias("wells"), *[F.kll_merge_agg_double(F.col(f"{f}_sketch"), k).alias(f) for f in FLUIDS.values()]
    )
    out = [*[F.col(c) for c in keys], F.col("wells")]
    for f in FLUIDS.values():
        n = F.kll_sketch_get_n_double(F.col(f))
        out.append(n.alias(f"{f}_n"))
        out += [F.when(n > 0, F.kll_sketch_get_quantile_double(F.col(f), F.lit(float(q)))).alias(f"{f}_p{percent(q)}") for q in probs]
    return merged.select(*out)


def sketch_ranks(rows: DataFrame, pooled: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """For every pooled percentile whether its true rank among the rows is within ``RANK_ERROR`` (and one value,
    because a rank falls between two) of the asked one. A group without values is right if it has none."""
    names = {(c, q): f"{f}_p{percent(q)}" for c, f in FLUIDS.items() for q in probs}
    size = pooled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    both = rows.select(*keys, *FLUIDS).join(broadcast_if_small(pooled, (size.n, size.bytes)), list(keys))
    counts = [F.count(c).alias(f"_n_{c}") for c in FLUIDS]
    for (c, _), name in names.items():
        counts += [F.count_if(F.col(c) < F.col(name)).alias(f"_lt_{name}"), F.count_if(F.col(c) <= F.col(name)).alias(f"_le_{name}")]
    found = both.groupBy(*keys).agg(*counts)
    checks = []
    for (c, q), name in names.items():
        n, slack = F.col(f"_n_{c}"), F.lit(RANK_ERROR) * F.col(f"_n_{c}") + 1
        near = (F.col(f"_lt_{name}") <= q * n + slack) & (F.col(f"_le_{name}") >= q * n - slack)
        checks.append(F.when(n == 0, F.lit(True)).otherwise(near).alias(f"{name}_ok"))
    return found.select(*keys, *checks)
