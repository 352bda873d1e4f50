"""Compositions a reader asks for: breakdowns, overview figures and curve comparison."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.functions.units import to_oilfield
from prodlens.operators.aggregates import (
    dense_top_series,
    share_by_month,
    share_of_total,
    top_k,
    top_k_with_other,
)
from prodlens.operators.filters import apply_filters, apply_narrowed, is_active, narrow, split_filters
from prodlens.plans.curves import newest_vintages, pooled_curve
from prodlens.plans.enrich import MONTH, WELL
from prodlens.plans.spec import pick_cube

# The resource subtypes counted as unconventional.
UNCONVENTIONAL = ("SHALE", "TIGHT")

BREAKDOWN_MEASURES = {"oil": "oil_m3", "gas": "gas_e3m3", "water": "water_m3"}

# Curve columns a filter may use, by the name the filter has elsewhere.
CURVE_FILTERS = {
    "trajectory": "trajectory",
    "cuenca": "cuenca",
    "operator": "operator",
    "formation": "formation",
    "area": "area",
    "sub_tipo_recurso": "subtype",
}
CURVE_LAST_SHOWN = 60


def breakdown_series(cube: DataFrame, dim: str, measure: str, filters: Mapping[str, Any], k: int = 8) -> DataFrame:
    """Monthly series of the k largest values and ``Other``."""
    return top_k_with_other(apply_filters(cube, filters), MONTH, dim, measure, k)


def breakdown_table(cube: DataFrame, dim: str, filters: Mapping[str, Any]) -> DataFrame:
    """Oil, gas, water per value and the share of oil. Well counts do not add along time, so
    there are none here; ``wells_over_time`` gives their monthly maximum and mean."""
    sums = apply_filters(cube, filters).groupBy(dim).agg(
        *[F.sum(c).alias(name) for name, c in BREAKDOWN_MEASURES.items()]
    )
    return share_of_total(sums, "oil", "oil_share")


def sort_breakdown(table: DataFrame, dim: str, by: str = "oil", order: str = "desc") -> DataFrame:
    """Sorted as labelled: names in language order, measures with NULL at the low end."""
    if by == "key":
        name = F.collate(F.coalesce(F.col(dim).cast("string"), F.lit("")), "UNICODE")
        return table.orderBy(name.asc() if order == "asc" else name.desc())
    c = F.col(by)
    return table.orderBy(c.asc_nulls_first() if order == "asc" else c.desc_nulls_last(), dim)


def wells_over_time(cube: DataFrame, dim: str, filters: Mapping[str, Any]) -> DataFrame:
    """Per value the largest and the mean monthly well count."""
    monthly = apply_filters(cube, filters).groupBy(dim, MONTH).agg(F.sum("wells").alias("w"))
    return monthly.groupBy(dim).agg(F.max("w").alias("wells_max"), F.avg("w").alias("wells_mean"))


def export_columns(table: DataFrame, dim: str, oilfield: bool = False) -> DataFrame:
    """A breakdown in the units chosen for display."""
    shown = lambda m: to_oilfield(F.col(m), m) if oilfield else F.col(m)
    return table.select(dim, *[shown(m).alias(m) for m in BREAKDOWN_MEASURES])


def explore(cubes: Mapping[str, DataFrame], dim: str, filters: Mapping[str, Any]) -> tuple[str, DataFrame]:
    """The cube that can answer, and its breakdown; a filter that cube cannot apply is refused."""
    name = pick_cube(dim, filters)
    return name, sort_breakdown(breakdown_table(cubes[name], dim, filters), dim)


def overview_totals(cube: DataFrame, wells: DataFrame, filters: Mapping[str, Any], well_filters: Mapping[str, Any]) -> DataFrame:
    """One row: volumes of the selection, its unconventional oil share and its wells.

    The share's numerator narrows the user's own selection, so it cannot exceed 100.
    """
    chosen = apply_filters(cube, filters)
    part = narrow(filters, "sub_tipo_recurso", UNCONVENTIONAL)
    unconventional = apply_narrowed(cube, part).agg(F.coalesce(F.sum("oil_m3"), F.lit(0.0))).scalar()
    counts = (
        apply_filters(wells, well_filters)
        .agg(
            F.struct(
                F.count("*").alias("n"),
                F.count_if(F.col("trajectory") == "Horizontal").alias("horizontal"),
            )
        )
        .scalar()
    )
    totals = chosen.agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in BREAKDOWN_MEASURES.items()]
    )
    return (
        totals.withColumn("_u", unconventional)
        .withColumn("_w", counts)
        .select(
            *BREAKDOWN_MEASURES,
            F.when(F.col("oil") != 0, F.col("_u") / F.col("oil") * 100).alias("unconventional_pct"),
            F.col("_w.n").alias("wells"),
            F.col("_w.horizontal").alias("wells_horizontal"),
        )
    )


def unconventional_share(cube: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Percent of each month's oil by unconventional subtype, within the selection."""
    part = apply_narrowed(cube, narrow(filters, "sub_tipo_recurso", UNCONVENTIONAL))
    per_type = part.groupBy(MONTH, "sub_tipo_recurso").agg(F.sum("oil_m3").alias("oil_m3"))
    months = apply_filters(cube, filters)
    types = per_type.select("sub_tipo_recurso").distinct()
    dense = share_by_month(
        _on_every_month(months, types, per_type), months, MONTH, "oil_m3", "pct"
    )
    return dense.select(MONTH, "sub_tipo_recurso", "pct").where(F.col("sub_tipo_recurso").isNotNull())


def _on_every_month(months: DataFrame, types: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells on all months for the subtypes that occur (at most the unconventional ones)."""
    present = types.agg(F.collect_set("sub_tipo_recurso")).scalar()
    grid = (
        months.select(MONTH)
        .distinct()
        .withColumn("_t", present)
        .select(MONTH, F.explode("_t").alias("sub_tipo_recurso"))
    )
    return grid.join(cells, [MONTH, "sub_tipo_recurso"], "left")


def basin_series(cube: DataFrame, measure: str, filters: Mapping[str, Any], k: int = 6) -> DataFrame:
    return dense_top_series(apply_filters(cube, filters), MONTH, "cuenca", measure, k)


def producing_wells(cube: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    return apply_filters(cube, filters).groupBy(MONTH).agg(F.sum("wells_producing").alias("n"))


def largest_operators(cube: DataFrame, filters: Mapping[str, Any], k: int = 12) -> DataFrame:
    sums = apply_filters(cube, filters).groupBy("operator").agg(F.sum("oil_m3").alias("oil"))
    return top_k(sums, "oil", k, tie_break=["operator"])


def best_wells(wells: DataFrame, filters: Mapping[str, Any], by: str = "cum_oil_m3", k: int = 50, ascending: bool = False) -> DataFrame:
    """The k best wells of the selection by any column; wells without a value are left out."""
    return top_k(apply_filters(wells, filters), by, k, ascending, [WELL])


def completion_scatter(wells: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Proppant intensity against cumulative oil, both positive, by trajectory."""
    both = (F.col("proppant_kg_per_m") > 0) & (F.col("cum_oil_m3") > 0)
    return apply_filters(wells, filters).where(both).select(
        WELL,
        F.coalesce("trajectory", F.lit("Unknown")).alias("class"),
        F.col("proppant_kg_per_m").alias("x"),
        F.col("cum_oil_m3").alias("y"),
    )


def curve_filters(filters: Mapping[str, Any], time: str = MONTH) -> tuple[dict[str, Any], list[str]]:
    """Filters renamed for the curve table, and the active ones it cannot apply."""
    usable = {CURVE_FILTERS[n]: s for n, s in filters.items() if n in CURVE_FILTERS and is_active(s)}
    ignored = [n for n, s in filters.items() if n not in CURVE_FILTERS and n != time and is_active(s)]
    return usable, ignored


def compare_curves(
    curve: DataFrame, split: str, fluid: str, filters: Mapping[str, Any], subtype: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Pooled curves by trajectory, subtype or vintage, and the filters not applied.

    Vintages are limited to the newest six and months to the first sixty, which is what the
    comparison is; the curve table itself keeps everything.
    """
    usable, ignored = curve_filters(filters)
    if subtype is not None and split != "subtype":
        usable.setdefault("subtype", [subtype])
    usable, absent = split_filters(curve, usable)
    ignored += [n for n, c in CURVE_FILTERS.items() if c in absent]
    chosen = apply_filters(curve, usable).where(F.col(split).isNotNull())
    if split == "vintage":
        chosen = chosen.join(F.broadcast(newest_vintages(chosen)), "vintage", "left_semi")
    shown = chosen.where(F.col("month_on_prod") <= CURVE_LAST_SHOWN)
    return pooled_curve(shown, split, fluid), ignored
