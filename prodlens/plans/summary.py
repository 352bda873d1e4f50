"""The small tables a first page needs: coverage, key figures, monthly series, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.functions.dates import year_month
from prodlens.functions.text import NO_DATA, or_label
from prodlens.functions.units import E3M3_TO_MCF, M3_TO_BBL
from prodlens.operators.aggregates import domain_counts
from prodlens.plans.enrich import MONTH

DOMAIN_DIMS = [
    "cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso", "trajectory",
    "well_fluid_latest", "clasificacion",
]

NOTE_ON_WELL_COUNTS = (
    "Well counts are per month: they add up across categories within one month and never along time."
)


def coverage(cube: DataFrame) -> DataFrame:
    """First and last month and the number of months. The months are distinct first, so
    the exact count works on one row per month."""
    months = cube.groupBy(MONTH).agg(F.lit(1).alias("one"))
    return months.agg(
        F.min(MONTH).alias("first_month"), F.max(MONTH).alias("last_month"), F.count(MONTH).alias("months")
    )


def kpi(attrs: DataFrame, cube: DataFrame) -> DataFrame:
    """One row: well counts from one pass over the wells, totals from one pass over the cube."""
    totals = cube.agg(F.struct(F.sum("oil_m3").alias("oil"), F.sum("gas_e3m3").alias("gas"))).scalar()
    is_class = lambda v: F.count_if(F.col("trajectory") == v)
    counts = attrs.agg(
        F.count("*").alias("wells"),
        F.count_if("has_production").alias("wells_with_production"),
        is_class("Horizontal").alias("wells_horizontal"),
        is_class("Vertical").alias("wells_vertical"),
        is_class("Unknown").alias("wells_unknown_trajectory"),
    )
    return counts.withColumn("_t", totals).select(
        *counts.columns, F.col("_t.oil").alias("cum_oil_m3"), F.col("_t.gas").alias("cum_gas_e3m3")
    )


def national_monthly(cube: DataFrame, digits: int = 1) -> DataFrame:
    """Volumes and producing wells per month; ``digits`` of the volumes are kept."""
    return cube.groupBy(year_month(MONTH).alias("ym")).agg(
        *[F.round(F.sum(c), digits).alias(c) for c in ("oil_m3", "gas_e3m3", "water_m3")],
        F.sum("wells_producing").alias("wells_producing"),
    )


def monthly_by(cube: DataFrame, dim: str, name: str | None = None) -> DataFrame:
    """Oil and gas per month and value of one dimension, NULL shown as not reported if renamed."""
    key = or_label(dim).alias(name) if name else F.col(dim)
    return cube.groupBy(year_month(MONTH).alias("ym"), key).agg(
        F.round(F.sum("oil_m3"), 1).alias("oil_m3"), F.round(F.sum("gas_e3m3"), 1).alias("gas_e3m3")
    )


def domains(attrs: DataFrame) -> DataFrame:
    return domain_counts(attrs, DOMAIN_DIMS, NO_DATA)


def about(spark: SparkSession) -> DataFrame:
    """One row of notes: when it was built, what may be added up, and the units."""
    return spark.range(1).select(
        F.current_timestamp().alias("generated"),
        F.lit(NOTE_ON_WELL_COUNTS).alias("note_on_well_counts"),
        F.lit("m3").alias("oil"),
        F.lit("e3m3 (10^3 m3)").alias("gas"),
        F.lit("m3").alias("water"),
        F.lit(M3_TO_BBL).alias("m3_to_bbl"),
        F.lit(E3M3_TO_MCF).alias("e3m3_to_mcf"),
    )


def summary_sections(
    attrs: DataFrame, cube: DataFrame, findings: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every section by name; each is a small aggregate, sorted when written."""
    checked = {} if findings is None else {"data_quality": findings}
    return {
        **checked,
        "about": about(cube.sparkSession),
        "coverage": coverage(cube),
        "kpi": kpi(attrs, cube),
        "national_monthly": national_monthly(cube).orderBy("ym"),
        "basin_monthly": monthly_by(cube, "cuenca").orderBy("ym", "cuenca"),
        "unconventional_monthly": monthly_by(cube, "sub_tipo_recurso", "subtype").orderBy("ym", "subtype"),
        "domains": domains(attrs).orderBy("dim", F.desc("n"), "value"),
    }
