"""Monthly cubes over the dated fact and the well attributes. No value is folded or capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.functions.text import or_label
from prodlens.operators.aggregates import distinct_by_entity
from prodlens.operators.bitmaps import distinct_entities, entity_cells, number_entities
from prodlens.operators.filters import apply_filters
from prodlens.plans.enrich import MONTH, WELL, is_producing

# The names of cube dimensions, slim columns and volumes.
CUBE_DIMS = [
    "cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso",
    "formation", "operator", "well_fluid", "trajectory",
]
BLOCK_DIMS = [
    "cuenca", "area", "yacimiento", "operator", "trajectory", "name_marker", "trajectory_class",
]
VOLUMES = {"prod_pet": "oil_m3", "prod_gas": "gas_e3m3", "prod_agua": "water_m3"}


def agg_monthly(fact: DataFrame, attrs: DataFrame) -> DataFrame:
    """Main cube: month and eight dimensions, well counts, volumes and hours.

    Well counts add up across cells of one month, never along time.
    """
    side = attrs.select(
        WELL, "cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso",
        or_label("formprod").alias("formation"), "trajectory",
    )
    rows = fact.select(
        WELL, MONTH,
        or_label("operator_asof").alias("operator"),
        or_label("well_fluid_asof").alias("well_fluid"),
        *VOLUMES, "iny_agua", "tef",
    ).join(side, WELL)
    sums = {**VOLUMES, "iny_agua": "water_inj_m3", "tef": "effective_hours"}
    return distinct_by_entity(rows, [MONTH, *CUBE_DIMS], WELL, sums, is_producing())


def agg_block(fact: DataFrame, attrs: DataFrame) -> DataFrame:
    """Block cube: month and seven dimensions; wells without a block are left out."""
    side = attrs.where(F.col("area").isNotNull()).select(
        WELL, *[d for d in BLOCK_DIMS if d != "operator"]
    )
    rows = fact.select(
        WELL, MONTH, or_label("operator_asof").alias("operator"), *VOLUMES
    ).join(side, WELL)
    return distinct_by_entity(rows, [MONTH, *BLOCK_DIMS], WELL, VOLUMES, is_producing())


# What a well is, not what it does: such dimensions leave each well in one cell a month.
WELL_DIMS = ["cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso", "trajectory"]


def agg_entities(fact: DataFrame, attrs: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Cube of months and well dimensions with bitmaps of the wells, present and producing."""
    dims = dims or WELL_DIMS
    numbers = number_entities(attrs, WELL, dims)
    rows = fact.select(WELL, MONTH, *VOLUMES).join(attrs.select(WELL, *dims), WELL).join(numbers, WELL)
    return entity_cells(rows, [MONTH, *dims], "number", {"producing": is_producing()})


def wells_over(cells: DataFrame, keys: list, filters: dict | None = None) -> DataFrame:
    """Distinct wells, all and producing, of any months and dimensions, from ``agg_entities`` alone. ``keys``
    are columns or expressions such as the year of the month; ``filters`` may restrict both."""
    chosen = apply_filters(cells, filters or {})
    return distinct_entities(chosen, keys, {"present": "wells", "producing": "wells_producing"})


# Column of the slim well table -> column of the attributes.
SLIM_COLUMNS = {
    "idpozo": "idpozo", "sigla": "sigla", "cuenca": "cuenca", "provincia": "provincia",
    "area": "area", "yacimiento": "yacimiento", "formation": "formprod",
    "formation_reported": "formacion", "tipo_recurso": "tipo_recurso",
    "sub_tipo_recurso": "sub_tipo_recurso", "clasificacion": "clasificacion",
    "operator": "operator_latest", "well_fluid": "well_fluid_latest",
    "well_state": "well_state_latest", "lift_method": "lift_method_latest",
    "trajectory": "trajectory", "name_marker": "name_marker",
    "trajectory_class": "trajectory_class", "completion_type": "completion_type",
    "lon": "lon", "lat": "lat", "depth_m": "profundidad",
    "first_prod_declared": "first_prod_declared", "first_prod_month": "first_prod_month",
    "last_prod_month": "last_prod_month", "producing_months": "producing_months",
    "cum_oil_m3": "cum_oil_m3", "cum_gas_e3m3": "cum_gas_e3m3", "cum_water_m3": "cum_water_m3",
    "lateral_m": "lateral_m", "stages": "stages", "proppant_t": "proppant_t",
    "frac_water_m3": "water_m3", "max_pressure_psi": "max_pressure_psi",
    "proppant_kg_per_m": "proppant_kg_per_m", "water_m3_per_m": "water_m3_per_m",
    "stage_spacing_m": "stage_spacing_m", "gor_m3_m3": "gor_m3_m3",
}


def wells_slim(attrs: DataFrame, degrees: int = 6) -> DataFrame:
    """The well table for maps and statistics; coordinates rounded."""
    shown = {
        name: F.round(F.col(src), degrees) if name in ("lon", "lat") else F.col(src)
        for name, src in SLIM_COLUMNS.items()
    }
    return attrs.select(*[c.alias(name) for name, c in shown.items()])


def well_history(fact: DataFrame) -> DataFrame:
    """The columns of the per-well drill-down."""
    return fact.select(
        WELL, MONTH, *[F.col(c).alias(o) for c, o in VOLUMES.items()], F.col("tef").alias("effective_hours")
    )
