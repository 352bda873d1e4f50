"""Enrichment: jobs, production history and attributes per well, and the dated fact.

Every table here is keyed by the well, so after the first shuffle by ``idpozo`` the joins
and the aggregates that follow reuse that partitioning. Job and event tables may hold very
many rows of one well; they are aggregated with a map-side combine before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.functions.dates import clamp_hours, date_from_parts
from prodlens.functions.units import or_zero, ratio
from prodlens.operators.aggregates import dedupe_groups
from prodlens.operators.classify import HORIZONTAL_M, combined_class, measured_class, name_class
from prodlens.operators.temporal import RowGuard, RowGuardError, asof_join, interval_join, latest_row, require_disjoint_spans

WELL = "idpozo"
MONTH = "fecha"


def is_producing() -> Column:
    """Oil plus gas above zero, a missing volume counting as nothing."""
    return (or_zero("prod_pet") + or_zero("prod_gas")) > 0


# How each job column rolls up: a length belongs to the well, consumption adds, a pressure is a peak.
JOB_RULES = {
    "frac_jobs": F.sum,
    "lateral_m": F.max,
    "stages": F.sum,
    "proppant_t": F.sum,
    "water_m3": F.sum,
    "max_pressure_psi": F.max,
    "max_hhp": F.max,
    "frac_first": F.min,
    "frac_last": F.max,
}
JOB_MODES = ("completion_type", "frac_formation")


def well_frac(jobs: DataFrame) -> DataFrame:
    """Fracture jobs to one row per well. Unreadable dates are NULL; ties of the commonest
    completion go to the first in order.

    Jobs are first rolled up per well and category with fixed-width states, which a hash
    aggregate combines before the shuffle; the commonest categories are then found on that
    short table instead of keeping a map of values per well.
    """
    as_date = lambda c: F.col(c).try_cast("date")
    named = jobs.select(
        WELL,
        F.lit(1).cast("long").alias("frac_jobs"),
        F.col("longitud_rama_horizontal_m").alias("lateral_m"),
        F.col("cantidad_fracturas").cast("long").alias("stages"),
        (or_zero("arena_bombeada_nacional_tn") + or_zero("arena_bombeada_importada_tn")).alias(
            "proppant_t"
        ),
        F.col("agua_inyectada_m3").alias("water_m3"),
        F.col("presion_maxima_psi").alias("max_pressure_psi"),
        F.col("potencia_equipos_fractura_hp").alias("max_hhp"),
        as_date("fecha_inicio_fractura").alias("frac_first"),
        as_date("fecha_fin_fractura").alias("frac_last"),
        F.col("tipo_terminacion").alias("completion_type"),
        F.col("formacion_productiva").alias("frac_formation"),
    )
    roll_up = [rule(F.col(c)).alias(c) for c, rule in JOB_RULES.items()]
    cells = named.groupBy(WELL, *JOB_MODES).agg(*roll_up).repartition(WELL)
    for c in JOB_MODES:
        cells = cells.withColumn(f"_n_{c}", F.sum("frac_jobs").over(Window.partitionBy(WELL, c)))
    commonest = [
        F.min_by(
            F.col(c), F.when(F.col(c).isNotNull(), F.struct((-F.col(f"_n_{c}")).alias("n"), F.col(c)))
        ).alias(c)
        for c in JOB_MODES
    ]
    return cells.groupBy(WELL).agg(*roll_up, *commonest)


def well_prod_summary(production: DataFrame, missing_hours_are_full: bool = False) -> DataFrame:
    """First and last producing month, producing months, cumulatives and clamped hours per well."""
    month = F.when(is_producing(), F.col(MONTH))
    return production.groupBy(WELL).agg(
        F.min(month).alias("first_prod_month"),
        F.max(month).alias("last_prod_month"),
        F.count(month).alias("producing_months"),
        F.sum("prod_pet").alias("cum_oil_m3"),
        F.sum("prod_gas").alias("cum_gas_e3m3"),
        F.sum("prod_agua").alias("cum_water_m3"),
        F.sum("iny_agua").alias("cum_water_inj_m3"),
        F.sum(clamp_hours("tef", MONTH, missing_hours_are_full)).alias("total_effective_hours"),
    )


def first_production(register: DataFrame) -> DataFrame:
    """First declared month per well; a well listed twice takes the earlier month."""
    return register.groupBy(WELL).agg(
        F.min(date_from_parts("anio", "mes")).alias("first_prod_declared")
    )


def latest_operator(history: DataFrame) -> DataFrame:
    cols = {"empresa": "operator_latest", "idempresa": "operator_code_latest"}
    return latest_row(history, WELL, "valid_from", cols)


def latest_state(events: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    cols = {
        "tipopozo": "well_fluid_latest",
        "tipoestado": "well_state_latest",
        "tipoextraccion": "lift_method_latest",
    }
    return latest_row(events, WELL, "event_date", cols, tie_break)


def intensities() -> list[Column]:
    """Completion intensity and gas-oil ratio; a zero or missing divisor gives NULL."""
    lateral, stages = F.col("lateral_m"), F.col("stages").cast("double")
    return [
        ratio(F.col("proppant_t"), lateral, 1000.0).alias("proppant_kg_per_m"),
        ratio(F.col("water_m3"), lateral).alias("water_m3_per_m"),
        ratio(lateral, stages).alias("stage_spacing_m"),
        ratio(F.col("cum_gas_e3m3"), F.col("cum_oil_m3"), 1000.0).alias("gor_m3_m3"),
    ]


def well_attrs(
    wells: DataFrame,
    history: DataFrame,
    events: DataFrame,
    register: DataFrame,
    production: DataFrame,
    jobs: DataFrame,
    cut_m: float = HORIZONTAL_M,
    event_tie_break: list[str] | None = None,
    null_length_is_unknown: bool = False,
    missing_hours_are_full: bool = False,
) -> DataFrame:
    """One row per well: identity, latest operator and state, history, jobs and classes.

    All five right sides are unique per well, so no join can add rows.
    """
    joined = wells
    for side in (
        latest_operator(history),
        latest_state(events, event_tie_break),
        first_production(register),
        well_prod_summary(production, missing_hours_are_full),
        well_frac(jobs),
    ):
        joined = joined.join(side, WELL, "left")
    has_record, length, name = F.col("frac_jobs").isNotNull(), F.col("lateral_m"), F.col("sigla")
    identity = [
        WELL, "sigla", "cuenca", "provincia", "area", "yacimiento", "formprod", "formacion",
        "clasificacion", "subclasificacion", "tipo_recurso", "sub_tipo_recurso",
        "profundidad", "cota",
    ]
    derived = [
        "operator_latest", "operator_code_latest",
        "well_fluid_latest", "well_state_latest", "lift_method_latest",
        "first_prod_declared", "first_prod_month", "last_prod_month", "producing_months",
        "cum_oil_m3", "cum_gas_e3m3", "cum_water_m3", "cum_water_inj_m3", "total_effective_hours",
        "frac_jobs", "lateral_m", "stages", "proppant_t", "water_m3", "max_pressure_psi",
        "max_hhp", "frac_first", "frac_last", "completion_type",
    ]
    return joined.select(
        *identity,
        F.col("coordenadax").alias("lon"),
        F.col("coordenaday").alias("lat"),
        "has_production",
        *derived,
        measured_class(has_record, length, cut_m).alias("trajectory"),
        name_class(name).alias("name_marker"),
        combined_class(has_record, length, name, cut_m, null_length_is_unknown).alias(
            "trajectory_class"
        ),
        *intensities(),
    )


def prod_monthly(
    production: DataFrame,
    history: DataFrame,
    events: DataFrame,
    event_tie_break: list[str] | None = None,
    check_spans: bool = True,
    check_grain: bool = True,
    asof_strategy: str = "spans",
    missing_hours_are_full: bool = False,
    guard: RowGuard | None = None,
) -> DataFrame:
    """The monthly fact with the operator and the state in force in each month.

    Overlapping operator spans would repeat months and inflate every total after this, so
    they are looked for in the (small) history table first and reported by well. Months are joined to
    spans by well alone, which is bounded only while a well has one row a month: that is checked too.
    A ``guard`` counts the months that go in and come out while the caller writes the result.
    """
    if check_grain and (n := dedupe_groups(production, [WELL, MONTH]).count()):
        raise RowGuardError(f"{n} pairs of {WELL} and {MONTH} occur more than once")
    if check_spans:
        history = require_disjoint_spans(history, WELL, "valid_from", "valid_to")
    if guard:
        production = guard.before(production)
    tef = clamp_hours("tef", MONTH, missing_hours_are_full)
    hours = production.withColumn("tef", tef).select(
        WELL, MONTH, "anio", "prod_pet", "prod_gas", "prod_agua", "iny_agua", "iny_gas", "tef"
    )
    owned = interval_join(
        hours, history, WELL, MONTH, "valid_from", "valid_to", {"empresa": "operator_asof"}
    )
    states = {"tipopozo": "well_fluid_asof", "tipoestado": "well_state_asof"}
    out = asof_join(
        owned, events, WELL, MONTH, "event_date", states, event_tie_break, strategy=asof_strategy
    )
    return guard.after(out) if guard else out
