from __future__ import annotations

import pytest
from conftest import by_key, d
from pyspark.sql import functions as F

from prodlens.operators.classify import combined_class, measured_class, name_class
from prodlens.plans import enrich


def test_job_rules(panel):
    got = by_key(enrich.well_frac(panel["jobs"]), "idpozo")
    one = got[1]
    assert one.frac_jobs == 2 and one.lateral_m == 500.0 and one.stages == 15
    assert one.proppant_t == 175.0 and one.water_m3 == 1500.0 and one.max_pressure_psi == 9000.0
    assert one.frac_first == d("2019-01-05") and one.frac_last == d("2019-03-09")
    assert one.completion_type == "Jetteo"  # tie goes to the first in order
    assert got[2].frac_last is None  # 30 February cannot be read
    assert got[3].completion_type is None and got[3].frac_jobs == 1
    assert got[3].proppant_t == 0.0
    assert 99 in got


def test_mode_counts_over_all_cells(spark, panel):
    rows = [(7, t, f) for t, f in [("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("b", "z"), ("a", "q"), ("a", None)]]
    jobs = spark.createDataFrame(rows, "idpozo long, tipo_terminacion string, formacion_productiva string")
    missing = [c for c in panel["jobs"].columns if c not in jobs.columns]
    full = jobs.select("*", *[F.lit(None).cast(panel["jobs"].schema[c].dataType).alias(c) for c in missing])
    got = enrich.well_frac(full).first()
    assert got.completion_type == "a" and got.frac_formation == "z" and got.frac_jobs == 7


def test_production_summary(panel):
    got = by_key(enrich.well_prod_summary(panel["monthly_production"]), "idpozo")
    one = got[1]
    assert one.first_prod_month == d("2020-02-01")  # declared zero is not production
    assert one.last_prod_month == d("2021-01-01")
    assert one.producing_months == 2  # the correction of -20 + 5 hides its month
    assert one.cum_oil_m3 == 130.0 and one.cum_gas_e3m3 == 15.0
    # 900 h is cut to 29 x 24; the month without a declaration adds nothing
    assert one.total_effective_hours == 300 + 696 + 720 + 744
    assert got[3].producing_months == 1 and got[3].cum_water_inj_m3 is None
    full = by_key(enrich.well_prod_summary(panel["monthly_production"], missing_hours_are_full=True), "idpozo")
    assert full[1].total_effective_hours == one.total_effective_hours + 744


def test_attributes(attrs, panel):
    got = by_key(attrs, "idpozo")
    assert len(got) == panel["wells"].count()
    one, two, three = got[1], got[2], got[3]
    assert one.operator_latest == "PAE" and one.operator_code_latest == "APEA"
    assert one.well_state_latest == "En Reparación"
    assert one.first_prod_declared == d("2020-01-01")  # listed twice, earlier kept
    assert one.proppant_kg_per_m == pytest.approx(350.0) and one.stage_spacing_m == pytest.approx(500 / 15)
    assert one.gor_m3_m3 == pytest.approx(15000 / 130)
    assert three.proppant_kg_per_m is None and three.stage_spacing_m is None  # zero divisors
    assert (one.trajectory, one.trajectory_class) == ("Horizontal", "Horizontal")
    # a record without a length: unknown as a measurement, directional by name
    assert (two.trajectory, two.trajectory_class, two.name_marker) == ("Unknown", "Directional", "(d) directional")
    assert (three.trajectory, three.trajectory_class) == ("Vertical", "Vertical")
    assert (got[4].trajectory, got[4].trajectory_class) == ("Unknown", "Horizontal")
    assert got[5].trajectory_class == "Directional" and got[4].first_prod_month is None


@pytest.mark.parametrize(
    "record, length, name, measured, combined, strict",
    [
        (True, 499.9, "x(h)", "Vertical", "Vertical", "Vertical"),
        (True, 500.0, "x(d)", "Horizontal", "Horizontal", "Horizontal"),
        (True, 0.0, "x(D)", "Vertical", "Directional", "Directional"),
        (True, None, "x", "Unknown", "Vertical", "Unknown"),
        (True, None, "x(h)", "Unknown", "Vertical", "Horizontal"),
        (False, None, "x(h)(d)", "Unknown", "Horizontal", "Horizontal"),
        (False, None, None, "Unknown", "Unknown", "Unknown"),
    ],
)
def test_class_chains(spark, record, length, name, measured, combined, strict):
    row = spark.createDataFrame([(record, length, name)], "r boolean, l double, n string")
    r, l, n = F.col("r"), F.col("l"), F.col("n")
    got = row.select(
        measured_class(r, l), combined_class(r, l, n), combined_class(r, l, n, null_length_is_unknown=True), name_class(n)
    ).first()
    assert tuple(got)[:3] == (measured, combined, strict)


def test_dated_fact(fact, panel):
    got = by_key(fact, "idpozo", "fecha")
    assert len(got) == panel["monthly_production"].count() == fact.count()
    assert got[(1, d("2020-02-01"))].tef == 696.0 and got[(1, d("2020-03-01"))].tef is None
    assert got[(1, d("2020-04-01"))].prod_pet == -20.0
    assert got[(1, d("2020-03-01"))].operator_asof is None
    assert got[(1, d("2020-03-01"))].well_fluid_asof == "Gasífero"


def test_both_asof_strategies_give_the_same_fact(fact, panel):
    other = enrich.prod_monthly(
        panel["monthly_production"], panel["well_operator_history"], panel["well_events"], ["event_id"], asof_strategy="fill"
    )
    assert fact.exceptAll(other).count() == 0 and other.exceptAll(fact).count() == 0
