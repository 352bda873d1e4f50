from __future__ import annotations

import pytest
from conftest import by_key, d
from pyspark.sql import functions as F

from prodlens.plans import quality
from prodlens.sources import sinks


@pytest.fixture(scope="module")
def official(spark):
    oil = spark.createDataFrame(
        [("2020-02", 110.0, 111.0, 100.0, 10.0), ("2020-03", 20.0, 25.0, 0.0, 20.0), ("2030-01", 1.0, 1.0, 1.0, 1.0)],
        "indice_tiempo string, total double, cuenca_neuquina double, shale double, tight double",
    ).withColumns({"total_diario": F.col("total") / 29, "kbbl_diario": F.col("total") / 29 * 6.28981 / 1000})
    gas = spark.createDataFrame(
        [("2020-02", 1010.0, 5.0, 1000.0)],
        "indice_tiempo string, produccion_gas_natural_cuenca_neuquina double, produccion_shale_gas double, produccion_tight_gas double",
    )
    return oil, gas


def test_counts_orphans_duplicates(panel):
    counts = by_key(quality.row_counts({"wells": panel["wells"]}, {"wells": 7}), "table_name")
    assert counts["wells"].n_rows == 6 and counts["wells"].delta == -1
    assert quality.orphans(panel["jobs"], panel["wells"], "idpozo").first().orphans == 1
    assert quality.orphans(panel["monthly_production"], panel["wells"], "idpozo").first().orphans == 0
    assert quality.duplicate_keys(panel["monthly_production"], ["idpozo", "fecha"]).first().duplicates == 0
    assert quality.duplicate_keys(panel["well_events"], ["idpozo", "event_date"]).first().duplicates == 1
    assert quality.duplicate_keys(panel["register"], ["idpozo"]).first().duplicates == 1


def test_reconciliation(panel, official):
    got = by_key(quality.reconcile_basins(panel["monthly_production"], panel["wells"], *official), "fluid", "series")
    oil = got[("oil", "NEUQUINA")]
    assert oil.months == 2 and oil.own_total == 130.0 and oil.official_total == 136.0
    assert oil.diff_pct == pytest.approx(-6 / 136 * 100) and oil.worst_month_pct == pytest.approx(20.0)
    assert got[("gas", "NEUQUINA")].diff_pct == 0.0
    split = by_key(quality.reconcile_subtypes(panel["monthly_production"], panel["wells"], *official), "fluid", "series")
    assert split[("oil", "SHALE")].own_total == 100.0 and split[("gas", "TIGHT")].official_total == 1000.0


def test_barrel_factor_from_the_published_month(spark):
    oil = spark.createDataFrame(
        [("2006-01", 3019656.7, 97408.28, 97408.28 * 6.28981 / 1000)],
        "indice_tiempo string, total double, total_diario double, kbbl_diario double",
    )
    row = quality.unit_rederivation(oil, 4).first()
    assert row.days == 31 and row.derived_daily == pytest.approx(97408.28, abs=0.01)
    assert row.factor == pytest.approx(6.28981, abs=1e-5)
    assert quality.mean_factor(quality.unit_rederivation(oil), 6.28981).first().off_pct < 0.001
    gas = spark.createDataFrame([("2006-01", 3100.0, 0.1)], "indice_tiempo string, produccion_gas_natural_total double, produccion_gas_natural_total_diario double")
    assert quality.gas_unit_ratio(gas).first().scale == pytest.approx(1000.0)


def test_census(panel):
    p = panel["monthly_production"]
    neg = by_key(quality.negative_census(p), "column_name")
    assert neg["prod_pet"].negative == 1 and neg["tef"].negative == 0
    nz = by_key(quality.null_zero_census(p), "column_name")
    assert (nz["prod_pet"].n_null, nz["prod_pet"].n_zero) == (1, 2)
    assert nz["prod_gas"].pct_null == pytest.approx(3 / 9 * 100)
    row = quality.ceiling_check(p).first()
    assert (row.max_hours, row.rows_over_ceiling) == (900.0, 1)


def test_geometry(spark, panel):
    row = quality.srid_histogram(panel["wells"]).first()
    assert row.prefix == "0101000020E6100000" and row.n == 6 and row.srid == 4326
    registry = spark.createDataFrame(
        [(1, '{"coordinates":[-68.0,-38.0]}'), (2, '{"coordinates":[-68.213,-38.5]}'), (3, '{"coordinates":[-60,-40]}'),
         (4, None), (5, "broken"), (6, '{"coordinates":[-69.10005,-33.1]}')],
        "idpozo long, geojson string",
    )
    row = quality.coordinate_agreement(panel["wells"], quality.registry_points(registry)).first()
    assert (row.matched, row.no_coordinate, row.comparable, row.identical) == (5, 2, 3, 1)
    assert (row.under_10m, row.under_1km, row.over_1km) == (1, 0, 1)
    assert row.no_coordinate + row.identical + row.under_10m + row.under_1km + row.over_1km == row.matched
    assert row.max_deg == pytest.approx(0.287) and row.max_dlat == 0.0 and row.p99_deg <= row.max_deg
    bounds = quality.coordinate_bounds(panel["wells"]).first()
    assert (bounds.missing, bounds.out_of_bounds) == (1, 1)


def test_coverage_and_bands(panel):
    got = by_key(quality.coverage_by(panel["wells"], panel["jobs"], "idpozo", "tipo_recurso"), "tipo_recurso")
    assert got["NO CONVENCIONAL"].covered == 2 and got["CONVENCIONAL"].coverage_pct == 25.0
    reg = quality.register_coverage(panel["wells"], panel["register"]).first()
    assert (reg.wells, reg.matched) == (6, 2)
    bands = quality.threshold_bands(panel["jobs"]).first()
    assert tuple(bands) == (2, 0, 2, 0)


def test_totals_agree_edges(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    b = spark.createDataFrame([(3.0,)], "y double")
    empty = spark.createDataFrame([], "y double")
    assert quality.totals_agree(a, b, {"v": ("x", "y")}).first().ok
    assert not quality.totals_agree(a, empty, {"v": ("x", "y")}).first().ok
    assert not quality.totals_agree(a, spark.createDataFrame([(3.00001,)], "y double"), {"v": ("x", "y")}).first().ok


def test_findings_and_gate(spark, panel, official, tmp_path):
    tables = {t: panel[t] for t in ("wells", "monthly_production", "well_operator_history", "well_events")}
    found = quality.verify(tables, *official, panel["jobs"], panel["register"], documented={"wells": 6}).cache()
    assert {"row_counts", "orphans", "reconciliation", "nulls", "srid", "threshold_bands"} <= {r.check_name for r in found.collect()}
    status = {(r.check_name, r.subject): r.status for r in found.collect()}
    assert status[("orphans", "well_events")] == "pass" and status[("hours", "all")] == "info"
    quality.gate(found.where("check_name <> 'bbl_per_m3'"))
    sinks.write_findings(found, str(tmp_path / "findings"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "findings" / "markdown")).collect()]
    assert len(lines) == found.count() + 2 and "| orphans | wells | orphans | 0.0 | pass |" not in lines
    assert "| orphans | well_events | orphans | 0.0 | pass |" in lines
    assert spark.read.json(str(tmp_path / "findings" / "json")).count() == found.count()
    stray = panel["well_events"].limit(1).withColumn("idpozo", F.lit(77).cast("long")).withColumn("event_date", F.lit(d("2020-01-01")))
    tables["well_events"] = panel["well_events"].unionByName(stray)
    with pytest.raises(quality.QualityGateError, match="orphans/well_events"):
        quality.gate(quality.verify(tables, *official, panel["jobs"], panel["register"]))


def test_budget(spark):
    manifest = spark.createDataFrame([("cube", 10), ("cube", 20), ("wells", 5)], "output string, bytes long")
    got = by_key(quality.budget_check(manifest, {"cube": 29, "wells": 5, "gone": 1}), "output")
    assert not got["cube"].ok and got["cube"].largest_file == 20 and got["wells"].ok and not got["gone"].ok
