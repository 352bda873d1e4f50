from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import by_key, d
from pyspark.sql import functions as F

from prodlens.operators import encode
from prodlens.plans import cubes, curves, quality, summary, views


@pytest.fixture(scope="module")
def cube(fact, attrs):
    return cubes.agg_monthly(fact, attrs).cache()


@pytest.fixture(scope="module")
def block(fact, attrs):
    return cubes.agg_block(fact, attrs).cache()


def test_cube_matches_its_source(fact, cube, block):
    rows = quality.cube_matches_source(fact, cube).collect()
    assert all(r.ok for r in rows) and {r.measure for r in rows} == {"oil", "gas"}
    # a well without a block is missing from the block cube, and the check says so
    assert not quality.cubes_match(cube, block).first().ok
    assert block.where(F.col("area").isNull()).count() == 0


def test_cube_cells(cube):
    cells = by_key(cube, "fecha", "cuenca", "sub_tipo_recurso")
    feb = cells[(d("2020-02-01"), "NEUQUINA", "SHALE")]
    assert (feb.wells, feb.wells_producing, feb.oil_m3, feb.effective_hours) == (1, 1, 100.0, 696.0)
    mar = cells[(d("2020-03-01"), "NEUQUINA", "SHALE")]
    assert (mar.wells, mar.wells_producing, mar.oil_m3, mar.operator) == (1, 0, None, "No informado")
    old = cells[(d("2019-12-01"), "GOLFO SAN JORGE", None)]  # NULL subtype kept, NULL formation labelled
    assert old.formation == "No informado" and old.well_fluid == "No informado"


def test_duplicate_rows_count_a_well_once(fact, attrs):
    twice = fact.unionByName(fact)
    assert cubes.agg_monthly(twice, attrs).agg(F.sum("wells")).first()[0] == cubes.agg_monthly(fact, attrs).agg(F.sum("wells")).first()[0]


def test_cube_plan_has_no_expand(fact, attrs):
    plan = cubes.agg_monthly(fact, attrs)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_codes_round_trip(cube):
    labels = encode.label_table(cube, cubes.CUBE_DIMS)
    coded = encode.encode(cube, cubes.CUBE_DIMS, labels)
    assert {r.sub_tipo_recurso for r in coded.collect()} == {-1, 0, 1}
    back = encode.decode(coded, cubes.CUBE_DIMS, labels)
    assert back.exceptAll(cube.select(back.columns)).count() == 0 and back.count() == cube.count()
    encode.require_labels(labels, cubes.CUBE_DIMS)
    with pytest.raises(ValueError, match="tc_area"):
        encode.require_labels(labels, [*cubes.CUBE_DIMS, "tc_area"])


def test_gloss(spark):
    names = spark.createDataFrame([("VMUT", "vaca muerta"), ("CORI", "cori"), ("X", "la (alta)-baja")], "code string, name string")
    df = spark.createDataFrame(
        [("VMUT", "Petrolífero", "NOROESTE"), ("CORI", "Acuífero", "NEUQUINA"), ("X", "Nuevo", None)],
        "formation string, well_fluid_latest string, cuenca string",
    )
    out = encode.gloss(df, df.columns, encode.gloss_table(spark, names))
    assert {tuple(r) for r in out.collect()} == {
        ("VMUT (Vaca Muerta)", "Petrolífero (Oil)", "NOROESTE (Northwest)"),
        ("CORI", "Acuífero (Aquifer)", "NEUQUINA (Neuquén)"),
        ("X (La (Alta)-Baja)", "Nuevo", None),
    }
    assert encode.has_gloss("formation_reported") and not encode.has_gloss("yacimiento")


@pytest.fixture(scope="module")
def many(spark):
    """Twelve wells on one long history, a third of the rows in one group."""
    rng = random.Random(5)
    rows, wells = [], []
    for w in range(12):
        start = date(2019, 1 + w % 3, 1)
        wells.append((w, start, "Horizontal" if w < 7 else "Vertical", "SHALE", "NEUQUINA", "YPF", "VMUT", None))
        for m in range(130):
            y, mm = divmod(start.month - 1 + m, 12)
            v = None if rng.random() < 0.1 else round(rng.uniform(0, 100), 2)
            rows.append((w, date(start.year + y, mm + 1, 1), v, v and v * 2, None))
    fact = spark.createDataFrame(rows, "idpozo long, fecha date, prod_pet double, prod_gas double, prod_agua double")
    attrs = spark.createDataFrame(
        wells,
        "idpozo long, first_prod_month date, trajectory string, sub_tipo_recurso string, cuenca string, operator_latest string, formprod string, area string",
    )
    return curves.curve_rows(fact, attrs).cache()


def test_type_curve(many):
    curve = curves.type_curve(many)
    got = by_key(curve, "trajectory", "month_on_prod")
    assert set(r.trajectory for r in got.values()) == {"Horizontal", "Vertical"}
    assert max(m for _, m in got) == 119 and min(m for _, m in got) == 0
    assert all(r.wells >= 5 and r.area == "No informado" for r in got.values())
    for r in got.values():
        assert r.oil_p10 is None or r.oil_p10 <= r.oil_p50 <= r.oil_p90
        assert r.water_p50 is None  # never declared: NULL, not zero
    builtin = many.groupBy("trajectory", "month_on_prod").agg(F.percentile("prod_gas", 0.9).alias("q"))
    for r in builtin.collect():
        assert got[(r.trajectory, r.month_on_prod)].gas_p90 == pytest.approx(r.q, abs=0.006)


def test_small_groups_are_suppressed(many):
    keys = ["trajectory", "vintage", "month_on_prod"]
    assert curves.type_curve(many, keys, min_wells=6).where("trajectory = 'Vertical'").count() == 0
    assert curves.type_curve(many, keys, min_wells=8).count() == 0


def test_pooling(many):
    curve = curves.type_curve(many, digits=None).cache()
    one = by_key(curves.pooled_curve(curve, "trajectory", "oil"), "trajectory", "month_on_prod")
    exact = by_key(curves.type_curve(many, ["trajectory", "month_on_prod"], digits=None), "trajectory", "month_on_prod")
    assert one[("Horizontal", 3)].p50 == pytest.approx(exact[("Horizontal", 3)].oil_p50)  # one group: exact
    pooled, ignored = views.compare_curves(curve, "subtype", "oil", {"cuenca": ["NEUQUINA"], "tipo_recurso": ["X"], "fecha": {"min": 1}})
    assert ignored == ["tipo_recurso"] and pooled.agg(F.max("month_on_prod")).first()[0] == 60
    assert views.compare_curves(curve, "vintage", "gas", {}, subtype="TIGHT")[0].count() == 0
    assert [r.vintage for r in curves.newest_vintages(curve).collect()] == [2019]


def test_summary(attrs, cube):
    row = summary.kpi(attrs, cube).first()
    assert (row.wells, row.wells_with_production, row.wells_horizontal, row.wells_vertical, row.wells_unknown_trajectory) == (6, 3, 1, 1, 4)
    assert row.cum_oil_m3 == 167.0
    cov = summary.coverage(cube).first()
    assert (cov.first_month, cov.last_month, cov.months) == (d("2019-12-01"), d("2021-01-01"), 6)
    ym = by_key(summary.national_monthly(cube), "ym")
    assert ym["2020-02"].oil_m3 == 110.0 and ym["2020-02"].wells_producing == 2
    dom = by_key(summary.domains(attrs), "dim", "value")
    assert dom[("sub_tipo_recurso", "(sin dato)")].n == 4 and dom[("well_fluid_latest", "Gasífero")].n == 2


def test_views(cube, attrs):
    table = views.breakdown_table(cube, "sub_tipo_recurso", {})
    assert sum(r.oil_share for r in table.collect() if r.oil_share) == pytest.approx(100)
    assert [r.oil for r in views.sort_breakdown(table, "sub_tipo_recurso").collect()] == [130.0, 30.0, 7.0]
    up = views.sort_breakdown(table, "sub_tipo_recurso", "key", "asc").collect()
    assert [r.sub_tipo_recurso for r in up] == [None, "SHALE", "TIGHT"]
    slim = cubes.wells_slim(attrs)
    total = views.overview_totals(cube, slim, {"sub_tipo_recurso": ["SHALE"]}, {"sub_tipo_recurso": ["SHALE"]}).first()
    assert total.unconventional_pct == 100.0 and (total.wells, total.wells_horizontal) == (1, 1)
    none = views.overview_totals(cube, slim, {"sub_tipo_recurso": ["CBM"]}, {}).first()
    assert none.oil == 0.0 and none.unconventional_pct is None
    share = by_key(views.unconventional_share(cube, {}), "fecha", "sub_tipo_recurso")
    assert share[(d("2020-02-01"), "SHALE")].pct == pytest.approx(100 / 110 * 100)
    assert share[(d("2019-12-01"), "SHALE")].pct == 0.0  # the whole has oil, the part has none
    name, found = views.explore({"cube": cube, "block": cube}, "cuenca", {})
    assert name == "cube" and found.count() == 2
    over_time = by_key(views.wells_over_time(cube, "cuenca", {}), "cuenca")
    assert over_time["NEUQUINA"].wells_max == 2
    best = views.best_wells(slim, {}, "cum_oil_m3", 2).collect()
    assert [r.idpozo for r in best] == [1, 2]
    assert views.completion_scatter(slim, {}).count() == 1
    export = views.export_columns(table, "sub_tipo_recurso", oilfield=True)
    assert {r.sub_tipo_recurso: r.oil for r in export.collect()}["TIGHT"] == pytest.approx(30 * 6.28981)


def test_map(attrs):
    from prodlens.operators import classify

    slim = cubes.wells_slim(attrs)
    pts = by_key(classify.map_points(slim, "idpozo", "lon", "lat", "sub_tipo_recurso", "cum_oil_m3"), "idpozo")
    assert set(pts) == {1, 2, 5, 6}
    assert pts[1].size == pytest.approx(9.6) and pts[5].size == pytest.approx(2.6) and pts[5]["class"] == "(sin dato)"
    split = by_key(classify.box_split(slim, "lon", "lat"), "place")
    assert {k: v.n for k, v in split.items()} == {"inside": 4, "outside": 1, "missing": 1}
    flat = classify.map_points(slim, "idpozo", "lon", "lat", "cuenca", highlight="CUYANA").collect()
    assert {r["class"] for r in flat} == {"CUYANA", "Other"} and {r.size for r in flat} == {3.0}
