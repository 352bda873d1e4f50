from __future__ import annotations

import pytest
from conftest import d
from pyspark.sql import functions as F

from prodlens.operators import aggregates, filters
from prodlens.plans.spec import Measure, QueryEngine, QuerySpec, SpecError, pick_cube, with_time_range


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [("a", "x", 1.0, d("2020-01-01")), ("a", "y", None, d("2020-02-01")), ("b", "x", 5.0, d("2020-03-01")),
         ("c", None, None, None), (None, "z", -2.0, d("2021-01-01"))],
        "g string, h string, v double, t date",
    )


def values(df, col="v"):
    return sorted((r[col] for r in df.collect()), key=lambda x: (x is None, x))


def test_filter_rules(table):
    assert filters.apply_filters(table, {"g": []}).count() == 5  # empty list: no constraint
    assert filters.apply_filters(table, {"g": None}).count() == 5
    assert filters.apply_filters(table, {"g": ["nope"]}).count() == 0
    assert values(filters.apply_filters(table, {"v": {"min": -2, "max": 1}})) == [-2.0, 1.0]
    assert filters.apply_filters(table, {"v": {}}).count() == 3  # NULL never passes a range
    assert filters.apply_filters(table, {"t": {"max": "2020-02-01"}}).count() == 2
    assert filters.apply_filters(table, {"v": [1.0]}).count() == 1  # lists work on any type


def test_reports(table):
    asked = {"g": ["a", "zz"], "area": ["x"], "other": [], "h": ["x"]}
    assert filters.unsupported_filters(table, asked) == ["area"]
    assert [(r.dim, r.value) for r in filters.unmatched_values(table, asked).collect()] == [("g", "zz")]
    assert {tuple(r) for r in filters.filter_report(table, asked).collect()} == {("unsupported", "area", None), ("unmatched", "g", "zz")}
    assert filters.filter_report(table, {}).count() == 0


def test_narrow_never_overrides(table):
    assert filters.narrow({"h": ["x", "z"]}, "h", ["x", "y"]) == {"h": ["x"]}
    assert filters.narrow({}, "h", ["x", "y"]) == {"h": ["x", "y"]}
    nothing = filters.narrow({"h": ["z"]}, "h", ["x", "y"])
    assert nothing is None and filters.apply_narrowed(table, nothing).count() == 0


def test_spec_groups_orders_and_limits(table):
    engine = QueryEngine({"t": table})
    spec = {"source": "t", "groupBy": ["g"], "measures": [
        {"as": "s", "col": "v", "agg": "sum"}, {"as": "m", "col": "v", "agg": "mean"},
        {"as": "n", "agg": "count"}, {"as": "k", "col": "h", "agg": "countDistinct"}], "orderBy": "s"}
    assert [(r.g, r.s, r.m, r.n, r.k) for r in engine.compile(spec).collect()] == [
        ("b", 5.0, 5.0, 1, 1), ("a", 1.0, 1.0, 2, 2), (None, -2.0, -2.0, 1, 1), ("c", None, None, 1, 0)]
    low = engine.compile({**spec, "order": "asc", "limit": 2}).collect()
    assert [r.g for r in low] == ["c", None]  # NULL measures first when ascending
    zero = QueryEngine({"t": table}, zero_fill_sum=True)
    assert {r.g: r.s for r in zero.compile(spec).collect()}["c"] == 0.0
    total = engine.compile({"source": "t", "filters": {"g": ["nope"]}, "measures": [{"as": "n", "agg": "count"}]})
    assert total.first().n == 0
    assert engine.compile(QuerySpec("t", group_by=("g",))).count() == 4
    assert engine.rows("t", {"g": ["a"]}).count() == 2


@pytest.mark.parametrize(
    "bad",
    [
        {"source": "nope"},
        {"source": "t", "groupBy": ["q"]},
        {"source": "t", "measures": [{"as": "x", "col": "v", "agg": "median"}]},
        {"source": "t", "measures": [{"as": "x", "col": "q", "agg": "sum"}]},
        {"source": "t", "groupBy": ["g"], "orderBy": "s"},
        {"source": "t", "groupBy": ["g"], "orderBy": "g", "order": "up"},
        {"source": "t", "filters": {"area": ["x"]}},
    ],
)
def test_spec_errors(table, bad):
    with pytest.raises(SpecError):
        QueryEngine({"t": table}).compile(bad)


def test_lenient_engine_reports_instead(table):
    engine = QueryEngine({"t": table}, strict=False)
    engine.register("u", table)
    out = engine.compile(QuerySpec("u", {"area": ["x"]}, measures=(Measure("n", agg="count"),)))
    assert out.first().n == 5
    absent, unmatched = engine.report("u", {"area": ["x"], "g": ["q"]})
    assert absent == ["area"] and unmatched.count() == 1


def test_cube_choice_and_time_range():
    assert pick_cube("cuenca", {}) == "cube" and pick_cube("area", {}) == "block"
    assert pick_cube("cuenca", {"area": ["x"]}) == "block" and pick_cube("cuenca", {"area": []}) == "cube"
    span = {"min": "2020-01-01", "max": "2020-12-01"}
    assert with_time_range({"a": ["x"]}, "fecha", span) == {"a": ["x"], "fecha": span}
    assert with_time_range({"a": ["x"]}, None, span) == {"a": ["x"]}


def test_filters_reach_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    engine = QueryEngine({"t": spark.read.parquet(str(tmp_path / "t"))})
    plan = engine.compile(
        {"source": "t", "filters": {"g": ["a"], "v": {"min": 0}}, "groupBy": ["g"], "measures": [{"as": "s", "col": "v", "agg": "sum"}]}
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(g,a)" in plan and "GreaterThanOrEqual(v" in plan
    assert "ReadSchema: struct<g:string,v:double>" in plan


def test_top_k_other_and_dense(spark):
    rows = [(m, k, float(v)) for m in ("1", "2", "3") for k, v in (("a", 9), ("b", 5), ("c", 2), (None, 4), ("e", 1))]
    rows = [r for r in rows if not (r[0] == "2" and r[1] == "b")] + [("3", "a", None)]
    df = spark.createDataFrame(rows, "m string, k string, v double")
    folded = {(r.m, r.k): r.v for r in aggregates.top_k_with_other(df, "m", "k", "v", 3).collect()}
    assert folded[("1", "Other")] == 3.0 and folded[("1", None)] == 4.0 and ("2", "b") not in folded
    assert sum(folded.values()) == sum(r[2] or 0 for r in rows)
    dense = {(r.m, r.k): r.v for r in aggregates.dense_top_series(df, "m", "k", "v", 3).collect()}
    assert len(dense) == 9 and dense[("2", "b")] == 0.0 and ("1", "c") not in dense
    plan = aggregates.dense_top_series(df, "m", "k", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_most_frequent_and_domains(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "x"), ("B", "q"), ("B", "p"), (None, "z"), ("C", None)], "c string, n string")
    assert {r.c: r.n for r in aggregates.code_names(df, "c", "n").collect()} == {"A": "x", "B": "p"}
    got = {(r.dim, r.value): r.n for r in aggregates.domain_counts(df, ["c", "n"], "(sin dato)").collect()}
    assert got[("c", "A")] == 3 and got[("c", "(sin dato)")] == 1 and got[("n", "(sin dato)")] == 1


def test_share_guards(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, v double")
    assert [r.s for r in aggregates.share_of_total(df, "v", "s").collect()] == [None, None]
    out = aggregates.share_by_month(df.limit(0), df, "k", "v", "p")
    assert {r.k: r.p for r in out.select("k", F.col("p")).collect()} == {"a": None, "b": None}


def test_search_keeps_what_is_selected(spark):
    df = spark.createDataFrame([("Neuquén",), ("Chubut",), ("Salta",)], "v string")
    found = lambda *a: sorted(r.v for r in filters.search_values(df, "v", *a).collect())
    assert found("NEUQUEN") == ["Neuquén"] and found("neu", ["Salta"]) == ["Neuquén", "Salta"]
    assert len(found(" ")) == 3 and found("zzz") == []
