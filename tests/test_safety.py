"""Nothing is lost in silence: filters, headers, folders, names, limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prodlens import common
from prodlens.operators import encode, filters, ranking, temporal
from prodlens.plans import quality, views
from prodlens.plans.spec import QueryEngine, SpecError
from prodlens.sources import intake, scans


def test_absent_filters_are_refused_or_reported(spark):
    cube = spark.createDataFrame([("a", 1.0, 1.0, 1.0)], "yacimiento string, oil_m3 double, gas_e3m3 double, water_m3 double")
    with pytest.raises(filters.FilterError):
        views.explore({"block": cube, "cube": cube}, "yacimiento", {"provincia": ["NOPE"]})
    curve = spark.createDataFrame([("x", 1, "SHALE", 2000, 1.0, 1.0, 1.0, 5)], "cuenca string, month_on_prod int, subtype string, vintage int, oil_p10 double, oil_p50 double, oil_p90 double, wells long")
    found, ignored = views.compare_curves(curve, "subtype", "oil", {"operator": ["A"], "cuenca": ["x"], "tipo_recurso": ["Y"]})
    assert found.count() == 1 and sorted(ignored) == ["operator", "tipo_recurso"]


def test_narrow_keeps_what_a_range_allows():
    assert filters.narrow({"y": {"min": 3}}, "y", [1, 3, 5]) == {"y": [3, 5]}
    assert filters.narrow({"y": {"min": 6}}, "y", [1, 3, 5]) is None


def test_csv_files_of_two_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("idpozo,anio,mes\n1,2020,3\nbad,2020,1\n")
    (tmp_path / "b.csv").write_text('"mes",idpozo,anio,more\n4,2,2021,"x,y"\n')
    got = scans.read_csv(spark, str(tmp_path), scans.REGISTER_SCHEMA, drop_malformed=True).collect()
    assert sorted(map(tuple, got)) == [(1, 2020, 3), (2, 2021, 4)]
    with pytest.raises(ValueError):
        scans.read_csv(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("idpozo,anio\n1,2\n")
    with pytest.raises(ValueError):
        scans.read_csv(spark, str(tmp_path), scans.REGISTER_SCHEMA)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        common.work_dir(Session())


def test_pinned_tables_can_be_cleared(spark, tmp_path):
    kept = common.pin(spark.range(3))
    path = kept.inputFiles()[0]
    assert spark.read.parquet(path).count() >= 0
    common.clear_work(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_labels_of_many_dimensions(spark):
    labels = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("dim"), F.lit("v").alias("value"), F.lit(0).alias("code"))
    encode.require_labels(labels, ["d2999", "d0"])
    with pytest.raises(ValueError):
        encode.require_labels(labels, ["d3000"])


def test_broadcast_needs_few_bytes(spark):
    df = spark.range(3)
    plan = lambda x: df.join(x, "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.broadcast_if_small(df, (3, 10)))
    assert "broadcast" not in plan(common.broadcast_if_small(df, (3, 10**9)))


def test_quantiles_that_round_alike(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    row = ranking.exact_quantiles(df, [], ["v"], [0.995, 0.999, 0.5]).first()
    assert (row["v_p99_5"], row["v_p99_9"], row["v_p50"]) == (995.0, 999.0, 500.0)


def test_spec_refuses_names_twice(spark):
    engine = QueryEngine({"t": spark.createDataFrame([("a", 1)], "g string, v int")})
    for bad in ({"groupBy": ["g", "g"]}, {"groupBy": ["g"], "measures": [{"as": "g", "col": "v", "agg": "sum"}]}, {"groupBy": ["g"], "limit": -1}):
        with pytest.raises(SpecError):
            engine.compile({"source": "t", **bad})


def test_messages_state_the_number(spark):
    found = spark.range(60).select(F.lit("c").alias("check_name"), F.lit("s").alias("subject"), F.col("id").cast("string").alias("key"), F.lit(1.0).alias("value"), F.lit("fail").alias("status"))
    with pytest.raises(quality.QualityGateError, match="60 failed"):
        quality.gate(found)
    spans = spark.range(40).select("id", F.lit(1).alias("a"), F.lit(5).alias("b"))
    spans = spans.union(spans).select("id", *[F.date_add(F.lit("2020-01-01").cast("date"), F.col(c)).alias(c) for c in "ab"])
    with pytest.raises(temporal.RowGuardError, match="40 values"):
        temporal.require_disjoint_spans(spans, "id", "a", "b")


def test_ingest_leaves_the_old_output_on_gaps(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS idpozo, make_date(y, 1, 1) AS fecha, 1.0D AS prod_pet FROM VALUES (2018), (2020) AS t(y)")
    for y in (2018, 2020):
        rows.where(F.year("fecha") == y).coalesce(1).write.parquet(str(tmp_path / f"raw/{y}"))
    out = str(tmp_path / "out")
    spark.range(3).write.parquet(out)
    with pytest.raises(intake.IntakeError):
        intake.ingest(spark, [str(tmp_path / "raw/2018"), str(tmp_path / "raw/2020")], out)
    assert spark.read.parquet(out).columns == ["id"]
