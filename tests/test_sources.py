from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from conftest import by_key, d
from pyspark.sql import functions as F

from prodlens.common import new_work_path, work_dir
from prodlens.plans.build import BuildInputs, build
from prodlens.plans.cubes import well_history
from prodlens.plans.quality import QualityGateError
from prodlens.sources import intake, lookup, releases, scans, sinks


@pytest.fixture(scope="module")
def store(panel, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    for t in ("wells", "well_events", "well_operator_history"):
        panel[t].coalesce(1).write.parquet(str(root / f"{t}.parquet"))
    intake.write_by_year(panel["monthly_production"].drop("anio"), str(root / "monthly_production"))
    return root


def test_parquet_source_and_views(spark, store):
    src = scans.open_source({"driver": "parquet", "parquet": {"root": str(store)}})
    found = scans.register_views(spark, src)
    assert set(found) == set(scans.TABLES)
    years = [r.anio for r in spark.sql("SELECT anio, count(*) FROM monthly_production GROUP BY anio ORDER BY anio").collect()]
    assert years == [2019, 2020, 2021]
    plan = found["monthly_production"].where("anio = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(anio" in plan
    with pytest.raises(ValueError):
        src.table(spark, "wells; DROP")
    with pytest.raises(scans.MissingTables, match="wells"):
        scans.ParquetSource(str(store / "nowhere")).ensure_available(spark)
    with pytest.raises(ValueError):
        scans.open_source({"driver": "ftp"})
    prints = src.fingerprint(spark).collect()
    assert len(prints) >= 6 and all(len(r.sha256) == 64 and r.bytes > 0 for r in prints if r.file.endswith(".parquet"))


def test_file_list_source(spark, store):
    files = sorted(str(p.relative_to(store / "monthly_production")) for p in (store / "monthly_production").glob("anio=*/*.parquet"))
    src = scans.FileListSource(str(store), tuple(files))
    src.ensure_available(spark)
    df = src.table(spark, "monthly_production")
    assert "anio" in df.columns and df.count() == 9
    (store / "monthly_production" / "_files.json").write_text(json.dumps(files[:1]))
    try:
        assert 0 < scans.FileListSource(str(store)).table(spark, "monthly_production").count() < 9
    finally:
        (store / "monthly_production" / "_files.json").write_text("[]")
    block_page = store.parent / "blocked"
    block_page.mkdir(exist_ok=True)
    for t in ("wells", "well_events", "well_operator_history"):
        (block_page / f"{t}.parquet").write_text("<html>")
    with pytest.raises(scans.MissingTables):
        scans.FileListSource(str(block_page), ("anio=2020/x.parquet",)).ensure_available(spark)


def test_jdbc_options():
    src = scans.JdbcSource("jdbc:postgresql://host/db", lower=0, upper=1000, partitions=16, properties={"user": "u"})
    opts = src.options("wells")
    assert opts["dbtable"] == "public.wells" and opts["partitionColumn"] == "idpozo" and opts["numPartitions"] == "16"
    with pytest.raises(ValueError):  # one task would read the whole table
        scans.JdbcSource("jdbc:x").options("wells")
    with pytest.raises(ValueError):
        scans.JdbcSource("").table(None, "wells")


def test_csv(spark, tmp_path):
    path = tmp_path / "reg.csv"
    path.write_text('idpozo,nombre,geojson,otro\n1,a,"{""coordinates"":[-1.5,2]}",7\nx,b,,8\n2,c,,9,10,11\n3,d,,9\n')
    bad_dropped = scans.read_csv(spark, str(path), scans.REGISTRY_SCHEMA, drop_malformed=True).collect()
    assert [r.idpozo for r in bad_dropped if r.idpozo is not None] == [1, 3]
    assert json.loads(bad_dropped[0].geojson)["coordinates"] == [-1.5, 2]
    inferred = scans.read_csv(spark, str(path))
    assert inferred.columns == ["idpozo", "nombre", "geojson", "otro"]
    with pytest.raises(ValueError, match="anio"):
        scans.read_csv(spark, str(path), scans.REGISTER_SCHEMA)


def test_manifest_hashes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc" * 1000)
    row = intake.file_manifest(spark, [str(tmp_path / "in")]).first()
    assert row.file == "a.bin" and row.bytes == 3000 and row.sha256 == hashlib.sha256(b"abc" * 1000).hexdigest()
    assert "sha256" not in intake.file_manifest(spark, [str(tmp_path / "in")], hashes=False).columns


def _raw(spark, panel, folder: Path):
    p = panel["monthly_production"].drop("anio")
    parts = {"data (1)": p.where("year(fecha) = 2019"), "data (2)": p.where("year(fecha) = 2020"), "data (3)": p.where("year(fecha) = 2021")}
    out = {}
    for name, df in parts.items():
        df.coalesce(1).write.parquet(str(folder / name))
        out[name] = str(folder / name)
    return out


def test_ingest(spark, panel, tmp_path):
    raw = _raw(spark, panel, tmp_path)
    copy = tmp_path / "copy"
    copy.mkdir()
    original = next(Path(raw["data (2)"]).glob("*.parquet"))
    (copy / "again.parquet").write_bytes(original.read_bytes())
    shorter = str(tmp_path / "short")
    panel["monthly_production"].drop("anio").where("fecha = '2021-01-01'").unionByName(
        panel["monthly_production"].drop("anio").where("fecha = '2021-01-01'")
    ).coalesce(1).write.parquet(shorter)
    decided = intake.ingest(spark, [*raw.values(), str(copy), shorter], str(tmp_path / "out"))
    notes = {(r.year, r.kept): r.note for r in decided.collect()}
    assert notes[(2019, True)] == "single"
    assert notes[(2020, True)] == "identical copies, kept one"
    assert notes[(2021, True)] == "files differ, kept the largest"
    assert decided.where("kept").count() == 3
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.anio: r.n_rows for r in intake.partition_probe(back).collect()} == {2019: 1, 2020: 7, 2021: 2}


def test_ingest_refuses_gaps_and_mixed_years(spark, panel, tmp_path):
    raw = _raw(spark, panel, tmp_path)
    with pytest.raises(intake.IntakeError, match="2020"):
        intake.ingest(spark, [raw["data (1)"], raw["data (3)"]], str(tmp_path / "gap"))
    mixed = str(tmp_path / "mixed")
    panel["monthly_production"].drop("anio").coalesce(1).write.parquet(mixed)
    with pytest.raises(intake.IntakeError, match="one year"):
        intake.ingest(spark, [mixed], str(tmp_path / "never"))
    with pytest.raises(intake.IntakeError):
        intake.partition_probe(panel["wells"])
    with pytest.raises(intake.IntakeError):
        intake.partition_probe(spark.createDataFrame([(None,), (2020,)], "anio int"))
    assert intake.year_coverage(panel["monthly_production"].limit(0)).count() == 0


def test_shards_split_a_hot_bucket_and_answer_lookups(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("idpozo"),
        F.date_add(F.lit(d("2000-01-01")), F.col("id").cast("int")).alias("fecha"),
        F.col("id").cast("double").alias("oil_m3"),
    )
    path = str(tmp_path / "shards")
    sinks.write_sharded(rows, path, buckets=16, partitions=12)
    back = spark.read.parquet(path)
    assert back.count() == 3000 and back.where("bucket <> pmod(idpozo, 16)").count() == 0
    assert len(list(Path(path).glob("bucket=7/*.parquet"))) >= 4  # a third of the rows, several tasks
    one = lookup.entity_history(spark, path, 7, buckets=16)
    dates = [r.fecha for r in one.collect()]
    assert dates == sorted(dates) and len(dates) >= 1000
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(idpozo,7)" in plan
    wanted = spark.createDataFrame([(7,), (8,), (8,), (12345,)], "idpozo long")
    many = lookup.entity_histories(spark, path, wanted, buckets=16)
    assert {r.idpozo for r in many.select("idpozo").distinct().collect()} == {7, 8}
    assert many.count() == rows.where("idpozo IN (7, 8)").count()
    assert "dynamicpruning" in many._jdf.queryExecution().executedPlan().toString()
    assert lookup.entity_history(spark, path, -1, buckets=16).count() == 0


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5), ('q"x', None)], "k string, v double")
    sinks.write_csv(df, str(tmp_path / "csv"), "Data: one\nTwo")
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').schema("k string, v double").csv(str(tmp_path / "csv" / "*.csv")).collect()} == {("a,b", 1.5), ('q"x', None)}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv" / "_CITATION")).collect()) == ["Data: one", "Two"]
    sinks.write_sorted(spark.range(100).select((99 - F.col("id")).alias("x")), str(tmp_path / "s"), ["x"], partitions=3)
    files = sorted(Path(tmp_path / "s").glob("*.parquet"))
    bounds = [spark.read.parquet(str(f)).agg(F.min("x"), F.max("x")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and len(files) == 3
    assert "zstd" in files[0].name


def test_work_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert work_dir(spark) == (named or work_dir(spark))
    assert new_work_path(spark, "x") != new_work_path(spark, "x")


def test_build_end_to_end(spark, panel, fact, tmp_path):
    inputs = BuildInputs(
        panel["wells"], panel["well_operator_history"], panel["well_events"], panel["monthly_production"], panel["jobs"], panel["register"]
    )
    # no group reaches five wells here, so the curve labels are missing and the build says so
    with pytest.raises(ValueError, match="tc_"):
        build(spark, inputs, str(tmp_path / "small"), ["event_id"])
    wide = panel["wells"].where("idpozo = 1")
    copies = [wide.withColumn("idpozo", F.lit(100 + i).cast("long")) for i in range(5)]
    prods = [panel["monthly_production"].where("idpozo = 1").withColumn("idpozo", F.lit(100 + i).cast("long")) for i in range(5)]
    wells, production = panel["wells"], panel["monthly_production"]
    for w, p in zip(copies, prods):
        wells, production = wells.unionByName(w), production.unionByName(p)
    inputs = BuildInputs(wells, panel["well_operator_history"], panel["well_events"], production, panel["jobs"], panel["register"])
    out = str(tmp_path / "built")
    manifest = build(spark, inputs, out, ["event_id"], limits={"agg_monthly": 10_000_000})
    assert {r.output for r in manifest.select("output").distinct().collect()} == {
        "agg_monthly", "agg_block", "typecurve", "wells_slim", "wells", "dims", "formation_names", "summary"}
    sizes = {r.output: r.n_rows for r in manifest.select("output", "n_rows").distinct().collect()}
    assert sizes["wells_slim"] == 11 and sizes["dims"] is None
    assert releases.open_table(spark, out, "typecurve").agg(F.max("wells")).first()[0] == 5
    assert lookup.entity_history(spark, releases.place(spark, out, "wells"), 1).count() == 5
    kpi = spark.read.json(f"{releases.place(spark, out, 'summary')}/kpi").first()
    assert kpi.wells == 11
    names = by_key(spark.read.json(releases.place(spark, out, "formation_names")), "formprod")
    assert names["VMUT"].formacion == "vaca muerta"
    assert well_history(fact).columns == ["idpozo", "fecha", "oil_m3", "gas_e3m3", "water_m3", "effective_hours"]
    with pytest.raises(QualityGateError, match="limit"):
        build(spark, inputs, str(tmp_path / "tight"), ["event_id"], limits={"agg_monthly": 1})
    # a build that fails between two tables leaves the whole old set
    before = releases.published(spark, out)
    with pytest.raises(QualityGateError, match="limit"):
        build(spark, inputs, out, ["event_id"], limits={"agg_monthly": 1})
    assert releases.published(spark, out) == before
    assert releases.open_table(spark, out, "wells_slim").count() == 11
