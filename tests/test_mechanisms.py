"""Bitmaps, quantile sketches, carried ranks, streamed hashes and pruned lookups against plain computations."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prodlens.catalog.queries import REGISTRY
from prodlens.common import new_work_path
from prodlens.operators import bitmaps, ranking, stats
from prodlens.plans import curves
from prodlens.sources import intake, lookup, sinks

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


# distinct counts along time


def test_bitmaps_count_any_union_of_cells(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(12), rng.choice([rng.randrange(50), 40_000 + rng.randrange(50)]), rng.random() < 0.4) for _ in range(4000)]
    rows += [("c", 3, None, True), ("a", 1, 70_000, None)]
    df = spark.createDataFrame(rows, "area string, month int, n long, busy boolean")
    cells = bitmaps.entity_cells(df, ["area", "month"], "n", {"active": F.col("busy")})
    assert cells.groupBy("area", "month", bitmaps.PLACE).count().where("count > 1").isEmpty()
    for keys in ([], ["area"], ["month"], [F.floor(F.col("month") / 5).alias("block")]):
        got = bitmaps.distinct_entities(cells, keys, {"present": "all", "active": "busy"})
        want = df.where("n IS NOT NULL").groupBy(*keys).agg(
            F.countDistinct("n").alias("all"), F.countDistinct(F.when(F.col("busy"), F.col("n"))).alias("busy")
        )
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_entities_are_numbered_without_gaps_in_order(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2], None if i % 5 == 0 else i % 3) for i in range(200)], "id long, a string, b int")
    got = sorted(map(tuple, bitmaps.number_entities(df, "id", ["a", "b"]).collect()), key=lambda r: r[1])
    want = sorted([r["id"] for r in df.collect()], key=lambda i: ("xy"[i % 2], -1 if i % 5 == 0 else i % 3, i))
    assert got == [(i, n) for n, i in enumerate(want)]


# pooled curves


def test_sketches_of_pooled_groups_keep_their_rank_error(spark):
    rng = random.Random(1)
    rows = [(f"g{w % 40}", w, m, rng.lognormvariate(w % 40, 1), None if m == 2 else float(w % 3), None) for w in range(6000) for m in range(3)]
    df = spark.createDataFrame(rows, "area string, idpozo long, month_on_prod int, prod_pet double, prod_gas double, prod_agua double")
    stored = curves.curve_sketches(df, ["area", "month_on_prod"])
    pooled = curves.pool_sketches(stored, ["month_on_prod"])
    checked = curves.sketch_ranks(df, pooled, ["month_on_prod"])
    found = {r["month_on_prod"]: r.asDict() for r in pooled.collect()}
    assert [found[m]["wells"] for m in range(3)] == [6000] * 3
    assert [found[m]["gas_n"] for m in range(3)] == [6000, 6000, 0] and found[2]["gas_p50"] is None and found[0]["water_n"] == 0
    for r in checked.collect():
        assert all(v for k, v in r.asDict().items() if k.endswith("_ok"))
    wrong = pooled.withColumn("oil_p50", F.col("oil_p90"))
    assert not curves.sketch_ranks(df, wrong, ["month_on_prod"]).first()["oil_p50_ok"]


def test_a_second_row_of_a_well_in_a_group_is_refused(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0, 1.0, 1.0)] * 2, "area string, idpozo long, month_on_prod int, prod_pet double, prod_gas double, prod_agua double")
    with pytest.raises(Exception, match="two rows"):
        curves.curve_sketches(df, ["area", "month_on_prod"]).collect()


# ranks that travel with their records


def hot_pairs(seed=2, n=3000):
    rng = random.Random(seed)
    return [(0.0 if rng.random() < 0.5 else rng.choice([rng.random(), float(rng.randrange(5))]), rng.choice([1.0, rng.random(), None])) for _ in range(n)]


def test_ranks_with_one_value_in_half_of_the_rows(spark):
    import pandas as pd

    rows = hot_pairs()
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        df = spark.createDataFrame([(g, x, float(i)) for g in (0, 1) for i, (x, _) in enumerate(rows[: 1000 * (g + 1)])], "g int, x double, y double")
        got = ranking.carried_ranks(df.withColumn("w", F.lit(1).cast("long")), "g", "x", "w", ["y"], "r", "n").toPandas()
        for g in (0, 1):
            mine = got[got.g == g].sort_values("y")
            want = pd.Series([x for x, _ in rows[: 1000 * (g + 1)]]).rank()
            assert mine.r.tolist() == want.tolist() and set(mine.n) == {1000 * (g + 1)}
        frame = pd.DataFrame(rows, columns=["a", "b"]).dropna()
        row = stats.spearman_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
        assert row.n == len(frame) and row.spearman == pytest.approx(frame.a.rank().corr(frame.b.rank()))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_no_join_on_a_value(spark):
    df = spark.createDataFrame(hot_pairs(n=50), "a double, b double")
    plan = plan_of(stats.spearman_matrix(df, ["a", "b"]))
    joins = re.findall(r"(?:HashJoin|MergeJoin) \[([^\]]*)\]", plan)
    assert joins and all(re.match(r"(_p|pair)#", j) for j in joins)
    assert plan.count("Exchange hashpartitioning") <= 8


# hashes


def test_streamed_hashes_equal_whole_ones(spark, tmp_path):
    rng, want = random.Random(3), {}
    for i, size in enumerate([1, 999, 1000, 1001, 250_000]):
        data = rng.randbytes(size)
        (tmp_path / f"f {i}é.bin").write_bytes(data)
        want[f"f {i}é.bin"] = (size, hashlib.sha256(data).hexdigest())
    (tmp_path / "empty.bin").touch()  # holds nothing and is left out
    for border in (0, 1000, 10**9):
        found = intake.file_manifest(spark, [str(tmp_path)], stream_from=border)
        assert {r.file: (r.bytes, r.sha256) for r in found.collect()} == want
    files = intake.file_manifest(spark, [str(tmp_path)], hashes=False).select("path", "file")
    assert {r.file: r.sha256 for r in intake.stream_digests(files, 300).collect()} == {f: h for f, (_, h) in want.items()}


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = 2**31 + 5
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(size)  # sparse
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size // len(zeros)):
        digest.update(zeros)
    digest.update(bytes(size % len(zeros)))
    row = intake.file_manifest(spark, [str(tmp_path)]).first()
    assert (row.bytes, row.sha256) == (size, digest.hexdigest())


# lookups


@pytest.fixture(scope="module")
def shards(spark):
    path = new_work_path(spark, "shards")
    rows = spark.range(20_000).select((F.col("id") % 2000).alias("idpozo"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("fecha"))
    sinks.write_sharded(rows, path, buckets=16, partitions=8)
    return path


def scan_metrics(df) -> dict:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = {}, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet"):
            for name in ("numFiles", "numOutputRows"):
                found[name] = found.get(name, 0) + metrics.apply(name).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return found


def test_a_point_lookup_reads_one_bucket_and_few_rows(spark, shards):
    found = lookup.entity_history(spark, shards, 77, buckets=16)
    metrics = scan_metrics(found)
    assert found.count() == 10
    files = {r[0] for r in spark.read.parquet(shards).where("bucket = 13").select("_metadata.file_path").distinct().collect()}
    assert 1 <= metrics["numFiles"] <= len(files)
    absent = lookup.entity_history(spark, shards, 77 + 16 * 10_000, buckets=16)
    assert scan_metrics(absent).get("numOutputRows", 0) == 0  # limits and filters of the row groups suffice


def test_a_bulk_lookup_prunes_buckets_at_run_time(spark, shards):
    wanted = spark.createDataFrame([(5,), (21,), (21,)], "idpozo long").where("idpozo > 0")
    found = lookup.entity_histories(spark, shards, wanted, buckets=16)
    assert "dynamicpruning" in plan_of(found)
    assert found.count() == 20 and {r.idpozo for r in found.select("idpozo").distinct().collect()} == {5, 21}


def test_shards_are_written_once(spark):
    import pathlib

    from prodlens.common import work_dir

    for name in ("entity_history", "entity_history_bulk"):
        REGISTRY[name](spark, SF).count()
    before = set(pathlib.Path(work_dir(spark)).glob("*/shards-*"))
    REGISTRY["sharded_roundtrip"](spark, SF).count()
    assert set(pathlib.Path(work_dir(spark)).glob("*/shards-*")) == before


# guards and quarantine


def guarded(spark, spans):
    from prodlens.operators import temporal

    months = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-02-01"), (2, "2020-01-01")], "k long, at string").withColumn("at", F.to_date("at"))
    side = spark.createDataFrame(spans, "k long, a string, b string, v string").select("k", F.to_date("a").alias("a"), F.to_date("b").alias("b"), "v")
    guard = temporal.RowGuard("spans")
    out = guard.after(temporal.interval_join(guard.before(months), side, "k", "at", "a", "b", {"v": "v"}))
    path = new_work_path(spark, "guarded")
    out.write.parquet(path)
    return guard, months, spark.read.parquet(path)


def test_a_guard_counts_in_the_job_that_writes(spark):
    from prodlens.operators.temporal import RowGuardError

    guard, before, after = guarded(spark, [(1, "2020-01-01", None, "x")])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("guard-check", "no job is run")
    try:
        assert guard.check(before, after) == 3
        assert not tracker.getJobIdsForGroup("guard-check")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(RowGuardError, match="3 rows before, 4 after"):
        guard, before, after = guarded(spark, [(1, "2020-01-01", None, "x"), (1, "2020-02-01", None, "y")])
        guard.check(before, after)


def test_bad_csv_rows_are_kept_aside_and_counted(spark, tmp_path):
    from prodlens.sources import scans

    (tmp_path / "a.csv").write_text("idpozo,anio,mes\n1,2020,3\nbad,2020,1\n3,2020,4,extra\n4,20x0,4\n")
    (tmp_path / "b.csv").write_bytes(b'"mes",idpozo,anio,more\r\n4,2,2021,"x,y"\r\n')
    (tmp_path / "c.csv").write_text("")
    good, bad = scans.read_csv_checked(spark, str(tmp_path), scans.REGISTER_SCHEMA)
    assert sorted(map(tuple, good.collect())) == [(1, 2020, 3), (2, 2021, 4)]
    assert sorted(r.line for r in bad.collect()) == ["3,2020,4,extra", "4,20x0,4", "bad,2020,1"]
    assert [(r.file.rsplit("/", 1)[1], r.n_bad) for r in scans.bad_lines_by_file(bad).collect()] == [("a.csv", 3)]


def test_headers_are_read_from_the_beginning_of_files(spark, tmp_path):
    import gzip

    from prodlens.sources import scans

    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("﻿a,b\n" + "1,2\n" * 50_000)
    assert scans.csv_layouts(spark, str(tmp_path)) == {("a", "b"): [str(tmp_path)]}
    assert "Scan text" not in plan_of(scans._heads(spark, str(tmp_path)))
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"b,a\n1,2\n"))
    found = scans.csv_layouts(spark, str(tmp_path))
    assert {k: len(v) for k, v in found.items()} == {("a", "b"): 3, ("b", "a"): 1}
