"""Releases: tables appear together, a failure leaves the old set, a refresh writes only its partitions."""

from __future__ import annotations

import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prodlens.sources import intake, releases


def years(spark, first, last, value):
    rows = spark.range(40).withColumn("anio", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.select(F.col("id").alias("idpozo"), F.make_date("anio", F.lit(1), F.lit(1)).alias("fecha"), F.lit(value).alias("v"), "anio")


def sums(df):
    return {r["anio"]: (r["n"], r["s"]) for r in df.groupBy("anio").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}


def test_a_refresh_writes_only_its_years(spark, tmp_path):
    out = str(tmp_path)
    assert releases.published(spark, out) == {}
    assert releases.refresh(spark, years(spark, 2018, 2020, 1), out, "panel") == 1
    old, files = releases.open_table(spark, out, "panel"), set(Path(out, "panel").rglob("*.parquet"))
    assert releases.refresh(spark, years(spark, 2020, 2021, 5), out, "panel") == 2
    assert sums(releases.open_table(spark, out, "panel")) == {2018: (40, 40), 2019: (40, 40), 2020: (40, 200), 2021: (40, 200)}
    # who opened the table before goes on with what there was
    assert sums(old) == {2018: (40, 40), 2019: (40, 40), 2020: (40, 40)}
    assert files < set(Path(out, "panel").rglob("*.parquet"))
    new = set(Path(out, "panel").rglob("*.parquet")) - files
    assert {f.parent.parent.name for f in new} == {"anio=2020", "anio=2021"}
    assert releases.refresh(spark, years(spark, 2020, 2021, 5).limit(0), out, "panel") is None
    assert releases.open_table(spark, out, "panel").columns == ["idpozo", "fecha", "v", "anio"]


def test_a_filter_on_the_year_prunes_folders(spark, tmp_path):
    out = str(tmp_path)
    releases.refresh(spark, years(spark, 2018, 2020, 1), out, "panel")
    releases.refresh(spark, years(spark, 2019, 2019, 2), out, "panel")
    one = releases.open_table(spark, out, "panel").where("anio = 2019")
    assert one.agg(F.sum("v")).first()[0] == 80
    assert "PartitionFilters: [isnotnull(anio" in one._jdf.queryExecution().executedPlan().toString()


def test_a_failure_before_the_pointer_leaves_the_old_set(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    releases.refresh(spark, years(spark, 2018, 2019, 1), out, "panel")
    before = releases.published(spark, out)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(releases, "publish", fails)
    with pytest.raises(OSError, match="lost"):
        releases.refresh(spark, years(spark, 2018, 2020, 9), out, "panel")
    assert releases.published(spark, out) == before
    assert sums(releases.open_table(spark, out, "panel")) == {2018: (40, 40), 2019: (40, 40)}


def test_tables_are_published_together_and_forgotten(spark, tmp_path):
    out = str(tmp_path)
    for k in range(4):
        spark.range(k + 1).write.parquet(f"{out}/releases/{k}/a")
        releases.publish(spark, out, {"a": [f"releases/{k}/a"]} | ({"b": ["releases/0/a"]} if k == 0 else {}))
    assert releases.open_table(spark, out, "a").count() == 4 and releases.open_table(spark, out, "b").count() == 1
    with pytest.raises(releases.ReleaseError, match="no published table"):
        releases.places(spark, out, "c")
    # folder 0 is still named as b
    assert releases.forget(spark, out, keep=2) == 1
    assert [Path(out, f"releases/{k}").joinpath("a").exists() for k in range(4)] == [True, False, True, True]
    assert releases.open_table(spark, out, "b").count() == 1 and releases.publish(spark, out, {}) == 5
    (tmp_path / "_releases" / "0000000006.json").write_text("{}")
    monkey = releases._numbers
    try:
        releases._numbers = lambda *_: [5]
        with pytest.raises(releases.ReleaseError, match="meanwhile"):
            releases.publish(spark, out, {})
    finally:
        releases._numbers = monkey


def test_dates_come_from_footers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    day = datetime.date
    tables = {"a": [day(2018, 3, 1), None, day(2018, 1, 1)], "b": [day(2019, 1, 1)], "nulls": [None, None], "none": []}
    for name, dates in tables.items():
        pq.write_table(pa.table({"fecha": pa.array(dates, pa.date32())}), raw / f"{name}.parquet")
    pq.write_table(pa.table({"fecha": pa.array([day(2020, 5, 1), day(2021, 5, 1)], pa.date32())}), raw / "bare.parquet", write_statistics=False)
    found = {r["uri"].split("/")[-1]: r for r in intake.identify_files(spark, [str(raw)]).collect()}
    scanned = {r["uri"].split("/")[-1]: r for r in intake.identify_partitions(spark.read.parquet(str(raw))).collect()}
    assert set(found) == set(scanned) == {"a.parquet", "b.parquet", "nulls.parquet", "bare.parquet"}
    assert {k: tuple(v) for k, v in found.items()} == {k: tuple(v) for k, v in scanned.items()}
    # no column of a file with stated limits is read
    stated = intake.footer_dates(intake.file_manifest(spark, [str(raw)], hashes=False).select("path"))
    assert {r["path"].split("/")[-1] for r in stated.where("NOT stated").collect()} == {"bare.parquet"}
