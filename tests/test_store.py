"""The kept tables: clustered reads without shuffles, reuse, and renewal when files change."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from prodlens.catalog.queries import REGISTRY, Panel
from prodlens.common import clear_work, new_work_path
from prodlens.sources.store import open_store

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def source(spark):
    path = new_work_path(spark, "source")
    spark.range(100).select((F.col("id") % 7).alias("idpozo"), F.col("id").alias("v")).write.parquet(path)
    return path


def clustered(spark, source, built):
    def build():
        built.append(1)
        return spark.read.parquet(source)

    store = open_store(spark, source, [source], "idpozo")
    return store, store.clustered("rows", build, ["idpozo", "v"])


def test_joins_and_aggregates_by_entity_need_no_shuffle(spark, source):
    _, rows = clustered(spark, source, [])
    sums = rows.groupBy("idpozo").agg(F.sum("v").alias("s"))
    joined = rows.hint("merge").join(sums, "idpozo")
    assert "Exchange" not in plan_of(joined)
    assert joined.count() == 100 and rows.agg(F.sum("v")).first()[0] == 4950


def test_a_store_is_built_once_until_its_files_change(spark, source):
    built = []
    store, _ = clustered(spark, source, built)
    again, _ = clustered(spark, source, built)
    assert store is again and len(built) == 1
    spark.range(1).select(F.lit(99).cast("long").alias("idpozo"), F.lit(1).cast("long").alias("v")).write.mode("append").parquet(source)
    renewed, rows = clustered(spark, source, built)
    assert renewed is not store and len(built) == 2 and rows.count() == 101
    renewed.close()
    assert not renewed.built and clustered(spark, source, built)[1].count() == 101 and len(built) == 3


def test_tables_whose_files_are_gone_are_built_again(spark, tmp_path):
    data = str(tmp_path / "own")
    spark.range(5).select(F.col("id").alias("idpozo"), F.col("id").alias("v")).write.parquet(data)
    built = []
    store, _ = clustered(spark, data, built)
    store.kept("plain", lambda: spark.read.parquet(data))
    clear_work(spark)
    assert clustered(spark, data, built)[1].count() == 5 and len(built) == 2
    assert store.kept("plain", lambda: spark.read.parquet(data)).count() == 5


@pytest.mark.parametrize("name", ["monthly_cube", "block_cube", "spec_top12"])
def test_cubes_read_the_store(spark, name):
    df = REGISTRY[name](spark, SF)
    plan = plan_of(df)
    assert "orders.parquet" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 5


def test_the_fact_is_built_without_a_shuffle_of_its_own(spark):
    from prodlens.plans import enrich

    p = Panel(spark, SF)
    fact = enrich.prod_monthly(p.monthly_production, p.well_operator_history, p.daily_events, ["event_id"], False, False)
    assert "Exchange hashpartitioning" not in plan_of(fact.hint("merge"))


def test_daily_states_give_the_states_of_all_events(spark):
    from prodlens.plans import enrich

    p = Panel(spark, SF)
    every, daily = (enrich.latest_state(e, ["event_id"]) for e in (p.well_events, p.daily_events))
    assert every.exceptAll(daily).isEmpty() and daily.exceptAll(every).isEmpty()
