from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from conftest import by_key, d
from pyspark.sql import functions as F

from prodlens.operators import temporal


def _owned(panel, **kw):
    return temporal.interval_join(
        panel["monthly_production"].select("idpozo", "fecha"), panel["well_operator_history"],
        "idpozo", "fecha", "valid_from", "valid_to", {"empresa": "op"}, **kw,
    )


@pytest.mark.parametrize("unit", [None, "year", "month"])
def test_interval_join_keeps_rows_and_respects_both_ends(panel, unit):
    got = by_key(_owned(panel, slice_unit=unit), "idpozo", "fecha")
    assert len(got) == panel["monthly_production"].count()
    assert got[(1, d("2020-02-01"))].op == "YPF"  # last day of a closed span
    assert got[(1, d("2020-03-01"))].op is None  # gap
    assert got[(1, d("2020-04-01"))].op == "PAE"  # first day of an open span
    assert got[(3, d("2019-12-01"))].op is None  # before the first span


def test_overlap_repeats_rows_and_is_found(spark, panel):
    extra = spark.createDataFrame(
        [(2, "X", "X", d("2020-01-01"), d("2020-02-15"))], panel["well_operator_history"].schema
    )
    spans = panel["well_operator_history"].unionByName(extra)
    fact = panel["monthly_production"].select("idpozo", "fecha")
    joined = temporal.interval_join(fact, spans, "idpozo", "fecha", "valid_from", "valid_to", {"empresa": "op"})
    assert joined.count() == fact.count() + 1
    with pytest.raises(temporal.RowGuardError):
        temporal.require_same_rows(fact, joined, "operators")
    with pytest.raises(temporal.RowGuardError, match="2"):
        temporal.require_disjoint_spans(spans, "idpozo", "valid_from", "valid_to")
    temporal.require_disjoint_spans(panel["well_operator_history"], "idpozo", "valid_from", "valid_to")


@pytest.mark.parametrize("strategy", ["spans", "fill"])
def test_asof_takes_the_latest_at_or_before(panel, strategy):
    got = by_key(
        temporal.asof_join(
            panel["monthly_production"].select("idpozo", "fecha"), panel["well_events"], "idpozo",
            "fecha", "event_date", {"tipopozo": "fluid", "tipoestado": "state"}, ["event_id"], strategy=strategy,
        ),
        "idpozo", "fecha",
    )
    assert got[(1, d("2020-01-01"))].fluid is None  # before the first event
    assert got[(1, d("2020-02-01"))].fluid == "Petrolífero"  # on the date
    assert got[(1, d("2020-03-01"))].state == "En Reparación"  # tie: highest id
    assert got[(1, d("2021-01-01"))].fluid == "Gasífero"  # long after, in another slice
    assert got[(2, d("2020-02-01"))].fluid == "Gasífero"
    assert got[(3, d("2020-02-01"))].fluid is None  # no events at all


def test_asof_plans_agree_with_brute_force_under_a_hot_key(spark):
    rng = random.Random(7)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(900))
    key = lambda: 0 if rng.random() < 0.5 else rng.randrange(1, 30)
    probes = sorted({(key(), day()) for _ in range(900)}) + [(None, date(2020, 5, 1)), (3, None)]
    events = [(key(), day(), i, f"s{rng.randrange(50)}") for i in range(700)] + [(None, date(2020, 1, 1), -1, "x")]
    fact = spark.createDataFrame(probes, "k long, at date")
    ev = spark.createDataFrame(events, "k long, since date, id long, s string")

    def brute(k, at):
        if k is None or at is None:
            return None
        ok = [(e[1], e[2], e[3]) for e in events if e[0] == k and e[1] <= at]
        return max(ok)[2] if ok else None

    want = {(k, at): brute(k, at) for k, at in probes}
    for kw in ({"strategy": "spans"}, {"strategy": "fill"}, {"strategy": "fill", "slice_unit": "month"}):
        out = temporal.asof_join(fact, ev, "k", "at", "since", {"s": "s"}, ["id"], **kw).collect()
        assert {(r.k, r["at"]): r.s for r in out} == want
        assert len(out) == len(probes)


def test_asof_without_tie_break_is_deterministic(spark):
    ev = spark.createDataFrame([(1, d("2020-01-01"), "a"), (1, d("2020-01-01"), "b")], "k long, since date, s string")
    fact = spark.createDataFrame([(1, d("2020-01-02"))], "k long, at date")
    got = temporal.asof_join(fact, ev, "k", "at", "since", {"s": "s"}).collect()
    assert [r.s for r in got] == ["b"]
    with pytest.raises(ValueError):
        temporal.asof_join(fact, ev, "k", "at", "since", {"s": "s"}, strategy="other")


def test_latest_row(panel):
    got = by_key(
        temporal.latest_row(panel["well_events"], "idpozo", "event_date", {"tipoestado": "s"}, ["event_id"]), "idpozo"
    )
    assert got[1].s == "En Reparación" and got[2].s == "Extracción Efectiva" and len(got) == 2


def test_interval_join_is_an_equi_join(panel):
    plan = _owned(panel)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_on_timestamps(spark):
    ev = spark.sql("SELECT 1L AS k, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS since, 'a' AS s")
    fact = spark.sql(
        "SELECT 1L AS k, TIMESTAMP_NTZ '2024-01-01 09:59:59' AS at UNION ALL SELECT 1L, TIMESTAMP_NTZ '2024-01-03 00:00:00'"
    )
    out = temporal.asof_join(fact, ev, "k", "at", "since", {"s": "s"}, strategy="fill", slice_unit="day")
    assert [r.s for r in out.orderBy(F.col("at")).collect()] == [None, "a"]
