from __future__ import annotations

import pytest
from conftest import d
from pyspark.sql import functions as F

from prodlens.functions import dates, geo, text, units


def one(spark, *cols, data=None):
    src = spark.createDataFrame([data], "a date, b date, h double") if data else spark.range(1)
    return tuple(src.select(*cols).first())


def test_months(spark):
    data = (d("2020-02-29"), d("2021-01-01"), 700.0)
    got = one(
        spark,
        dates.month_start("a"), dates.year_month("a"), dates.hours_in_month("a"), dates.days_in_month("b"),
        dates.months_between_starts("a", "b"), dates.month_index("a"), dates.month_label(dates.month_index("b")),
        dates.clamp_hours("h", "a"), dates.clamp_hours("h", "b"),
        data=data,
    )
    assert got == (d("2020-02-01"), "2020-02", 696, 31, 11, 169, "2021-01", 696.0, 700.0)
    nulls = one(spark, dates.month_index("a"), dates.clamp_hours("h", "b"), data=(None, d("2020-01-01"), None))
    assert nulls == (None, None)
    assert one(spark, dates.month_label(F.lit(-1)), dates.date_from_parts(F.lit(2020), F.lit(12))) == ("2005-12", d("2020-12-01"))


def test_text(spark):
    assert one(spark, text.title_case(F.lit("VACA MUERTA")), text.title_case(F.lit("ñirihuau-este/(alto)"))) == ("Vaca Muerta", "Ñirihuau-Este/(Alto)")
    found = [("Neuquén", "NEUQUEN"), ("PUESTO ZUÑIGA", "zuniga"), ("Petrolífero", " ífer ")]
    for value, term in found:
        assert one(spark, text.folded_contains(F.lit(value), term)) == (True,)
    assert one(spark, text.folded_contains(F.lit("Chubut"), "neu")) == (False,)
    assert one(spark, text.or_label(F.lit(None).cast("string"))) == ("No informado",)


def test_units(spark):
    got = one(spark, *[units.to_oilfield(F.lit(2.0), k) for k in ("oil", "gas", "water", "length", "other")])
    assert got == pytest.approx((12.57962, 70.6294, 12.57962, 6.56168, 2.0))
    assert one(spark, units.ratio(F.lit(1.0), F.lit(0.0)), units.ratio(F.lit(3.0), F.lit(2.0), 10.0)) == (None, 15.0)


def test_boxes(spark):
    where = lambda x, y: one(spark, geo.box_class(F.lit(x).cast("double"), F.lit(y).cast("double")))[0]
    assert [where(-74, -56), where(-53, -21), where(-52.9, -30), where(None, 1), where(float("nan"), -30)] == [
        "inside", "inside", "outside", "missing", "missing"]
