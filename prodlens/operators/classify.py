"""Classification columns and the point dataset for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.common import finite
from prodlens.functions.geo import COUNTRY_BOX, Box, box_class
from prodlens.functions.text import NO_DATA

# The lateral length from which a well counts as horizontal, the name
# markers, and the floor, span and default of the point size.
HORIZONTAL_M = 500.0
HORIZONTAL_NAME = "%(h)%"
DIRECTIONAL_NAME = "%(d)%"
POINT_FLOOR, POINT_SPAN, POINT_DEFAULT = 2.6, 7.0, 3.0


def measured_class(has_record: Column, length: Column, cut: float = HORIZONTAL_M) -> Column:
    """Trajectory from the measured length only; no record or no length is Unknown."""
    return (
        F.when(~has_record | length.isNull(), "Unknown")
        .when(length >= cut, "Horizontal")
        .otherwise("Vertical")
    )


def name_class(name: Column) -> Column:
    """What the naming convention says about the trajectory."""
    return (
        F.when(name.ilike(HORIZONTAL_NAME), "(h) horizontal")
        .when(name.ilike(DIRECTIONAL_NAME), "(d) directional")
        .otherwise("Not indicated")
    )


def combined_class(
    has_record: Column,
    length: Column,
    name: Column,
    cut: float = HORIZONTAL_M,
    null_length_is_unknown: bool = False,
) -> Column:
    """Measurement first, then the name.

    A record without a length counts as measured and short, so it can be Vertical here and
    Unknown in ``measured_class``; ``null_length_is_unknown`` treats it as no record.
    """
    measured = has_record & length.isNotNull() if null_length_is_unknown else has_record
    directional = name.ilike(DIRECTIONAL_NAME)
    by_length = (
        F.when(length >= cut, "Horizontal").when(directional, "Directional").otherwise("Vertical")
    )
    by_name = (
        F.when(name.ilike(HORIZONTAL_NAME), "Horizontal")
        .when(directional, "Directional")
        .otherwise("Unknown")
    )
    return F.when(measured, by_length).otherwise(by_name)


def emphasis_class(value: Column, highlight) -> Column:
    """One highlighted value against everything else."""
    return F.when(value == F.lit(highlight), value).otherwise(F.lit("Other"))


def box_split(df: DataFrame, lon: str, lat: str, box: Box = COUNTRY_BOX) -> DataFrame:
    """Rows inside, outside and without a coordinate; the three counts add to all rows."""
    return df.groupBy(box_class(F.col(lon), F.col(lat), box).alias("place")).agg(
        F.count("*").alias("n")
    )


def point_size(value: Column, largest: Column) -> Column:
    """Radius grows with the square root of the value and never falls below the floor."""
    v = F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    return F.lit(POINT_FLOOR) + F.lit(POINT_SPAN) * F.sqrt(v / largest)


def map_points(
    df: DataFrame,
    key: str,
    lon: str,
    lat: str,
    color_by: str,
    size_by: str | None = None,
    highlight=None,
    box: Box = COUNTRY_BOX,
) -> DataFrame:
    """Drawable points with class and size. The largest value is taken over the whole
    selection, points outside the box included, and is never below 1."""
    value = F.col(color_by)
    cls = emphasis_class(value, highlight) if highlight is not None else F.coalesce(value, F.lit(NO_DATA))
    if size_by is None:
        size = F.lit(POINT_DEFAULT)
    else:
        largest = df.agg(F.greatest(F.coalesce(F.max(finite(size_by)), F.lit(1.0)), F.lit(1.0))).scalar()
        size = point_size(F.col(size_by), largest)
    return df.where(box_class(F.col(lon), F.col(lat), box) == "inside").select(
        key, F.col(lon).alias("lon"), F.col(lat).alias("lat"), cls.alias("class"), size.alias("size")
    )
