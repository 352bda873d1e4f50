"""Geometry headers and bounding boxes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float


# The country's bounding box in degrees.
COUNTRY_BOX = Box(lon_min=-74.0, lon_max=-53.0, lat_min=-56.0, lat_max=-21.0)


def wkb_prefix(geom: Column | str) -> Column:
    """Byte order, type word and SRID of a WKB value: nine bytes as hex text."""
    g = F.col(geom) if isinstance(geom, str) else geom
    return F.hex(F.substring(g, 1, 9))


def wkb_srid(prefix: Column | str) -> Column:
    """SRID from a little-endian extended-WKB prefix."""
    p = F.col(prefix) if isinstance(prefix, str) else prefix
    byte_pairs = [F.substring(p, i, 2) for i in (17, 15, 13, 11)]
    return F.conv(F.concat(*byte_pairs), 16, 10).cast("long")


def box_class(lon: Column, lat: Column, box: Box = COUNTRY_BOX) -> Column:
    """``inside``, ``outside`` or ``missing``; every row gets exactly one."""
    inside = lon.between(box.lon_min, box.lon_max) & lat.between(box.lat_min, box.lat_max)
    return (
        F.when(lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat), F.lit("missing"))
        .when(inside, F.lit("inside"))
        .otherwise(F.lit("outside"))
    )


def geojson_coordinate(c: Column | str, index: int) -> Column:
    """One coordinate of a GeoJSON point held as text."""
    return F.get_json_object(c, f"$.coordinates[{index}]").cast("double")
