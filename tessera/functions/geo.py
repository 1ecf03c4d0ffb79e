"""Column expressions on points in integer microdegrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: metres in a microdegree of latitude, and of longitude at the region's latitude
LAT, LNG = 0.111195, 0.086284


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance on the local plane, rounded half up to whole metres."""
    dy, dx = (lat2 - lat1) * F.lit(LAT), (lng2 - lng1) * F.lit(LNG)
    return F.floor(F.sqrt(dy * dy + dx * dx) + 0.5).cast("long")


def walk_minutes(m: Column) -> Column:
    """At 80 metres a minute with a detour of 1.3, at least one."""
    return F.greatest(F.lit(1), F.ceil(m * F.lit(1.3) / F.lit(80.0))).cast("long")


METRES_SQL = "CAST(floor(sqrt(({b}.lat - {a}.lat) * 0.111195::DOUBLE * (({b}.lat - {a}.lat) * 0.111195::DOUBLE) + ({b}.lng - {a}.lng) * 0.086284::DOUBLE * (({b}.lng - {a}.lng) * 0.086284::DOUBLE)) + 0.5::DOUBLE) AS BIGINT)"
