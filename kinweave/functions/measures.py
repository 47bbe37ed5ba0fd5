"""Numbers: distances, grid cells, spiral offsets, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import col

#: Radius of the earth in km, golden angle in radians, cell and pitch in degrees.
EARTH_KM, GOLDEN_ANGLE, CELL, PITCH = 6371, 2.399963229728653, 0.05, 0.16


def distance_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell(x) -> Column:
    """Nearest grid line; halves go up, also below zero."""
    return F.floor(col(x) / CELL + 0.5)


def spread_lat(lat, rank) -> Column:
    return col(lat) + PITCH * F.sqrt(col(rank)) * F.sin(col(rank) * GOLDEN_ANGLE)


def spread_lng(lat, lng, rank) -> Column:
    stretch = F.greatest(F.lit(0.2), F.cos(F.radians(col(lat))))
    return col(lng) + PITCH * F.sqrt(col(rank)) * F.cos(col(rank) * GOLDEN_ANGLE) / stretch


def share_label(x) -> Column:
    """Percent with one decimal, two below 0.1 %, and a floor. Decimals round half up on the exact binary value."""
    p = col(x) * 100
    exact = lambda n: F.format_string(f"%.{n}f", F.floor(p.cast("decimal(38,20)") * 10**n + F.lit(0.5).cast("decimal(2,1)")).cast("double") / 10**n)
    return F.when(p <= 0, "0%").when(p < 0.01, "<0.01%").when(p < 0.1, F.concat(exact(2), F.lit("%"))).otherwise(F.concat(exact(1), F.lit("%")))
