"""Geometry as column expressions: great-circle distance, point in ring, distance to a ring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8  # fixed value: mean earth radius in metres


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres of coordinates in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def ring_edges(ring: Column) -> Column:
    """Closed list of edges (ax, ay, bx, by) of an array of (x, y) corners."""
    follow = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(
        ring, follow,
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )


def inside_ring(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges. Points on the border are not
    treated specially (the predicate meant is "within")."""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return spans & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_distance(x: Column, y: Column, edges: Column) -> Column:
    """Distance to the nearest edge."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.coalesce(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / length2, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt(F.pow(x - (e["ax"] + t * dx), 2) + F.pow(y - (e["ay"] + t * dy), 2))

    return F.array_min(F.transform(edges, to_edge))
