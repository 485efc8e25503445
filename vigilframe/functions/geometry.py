"""GeoJSON geometries of a type and a text of coordinates, taken apart by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parsed(c: Column, depth: int) -> Column:
    kind = "double"
    for _ in range(depth):
        kind = f"array<{kind}>"
    return F.from_json(c, kind)


def parts(kind: Column, c: Column) -> Column:
    """Array of point lists: one for a point or line, one for each ring or line of the rest."""
    one = lambda x: F.array(x)
    return (
        F.when(kind == "Point", one(one(_parsed(c, 1))))
        .when(kind.isin("LineString", "MultiPoint"), one(_parsed(c, 2)))
        .when(kind.isin("Polygon", "MultiLineString"), _parsed(c, 3))
        .when(kind == "MultiPolygon", F.flatten(_parsed(c, 4)))
    )


def points(kind: Column, c: Column) -> Column:
    return F.flatten(parts(kind, c))


def valid(kind: Column, c: Column, most_lat: float = 90.0) -> Column:
    """Points in range, lines of two points at least, rings of four at least that close."""
    p = parts(kind, c)
    ranged = F.forall(F.flatten(p), lambda x: (F.size(x) >= 2) & F.get(x, 0).between(-180, 180) & F.get(x, 1).between(-most_lat, most_lat))
    ring = F.forall(p, lambda r: (F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1)))
    line = F.forall(p, lambda r: F.size(r) >= 2)
    shape = F.when(kind.isin("Polygon", "MultiPolygon"), ring).when(kind.isin("LineString", "MultiLineString"), line).otherwise(F.lit(True))
    return F.coalesce(ranged & shape & (F.size(p) > 0), F.lit(False))


def region_shape(kind: Column, c: Column) -> Column:
    """Whether a watch region may have this shape: a point or polygons, at most 500 points, latitudes within 85, closed rings. No shape is none."""
    fit = kind.isin("Point", "Polygon", "MultiPolygon") & (F.size(points(kind, c)) <= 500) & valid(kind, c, 85.0)
    return F.coalesce(fit, F.lit(False))


def centroid(p: Column, k: int) -> Column:
    """Mean of the vertices; a ring's closing vertex counts again."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + F.get(x, k)) / F.size(p)


def bounds(p: Column) -> Column:
    at = lambda k: F.transform(p, lambda x: F.get(x, k))
    return F.struct(F.array_min(at(0)).alias("west"), F.array_min(at(1)).alias("south"), F.array_max(at(0)).alias("east"), F.array_max(at(1)).alias("north"))


def stride(p: Column, most: int) -> Column:
    """The least power of two that leaves at most `most` points of every stride-th one and the last one."""
    n = F.size(p)
    kept = lambda s: F.ceil(n / s) + F.when((n - 1) % s == 0, 0).otherwise(1)
    strides = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.get(F.filter(strides, lambda s: kept(s) <= most), 0)


def strided(p: Column, step: Column) -> Column:
    """Every step-th point and the last one."""
    return F.filter(p, lambda x, i: (i % step == 0) | (i == F.size(p) - 1))


def simplified(p: Column, most: int) -> Column:
    """Every stride-th point and the last one, the stride the least power of two that leaves at most `most` points."""
    return strided(p, stride(p, most))
