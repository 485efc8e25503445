"""Geographic expressions; longitude before latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EARTH_KM


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(EARTH_KM * 2) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def normalized_longitude(c: Column) -> Column:
    """Wrapped to -180..180; a positive number stays at 180."""
    wrapped = F.pmod(c + 180, F.lit(360.0)) - 180
    return F.when((wrapped == -180) & (c > 0), 180.0).otherwise(wrapped)


def valid_point(lon: Column, lat: Column) -> Column:
    x, y = lon.cast("string").try_cast("double"), lat.cast("string").try_cast("double")
    return F.coalesce(x.between(-180, 180) & y.between(-90, 90), F.lit(False))


def in_bounds(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """A box with west beyond east crosses the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return across & lat.between(max(-90.0, south), min(90.0, north))


def boxes_overlap(w: Column, s: Column, e: Column, n: Column, west: float, south: float, east: float, north: float) -> Column:
    return (w <= east) & (e >= west) & (s <= north) & (n >= south)


def compass_point(degrees: Column) -> Column:
    names = F.array(*map(F.lit, "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()))
    return F.element_at(names, (F.floor(degrees / 22.5 + 0.5) % 16 + 1).cast("int"))


def location_label(lon: Column, lat: Column) -> Column:
    """12.3°N, 45.6°E"""
    part = lambda c, less, more: F.concat(F.format_string("%.1f", F.floor(F.round(F.abs(c) * 10, 6) + 0.5) / 10), F.lit("°"), F.when(c < 0, less).otherwise(more))
    return F.when(lon.isNull() | lat.isNull(), "Location not reported").otherwise(F.concat(part(lat, "S", "N"), F.lit(", "), part(lon, "W", "E")))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """2 on the boundary, 1 inside, 0 outside a closed ring of (lon, lat), even-odd.

    Longitudes are unwrapped towards the one before, the first towards the point, so rings may cross the antimeridian.
    """
    near = lambda v, to: to + F.pmod(v - to + 180, F.lit(360.0)) - 180
    start = F.struct(lon.alias("x"), lat.alias("y"), F.lit(False).alias("any"), F.lit(0).alias("crossings"), F.lit(False).alias("edge"))

    def step(a: Column, p: Column) -> Column:
        x1, y1, x2, y2 = a["x"], a["y"], near(p["lon"], a["x"]), p["lat"]
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        tiny = 1e-9
        on = (F.abs(cross) <= tiny) & lon.between(F.least(x1, x2) - tiny, F.greatest(x1, x2) + tiny) & lat.between(F.least(y1, y2) - tiny, F.greatest(y1, y2) + tiny)
        over = ((y2 > lat) != (y1 > lat)) & (x1 + (lat - y1) * (x2 - x1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) > lon)
        return F.struct(x2.alias("x"), y2.alias("y"), F.lit(True).alias("any"), F.when(a["any"] & over, a["crossings"] + 1).otherwise(a["crossings"]).alias("crossings"), (a["edge"] | (a["any"] & on)).alias("edge"))

    done = F.aggregate(ring, start, step)
    return F.when(F.size(ring) < 4, 0).when(done["edge"], 2).otherwise(done["crossings"] % 2)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """In the first ring and in none of the others, whose boundaries still count as inside."""
    holes = F.transform(F.slice(rings, 2, 1 << 20), lambda r: point_in_ring(lon, lat, r))
    decided = F.element_at(F.concat(F.filter(holes, lambda h: h > 0), F.array(F.lit(2))), 1)
    return (F.size(rings) > 0) & (point_in_ring(lon, lat, F.element_at(rings, 1)) > 0) & (decided == 2)


def band_degrees(km: float) -> float:
    """Height of latitude bands such that points within km lie in the same or neighbouring bands; rounded up."""
    return math.ceil(km / (EARTH_KM * math.pi / 180) * 1000 + 1) / 1000
