"""Geometry expressions over tracks of the events: a line, a ring or a set of points for each user and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.ingest import once
from ..views import observations
from .registry import query

C = F.col
_SQL = """, tr AS (SELECT user_id, event_id // 1000 AS day, list([round(slon, 2), round(slat, 2)] ORDER BY event_id) AS p FROM o GROUP BY ALL
), g AS (SELECT user_id, day, CASE user_id % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Polygon' ELSE 'MultiPoint' END AS kind, CASE WHEN user_id % 3 = 1 THEN list_append(p, p[1]) ELSE p END AS p FROM tr)
"""


def shapes(spark, sf_dir):
    """(user_id, day, kind, coordinates): GeoJSON coordinates as text."""
    o = observations(spark, sf_dir).select("user_id", F.floor(C("event_id") / 1000).alias("day"), F.struct("event_id", F.array(F.round("slon", 2), F.round("slat", 2)).alias("x")).alias("i"))
    t = o.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]).alias("p"))
    kind = F.when(C("user_id") % 3 == 0, "LineString").when(C("user_id") % 3 == 1, "Polygon").otherwise("MultiPoint")
    text = F.when(C("user_id") % 3 == 1, F.to_json(F.array(F.concat("p", F.array(F.get("p", 0)))))).otherwise(F.to_json("p"))
    return t.select("user_id", "day", kind.alias("kind"), text.alias("coordinates"))


@query("fn_geom_points", _SQL + "SELECT user_id, day, len(p) AS n, CASE kind WHEN 'Polygon' THEN len(p) >= 4 WHEN 'LineString' THEN len(p) >= 2 ELSE true END AS valid FROM g")
def fn_geom_points(spark, sf_dir):
    s = shapes(spark, sf_dir)
    return s.select("user_id", "day", F.size(geometry.points(C("kind"), C("coordinates"))).alias("n"), geometry.valid(C("kind"), C("coordinates")).alias("valid"))


@query("fn_centroid_bbox", _SQL + "SELECT user_id, day, round(list_avg(list_transform(p, lambda x: x[1])), 6) AS lon, round(list_avg(list_transform(p, lambda x: x[2])), 6) AS lat, list_min(list_transform(p, lambda x: x[1])) AS west, list_max(list_transform(p, lambda x: x[2])) AS north FROM g")
def fn_centroid_bbox(spark, sf_dir):
    p = shapes(spark, sf_dir).select("user_id", "day", geometry.points(C("kind"), C("coordinates")).alias("p"))
    b = geometry.bounds(C("p"))
    return p.select("user_id", "day", F.round(geometry.centroid(C("p"), 0), 6).alias("lon"), F.round(geometry.centroid(C("p"), 1), 6).alias("lat"), b["west"].alias("west"), b["north"].alias("north"))


@query("fn_simplify", _SQL + ", st AS (SELECT *, list_min(list_filter([1, 2, 4, 8, 16, 32, 64, 128], lambda s: ceil(len(p) / s) + CASE WHEN (len(p) - 1) % s = 0 THEN 0 ELSE 1 END <= 5)) AS stride FROM g) SELECT user_id, day, (len(p) - 1) // stride + 1 + CASE WHEN (len(p) - 1) % stride = 0 THEN 0 ELSE 1 END AS n, p[1][1] AS first_lon, p[len(p)][1] AS last_lon FROM st")
def fn_simplify(spark, sf_dir):
    p = once(shapes(spark, sf_dir), points=geometry.points(C("kind"), C("coordinates")))
    p = once(p, stride=geometry.stride(C("points"), 5))
    p = once(p, p=geometry.strided(C("points"), C("stride")))
    return p.select("user_id", "day", F.size("p").alias("n"), F.get(F.get("p", 0), 0).alias("first_lon"), F.get(F.element_at("p", -1), 0).alias("last_lon"))


@query("agg_geometry_count", _SQL + "SELECT kind, CAST(sum(len(p)) AS BIGINT) AS vertices FROM g GROUP BY kind")
def agg_geometry_count(spark, sf_dir):
    s = shapes(spark, sf_dir)
    return s.groupBy("kind").agg(F.sum(F.size(geometry.points(C("kind"), C("coordinates")))).alias("vertices"))


@query("wat_clean_geometry", _SQL + "SELECT user_id, day FROM g WHERE kind = 'Polygon' AND len(p) BETWEEN 4 AND 500 AND len(list_filter(p, lambda x: x[2] NOT BETWEEN -85 AND 85)) = 0")
def wat_clean_geometry(spark, sf_dir):
    """Shapes that a watch region may have: points and polygons, at most 500 points, latitudes within 85, closed rings."""
    s = shapes(spark, sf_dir)
    return s.where(geometry.region_shape(C("kind"), C("coordinates"))).select("user_id", "day")
