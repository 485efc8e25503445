"""Coastal contexts: where marine measurements are asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.coastal import KEPT_KM, MOST, coastal_contexts
from ..operators.scoring import scored_incidents
from ..views import NOW, members, observations
from .joins import _NEAR, _REGION_SQL, station_places, watch_regions
from .registry import query
from .scalars import sql_km
from .sinks import _EXPORT

C = F.col
#: Kilometres to the nearest station; the most that may be asked for, as the tables' stations are few.
_REACH = 500.0
_CONTEXT_SQL = (
    _EXPORT.rstrip().replace("QUALIFY place <= 200", "QUALIFY place <= 1000")
    + _REGION_SQL.rstrip()
    + _NEAR.rstrip().split(", near AS")[0]
    + f""", cand AS (
 SELECT 0 AS part, region AS a, '' AS b, concat('watch:', region) AS context, r_lon AS lon, r_lat AS lat, CAST(greatest(25.0, least(185.2, radius)) AS DOUBLE) AS radius_km FROM r WHERE enabled AND shape = 'Point' AND NOT worldwide
 UNION ALL SELECT 1, -priority_score, incident_id, concat('incident:', incident_id), lon, lat, 100.0 FROM ex WHERE status = 'active' AND lon IS NOT NULL AND kind NOT IN ('marine_observation', 'water_level')
), coast AS (SELECT *, row_number() OVER (ORDER BY part, a, b) AS n FROM cand WHERE EXISTS (SELECT 1 FROM st WHERE {sql_km('lon', 'lat', 's_lon', 's_lat')} <= {_REACH})
), kept AS (WITH RECURSIVE g(n, k) AS (SELECT 0::BIGINT, [{{'n': 0::BIGINT, 'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE}}][:0] UNION ALL
 SELECT c.n, CASE WHEN len(k) < {MOST} AND len(list_filter(k, lambda p: {sql_km('p.x', 'p.y', 'c.lon', 'c.lat')} <= {KEPT_KM})) = 0 THEN list_append(k, {{'n': c.n, 'x': c.lon::DOUBLE, 'y': c.lat::DOUBLE}}) ELSE k END FROM g JOIN coast c ON c.n = g.n + 1
) SELECT unnest(k).n AS n FROM (SELECT arg_max(k, n) AS k FROM g))
"""
)


@query("join_coastal_context", _CONTEXT_SQL + "SELECT context, round(lon, 4) AS lon, round(lat, 4) AS lat, round(radius_km, 1) AS radius_km, row_number() OVER (ORDER BY n) AS place FROM coast JOIN kept USING (n)")
def coastal_context(spark, sf_dir):
    """Contexts of the point watches and then of the incidents by priority, with suppliers for stations."""
    incidents = scored_incidents(members(observations(spark, sf_dir)), NOW).withColumns({c: F.round(c, 4) for c in ("lon", "lat")})
    told = coastal_contexts(watch_regions(spark, sf_dir), incidents, station_places(spark, sf_dir), _REACH)
    return told.select("context", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), F.round("radius_km", 1).alias("radius_km"), "place")
