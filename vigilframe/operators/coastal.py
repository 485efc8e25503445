"""Where marine measurements are asked for: watches and incidents near a station, thinned out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, valid_point
from .joins import checkpoint_dir, nearest

C = F.col
#: Contexts in all, kilometres that two of them are apart, and those from the coast that may be asked for.
MOST, KEPT_KM, REACH_KM = 6, 50.0, (25.0, 500.0)
#: Radius of an incident's context, and the least and most of a watch's.
INCIDENT_KM, WATCH_KM = 100.0, (25.0, 185.2)
#: Incidents looked at, by priority; kinds that measurements make themselves, which must not keep themselves going.
INCIDENTS, OWN_KINDS = 1000, ("marine_observation", "water_level")


def thinned(df: DataFrame, per: str, least_km: float, most: int) -> DataFrame:
    """Greedy choice in order of rank: a point goes if one already kept lies within least_km; at most `most` of each group stay.

    A round takes the first point left in each group, by a partial aggregate, and drops what lies near it, so no task
    holds a group.
    """
    checkpoint_dir(df.sparkSession)
    left, kept = df.select(per, "id", "rank", "lon", "lat").checkpoint(), None
    for _ in range(most):
        first = left.groupBy(per).agg(F.min_by(F.struct("id", "lon", "lat"), F.struct("rank", "id")).alias("f")).select(per, "f.*").checkpoint()
        kept = first if kept is None else kept.union(first)
        near = first.select(per, C("lon").alias("k_lon"), C("lat").alias("k_lat"))
        left = left.join(near, per).where(haversine_km(C("lon"), C("lat"), C("k_lon"), C("k_lat")) > least_km).drop("k_lon", "k_lat").checkpoint()
    return kept.select(per, "id")


def coastal_contexts(regions: DataFrame, incidents: DataFrame, stations: DataFrame, reach_km: float = 100.0) -> DataFrame:
    """(context, lon, lat, radius_km, place): at most MOST places near a station and not near one another, enabled point watches first, then live incidents by priority.

    regions as watch_matches() takes them; incidents(incident_id, kind, status, priority_score, lon, lat); stations
    (s_suppkey, lon, lat). Rows without a place count nowhere; without stations there are no contexts.
    """
    reach = max(REACH_KM[0], min(REACH_KM[1], reach_km))
    radius = F.greatest(F.lit(WATCH_KM[0]), F.least(F.lit(WATCH_KM[1]), F.coalesce(C("radius").cast("double"), F.lit(INCIDENT_KM))))
    rank = lambda part, a, b: F.struct(F.lit(part).alias("part"), a.cast("long").alias("a"), b.alias("b")).alias("rank")
    watches = regions.where("enabled AND shape = 'Point' AND NOT worldwide").select(F.concat(F.lit("watch:"), C("region").cast("string")).alias("id"), C("r_lon").alias("lon"), C("r_lat").alias("lat"), radius.alias("radius_km"), rank(0, C("region"), F.lit("")))
    live = incidents.orderBy(F.desc("priority_score"), "incident_id").limit(INCIDENTS).where(C("status").isin("active", "updated") & ~C("kind").isin(*OWN_KINDS))
    said = live.select(F.concat(F.lit("incident:"), "incident_id").alias("id"), "lon", "lat", F.lit(INCIDENT_KM).alias("radius_km"), rank(1, -C("priority_score"), C("incident_id")))
    placed = watches.unionByName(said).where(valid_point(C("lon"), C("lat")))
    coast = placed.join(nearest(placed, stations, "id", "s_suppkey", most_km=reach).select("id"), "id", "left_semi").withColumn("all", F.lit(1)).checkpoint()
    kept = coast.join(thinned(coast, "all", KEPT_KM, MOST).select("id"), "id")  # MOST rows
    return kept.select(C("id").alias("context"), "lon", "lat", "radius_km", F.row_number().over(W.orderBy("rank")).alias("place"))
