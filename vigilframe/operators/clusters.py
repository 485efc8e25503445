"""Grid clusters for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import in_bounds, valid_point

C = F.col
#: Members that a cluster lists by name; all are counted.
LISTED = 50
WORLD = (-180.0, -90.0, 180.0, 90.0)


def cell_size(zoom: float, pixels: float) -> tuple[float, float]:
    """Degrees of longitude and latitude of a cell: zoom 0 to 20, 16 to 256 pixels."""
    tiles = 256 * 2 ** max(0, min(20, zoom))
    side = max(16, min(256, pixels))
    return 360 / tiles * side, 170 / tiles * side


def clusters(rows: DataFrame, id: str, priority: str, lon: str, lat: str, zoom: float = 2, pixels: float = 52, bounds: tuple = WORLD, listed: int = LISTED) -> DataFrame:
    """(x, y, lon, lat, n, most, members) of the cells that rows within bounds (west, south, east, north) lie in.

    Longitudes are averaged on the circle. members are the first `listed` ids by priority, the highest first, and id;
    they are chosen before the shuffle as well as after it, so a full cell is no one task's. Rows without a place, or out
    of range, are in none; a null priority counts as 0.
    """
    wide, high = cell_size(zoom, pixels)
    placed = rows.where(valid_point(C(lon), C(lat)) & in_bounds(C(lon), C(lat), *bounds))
    x = F.floor(F.pmod(C(lon) + 180 + wide / 2, F.lit(360.0)) / wide)
    cells = placed.select(x.alias("x"), F.floor((C(lat) + 90) / high).alias("y"), C(lon).alias("a"), C(lat).alias("b"), C(id).alias("id"), F.coalesce(C(priority), F.lit(0)).alias("p"))
    first = W.partitionBy("x", "y").orderBy(F.desc("p"), "id")
    named = cells.withColumn("k", F.row_number().over(first)).where(C("k") <= listed).groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda m: m["id"]).alias("members"))
    middle = F.degrees(F.atan2(F.sum(F.sin(F.radians("a"))), F.sum(F.cos(F.radians("a")))))
    return cells.groupBy("x", "y").agg(middle.alias("lon"), F.avg("b").alias("lat"), F.count("*").alias("n"), F.max("p").alias("most")).join(named, ["x", "y"])
