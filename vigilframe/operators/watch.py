"""Watch regions: points with a radius, polygons with holes, several polygons, or the whole world.

Regions are covered by cells of a grid; observations meet them by cell. A cell that lies wholly inside needs no further
test, a cell on an edge is followed by the exact one. Large regions take larger cells, so that a cover stays small.

A regions table has region, label, worldwide, enabled, kinds (none: all), least (a severity's rank), keywords (none: any),
shape (Point, Polygon or MultiPolygon), r_lon, r_lat and radius of a point, and polygons: an array of arrays of rings of
(lon, lat), as GeoJSON has them, of which the first is the outer one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lookup import severity_rank
from ..model import EARTH_KM

C = F.col
#: Sides of the grids' cells in degrees, each a divisor of 360, and the most square degrees of a region that takes them.
SIDES = {1: 400.0, 5: 10_000.0, 20: math.inf}
#: Regions, and rows of covers, that are broadcast at most; beyond them they are joined by a shuffle, worldwide regions in blocks.
BROADCAST_REGIONS, BROADCAST_CELLS = 10_000, 500_000
#: Degrees by which cells are taken larger than they are, against rounding.
MARGIN = 1e-6


def _near(v: Column, to: Column) -> Column:
    """A longitude moved by whole turns to within 180 degrees of another."""
    return to + F.pmod(v - to + 180, F.lit(360.0)) - 180


def ring_valid(ring: Column) -> Column:
    return F.coalesce((F.size(ring) >= 4) & F.forall(ring, lambda p: F.coalesce(geo.valid_point(p["lon"], p["lat"]), F.lit(False))), F.lit(False))


def valid_polygons(polygons: Column) -> Column:
    """Polygons whose outer ring can be used, without holes that can't."""
    usable = F.filter(polygons, lambda p: (F.size(p) > 0) & ring_valid(F.get(p, 0)))
    return F.transform(usable, lambda p: F.concat(F.slice(p, 1, 1), F.filter(F.slice(p, 2, 1 << 20), ring_valid)))


def ring_bounds(ring: Column) -> Column:
    """(west, east, south, north) of a ring whose longitudes follow one another by less than half a turn; east may be beyond 180."""
    first = F.get(ring, 0)
    start = F.struct(first["lon"].alias("x"), first["lon"].alias("west"), first["lon"].alias("east"), first["lat"].alias("south"), first["lat"].alias("north"))

    def step(a: Column, p: Column) -> Column:
        x = _near(p["lon"], a["x"])
        return F.struct(x.alias("x"), F.least(a["west"], x).alias("west"), F.greatest(a["east"], x).alias("east"), F.least(a["south"], p["lat"]).alias("south"), F.greatest(a["north"], p["lat"]).alias("north"))

    return F.aggregate(ring, start, step)


def _ring_meets(x: Column, y: Column, half: Column, ring: Column) -> Column:
    """Whether an edge of the ring touches the square around (x, y), or the ring lies so far that points of the square would see different turns of it."""
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(False).alias("any"), F.lit(False).alias("meets"))

    def step(a: Column, p: Column) -> Column:
        x1, y1, x2, y2 = a["x"], a["y"], _near(p["lon"], a["x"]), p["lat"]
        boxes = (F.least(x1, x2) <= x + half) & (F.greatest(x1, x2) >= x - half) & (F.least(y1, y2) <= y + half) & (F.greatest(y1, y2) >= y - half)
        # The square is on both sides of the edge's line if its middle is no further from it than its corners can be.
        reach = half * (F.abs(x2 - x1) + F.abs(y2 - y1))
        line = F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) <= reach + MARGIN
        far = ~a["any"] & (F.abs(x2 - x) + half >= 180)
        return F.struct(x2.alias("x"), y2.alias("y"), F.lit(True).alias("any"), (a["meets"] | far | (a["any"] & boxes & line)).alias("meets"))

    return F.aggregate(ring, start, step)["meets"]


def _box_of_point() -> Column:
    """Bounds of a circle; every longitude where it reaches a pole."""
    up = C("radius") / (EARTH_KM * math.pi / 180) + MARGIN
    wide = F.sin(F.radians(up)) / F.cos(F.radians("r_lat"))
    aside = F.when((F.abs("r_lat") + up >= 90) | (wide >= 1), 180.0).otherwise(F.degrees(F.asin(wide)) + MARGIN)
    return F.struct((C("r_lon") - aside).alias("west"), (C("r_lon") + aside).alias("east"), (C("r_lat") - up).alias("south"), (C("r_lat") + up).alias("north"))


def region_cells(local: DataFrame) -> DataFrame:
    """(region, side, cx, cy, inner): the cells of each region that is not worldwide. No longer than some hundred rows a region."""
    polygon_box = F.transform("polygons", lambda p: ring_bounds(F.get(p, 0)))
    boxes = F.when(C("shape") == "Point", F.array(_box_of_point())).otherwise(F.transform(polygon_box, lambda b: F.struct(b["west"].alias("west"), b["east"].alias("east"), b["south"].alias("south"), b["north"].alias("north"))))
    area = F.array_max(F.transform("boxes", lambda b: (b["east"] - b["west"]) * (b["north"] - b["south"])))  # one side for all parts, so no row meets a region twice
    side = reduce(lambda rest, s: F.when(area <= SIDES[s], s).otherwise(rest), sorted(SIDES, reverse=True), F.lit(max(SIDES)))
    boxed = local.select("region", "shape", "polygons", boxes.alias("boxes")).select("region", "shape", "polygons", side.alias("side"), F.posexplode("boxes").alias("part", "box"))
    sized = boxed.withColumn("polygon", F.get("polygons", "part")).drop("polygons")
    index = lambda c, shift, margin: F.floor((C(c) + shift + margin) / C("side")).cast("int")
    across = sized.withColumn("x", F.explode(F.sequence(index("box.west", 180, -MARGIN), index("box.east", 180, MARGIN))))
    spread = across.withColumn("cy", F.explode(F.sequence(index("box.south", 90, -MARGIN), index("box.north", 90, MARGIN))))
    x, y, half = (C("x") + 0.5) * C("side") - 180, (C("cy") + 0.5) * C("side") - 90, C("side") / 2 + MARGIN
    edge = (C("shape") == "Point") | F.exists("polygon", lambda ring: _ring_meets(x, y, half, ring))
    inside = (geo.point_in_ring(x, y, F.get("polygon", 0)) == 1) & ~F.exists(F.slice("polygon", 2, 1 << 20), lambda ring: geo.point_in_ring(x, y, ring) == 1)
    told = spread.withColumn("inner", ~edge).where(edge | inside)
    return told.select("region", "side", F.pmod("x", F.lit(360) / C("side")).cast("int").alias("cx"), "cy", "inner").groupBy("region", "side", "cx", "cy").agg(F.max("inner").alias("inner"))


def in_region(lon: Column, lat: Column) -> Column:
    """The exact test of a region's shape."""
    close = geo.haversine_km(C("r_lon"), C("r_lat"), lon, lat) <= C("radius")
    return F.when(C("shape") == "Point", close).otherwise(F.exists("polygons", lambda p: geo.in_polygon(lon, lat, p)))


def watch_matches(observed: DataFrame, regions: DataFrame) -> DataFrame:
    """observed rows (kind, severity, headline, summary, location_name, slon, slat, ...) with region and label of each enabled region that they match.

    Kind, severity and keywords are tested first. Worldwide regions match rows without a place too; others match by
    shape, borders and the rims of holes included. Rings with points out of range, or of fewer than four, are none.
    """
    said = F.lower(F.concat_ws(" ", "headline", "summary", "location_name"))
    on = regions.where("enabled").withColumn("polygons", valid_polygons(F.coalesce("polygons", F.array().cast(regions.schema["polygons"].dataType))))
    rule = ["region", "label", "kinds", "least", "keywords"]
    kind = F.coalesce(F.size("kinds") <= 0, F.lit(True)) | F.array_contains("kinds", F.coalesce("kind", F.lit("unknown")))
    words = F.coalesce(F.size("keywords") <= 0, F.lit(True)) | F.exists("keywords", lambda w: F.contains(said, F.lower(w)))
    rules = kind & (severity_rank(C("severity")) >= C("least")) & words
    columns = [*(observed[c] for c in observed.columns), C("region"), C("label")]

    world = on.where("worldwide").select(*rule)
    blocks = max(1, -(-world.count() // (BROADCAST_REGIONS // 2)))  # about half the bound in each
    block = F.pmod(F.xxhash64("region"), F.lit(blocks))
    found = [observed.join(F.broadcast(world.where(block == k)), rules).select(*columns) for k in range(blocks)]

    local = on.where("NOT worldwide")
    cells = region_cells(local)
    few = local.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS and cells.count() <= BROADCAST_CELLS
    sent = F.broadcast if few else lambda df: df
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.pmod(F.floor((C("slon") + 180) / s), F.lit(360 // s)).cast("int").alias("cx"), F.floor((C("slat") + 90) / s).cast("int").alias("cy")) for s in SIDES))
    placed = observed.where(geo.valid_point(C("slon"), C("slat"))).withColumn("cell", F.explode(sides))
    near = placed.select("*", "cell.*").drop("cell").join(sent(cells), ["side", "cx", "cy"]).drop("side", "cx", "cy")
    shape = ["shape", "r_lon", "r_lat", "radius", "polygons"]
    # Rules first, by the small columns; shapes meet only what lies in cells on an edge.
    ruled = near.join(sent(local.select(*rule)), "region").where(rules)
    found.append(ruled.where("inner").select(*columns))
    found.append(ruled.where("NOT inner").join(sent(local.select("region", *shape)), "region").where(in_region(C("slon"), C("slat"))).select(*columns))
    return reduce(DataFrame.unionByName, found)
