"""A table of points laid out along a space-filling curve: boxes become ranges of cells, so a scan reads little else.

A point's cell is its place on the Z curve of a grid of 2^BITS columns and rows; the curve's first steps are its tile.
Rows lie in folders by tile, sorted by cell, so a box prunes folders by tile and row groups by ranges of cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_bounds, valid_point

C = F.col
#: Bits of a cell's column and row, and of a tile's.
BITS, TILE_BITS = 15, 3
#: Ranges that a box is made of at most; a finer cover is made coarser.
RANGES = 48


def _spread(c: Column) -> Column:
    """A zero bit before each of the lower 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def cell_of(lon: Column, lat: Column) -> Column:
    """Number of a point's cell; 180 degrees east and the pole lie in the last column and row."""
    n = 1 << BITS
    column = F.least(F.floor((lon + 180) / 360 * n), F.lit(n - 1)).cast("int")
    row = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("int")
    return _spread(column).bitwiseOR(F.shiftleft(_spread(row), 1))


def cell_ranges(west: float, south: float, east: float, north: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cells (first, last) that cover a box with west <= east: quarters of the world, those on the box's edge quartered again while there are few."""
    n = 1 << BITS
    step = lambda v, low, span: min(n - 1, max(0, int((v - low) / span * n)))
    # A cell more on each side, as a point's cell is found by other arithmetic.
    x0, x1 = max(0, step(west, -180, 360) - 1), min(n - 1, step(east, -180, 360) + 1)
    y0, y1 = max(0, step(south, -90, 180) - 1), min(n - 1, step(north, -90, 180) + 1)
    whole: list[tuple[int, int]] = []
    edge = [(0, 0, n)]  # column, row, side
    while edge and edge[0][2] > 1:
        finer = []
        for x, y, side in edge:
            half = side // 2
            for a, b in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
                if a > x1 or a + half - 1 < x0 or b > y1 or b + half - 1 < y0:
                    continue
                inside = x0 <= a and a + half - 1 <= x1 and y0 <= b and b + half - 1 <= y1
                (whole if inside else finer).append((a, b, half))
        if len(whole) + len(finer) > most:
            break
        edge = finer
    bits = lambda v: int("".join(f"0{d}" for d in f"{v:b}"), 2)
    first = lambda a, b: bits(a) | bits(b) << 1
    found = sorted((first(a, b), first(a, b) + side * side - 1) for a, b, side in [*whole, *edge])
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class GeoTable:
    """Rows with a point each under a folder; rows without a point in range lie in a tile of their own, which no box reads."""

    def __init__(self, spark: SparkSession, path: str, lon: str, lat: str):
        self.spark, self.path, self.lon, self.lat = spark, path, lon, lat

    def put(self, rows: DataFrame, mode: str = "append") -> GeoTable:
        """Lays rows out. Tiles hold very different numbers of rows; ranges of cells, taken from a sample, are dealt to tasks instead."""
        cell = F.when(valid_point(C(self.lon), C(self.lat)), cell_of(C(self.lon), C(self.lat))).otherwise(-1)
        placed = rows.withColumn("geo_cell", cell).withColumn("geo_tile", F.shiftright("geo_cell", 2 * (BITS - TILE_BITS)))
        placed.repartitionByRange("geo_cell").sortWithinPartitions("geo_cell").write.mode(mode).partitionBy("geo_tile").parquet(self.path)
        return self

    def within(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """Rows in a box, edges included; one with west beyond east crosses the antimeridian."""
        if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= north <= 90):
            raise ValueError("invalid bounding box")
        boxes = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
        ranges = [r for w, e in boxes for r in cell_ranges(w, south, e, north)]
        tiles = sorted({t for a, b in ranges for t in range(a >> 2 * (BITS - TILE_BITS), (b >> 2 * (BITS - TILE_BITS)) + 1)})
        rows = self.spark.read.parquet(self.path).where(C("geo_tile").isin(tiles))
        near = reduce(lambda a, b: a | b, (C("geo_cell").between(a, b) for a, b in ranges))
        return rows.where(near & in_bounds(C(self.lon), C(self.lat), west, south, east, north)).drop("geo_cell", "geo_tile")
