"""The table of cells against plain boxes, and what its scans leave out."""

import random
import re

from vigilframe.operators.commits import new_folder
from vigilframe.operators.geo_table import GeoTable, cell_ranges

SCHEMA = "id long, x double, y double"


def points(r, n):
    corners = [(x, y) for x in (-180.0, 180.0, 0.0, -22.5, 10.0) for y in (-90.0, 90.0, 0.0, 45.0)]
    some = [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(n)] + [(10 + r.random(), 45 + r.random()) for _ in range(n)]
    return [(k, x, y) for k, (x, y) in enumerate([*corners, *some, (None, 1.0), (1.0, None), (200.0, 0.0), (0.0, 91.0), (float("nan"), 0.0)])]


def test_boxes(spark):
    r = random.Random(4)
    rows = points(r, 400)
    table = GeoTable(spark, new_folder(spark), "x", "y").put(spark.createDataFrame(rows[:500], SCHEMA)).put(spark.createDataFrame(rows[500:], SCHEMA))
    boxes = [(-180, -90, 180, 90), (10, 45, 11, 46), (170, -20, -170, 20), (180, 90, 180, 90), (-22.5, 0, 0, 45), (10.2, 45.2, 10.2001, 45.2001)]
    boxes += [(r.uniform(-180, 180), *sorted((r.uniform(-90, 90), r.uniform(-90, 90))), r.uniform(-180, 180)) for _ in range(4)]
    boxes = boxes[:6] + [(w, s, e, n) for w, s, n, e in boxes[6:]]
    for w, s, e, n in boxes:
        want = {k for k, x, y in rows if x is not None and y is not None and -180 <= x <= 180 and s <= y <= n and (w <= x <= e if w <= e else x >= w or x <= e)}
        assert {x.id for x in table.within(w, s, e, n).collect()} == want, (w, s, e, n)
        assert 1 <= len(cell_ranges(min(w, e), s, max(w, e), n)) <= 48
    plan = table.within(10, 45, 11, 46)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*geo_tile", plan) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(geo_cell", plan)
    assert len(table.within(10, 45, 11, 46).inputFiles()) >= 1
    read = table.within(10, 45, 11, 46)._jdf.queryExecution().executedPlan()
    assert read is not None and "geo_tile=-1" not in plan


def test_empty_and_invalid(spark):
    table = GeoTable(spark, new_folder(spark), "x", "y").put(spark.createDataFrame([(1, None, None)], SCHEMA))
    assert table.within(-180, -90, 180, 90).collect() == []
    for bad in ((-181, 0, 0, 1), (0, 5, 1, 4), (0, 0, 1, 91)):
        try:
            table.within(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)
