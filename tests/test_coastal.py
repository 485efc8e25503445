"""Coastal contexts against a plain loop."""

import math
import random

import pytest

from vigilframe.operators.coastal import coastal_contexts

REGION = "region long, label string, worldwide boolean, enabled boolean, shape string, r_lon double, r_lat double, radius double"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("seed", [1, 2])
def test_watches_before_incidents(spark, seed):
    r = random.Random(seed)
    place = lambda: (r.uniform(0, 6), r.uniform(0, 6))
    regions = [(k, "", k % 7 == 0, k % 5 != 0, "Point" if k % 3 else "Polygon", *(place() if k % 8 else (None, 1.0)), r.choice([None, 3.0, 60.0, 900.0])) for k in range(6 if seed == 1 else 40)]
    incidents = [(f"i{k}", r.choice(["earthquake", "water_level", "volcano"]), r.choice(["active", "updated", "ended", "unknown"]), r.randrange(100), *(place() if k % 9 else (None, None))) for k in range(60)]
    stations = [(k, r.uniform(0, 3), r.uniform(0, 6)) for k in range(12)]
    candidates = [(f"watch:{k}", x, y, max(25.0, min(185.2, 100.0 if radius is None else radius))) for k, _, world, on, shape, x, y, radius in regions if on and not world and shape == "Point" and x is not None]
    candidates += [(f"incident:{i}", x, y, 100.0) for i, kind, status, _, x, y in sorted(incidents, key=lambda i: (-i[3], i[0])) if status in ("active", "updated") and kind != "water_level" and x is not None]
    kept = []
    for c in candidates:
        if len(kept) < 6 and min(km(c[1], c[2], x, y) for _, x, y in stations) <= 100 and all(km(c[1], c[2], k[1], k[2]) > 50 for k in kept):
            kept.append(c)
    tables = spark.createDataFrame(regions, REGION), spark.createDataFrame(incidents, "incident_id string, kind string, status string, priority_score int, lon double, lat double"), spark.createDataFrame(stations, "s_suppkey long, lon double, lat double")
    got = coastal_contexts(*tables).orderBy("place").collect()
    assert [(x.context, x.lon, x.lat, x.radius_km) for x in got] == kept and len(kept) >= 4 and [x.place for x in got] == list(range(1, len(kept) + 1))
    assert coastal_contexts(*tables[:2], tables[2].limit(0)).collect() == []
