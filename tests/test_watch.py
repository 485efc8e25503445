"""Watch regions: shapes with holes and over the antimeridian, kinds and keywords, against plain tests of every pair."""

import math
import random

import pytest

from vigilframe.operators import watch


def near(v, to):
    return to + (v - to + 180) % 360 - 180


def ring_rel(x, y, ring):
    """2 on the ring, 1 inside, 0 outside or unusable."""
    if len(ring) < 4 or any(not (-180 <= a <= 180 and -90 <= b <= 90) for a, b in ring):
        return 0
    at, turned = x, []
    for a, b in ring:
        at = near(a, at)
        turned.append((at, b))
    odd = False
    for (x1, y1), (x2, y2) in zip(turned, turned[1:], strict=False):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        if abs(cross) <= 1e-9 and min(x1, x2) - 1e-9 <= x <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= y <= max(y1, y2) + 1e-9:
            return 2
        if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            odd = not odd
    return int(odd)


def inside(x, y, polygons):
    def one(p):
        if not p or not ring_rel(x, y, p[0]):
            return False
        for hole in p[1:]:
            if rel := ring_rel(x, y, hole):
                return rel == 2
        return True

    return any(map(one, polygons))


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


SCHEMA = "region long, label string, worldwide boolean, enabled boolean, kinds array<string>, least int, keywords array<string>, shape string, r_lon double, r_lat double, radius double, polygons array<array<array<struct<lon: double, lat: double>>>>"
OBSERVED = "event_id long, kind string, severity string, headline string, summary string, location_name string, slon double, slat double"


def wrap(x):
    return (x + 180) % 360 - 180


def ring(r, x, y, w, n=6):
    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    some = [(wrap(round(x + w * math.cos(t), 2)), max(-89.0, min(89.0, round(y + w / 2 * math.sin(t), 2)))) for t in turns]
    return [*some, some[0]]


def regions(r):
    plain = lambda n, shape, polygons=None, x=None, y=None, radius=None, **more: {"region": n, "label": f"L{n}", "worldwide": False, "enabled": True, "kinds": [], "least": 0, "keywords": [], "shape": shape, "r_lon": x, "r_lat": y, "radius": radius, "polygons": polygons} | more
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    out = [
        plain(1, "Polygon", [[square(170.0, -10.0, -160.0, 10.0)]]),
        plain(2, "Polygon", [[square(0.0, 0.0, 10.0, 10.0), square(3.0, 3.0, 7.0, 7.0)]]),
        plain(3, "MultiPolygon", [[square(20.0, 0.0, 25.0, 5.0)], [square(-100.0, -80.0, 60.0, 80.0)]]),
        plain(4, "Point", x=179.5, y=0.0, radius=300.0),
        plain(5, "Point", x=10.0, y=89.0, radius=500.0),
        plain(6, "Point", worldwide=True, kinds=["tsunami"], least=2),
        plain(7, "Polygon", [[square(0.0, 0.0, 10.0, 10.0)]], enabled=False),
        plain(8, "Polygon", [[square(0.0, 0.0, 10.0, 10.0)], [[(0.0, 0.0), (1.0, 1.0)]], [square(0.0, 91.0, 5.0, 0.0)]], kinds=["quake", "tsunami"], keywords=["HARBOUR", "x"]),
        plain(9, "Point"),
        plain(10, "Polygon", None),
        plain(11, "Polygon", [[[(-170.0, -60.0), (-60.0, -60.0), (50.0, -60.0), (160.0, -60.0), (160.0, 60.0), (50.0, 60.0), (-60.0, 60.0), (-170.0, 60.0), (-170.0, -60.0)]]]),
        plain(12, "Point", worldwide=True, keywords=["harbour"]),
    ]
    for k in range(13, 60):
        x, y, w = r.uniform(-180, 180), r.uniform(-70, 70), r.choice([0.3, 2, 9, 40])
        out.append(plain(k, "Point", x=x, y=y, radius=w * 60.0) if k % 3 == 0 else plain(k, "MultiPolygon", [[ring(r, x, y, w), *([ring(r, x, y, w / 3)] if k % 2 else [])], [ring(r, wrap(x + 90), y, w)]]))
    return out


def observations(r):
    some = [(k, r.choice(["quake", "tsunami", None]), r.choice(["Extreme", "Moderate", None]), r.choice(["Harbour wave", "x y", None]), "", r.choice([None, "harbour"]), r.uniform(-180, 180), r.uniform(-90, 90)) for k in range(1500)]
    spots = [(x, y) for x in (-180.0, 180.0, 0.0, 3.0, 5.0, 7.0, 10.0, 170.0, -160.0, 20.0, 25.0) for y in (-90.0, 0.0, 3.0, 5.0, 10.0, 89.5, 90.0)]
    return some + [(2000 + k, "tsunami", "Extreme", "harbour", "x", None, x, y) for k, (x, y) in enumerate(spots)] + [(3000, "tsunami", "Severe", None, None, "Harbour", None, None), (3000, "tsunami", "Severe", None, None, "Harbour", 5.0, 400.0), (3001, None, None, None, None, None, None, 1.0)]


@pytest.mark.parametrize("bound", [10_000, 4])
def test_watch_matches_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(watch, "BROADCAST_REGIONS", bound)
    r = random.Random(7)
    known, seen = regions(r), observations(r)
    rank = {"Extreme": 4, "Severe": 3, "Moderate": 2, "Minor": 1}
    want = []
    for g in known:
        for event, kind, severity, *said, x, y in seen:
            text = " ".join(t for t in said if t is not None).lower()
            placed = x is not None and y is not None and -180 <= x <= 180 and -90 <= y <= 90
            where = g["worldwide"] or placed and (g["r_lon"] is not None and km(g["r_lon"], g["r_lat"], x, y) <= g["radius"] if g["shape"] == "Point" else inside(x, y, g["polygons"] or []))
            if g["enabled"] and where and (not g["kinds"] or (kind or "unknown") in g["kinds"]) and rank.get(severity, 0) >= g["least"] and (not g["keywords"] or any(w.lower() in text for w in g["keywords"])):
                want.append((g["region"], event))
    names = list(known[0])
    table = spark.createDataFrame([tuple(g[n] for n in names) for g in known], SCHEMA)
    got = watch.watch_matches(spark.createDataFrame(seen, OBSERVED), table)
    assert sorted((x.region, x.event_id) for x in got.collect()) == sorted(want)
    assert {g for g, _ in want} >= {1, 2, 3, 4, 5, 6, 8, 11, 12}


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(observations(random.Random(1))[:5], OBSERVED)
    assert watch.watch_matches(some, none).collect() == [] == watch.watch_matches(some.limit(0), none).collect()
