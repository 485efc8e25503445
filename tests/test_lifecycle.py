"""Replay, components, joins and geometry beyond what SQL covers."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import geo, geometry
from vigilframe.operators.joins import components, likeness_join, nearest
from vigilframe.operators.lifecycle import correlate_replay, upsert_latest
from vigilframe.sources.ingest import OBSERVATION, PROVIDERS, diagnostics, normalize, register_provider


def greedy(rows, pairs):
    near = {r[0]: {b for a, b in pairs if a == r[0]} | {a for a, b in pairs if b == r[0]} for r in rows}
    where = {}
    for event, own in rows:
        found = [where[x] for x in near[event] if x in where]
        where[event] = min(found) if found else own
    return where


def test_replay_is_the_global_greedy_result(spark):
    r = random.Random(1)
    n = 60
    o = spark.createDataFrame([(i, f"p:{r.random()}", i, "volcano") for i in range(n)], "event_id long, observation_id string, t long, kind string").withColumn("ingested_at", F.timestamp_seconds("t"))
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(45)})
    got = {x.event_id: x.incident for x in correlate_replay(o, spark.createDataFrame(pairs, "a long, b long")).collect()}
    own = {x.event_id: x.own for x in o.select("event_id", F.concat(F.lit("incident:volcano:"), F.substring(F.sha2("observation_id", 256), 1, 24)).alias("own")).collect()}
    assert got == greedy([(i, own[i]) for i in range(n)], pairs)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert {x.node: x.component for x in components(links, "a", "b").collect()} == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_likeness_join_loses_nothing(spark):
    r = random.Random(2)
    sets = [(i, r.sample("abcdefghij", r.randrange(1, 8))) for i in range(60)]
    df = spark.createDataFrame(sets, "id long, t array<string>")
    got = {(x.x, x.y) for x in likeness_join(df.withColumnRenamed("id", "x"), df.withColumnRenamed("id", "y"), "x", "t", "y", "t", 0.5).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5}


def km(a, b):
    (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("n", [1, 30, 400])
def test_nearest_by_rings_equals_the_scan(spark, n):
    r = random.Random(n)
    place = lambda n: [(i, r.uniform(-180, 180), r.choice([r.uniform(-90, 90), 90.0, -90.0, r.uniform(84, 90)])) for i in range(n)]
    points, stations = place(60) + [(99, None, 1.0)], place(n) + [(1000, 5.0, None)]
    p, s = spark.createDataFrame(points, "p long, lon double, lat double"), spark.createDataFrame(stations, "s long, lon double, lat double")
    got = {x.p: (x.s, round(x.km, 3)) for x in nearest(p, s, "p", "s").collect()}
    want = {i: min((round(km((x, y), (u, v)), 6), j) for j, u, v in stations[:-1]) for i, x, y in points[:-1]}
    assert set(got) == set(want) and all(abs(got[i][1] - want[i][0]) < 0.01 for i in want)
    assert sum(got[i][0] == want[i][1] for i in want) >= len(want) - 2


def test_nearest_repeats_no_points(spark, monkeypatch):
    rows, frame = [], type(spark.range(1))
    kept = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: (rows.append(self), kept(self, *a))[1])
    r = random.Random(8)
    points = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(200)]
    stations = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(100)]
    p = spark.createDataFrame([*points, points[3]], "p long, lon double, lat double")
    s = spark.createDataFrame([*stations, (500, *stations[5][1:]), (-1, *stations[6][1:])], "s long, lon double, lat double")
    got = [(x.p, x.s) for x in nearest(p, s, "p", "s").collect()]
    want = {i: min((round(km((x, y), (u, v)), 6), j) for j, u, v in stations)[1] for i, x, y in points}
    assert sorted(got) == sorted((i, -1 if j == 6 else j) for i, j in want.items())
    assert len(rows) > 1 and not any(re.search(r"Generate .*\bp#", d._jdf.queryExecution().executedPlan().toString()) for d in rows)


def test_thinning_is_greedy(spark):
    from vigilframe.operators.coastal import thinned

    r = random.Random(4)
    rows = [(f"g{r.randrange(3)}", i, float(r.randrange(20)), r.uniform(0, 3), r.uniform(0, 3)) for i in range(150)]
    got = {(x.per, x.id) for x in thinned(spark.createDataFrame(rows, "per string, id long, rank double, lon double, lat double"), "per", 50.0, 6).collect()}
    want = set()
    for g in {x[0] for x in rows}:
        kept = []
        for row in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            if len(kept) < 6 and all(km(row[3:], k[3:]) > 50 for k in kept):
                kept.append(row)
        want |= {(g, k[1]) for k in kept}
    assert got == want


def test_dense_cursors_and_merges(spark, tmp_path):
    from vigilframe.operators.sinks import dense_cursor, upsert_actions, upsert_table

    r = random.Random(5)
    rows = [(i, r.randrange(40) * 1200) for i in range(200)]
    log = spark.createDataFrame(rows, "i long, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {x.i: x.cursor for x in dense_cursor(log, "at", ["i"], 1000).collect()}
    assert got == {i: 1001 + k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    make = lambda *x: spark.createDataFrame(list(x), "k string, n int, h string")
    path = f"{tmp_path}/t"
    upsert_table(spark, path, make(("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")), "k", ["n"], "h")
    second = upsert_table(spark, path, make(("a", 3, "z"), ("c", 1, "w")), "k", ["n"], "h")
    assert sorted((x.k, x.n, x.h, x.changed) for x in second.collect()) == [("a", 3, "z", False), ("b", 1, "y", False), ("c", 1, "w", True)]
    old, new = make(("a", 1, "x"), ("b", 2, "x"), ("c", 2, "x")), make(("a", 1, "y"), ("b", 3, "x"), ("c", 2, "x"), ("d", 1, "x"))
    assert sorted((x.k, x.action) for x in upsert_actions(old, new, "k", "n", "h").collect()) == [("a", "rejected"), ("b", "updated"), ("d", "inserted")]


def test_a_named_stream_goes_on(spark, tmp_path):
    from vigilframe.streaming.streams import run_available

    schema = "i long"
    live = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    name = f"test-{random.Random().random()}"
    for part in ([1, 2], [3]):
        spark.createDataFrame([(x,) for x in part], schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = run_available(live(), name=name)
    assert sorted(x.i for x in out.collect()) == [1, 2, 3]


def test_a_replaced_source_has_another_name(spark, tmp_path):
    import os

    from vigilframe.streaming.streams import source_name

    path = f"{tmp_path}/in"
    put = lambda n, mode: spark.range(n).coalesce(1).write.mode(mode).parquet(path)
    put(3, "overwrite")
    first = source_name(spark, path)
    for f in os.listdir(path):
        os.utime(f"{path}/{f}", (1000, 1000))
    aged = source_name(spark, path)
    put(5, "append")
    assert source_name(spark, path) == aged != first
    put(3, "overwrite")
    assert source_name(spark, path) not in (aged, first)


def test_entities_and_folding(spark):
    import html
    import unicodedata

    from vigilframe.functions.text import ascii_fold, unescaped

    texts = ["a &amp;lt; b", "&#233;&#xE9; &eacute; &nosuch; &copy &quot;", "&#0; &#x110000; x", "plain & simple", "&lt;p&gt;&nbsp;&hellip;", "ﬁ ½ é ß ① Å ㎏ 𝔘 é 日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped(F.col("t")).alias("u"), ascii_fold(F.col("t")).alias("f")).collect()
    for x in rows:
        if "&copy " not in x.t:
            assert x.u == html.unescape(x.t), x.t
        assert x.f == unicodedata.normalize("NFKD", x.t).encode("ascii", "ignore").decode()


@pytest.mark.parametrize("lon, lat, want", [(5, 5, False), (0.5, 0.5, True), (0, 5, True), (2, 5, True), (11, 5, False)])
def test_polygon_with_a_hole(spark, lon, lat, want):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p))
    rings = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((2, 2), (8, 2), (8, 8), (2, 8), (2, 2)))
    assert spark.range(1).select(geo.in_polygon(F.lit(float(lon)), F.lit(float(lat)), rings)).first()[0] is want


def test_geometry_types(spark):
    rows = [("Point", "[1,2]", True, 1), ("Point", "[200,2]", False, 1), ("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]", True, 8), ("Polygon", "[[[0,0],[1,0],[1,1]]]", False, 3), ("LineString", "[[0,0]]", False, 1), ("Odd", "[]", False, None)]
    df = spark.createDataFrame(rows, "kind string, c string, ok boolean, n int")
    for x in df.select("ok", "n", geometry.valid(F.col("kind"), F.col("c")).alias("got"), F.size(geometry.points(F.col("kind"), F.col("c"))).alias("m")).collect():
        assert x.got == x.ok and (x.n is None or x.m == x.n)


def test_upsert_guards_revisions(spark):
    old = spark.createDataFrame([("a", 2), ("b", 5)], "id string, rev long")
    new = spark.createDataFrame([("a", 3), ("b", 5), ("c", 1)], "id string, rev long")
    assert sorted(map(tuple, upsert_latest(old, new, "id", "rev").collect())) == [("a", 3, False), ("c", 1, True)]


def test_bad_payloads_never_drop_the_others(spark):
    quake = {"id": "q1", "geometry": {"coordinates": [1.5, 2.5, 10.0]}, "properties": {"mag": 5.1, "title": "M 5.1", "time": 1700000000000, "url": "https://user:pw@example.org/"}}
    rows = [("usgs_earthquakes", json.dumps({"features": [quake, {"properties": {}}, {"id": " "}]})), ("usgs_earthquakes", "not json"), ("usgs_earthquakes", None), ("nhc_storms", "[]"), ("nobody", "{}")]
    p = spark.createDataFrame(rows, "provider_id string, body string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    got = normalize(p).collect()
    assert [x.record_id for x in got] == ["q1"] and tuple(got[0].asDict()) == OBSERVATION
    assert (got[0].lon, got[0].metrics["magnitude"], got[0].source_url, got[0].severity) == (1.5, "5.1", None, "Unknown")
    said = {(x.provider_id, x.problem, x.field) for x in diagnostics(p, {"usgs_earthquakes": ("features", "metadata"), "nhc_storms": ("activeStorms",)}).collect()}
    assert ("usgs_earthquakes", "missing", "metadata") in said and ("usgs_earthquakes", "wrong root", "") in said and ("nobody", "unknown provider", "") in said


def test_providers_can_be_added(spark):
    @register_provider("own")
    def own(p):
        return PROVIDERS["smithsonian_volcano"](p)

    p = spark.createDataFrame([("own", "<rss><item><guid>g</guid><title>Ash</title></item></rss>")], "provider_id string, body string").withColumn("ingested_at", F.current_timestamp())
    assert [x.record_id for x in normalize(p).collect()] == ["g"]
    del PROVIDERS["own"]
