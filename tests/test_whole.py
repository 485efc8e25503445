"""Queries see whole tables and whole texts."""

from pyspark.sql import functions as F

from vigilframe.model import ZONES
from vigilframe.plans import QUERIES
from vigilframe.views import articles

SF = "/root/testdata/sf0.001"


def test_freshness_counts_every_event(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 11).alias("s")).collect()
    states = {}
    for r in e:
        states.setdefault(r.user_id, []).append({0: "error", 1: "stale", 2: "cached"}.get(r.s, "live"))
    worst = lambda s: max(s, key=("live", "cached", "stale", "error").index)
    combined = lambda s: "error" if set(s) == {"error"} else "stale" if {"error", "stale"} & set(s) else worst(s)
    for name, fold in (("fn_worst_freshness", worst), ("fn_combine_freshness", combined)):
        assert {r.user_id: r.state for r in QUERIES[name](spark, SF).collect()} == {u: fold(s) for u, s in states.items()}


def test_articles_are_matched_over_their_whole_text(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    late = [i for i, t in docs.items() if "thing" in t.lower() and not {"thing", "über"} & {w for w in ("thing", "über") if w in t[:280].lower()}]
    assert late
    found = lambda name: {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()}
    assert found("flt_watchlist") == {i for i, t in docs.items() if "thing" in t.lower() or "über" in t.lower()}
    zones = {(r.zone, r.doc_id) for r in QUERIES["join_hotspot_zones"](spark, SF).collect()}
    said = {r.doc_id: (r.title + " " + r.summary).lower() for r in articles(spark, SF).collect() if r.summary is not None}
    assert all(said[i].startswith(docs[i].split("\n")[0].lower()) and docs[i].lower() in said[i] for i in said)
    assert zones == {(z, i) for z, words in ZONES.items() for i, t in said.items() if any(w in t for w in words.split("|"))} and len(zones) > len(docs) / 2
    long = {i for i, t in docs.items() if len(t.split("\n")[0]) > 240 and t.split("\n")[0].isascii()}
    titles = {r.doc_id: r.title for r in QUERIES["fn_norm_title"](spark, SF).collect()}
    assert long and all(len(titles[i]) > 120 for i in long)


def test_replay_holds_no_component_in_a_task(spark):
    from vigilframe.operators.lifecycle import correlate_replay

    n = 40
    o = spark.createDataFrame([(i, f"p:{i * 7919 % 101}", i // 2, "volcano") for i in range(n)], "event_id long, observation_id string, t long, kind string").withColumn("ingested_at", F.timestamp_seconds("t"))
    pairs = sorted({(i, j) for i in range(n) for j in range(i + 1, min(n, i + 4)) if i % 3})
    got = correlate_replay(o, spark.createDataFrame(pairs, "a long, b long"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    rows = [(r.event_id, r.own) for r in o.orderBy("ingested_at", "observation_id").select("event_id", F.concat(F.lit("incident:volcano:"), F.substring(F.sha2("observation_id", 256), 1, 24)).alias("own")).collect()]
    want = {}
    for i, own in rows:
        near = [want[x] for p in pairs if i in p for x in p if x in want]
        want[i] = min(near, default=own)
    assert {r.event_id: r.incident for r in got.collect()} == want
