"""Revision chains against scoring the evidence anew at each arrival, in one slot and in many."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import revisions
from vigilframe.operators.revisions import revision_chain

SEVERITY, URGENCY = {"Extreme": 40, "Severe": 30, "Moderate": 20, "Minor": 10}, {"Immediate": 20, "Expected": 15, "Future": 8}
SCHEMA = "event_id long, incident_id string, observation_id string, content_hash string, provider_id string, kind string, severity string, urgency string, status string, event_at timestamp, source_updated_at timestamp, ingested_at timestamp, expires_at timestamp"


def made(r, n):
    base, rows = datetime.datetime(2024, 1, 1), []
    when = lambda h: base + datetime.timedelta(seconds=round(h * 3600))
    for k in range(n):
        o, h = r.randrange(25), k * r.choice([0.01, 0.3]) + r.randrange(3)
        mine = f"i{o % 2}" if r.random() < 0.95 else "i2"  # now and then an observation goes to another incident
        rows.append((k, mine, f"o{o}", r.choice("abcd"), r.choice(["p1", "p2", "p3", "p4", None]), "volcano", r.choice([*SEVERITY, "Unknown"]), r.choice([*URGENCY, "Past"]), r.choice(["active", "updated", "ended", "cancelled", "unknown"]), when(h - r.randrange(300)) if r.random() < 0.8 else None, when(h - r.randrange(5)) if r.random() < 0.5 else None, when(h), when(h + r.randrange(-20, 40)) if r.random() < 0.7 else None))
    return rows


def plain(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    known, chain, out = {}, {}, set()
    for v in sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda v: (v["ingested_at"], v["event_id"])):
        before = known.get(v["observation_id"])
        if before and before["content_hash"] == v["content_hash"]:
            continue
        known[v["observation_id"]] = v
        now, held = v["ingested_at"], [x for x in known.values() if x["incident_id"] == v["incident_id"]]
        newest = max(x["event_at"] or x["source_updated_at"] or x["ingested_at"] for x in held)
        age = max(0.0, (now - newest).total_seconds() / 3600)
        last = max(held, key=lambda x: (x["source_updated_at"] or x["event_at"] or x["ingested_at"], x["observation_id"]))["status"]
        status = last if last in ("ended", "cancelled") else "active" if any(x["status"] in ("active", "updated") for x in held) else "unknown"
        expired = all(x["expires_at"] is not None and x["expires_at"] <= now for x in held)
        points = max(SEVERITY.get(x["severity"], 0) for x in held) + max(URGENCY.get(x["urgency"], 0) for x in held) + min(15, 5 * (len({x["provider_id"] for x in held} - {None}) - 1))
        points += (15 if age <= 1 else 10 if age <= 6 else 5 if age <= 24 else 0) + (-40 if expired or last in ("ended", "cancelled") else -20 if age > 168 else 0)
        score, n, was = max(0, min(100, points)), *chain.get(v["incident_id"], (0, None))
        kind = "new" if n == 0 else "cancelled" if status == "cancelled" else "resolved" if status == "ended" else "escalated" if score >= was + 10 else "downgraded" if score <= was - 10 else "updated"
        chain[v["incident_id"]] = (n + 1, score)
        out.add((v["incident_id"], n + 1, v["event_id"], score, kind))
    return out


@pytest.mark.parametrize("slot", [1, 20, 4096])
def test_chain_is_scored_as_of_each_arrival(spark, slot):
    rows = made(random.Random(slot), 300)
    got = revision_chain(spark.createDataFrame(rows, SCHEMA).repartition(3), slot)
    assert {tuple(x) for x in got.collect()} == plain(rows) and len({x[4] for x in plain(rows)}) >= 5


def test_no_versions_and_a_long_incident(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert revision_chain(none).collect() == []
    long = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("i").alias("incident_id"), F.concat(F.lit("o"), F.col("id") % 3000).alias("observation_id"), F.col("id").cast("string").alias("content_hash"), F.lit("p").alias("provider_id"), F.lit("volcano").alias("kind"), F.lit("Severe").alias("severity"), F.lit("Past").alias("urgency"), F.lit("active").alias("status"), *(F.timestamp_seconds(F.col("id") * 60).alias(c) for c in ("event_at", "source_updated_at", "ingested_at")), F.lit(None).cast("timestamp").alias("expires_at"))
    told = revision_chain(long).agg(F.count("*").alias("n"), F.max("revision").alias("most"), F.countDistinct("revision").alias("d")).first()
    assert tuple(told) == (20_000, 20_000, 20_000)


def test_small_incidents_are_swept_many_at_a_time(spark):
    hour = 3_600_000_000
    rows = [(f"i{i:03}", 0, True, hour * k, 3 * i + k, hour * (k + 1) if k < 2 else None, 3 * i + k + 1 if k < 2 else None, "o", 10 * k, 8, "p", "active", hour * k, hour * k, hour * 9) for i in range(500) for k in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 400], strict=True)], names=list(revisions.VERSION)) for a in range(0, 1500, 400)]  # incidents go on from batch to batch
    out = list(revisions._sweep_all()(iter(batches)))
    assert len(out) == 1
    got = out[0].to_pylist()
    assert [(x["incident_id"], x["arrival"], x["impact"], x["source_count"]) for x in got] == [(f"i{i:03}", 3 * i + k, 10 * k, 1) for i in range(500) for k in range(3)]
