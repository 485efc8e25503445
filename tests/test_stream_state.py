"""Streams with state in tables: slices, restarts and expiry against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from vigilframe.streaming.state import KeyedState, changed_rows, failure_streaks
from vigilframe.streaming.streams import changed_only, failure_events, shared_folder


def plain_streaks(rows, start=None):
    run, out = dict(start or {}), set()
    for event, provider, failed in sorted(rows):
        before = run.get(provider, 0)
        run[provider] = before + 1 if failed else 0
        out.add((event, provider, failed, run[provider], before))
    return out


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_streaks_in_slices(spark, size):
    r = random.Random(size)
    rows = [(e, r.randrange(3), r.random() < 0.8) for e in r.sample(range(-50, 400), 200)]
    df = spark.createDataFrame(rows, "event_id long, provider int, failed boolean")
    assert {tuple(x) for x in failure_streaks(df, size).collect()} == plain_streaks(rows)
    start = {0: 5, 2: 0, 9: 7}
    known = spark.createDataFrame(list(start.items()), "provider int, streak int")
    assert {tuple(x) for x in failure_streaks(df, size, known).collect()} == plain_streaks(rows, start)
    assert failure_streaks(df.limit(0), size).collect() == []


@pytest.mark.parametrize("size", [3, 1000])
def test_changed_rows_in_slices(spark, size):
    r = random.Random(size)
    rows = [(r.choice([1, 2, None]), e, r.choice(["a", "b", None])) for e in range(150)]
    last, want = {1: "a", 7: "b", None: None}, []
    known = spark.createDataFrame(list(last.items()), "k int, d string")
    for k, e, d in rows:
        if k not in last or last[k] != d:
            want.append((k, e, d))
        last[k] = d
    got = changed_rows(spark.createDataFrame(rows, "k int, e long, d string"), "k", "d", "e", size, known)
    assert sorted((tuple(x) for x in got.collect()), key=lambda x: x[1]) == want


def test_health_and_changes_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(8)
    schema = "event_id long, provider long, failed boolean, d string, at timestamp"
    base, other, rows = shared_folder(spark), shared_folder(spark), []
    for n in range(3):
        part = [(100 * n + e, r.randrange(4), r.random() < 0.7, r.choice("ab")) for e in range(60)]
        spark.createDataFrame(part, "event_id long, provider long, failed boolean, d string").withColumn("at", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows += part
        live = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        lost = failure_events(live().select("event_id", "provider", "failed"), base)
        changed = changed_only(live(), other, "provider", "d", "event_id", "at", 10**9)
    want = {(p, e, "lost" if f else "recovered") for e, p, f, now, was in plain_streaks([x[:3] for x in rows]) if (f and now == 3) or (not f and was >= 3)}
    assert {tuple(x) for x in lost.collect()} == want and len(want) > 5
    last, told = {}, set()
    for e, p, _, d in sorted(rows):
        if last.get(p) != d:
            told.add((p, e, d))
        last[p] = d
    assert {tuple(x) for x in changed.collect()} == told


def test_state_parts_and_expiry(spark):
    state = KeyedState(spark, shared_folder(spark), "k", "k long, v int")
    make = lambda *x: spark.createDataFrame(list(x), "k long, v int")
    every = lambda n: sorted(tuple(x) for x in state.rows(n).collect())
    one, two = make(*((k, k) for k in range(40))), make((3, 30), (50, 50))
    state.put(0, one, state.touched(one))
    state.put(1, two, state.touched(two), F.col("v") < 20)
    parts = state.touched(two)
    gone = {x.k for x in state.rows(1, parts).collect() if x.v >= 20 and x.k != 3}
    assert every(2) == sorted([(k, k) for k in range(40) if k != 3 and k not in gone] + [(3, 30), (50, 50)])
    assert every(1) == [(k, k) for k in range(40)] and every(0) == []
