"""Streaming queries: each runs over what is there and must equal its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookup import severity_rank
from ..operators.watch import watch_matches
from ..streaming.correlate import StreamCorrelator
from ..streaming.streams import changed_only, dedupe_keys, event_stream, failure_events, for_each_batch, recent, run_available, shared_folder, source_name
from ..views import as_observations
from .joins import REPLAY_SQL, _MATCHES, _PLACED, _REGION_SQL, _SEV, replay_links, watch_regions
from .registry import query

C = F.col


def _stream(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return event_stream(spark, sf_dir)


@query("str_upsert_dedupe", "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)")
def str_upsert_dedupe(spark, sf_dir):
    """State goes sixty days after a key was last seen."""
    s = _stream(spark, sf_dir).withColumn("ts", C("ts").cast("timestamp"))
    return changed_only(s, shared_folder(spark), "user_id", "event_type", "event_id", at="ts", keep_ms=60 * 86_400_000)


@query("str_dedupe_keys", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def str_dedupe_keys(spark, sf_dir):
    s = _stream(spark, sf_dir).select("user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    return run_available(dedupe_keys(s, ["user_id", "event_type"], "ts", "60 days")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("str_edits_recent", "SELECT user_id, array_to_string(list_sort(list(event_id)), ',') AS recent FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30) GROUP BY user_id")
def str_edits_recent(spark, sf_dir):
    got: list = []
    base = shared_folder(spark)
    for_each_batch(recent(_stream(spark, sf_dir), "user_id", "event_id", 30), lambda batch, n: (batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/batch={n}"), got.append(n))[0], mode="update")
    all_ = spark.read.parquet(*[f"{base}/batch={n}" for n in got])
    last = all_.groupBy("user_id").agg(F.max_by("recent", "batch").alias("recent"))
    return last.select("user_id", F.array_join(F.col("recent").cast("array<string>"), ",").alias("recent"))


@query("str_health", ", poll AS (SELECT event_id, user_id % 14 AS provider, event_type = 'error' AS failed FROM events), isl AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY event_id) AS g FROM poll), st AS (SELECT *, CASE WHEN failed THEN sum(CAST(failed AS INT)) OVER (PARTITION BY provider, g ORDER BY event_id) ELSE 0 END AS n FROM isl) SELECT provider, event_id, CASE WHEN failed THEN 'lost' ELSE 'recovered' END AS event FROM (SELECT *, lag(n) OVER (PARTITION BY provider ORDER BY event_id) AS before FROM st) WHERE (failed AND n = 3) OR (NOT failed AND before >= 3)")
def str_health(spark, sf_dir):
    p = _stream(spark, sf_dir).select("event_id", (C("user_id") % 14).alias("provider"), (C("event_type") == "error").alias("failed"))
    return failure_events(p, shared_folder(spark))


@query("str_change_feed", "SELECT event_id AS cursor, user_id FROM events WHERE event_id > 400")
def str_change_feed(spark, sf_dir):
    """The checkpoint is the cursor: its name is the source's, so the next run goes on after the last row that this one gave out, and a source that was replaced begins anew."""
    name = "change-feed-" + source_name(spark, f"{sf_dir}/events.parquet")
    return run_available(_stream(spark, sf_dir).where("event_id > 400").select(C("event_id").alias("cursor"), "user_id"), name=name)


@query("str_notify", _REGION_SQL + f"SELECT r.region, o.event_id FROM r JOIN o ON {_MATCHES} AND {_SEV} >= 2 AND {_PLACED.format('o')}")
def str_notify(spark, sf_dir):
    """Stream-static join with the watch regions; the stream brings all columns of the observations with it."""
    regions = watch_regions(spark, sf_dir)
    live = as_observations(_stream(spark, sf_dir)).where(severity_rank(C("severity")) >= 2).select("event_id", "kind", "headline", "summary", "location_name", "severity", "slon", "slat")
    base = shared_folder(spark)
    got: list = []

    def step(batch, n):
        watch_matches(batch, regions).select("region", "event_id").write.mode("overwrite").parquet(f"{base}/batch={n}")
        got.append(n)

    for_each_batch(live, step)
    return spark.read.schema("region long, event_id long").parquet(*[f"{base}/batch={n}" for n in got])


#: Moments between the files that the events of str_correlate land in.
_LANDED = ("2024-01-11", "2024-01-21")
_FIRST = ", f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at, event_id) = 1)\n"


@query("str_correlate", _FIRST + REPLAY_SQL("f").rstrip() + "SELECT observation_id, event_id, incident FROM told JOIN f USING (event_id)")
def str_correlate(spark, sf_dir):
    """Incidents of observations by all rules, out of a stream that stops and starts again after each of three files; each start is a correlator of its own."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    landing, base = shared_folder(spark), shared_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k, when in enumerate((C("ts") < _LANDED[0], (C("ts") >= _LANDED[0]) & (C("ts") < _LANDED[1]), C("ts") >= _LANDED[1])):
        events.where(when).write.parquet(f"{landing}/part={k}")
        live = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(landing)
        correlator = StreamCorrelator(spark, base, replay_links)
        as_observations(live).writeStream.foreachBatch(correlator.step).option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start().awaitTermination()
    return StreamCorrelator(spark, base, replay_links).incidents()
