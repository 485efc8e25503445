"""Aggregates, lifecycle, retention, watches, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, lookup, text
from ..functions.times import quiet, utc_label
from ..model import SEVERITIES, ZONES
from ..operators.clusters import cell_size, clusters
from ..operators.lifecycle import correlate_replay
from ..operators.scoring import build_incidents, incident_scores, incident_status
from ..operators.watch import watch_matches
from ..views import NOW, articles, latest_observations, members, observations, table
from .filters import CHG, INC, changes, incidents, scored
from .joins import REPLAY_SQL, _MATCHES, _PLACED, _REGION_SQL, _ZONE_SQL, kept_latest, replay_links, watch_regions, zone_hits
from .registry import query

C = F.col
_NOW = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")




@query("agg_score", INC + "SELECT incident_id, priority_score FROM inc")
def agg_score(spark, sf_dir):
    return scored(spark, sf_dir)[0].select("incident_id", "priority_score")


@query("agg_components", INC + "SELECT incident_id, impact, urgency, freshness, corroboration, 0 AS watch_region, penalty, round(age, 3) AS age_hours, source_count FROM inc")
def agg_components(spark, sf_dir):
    return scored(spark, sf_dir)[0].drop("priority_score", "lane")


_LAST = "{'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id}"
_RANK = lambda c, o: f"({list(reversed(o))})[max(CASE {c} " + " ".join(f"WHEN '{v}' THEN {len(o) - i}" for i, v in enumerate(o)) + " END)]"
_STATUS = f"CASE WHEN arg_max(status, {_LAST}) IN ('cancelled','ended') THEN arg_max(status, {_LAST}) WHEN bool_or(status IN ('active','updated')) THEN 'active' ELSE 'unknown' END"


@query("agg_incident_build", f"SELECT incident_id, arg_max(headline, {_LAST}) AS headline, {_STATUS} AS status, {_RANK('severity', ('Extreme', 'Severe', 'Moderate', 'Minor', 'Unknown'))} AS severity, {_RANK('urgency', ('Immediate', 'Expected', 'Future', 'Past', 'Unknown'))} AS urgency, {_RANK('certainty', ('Observed', 'Likely', 'Possible', 'Unlikely', 'Unknown'))} AS certainty, epoch_us(min(coalesce(event_at, source_updated_at, ingested_at))) AS first_seen, epoch_us(max(coalesce(event_at, source_updated_at, ingested_at))) AS last_observed, arg_max(lon, {_LAST}) AS lon, array_to_string(list_sort(list_distinct(list(observation_id))), ',') AS members FROM m GROUP BY incident_id")
def agg_incident_build(spark, sf_dir):
    i = build_incidents(members(observations(spark, sf_dir)))
    return i.select("incident_id", "headline", "status", "severity", "urgency", "certainty", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_observed").alias("last_observed"), "lon", F.array_join("observation_ids", ",").alias("members"))


@query("agg_status", f"SELECT incident_id, {_STATUS} AS status FROM m GROUP BY incident_id")
def agg_status(spark, sf_dir):
    return members(observations(spark, sf_dir)).groupBy("incident_id").agg(incident_status().alias("status"))


_LOST_INC = INC.replace("FROM m GROUP BY incident_id\n", "FROM m WHERE provider_id <> 'prov_1' GROUP BY incident_id\n", 1)
_LOST = _LOST_INC + "SELECT x.incident_id, coalesce(inc.priority_score, 0) AS priority_score, coalesce(inc.penalty, -40) AS penalty, inc.incident_id IS NULL AS nothing_left FROM (SELECT DISTINCT incident_id FROM m WHERE provider_id = 'prov_1') x LEFT JOIN inc USING (incident_id)"


def source_lost(m, provider: str, now: str):
    """Incidents with evidence of a lost provider, scored without it; with none left the score is 0 and the penalty full."""
    hit = m.where(C("provider_id") == provider).select("incident_id").distinct()
    left = incident_scores(m.where(C("provider_id") != provider).join(hit, "incident_id", "left_semi"), now)
    return hit.join(left, "incident_id", "left").select("incident_id", F.coalesce("priority_score", F.lit(0)).alias("priority_score"), F.coalesce("penalty", F.lit(-40)).alias("penalty"), C("priority_score").isNull().alias("nothing_left"))


query("agg_lost_sources", _LOST)(lambda spark, sf_dir: source_lost(members(observations(spark, sf_dir)), "prov_1", NOW))


#: Zooms of the cluster query, each with bounds: of the world, and of a box over the antimeridian.
_ZOOMS = {2: (-180.0, -90.0, 180.0, 90.0), 4: (150.0, -45.0, -120.0, 60.0)}
_CLUSTER = "SELECT {z} AS zoom, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(degrees(atan2(sum(sin(radians(slon))), sum(cos(radians(slon))))), 4) AS lon, round(avg(slat), 6) AS lat, count(*) AS n, max(k) AS most, array_to_string(list(event_id ORDER BY k DESC, event_id)[:50], ',') AS members FROM (SELECT *, floor((slon + 180 + {w} / 2 - 360 * floor((slon + 180 + {w} / 2) / 360)) / {w}) AS x, floor((slat + 90) / {h}) AS y FROM o WHERE {inside}) GROUP BY x, y"


def _cluster_sql(zoom, west, south, east, north):
    wide, high = (f"{v!r}::DOUBLE" for v in cell_size(zoom, 52))
    return _CLUSTER.format(z=zoom, w=wide, h=high, inside=f"slat BETWEEN {south} AND {north} AND (slon {'BETWEEN' if west <= east else '>='} {west} {'AND' if west <= east else 'OR slon <='} {east})")


@query("agg_cluster", " UNION ALL ".join(_cluster_sql(z, *b) for z, b in _ZOOMS.items()))
def agg_cluster(spark, sf_dir):
    """Grid clusters of 52 pixels at two zooms, with the first fifty members by priority and id."""
    o = observations(spark, sf_dir)
    each = (clusters(o, "event_id", "k", "slon", "slat", z, 52, b).select(F.lit(z).alias("zoom"), "x", "y", F.round("lon", 4).alias("lon"), F.round("lat", 6).alias("lat"), "n", "most", F.array_join(C("members").cast("array<string>"), ",").alias("members")) for z, b in _ZOOMS.items())
    return reduce(DataFrame.unionByName, each)


_NOW_S = 1706702400


#: Some articles have no time.
_TIMED = "CASE WHEN doc_id % 50 = 0 THEN CASE WHEN doc_id % 100 = 0 THEN 0 END ELSE ts END"
_ZONE_RANK = "CASE zone " + " ".join(f"WHEN '{z}' THEN {k}" for k, z in enumerate(ZONES)) + " END"


@query("agg_hotspots", _ZONE_SQL + f", t AS (SELECT * REPLACE ({_TIMED} AS ts) FROM hit), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY coalesce(ts, 0) DESC, doc_id) AS n FROM t), g AS (SELECT zone, count(*) AS n, round(sum(CASE WHEN n <= 10 THEN 1.0 / (1.0 + greatest(1.0, ({_NOW_S} - coalesce(nullif(ts, 0), {_NOW_S})) / 3600.0) / 6.0) END), 2) AS score, arg_min(doc_id, n) AS latest, arg_min(title, n) AS title, arg_min(src, n) AS src, coalesce(arg_min(ts, n), 0) AS ts, string_agg(CASE WHEN n <= 5 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY n) AS recent FROM r GROUP BY zone) SELECT *, row_number() OVER (ORDER BY score DESC, {_ZONE_RANK}) AS place FROM g")
def agg_hotspots(spark, sf_dir):
    """Zones by how often and how lately they are named, with the newest title and its feed, the highest score first.

    All hits are counted, only the newest ten of a zone are ordered and weighed. A time of 0 or none is old where hits
    are ordered, and now where they are weighed.
    """
    hits = zone_hits(spark, sf_dir).select("zone", "doc_id", "title", "src", F.expr(_TIMED).alias("ts"))
    w = W.partitionBy("zone").orderBy(F.desc(F.coalesce("ts", F.lit(0))), "doc_id")
    r = hits.withColumn("n", F.row_number().over(w)).where("n <= 10")
    age = (_NOW_S - F.coalesce(F.nullif("ts", F.lit(0)), F.lit(_NOW_S))) / 3600.0
    recent = F.transform(F.array_sort(F.collect_list(F.when(C("n") <= 5, F.struct("n", "doc_id")))), lambda x: x["doc_id"].cast("string"))
    newest = F.min_by(F.struct("doc_id", "title", "src", F.coalesce("ts", F.lit(0)).alias("ts")), "n").alias("l")
    top = r.groupBy("zone").agg(F.round(F.sum(1.0 / (1.0 + F.greatest(F.lit(1.0), age) / 6.0)), 2).alias("score"), newest, F.array_join(recent, ",").alias("recent"))
    place = F.row_number().over(W.orderBy(F.desc("score"), F.expr(_ZONE_RANK))).alias("place")  # a row for each of the zones, a fixed list
    told = hits.groupBy("zone").agg(F.count("*").alias("n")).join(top, "zone")
    return told.select("zone", "n", "score", C("l.doc_id").alias("latest"), "l.title", "l.src", "l.ts", "recent", place)


_HEALTH = ", h AS (SELECT user_id % 14 AS provider, arg_max(event_type, event_id) AS last_event, max(event_id) AS seen_at FROM events GROUP BY ALL), st AS (SELECT provider, seen_at, CASE last_event WHEN 'error' THEN 'error' WHEN 'view' THEN 'cached' WHEN 'signup' THEN 'stale' ELSE 'live' END AS status FROM h)\n"


def health(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy((C("user_id") % 14).alias("provider")).agg(F.max_by("event_type", "event_id").alias("last"), F.max("event_id").alias("at"))
    return h.select("provider", "at", F.when(C("last") == "error", "error").when(C("last") == "view", "cached").when(C("last") == "signup", "stale").otherwise("live").alias("status"))


@query("agg_status_counts", _HEALTH + "SELECT status, count(*) AS n FROM st GROUP BY status")
def agg_status_counts(spark, sf_dir):
    return health(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("agg_feed_counts", _HEALTH + "SELECT count(*) FILTER (status = 'live') AS live, count(*) FILTER (status IN ('cached','stale')) AS cached, count(*) FILTER (status = 'error') AS errored FROM st")
def agg_feed_counts(spark, sf_dir):
    return health(spark, sf_dir).agg(F.count_if(C("status") == "live").alias("live"), F.count_if(C("status").isin("cached", "stale")).alias("cached"), F.count_if(C("status") == "error").alias("errored"))


@query("agg_change_summary", CHG + "SELECT user_id, string_agg(concat(n, ' ', change_type), ' · ' ORDER BY change_type) AS words FROM (SELECT user_id, change_type, count(*) AS n FROM chg GROUP BY ALL) GROUP BY user_id")
def agg_change_summary(spark, sf_dir):
    n = changes(spark, sf_dir).groupBy("user_id", "change_type").agg(F.count("*").alias("n"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("change_type", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["change_type"]))
    return n.groupBy("user_id").agg(F.array_join(said, " · ").alias("words"))


@query("agg_page_total", INC + "SELECT count(*) AS total FROM inc WHERE kind <> 'news_item'")
def agg_page_total(spark, sf_dir):
    return incidents(spark, sf_dir).where("kind <> 'news_item'").agg(F.count("*").alias("total"))


@query("agg_latest_cursor", "SELECT max(event_id) AS cursor, epoch_us(arg_max(ingested_at, event_id)) AS at FROM o")
def agg_latest_cursor(spark, sf_dir):
    return observations(spark, sf_dir).agg(F.max("event_id").alias("cursor"), F.unix_micros(F.max_by("ingested_at", "event_id")).alias("at"))


@query("agg_oldest_source", _HEALTH + "SELECT max((SELECT max(event_id) FROM events) - seen_at) AS oldest FROM st")
def agg_oldest_source(spark, sf_dir):
    h = health(spark, sf_dir)
    return h.agg(F.max("at").alias("newest"), F.min("at").alias("least")).select((C("newest") - C("least")).alias("oldest"))


@query("agg_distinct_providers", "SELECT incident_id, count(DISTINCT provider_id) AS n FROM m GROUP BY incident_id")
def agg_distinct_providers(spark, sf_dir):
    return members(observations(spark, sf_dir)).groupBy("incident_id").agg(F.countDistinct("provider_id").alias("n"))


_METRICS = {"hazard_type": ("hazard_type", "", "provider_id"), "storm_name": ("storm_name", "", "'Source not reported'"), "magnitude": ("k", "M", "provider_id"), "expected_loss": ("k * 1000", "USD", "'model'")}


@query("agg_metric_rows", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS key, CAST({v} AS VARCHAR) AS value, '{u}' AS unit, {p} AS provenance, provider_id FROM l" for n, (v, u, p) in _METRICS.items()) + ") ORDER BY key, provider_id, event_id LIMIT 200")
def agg_metric_rows(spark, sf_dir):
    """Metrics with value, unit and provenance, one a row, by key and provider; the first 200."""
    metric = lambda v, u, p: F.struct(F.expr(v).cast("string").alias("value"), F.lit(u).alias("unit"), F.expr(p).alias("provenance"))
    metrics = F.create_map(*(x for n, m in _METRICS.items() for x in (F.lit(n), metric(*m))))
    rows = latest_observations(observations(spark, sf_dir)).select("event_id", "provider_id", F.explode(metrics))
    return rows.orderBy("key", "provider_id", "event_id").limit(200).select("event_id", "key", "value.value", "value.unit", "value.provenance", "provider_id")


#: Part of the digest: rows of it shown, and where they come from.
_STREAMS = {"quake": (10, "kind = 'earthquake' AND k >= 50"), "alert": (8, "kind = 'weather_alert'"), "relief": (8, "kind = 'disaster_declaration'"), "gdacs": (10, "kind IN ('wildfire', 'volcano') AND severity IN ('Extreme', 'Severe')"), "conflict": (12, "kind = 'news_item'")}


@query("agg_briefing", _ZONE_SQL.rstrip() + ", zn AS (SELECT zone, count(*) AS n FROM hit GROUP BY zone) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{p}' AS part, CAST(event_id AS VARCHAR) AS item, count(*) OVER () AS total FROM o WHERE {w} ORDER BY event_at DESC, event_id LIMIT {n})" for p, (n, w) in _STREAMS.items()) + " UNION ALL SELECT * FROM (SELECT 'hotspot', concat(zone, ' ', n), count(*) OVER () FROM zn ORDER BY n DESC, zone LIMIT 10)")
def agg_briefing(spark, sf_dir):
    """Digest: the first rows of six streams, and how many each has."""
    o = observations(spark, sf_dir)

    def top(part, rows, n, *order):
        total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
        return rows.orderBy(*order).limit(n).crossJoin(total).select(F.lit(part).alias("part"), "item", "total")

    said = [top(p, o.where(w).withColumn("item", C("event_id").cast("string")), n, F.desc("event_at"), "event_id") for p, (n, w) in _STREAMS.items()]
    zones = zone_hits(spark, sf_dir).groupBy("zone").agg(F.count("*").alias("n")).withColumn("item", F.concat_ws(" ", "zone", C("n").cast("string")))
    return reduce(DataFrame.unionByName, said + [top("hotspot", zones, 10, F.desc("n"), "zone")])


_SAID_WHERE = "CASE WHEN location_name IS NOT NULL THEN location_name WHEN lon IS NOT NULL THEN concat(CAST(round(lat, 4) AS {0}), ', ', CAST(round(lon, 4) AS {0})) ELSE 'Location not reported' END"
_KIND_SAID = "CASE WHEN kind IN ('weather_alert','tropical_cyclone','tsunami') THEN 'Warning' WHEN kind = 'aviation_hazard' THEN 'Official advisory' WHEN kind = 'disaster_declaration' THEN 'Administrative declaration' WHEN kind IN ('news_item') THEN 'Media coverage' WHEN urgency = 'Future' OR certainty IN ('Possible','Unlikely') THEN 'Forecast' ELSE 'Observation' END"


@query("fn_summary_text", CHG.rstrip() + ", steps AS (SELECT observation_id, array_to_string(list_sort(list_distinct(list(provider_id))), ', ') AS sources, string_agg(concat('r', revision, ' ', replace(change_type, '_', ' '), ' ', strftime(ingested_at, '%Y-%m-%d %H:%M:%S UTC')), '; ' ORDER BY revision) AS steps FROM chg GROUP BY observation_id), last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY revision DESC) = 1) SELECT observation_id, concat_ws(chr(10), headline, concat('Summary: ', summary), concat(" + _KIND_SAID + ", '. ', severity, ' severity; ', status, ' status; ', certainty, ' certainty.'), concat('Location: ', " + _SAID_WHERE.format("VARCHAR") + ", '.'), concat('Priority: ', score, '/100 (explainable triage, not a prediction).'), concat('Last changed: ', strftime(ingested_at, '%Y-%m-%d %H:%M:%S UTC'), '.'), concat('Sources: ', sources, '.'), concat('Revision sequence: ', steps, '.')) AS summary FROM last JOIN steps USING (observation_id)")
def fn_summary_text(spark, sf_dir):
    """Eight lines on each observation out of its last revision and the chain of them."""
    c = changes(spark, sf_dir).withColumns({"said_where": F.expr(_SAID_WHERE.format("STRING")), "said_kind": lookup.provenance(C("kind"), C("urgency"), C("certainty")), "at": utc_label(F.date_trunc("second", "ingested_at"))})
    step = F.concat(F.lit("r"), C("revision").cast("string"), F.lit(" "), F.replace("change_type", F.lit("_"), F.lit(" ")), F.lit(" "), "at")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("revision", step.alias("s")))), lambda x: x["s"])
    shown = ("headline", "summary", "said_kind", "severity", "status", "certainty", "said_where", "score", "at")
    g = c.groupBy("observation_id").agg(F.max_by(F.struct(*shown), "revision").alias("x"), F.array_join(F.sort_array(F.collect_set("provider_id")), ", ").alias("sources"), F.array_join(steps, "; ").alias("steps"))
    g = g.select("observation_id", "x.*", "sources", "steps")
    lines = (
        text.single_line(C("headline"), "Untitled incident"),
        F.concat(F.lit("Summary: "), text.single_line(C("summary"), "not reported")),
        F.format_string("%s. %s severity; %s status; %s certainty.", "said_kind", "severity", "status", "certainty"),
        F.format_string("Location: %s.", "said_where"),
        F.format_string("Priority: %d/100 (explainable triage, not a prediction).", "score"),
        F.format_string("Last changed: %s.", "at"),
        F.format_string("Sources: %s.", "sources"),
        F.format_string("Revision sequence: %s.", "steps"),
    )
    return g.select("observation_id", F.concat_ws("\n", *lines).alias("summary"))


# Correlation over time


@query("cor_replay", REPLAY_SQL("l") + "SELECT event_id, incident FROM told")
def cor_replay(spark, sf_dir):
    """Greedy assignment in order of arrival, replayed within each component of the pair graph."""
    o = kept_latest(spark, sf_dir)
    return correlate_replay(o, *replay_links(o))


# Retention


@query("ret_age", "SELECT event_id FROM l WHERE ingested_at < TIMESTAMP '2024-01-17 12:00:00'")
def ret_age(spark, sf_dir):
    return latest_observations(observations(spark, sf_dir)).where(C("ingested_at") < F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 14 DAYS")).select("event_id")


@query("ret_overflow", "SELECT observation_id FROM l ORDER BY ingested_at DESC, observation_id DESC OFFSET 500")
def ret_overflow(spark, sf_dir):
    """The oldest beyond a number to keep: the moment of the last one kept comes from a bounded top-k, and all older ones go."""
    keep = 500
    o = latest_observations(observations(spark, sf_dir)).select("observation_id", "ingested_at")
    edge = o.orderBy(F.desc("ingested_at"), F.desc("observation_id")).limit(keep).agg(F.min(F.struct("ingested_at", "observation_id")).alias("edge"), F.count("*").alias("n"))
    return o.crossJoin(F.broadcast(edge)).where((C("n") == keep) & (F.struct("ingested_at", "observation_id") < C("edge"))).select("observation_id")  # edge is one row


@query("ret_kind_days", f"SELECT event_id FROM l WHERE epoch_us(ingested_at) < epoch_us({_NOW}) - CASE kind WHEN 'earthquake' THEN 30 WHEN 'weather_alert' THEN 14 WHEN 'tropical_cyclone' THEN 30 WHEN 'tsunami' THEN 30 WHEN 'volcano' THEN 90 WHEN 'wildfire' THEN 14 WHEN 'disaster_declaration' THEN 365 WHEN 'aviation_hazard' THEN 14 WHEN 'news_item' THEN 7 END * 86400000000")
def ret_kind_days(spark, sf_dir):
    days = lookup.retention_days(C("kind")).cast("long")
    return latest_observations(observations(spark, sf_dir)).where(F.unix_micros("ingested_at") < F.unix_micros(_now()) - days * F.lit(86400000000)).select("event_id")


@query("ret_report", "SELECT count(*) FILTER (old) AS expired, greatest(count(*) FILTER (NOT old) - 500, 0) AS overflow, count(*) FILTER (old) + greatest(count(*) FILTER (NOT old) - 500, 0) AS deleted, true AS dry_run FROM (SELECT ingested_at < TIMESTAMP '2024-01-17 12:00:00' AS old FROM l)")
def ret_report(spark, sf_dir):
    old = C("ingested_at") < F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 14 DAYS")
    g = latest_observations(observations(spark, sf_dir)).agg(F.count_if(old).alias("expired"), F.greatest(F.count_if(~old) - 500, F.lit(0)).alias("overflow"))
    return g.select("expired", "overflow", (C("expired") + C("overflow")).alias("deleted"), F.lit(True).alias("dry_run"))


# Watches

#: What notifications a user asks for: changes, kinds, least severity, quiet hours in minutes of the day.
NOTIFY = {"enabled": True, "changes": ("new", "escalated", "updated"), "kinds": ("earthquake", "weather_alert", "tsunami", "wildfire", "volcano", "news_item"), "least": 2, "quiet": (1320, 420)}
_QUIET = "(hour({0}) * 60 + minute({0}) >= 1320 OR hour({0}) * 60 + minute({0}) < 420)"


def notifications(changed, regions, seen, acknowledged, snoozed, config=NOTIFY):
    """Changes to notify of: (key, event_id, change_type, labels).

    Those of the changes and kinds asked for, severe enough, outside quiet hours, whose key id@revision was neither
    seen nor acknowledged, whose id isn't snoozed any more, and that match an enabled region; all matching labels are named.
    seen and acknowledged hold keys; snoozed holds (observation_id, until).
    """
    if not config["enabled"]:
        changed = changed.limit(0)
    c = changed.withColumn("key", F.concat("observation_id", F.lit("@"), C("revision").cast("string")))
    c = c.where(C("change_type").isin(*config["changes"]) & C("kind").isin(*config["kinds"]) & (lookup.severity_rank(C("severity")) >= config["least"]) & ~quiet(C("ingested_at"), *config["quiet"]))
    c = c.join(seen, "key", "left_anti").join(acknowledged, "key", "left_anti").join(snoozed, "observation_id", "left")
    c = c.where(C("until").isNull() | (C("until") <= C("ingested_at")))
    m = watch_matches(c, regions)
    return m.groupBy("key", "event_id", "change_type").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


_KEY = "concat(observation_id, '@', revision)"


@query("wat_notify", CHG.rstrip() + _REGION_SQL.rstrip() + f", sz AS (SELECT observation_id, max(ingested_at) + INTERVAL 1 HOUR AS until FROM chg WHERE k % 17 = 0 GROUP BY 1) SELECT {_KEY} AS key, event_id, change_type, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM chg LEFT JOIN sz USING (observation_id) JOIN r ON {_MATCHES} AND {_PLACED.format('chg')} WHERE change_type IN ('new','escalated','updated') AND kind IN ('earthquake','weather_alert','tsunami','wildfire','volcano','news_item') AND severity IN ('Moderate','Severe','Extreme') AND NOT {_QUIET.format('ingested_at')} AND event_id % 13 <> 0 AND NOT (k % 11 = 0 AND severity = 'Severe') AND (until IS NULL OR until <= ingested_at) GROUP BY ALL")
def wat_notify(spark, sf_dir):
    """Notifications out of the change feed; keys seen and acknowledged, and snoozes, are rows of these tables."""
    c = changes(spark, sf_dir)
    key = F.concat("observation_id", F.lit("@"), C("revision").cast("string")).alias("key")
    seen, acknowledged = c.where("event_id % 13 = 0").select(key), c.where("k % 11 = 0 and severity = 'Severe'").select(key)
    snoozed = c.where("k % 17 = 0").groupBy("observation_id").agg((F.max("ingested_at") + F.expr("INTERVAL 1 HOUR")).alias("until"))
    return notifications(c, watch_regions(spark, sf_dir), seen, acknowledged, snoozed)


_STATE_SQL = "SELECT user_id, 'seen' AS part, concat(observation_id, '@', event_id) AS item, CAST(NULL AS BIGINT) AS until_us FROM o WHERE severity = 'Severe' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 400 UNION ALL SELECT user_id, 'acknowledged', concat(observation_id, '@', event_id), NULL FROM o WHERE severity = 'Extreme' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 400 UNION ALL SELECT user_id, 'snoozed', observation_id, epoch_us(t) + 3600000000 FROM (SELECT user_id, observation_id, max(ingested_at) AS t FROM o WHERE k % 7 = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, observation_id) <= 200"


@query("wat_state", _STATE_SQL)
def wat_state(spark, sf_dir):
    """A user's notification state out of an append log: the newest 400 keys seen and acknowledged, and the newest 200 snoozes, an hour from the last on each incident."""
    o = observations(spark, sf_dir)
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    item = F.concat("observation_id", F.lit("@"), C("event_id").cast("string")).alias("item")
    newest = lambda rows, w, n: rows.withColumn("rn", F.row_number().over(w)).where(C("rn") <= n)
    keys = [newest(o.where(C("severity") == s), w, 400).select("user_id", F.lit(p).alias("part"), item, F.lit(None).cast("long").alias("until_us")) for p, s in (("seen", "Severe"), ("acknowledged", "Extreme"))]
    last = o.where("k % 7 = 0").groupBy("user_id", "observation_id").agg(F.max("ingested_at").alias("t"))
    snoozed = newest(last, W.partitionBy("user_id").orderBy(F.desc("t"), "observation_id"), 200)
    return keys[0].unionByName(keys[1]).unionByName(snoozed.select("user_id", F.lit("snoozed").alias("part"), C("observation_id").alias("item"), (F.unix_micros("t") + 3600000000).alias("until_us")))


@query("wat_keyword_alerts", f"SELECT src, t80, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id) AS n FROM (SELECT src, substr(title, 1, 80) AS t80, min(doc_id) AS doc_id FROM art WHERE contains(lower(summary), 'the') AND NOT {_QUIET.format('to_timestamp(ts)::TIMESTAMP')} GROUP BY ALL)) WHERE n > 1".replace("to_timestamp(ts)::TIMESTAMP", "make_timestamp(ts * 1000000)"))
def wat_keyword_alerts(spark, sf_dir):
    """First hit of each source and title outside quiet hours; the very first of a source stays silent."""
    loud = articles(spark, sf_dir).where(~quiet(F.timestamp_seconds("ts"), *NOTIFY["quiet"]))
    hits = loud.where(F.contains(F.lower("summary"), F.lit("the"))).groupBy("src", F.substring("title", 1, 80).alias("t80")).agg(F.min("doc_id").alias("doc_id"))
    first = hits.groupBy("src").agg(F.min("doc_id").alias("first"))
    return hits.join(first, "src").where("doc_id > first").select("src", "t80", "doc_id")


#: Raw regions out of suppliers, some of them unfit: (id, label, scope, lon, radius, least severity), alike in both dialects.
_RAW = {
    "id": "CASE WHEN s_suppkey % 7 = 0 THEN concat('-', s_suppkey) WHEN s_suppkey % 7 = 1 THEN concat('r', s_suppkey - 1) ELSE concat('r', s_suppkey) END",
    "label": "CASE WHEN s_suppkey % 5 = 0 THEN '   ' ELSE concat(' ', s_name, '  x') END",
    "scope": "CASE WHEN s_suppkey % 3 = 0 THEN 'global' WHEN s_suppkey % 3 = 1 THEN 'region' ELSE 'odd' END",
    "shape": "CASE s_suppkey % 4 WHEN 1 THEN 'Point' WHEN 2 THEN 'Polygon' WHEN 3 THEN CASE WHEN s_suppkey % 8 = 3 THEN 'Polygon' ELSE 'LineString' END END",
    "coordinates": "CASE s_suppkey % 4 WHEN 1 THEN concat('[', s_suppkey % 180, ',20.5]') WHEN 2 THEN '[[[0,0],[5,0],[5,5],[0,0]],[[3,1],[4,1],[4,2],[3,1]]]' WHEN 3 THEN CASE WHEN s_suppkey % 8 = 3 THEN '[[[0,80],[5,80],[5,88],[0,80]]]' ELSE '[[0,0],[1,1]]' END END",
    "radius": "CASE WHEN s_suppkey % 11 = 0 THEN 'wide' ELSE CAST(s_suppkey * 90 - 300 AS {}) END",
    "severity": "CASE WHEN s_suppkey % 4 = 1 THEN 'Severe' ELSE 'Dire' END",
}


def clean_regions(raw, words):
    """Watch regions fit to use, at most 50 in order: ids of safe characters, the first of each; labels; a place (region_shape) unless worldwide; radius within 1 to 2000 km; severity Moderate where unknown.

    A list of keywords from before regions were kept becomes one more, worldwide.
    """
    scope = F.when(C("scope").isin("region", "global"), C("scope")).otherwise("region")
    r = raw.withColumns({"scope": scope, "label": F.substring(text.single_line(C("label")), 1, 80), "radius": C("radius").try_cast("double")})
    r = r.where(C("id").rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$") & (F.length("id") <= 80) & (C("label") != "") & ((C("scope") == "global") | geometry.region_shape(C("shape"), C("coordinates"))) & C("radius").isNotNull())
    one = r.groupBy("id").agg(F.min_by(F.struct("n", "label", "scope", "radius", "severity"), "n").alias("x")).select("id", "x.*").orderBy("n").limit(50)
    clean = one.select("id", "label", "scope", F.greatest(F.lit(1.0), F.least(F.lit(2000.0), "radius")).alias("radius"), F.when(C("severity").isin(*SEVERITIES), C("severity")).otherwise("Moderate").alias("severity"), F.lit("").alias("keywords"))
    return clean.unionByName(words.select(F.lit("legacy:keywords").alias("id"), F.lit("Keywords").alias("label"), F.lit("global").alias("scope"), F.lit(1.0).alias("radius"), F.lit("Moderate").alias("severity"), "keywords"))


@query("wat_clean_regions", ", raw AS (SELECT s_suppkey AS n, " + ", ".join(f"{x.format('VARCHAR')} AS {c}" for c, x in _RAW.items()) + " FROM supplier), c AS (SELECT n, id, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, CASE WHEN scope = 'odd' THEN 'region' ELSE scope END AS scope, n % 4 IN (1, 2) AS placed, try_cast(radius AS DOUBLE) AS radius, CASE WHEN severity = 'Dire' THEN 'Moderate' ELSE severity END AS severity FROM raw), f AS (SELECT * FROM c WHERE regexp_matches(id, '^[A-Za-z0-9]') AND label <> '' AND (scope = 'global' OR placed) AND radius IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1 ORDER BY n LIMIT 50) SELECT id, label, scope, greatest(1.0, least(2000.0, radius))::DOUBLE AS radius, severity, '' AS keywords FROM f UNION ALL SELECT 'legacy:keywords', 'Keywords', 'global', 1.0, 'Moderate', string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT lower(r_name) AS w FROM region ORDER BY w LIMIT 20)")
def wat_clean_regions(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("n"), *(F.expr(x.format("STRING")).alias(c) for c, x in _RAW.items()))
    words = table(spark, sf_dir, "region").select(F.lower("r_name").alias("w")).distinct().orderBy("w").limit(20)
    return clean_regions(raw, words.agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("keywords")))
