"""Sinks: what they write, as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SEVERITIES, URGENCIES
from ..operators.scoring import incident_scores, latest_key, snapshot_parts
from ..operators.sinks import CSV_COLUMNS, csv_lines, dense_cursor, geojson_collection, merge_latest, sources_of, upsert_incidents
from ..views import NOW, latest_observations, members, observations
from .aggregates import _RANK, _STATUS
from .filters import INC
from .registry import query
from .relations import cases

C = F.col
_AT = "2024-01-31T12:00:00Z"
#: An address for each provider, but for one that has a secret in it and so isn't shown.
_URL = "CASE provider_id WHEN 'prov_3' THEN 'https://user:key@feeds.example/3' ELSE concat('https://feeds.example/', provider_id) END"
_SAFE_URL = "CASE WHEN provider_id <> 'prov_3' THEN concat('https://feeds.example/', provider_id) END"


def export_rows(spark, sf_dir):
    """Incidents as exports take them; some headlines begin with a sign that a spreadsheet would run."""
    m = members(observations(spark, sf_dir)).withColumn("headline", F.when(C("kind") == "volcano", F.concat(F.lit("=\"x\" "), "headline")).otherwise(C("headline")))
    sources = sources_of(C("provider_id"), F.expr(_URL)).alias("sources")
    i = incident_scores(m, NOW, more=(*snapshot_parts(), sources))
    return i.withColumnRenamed("urgency", "urgency_points").withColumnRenamed("urgency_name", "urgency")


_LAST = "{'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id}"
_EXPORT = (
    INC.rstrip()
    + f""", sn AS (SELECT incident_id, arg_max(CASE kind WHEN 'volcano' THEN concat('="x" ', headline) ELSE headline END, {_LAST}) AS headline, arg_max(summary, {_LAST}) AS summary, {_STATUS} AS status, {_RANK('severity', SEVERITIES)} AS severity, {_RANK('urgency', URGENCIES)} AS urgency, {_RANK('certainty', ('Observed', 'Likely', 'Possible', 'Unlikely', 'Unknown'))} AS certainty,
  min(coalesce(event_at, source_updated_at, ingested_at)) AS first_seen, max(coalesce(event_at, source_updated_at, ingested_at)) AS last_observed, round(arg_max(lon, {_LAST}), 4) AS lon, round(arg_max(lat, {_LAST}), 4) AS lat FROM m GROUP BY incident_id
), so AS (SELECT incident_id, list({{'p': provider_id, 'u': {_SAFE_URL}}} ORDER BY provider_id) AS sources FROM (SELECT DISTINCT incident_id, provider_id FROM m) GROUP BY incident_id
), ex AS (SELECT sn.*, inc.kind, inc.priority_score, inc.last_changed, so.sources, row_number() OVER (ORDER BY inc.priority_score DESC, inc.last_changed DESC, sn.incident_id) AS place FROM sn JOIN inc USING (incident_id) JOIN so USING (incident_id) QUALIFY place <= 200
)
"""
)
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_CELL = "concat('\"', replace(CASE WHEN regexp_matches({0}, '^[=+\\-@]') THEN concat(chr(9), {0}) ELSE {0} END, '\"', '\"\"'), '\"')"
_NUM = "concat('\"', regexp_replace(CAST({} AS VARCHAR), '\\.0$', ''), '\"')"
_HEAD = ",".join(f'"{c}"' for c in CSV_COLUMNS)
_CSV_SQL = (
    _EXPORT
    + f"SELECT 0 AS place, concat(chr(65279), '{_HEAD}', chr(13), chr(10)) AS line UNION ALL SELECT place, concat(concat_ws(',', '\"1\"', "
    + ", ".join(_CELL.format(c) for c in ("incident_id", "kind", "headline", "summary", "status", "severity", "urgency", "certainty"))
    + f", {_NUM.format('priority_score')}, "
    + ", ".join(_CELL.format(_ISO.format(c)) for c in ("first_seen", "last_changed", "last_observed"))
    + f", {_NUM.format('lon')}, {_NUM.format('lat')}, "
    + _CELL.format("array_to_string(list_transform(sources, lambda s: CASE WHEN s.u IS NULL THEN s.p ELSE concat(s.p, ' (', s.u, ')') END), '; ')")
    + "), chr(13), chr(10)) FROM ex"
)


@query("sink_csv", _CSV_SQL)
def sink_csv(spark, sf_dir):
    return csv_lines(export_rows(spark, sf_dir))


_FEATURE = (
    "json_object('type', 'Feature', 'id', incident_id, 'geometry', CASE kind WHEN 'disaster_declaration' THEN json_object('type', 'Polygon', 'coordinates', [[[lon, lat], [greatest(lon - 1, -180.0), lat], [lon, lat + 1], [lon, lat]]]) ELSE json_object('type', 'Point', 'coordinates', [lon, lat]) END, 'properties', json_object('schema_version', 1, 'incident_id', incident_id, 'kind', kind, 'headline', headline, 'summary', summary, 'status', status, 'severity', severity, 'urgency', urgency, 'certainty', certainty, 'priority_score', priority_score, "
    + ", ".join(f"'{n}', {_ISO.format(c)}" for n, c in (("first_seen_at", "first_seen"), ("last_changed_at", "last_changed"), ("last_observed_at", "last_observed")))
    + ", 'sources', list_transform(sources, lambda s: {'provider_id': s.p, 'attribution': s.p, 'source_url': s.u})))"
)


@query("sink_geojson", _EXPORT + f"SELECT concat('{{\"type\":\"FeatureCollection\",\"schema_version\":1,\"generated_at\":\"{_AT}\",\"features\":[', string_agg(CAST({_FEATURE} AS VARCHAR), ',' ORDER BY place), ']}}') AS collection FROM ex")
def sink_geojson(spark, sf_dir):
    """Declarations are drawn as triangles; volcanoes have a ring that doesn't close, so they stay points."""
    x, y = F.round("lon", 4), F.round("lat", 4)
    ring = F.array(F.array(x, y), F.array(F.greatest(x - 1, F.lit(-180.0)), y), F.array(x, y + 1))
    shape = F.when(C("kind").isin("disaster_declaration", "volcano"), "Polygon")
    text_ = F.to_json(F.array(F.when(C("kind") == "volcano", ring).otherwise(F.concat(ring, F.array(F.array(x, y))))))
    return geojson_collection(export_rows(spark, sf_dir).withColumns({"shape": shape, "coordinates": text_}), _AT)


@query("sink_revision_log", "SELECT event_id, row_number() OVER (ORDER BY event_id >= 5000, ingested_at, observation_id, event_id) AS cursor FROM o")
def sink_revision_log(spark, sf_dir):
    """Two batches: the second one's cursors go on from the last that the first one gave out, over the whole log."""
    o = observations(spark, sf_dir)
    first = dense_cursor(o.where("event_id < 5000"), "ingested_at", ["observation_id", "event_id"])
    last = first.agg(F.max("cursor").alias("last"))
    more = dense_cursor(o.where("event_id >= 5000"), "ingested_at", ["observation_id", "event_id"], last)
    return first.select("event_id", "cursor").unionByName(more.select("event_id", "cursor"))


@query("sink_upsert_obs", ", a AS (SELECT observation_id, arg_max(content_hash, {'a': ingested_at, 'b': event_id}) AS h, max(ingested_at) AS t FROM o WHERE event_id < 300 GROUP BY ALL), b AS (SELECT observation_id, arg_max(content_hash, {'a': ingested_at, 'b': event_id}) AS h, max(ingested_at) AS t FROM o WHERE event_id >= 300 GROUP BY ALL) SELECT coalesce(b.observation_id, a.observation_id) AS observation_id, coalesce(b.h, a.h) AS content_hash, epoch_us(coalesce(b.t, a.t)) AS ingested_us, b.h IS NOT NULL AND b.h IS DISTINCT FROM a.h AS changed FROM a FULL JOIN b USING (observation_id)")
def sink_upsert_obs(spark, sf_dir):
    """The table that the rows before 300 left, after an upsert of those from 300 on: equal content still brings its later time in."""
    o = observations(spark, sf_dir).select("observation_id", "content_hash", "ingested_at", "event_id")
    order = ["ingested_at", "event_id"]
    old = merge_latest(None, o.where("event_id < 300"), "observation_id", order, "content_hash").drop("changed")
    return merge_latest(old, o.where("event_id >= 300"), "observation_id", order, "content_hash").select("observation_id", "content_hash", F.unix_micros("ingested_at").alias("ingested_us"), "changed")


_SAID = "arg_max(concat(headline, status), {'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id})"


_CASE_ID = "concat('incident:', kind, ':u', user_id)"
_UPSERT = f""", l0 AS (SELECT * FROM o WHERE event_id < 5000 QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at DESC, event_id DESC) = 1
), old AS (SELECT {_CASE_ID} AS incident_id, count(*) AS n, {_SAID} AS said FROM l0 GROUP BY 1), new AS (SELECT {_CASE_ID} AS incident_id, count(*) AS n, {_SAID} AS said, max(ingested_at) AS last_changed FROM l GROUP BY 1
), act AS (SELECT * FROM (SELECT new.incident_id, new.n AS revision, last_changed, CASE WHEN old.n IS NULL THEN 'inserted' WHEN new.n > old.n THEN 'updated' WHEN new.n = old.n AND new.said IS DISTINCT FROM old.said THEN 'rejected' END AS action FROM new LEFT JOIN old USING (incident_id)) WHERE action IS NOT NULL
), acc AS (SELECT * FROM act WHERE action <> 'rejected')
"""


@query("sink_upsert_incident", _UPSERT + f"SELECT 'action' AS part, incident_id, action AS item, revision AS number FROM act UNION ALL SELECT 'edge', {_CASE_ID}, observation_id, NULL FROM l WHERE {_CASE_ID} IN (SELECT incident_id FROM acc) UNION ALL SELECT 'edge', {_CASE_ID}, observation_id, NULL FROM l0 WHERE {_CASE_ID} NOT IN (SELECT incident_id FROM acc) UNION ALL SELECT 'log', incident_id, CAST(revision AS VARCHAR), row_number() OVER (ORDER BY last_changed, incident_id) + (SELECT count(*) FROM old) FROM acc")
def sink_upsert_incident(spark, sf_dir):
    """Snapshot incidents laid over an older snapshot: higher revisions go in, with new edges and a row of the log; other content under the same revision is rejected."""

    def snapshot(o):
        m = cases(o)
        i = m.groupBy("incident_id").agg(F.count("*").alias("n_members"), F.max_by("headline", latest_key()).alias("headline"), F.max_by("status", latest_key()).alias("last_status"), F.max("ingested_at").alias("last_changed"))
        return i.select("incident_id", C("n_members").alias("revision"), F.concat("headline", "last_status").alias("said"), "last_changed"), m.select("incident_id", "observation_id")

    o = observations(spark, sf_dir)
    (old, old_edges), (new, new_edges) = snapshot(o.where("event_id < 5000")), snapshot(o)
    actions, edges, log = upsert_incidents(old, new, old_edges, new_edges, old.agg(F.count("*").alias("last")))
    none = F.lit(None).cast("long")
    said = actions.select(F.lit("action").alias("part"), "incident_id", C("action").alias("item"), C("revision").alias("number"))
    said = said.unionByName(edges.select(F.lit("edge").alias("part"), "incident_id", C("observation_id").alias("item"), none.alias("number")))
    return said.unionByName(log.select(F.lit("log").alias("part"), "incident_id", C("revision").cast("string").alias("item"), C("cursor").cast("long").alias("number")))


#: Kind -> panel; the last two kinds stand in for panels whose own kinds these tables lack.
PANELS = {
    "earthquake": "usgs_earthquakes", "weather_alert": "nws_alerts", "tropical_cyclone": "nhc_storms", "tsunami": "noaa_tsunami", "wildfire": "gdacs",
    "volcano": "smithsonian_volcano", "news_item": "reliefweb_rss", "disaster_declaration": "nasa_eonet", "aviation_hazard": "noaa_space_weather",
}
#: Fields of each panel's rows, in order, and what they hold.
LAYOUTS = {
    "usgs_earthquakes": {"id": "record_id", "lon": "round(slon, 4)", "lat": "round(slat, 4)", "mag": "k / 10.0", "place": "coalesce(location_name, headline)", "time": "ms(event_at)", "updated": "ms(source_updated_at)", "url": "source_url", "tsunami": "k % 2"},
    "nws_alerts": {"id": "record_id", "event": "event_type", "headline": "headline", "description": "summary", "instruction": "''", "severity": "severity", "urgency": "urgency", "certainty": "certainty", "onset": "iso(event_at)", "effective": "iso(effective_at)", "expires": "iso(expires_at)", "sent": "iso(source_updated_at)", "areaDesc": "location_name", "senderName": "''"},
    "nhc_storms": {"id": "record_id", "name": "storm_name", "classification": "''", "intensity": "k", "pressure": "900 + k", "latitude": "round(slat, 4)", "longitude": "round(slon, 4)", "lastUpdate": "iso(source_updated_at)"},
    "noaa_tsunami": {"source": "'NOAA'", "title": "headline", "summary": "summary", "ts": "s(source_updated_at)", "lat": "round(slat, 4)", "lon": "round(slon, 4)"},
    "gdacs": {"title": "headline", "descr": "summary", "link": "source_url", "ts": "s(event_at)", "alert": "'Green'", "etype": "'WF'", "lat": "round(slat, 4)", "lon": "round(slon, 4)"},
    "nasa_eonet": {"id": "record_id", "title": "headline", "date": "iso(event_at)", "lat": "round(slat, 4)", "lon": "round(slon, 4)", "cats": "[incident_type]", "link": "source_url"},
    "smithsonian_volcano": {"name": "headline", "summary": "summary", "link": "source_url", "lat": "round(slat, 4)", "lon": "round(slon, 4)"},
    "noaa_space_weather": {"time_tag": "iso(event_at)", "Kp": "k % 10", "a_running": "k", "station_count": "k % 9"},
    "reliefweb_rss": {"ts": "s(source_updated_at)", "title": "headline", "summary": "summary", "link": "source_url", "src": "'ReliefWeb'"},
}


def _panel_value(x: str, spark: bool) -> str:
    """A layout's value in either dialect: iso, s and ms of moments, and lists of one."""
    head, _, inner = x.partition("(")
    inner = inner.removesuffix(")")
    if head == "iso":
        return f"date_format({inner}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")" if spark else f"strftime({inner}, '%Y-%m-%dT%H:%M:%SZ')"
    if head in ("s", "ms"):
        return f"unix_{'seconds' if head == 's' else 'millis'}({inner})" if spark else f"CAST(floor(epoch_us({inner}) / 1e{6 if head == 's' else 3}) AS BIGINT)"
    if x.startswith("["):
        return f"array({x[1:-1]})" if spark else x
    if x == "k / 10.0":
        return "CAST(k / 10.0 AS DOUBLE)"
    return x


_ITEM_SQL = "CASE kind " + " ".join(f"WHEN '{kind}' THEN CAST(json_object(" + ", ".join(f"'{n}', {_panel_value(x, False)}" for n, x in LAYOUTS[p].items()) + ") AS VARCHAR)" for kind, p in PANELS.items()) + " END"


@query("sink_panel", f"SELECT event_id, panel, item FROM (SELECT event_id, CASE kind " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in PANELS.items()) + f" END AS panel, {_ITEM_SQL} AS item FROM (SELECT *, {_SAFE_URL} AS source_url FROM l)) WHERE panel IS NOT NULL")
def sink_panel(spark, sf_dir):
    """Latest observations as the rows of their source's panel, one JSON item each."""
    o = latest_observations(observations(spark, sf_dir)).where(C("kind").isin(*PANELS)).withColumn("source_url", F.expr(_SAFE_URL))
    panel, item = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, p in PANELS.items():
        mine = F.to_json(F.struct(*(F.expr(_panel_value(x, True)).alias(n) for n, x in LAYOUTS[p].items())), {"ignoreNullFields": "false"})
        panel, item = F.when(C("kind") == kind, p).otherwise(panel), F.when(C("kind") == kind, mine).otherwise(item)
    return o.select("event_id", panel.alias("panel"), item.alias("item"))
