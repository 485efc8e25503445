"""Scalar expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, lookup, text, times
from ..model import FILTER_KINDS, SEVERITY_POINTS, TAXONOMY
from ..views import NOW, articles, observations, table
from .registry import query

_obs = observations
C = F.col
_NOW = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")


_TOKENS = "list_filter(regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','at','for','in','of','on','the','to','update'))"
_FOLDED = "strip_accents(replace(title, chr(223), ''))"
_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '', 'g')"


def over_obs(name: str, columns, sql: str):
    """Registers a query that selects columns of every observation version."""

    @query(name, f"SELECT event_id, {sql} FROM o")
    def run(spark, sf_dir, columns=columns):
        return _obs(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in columns().items()))

    return run


def _case(values: dict, c: str, other: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {other} END"


_R = "CASE {} WHEN '{}' THEN 4 WHEN '{}' THEN 3 WHEN '{}' THEN 2 WHEN '{}' THEN 1 ELSE 0 END"
over_obs(
    "fn_rank",
    lambda: {"severity_rank": lookup.severity_rank(C("severity")), "urgency_rank": lookup.urgency_rank(C("urgency")), "certainty_rank": lookup.certainty_rank(C("certainty"))},
    f"{_R.format('severity', 'Extreme', 'Severe', 'Moderate', 'Minor')} AS severity_rank, {_R.format('urgency', 'Immediate', 'Expected', 'Future', 'Past')} AS urgency_rank, {_R.format('certainty', 'Observed', 'Likely', 'Possible', 'Unlikely')} AS certainty_rank",
)
over_obs("fn_lane", lambda: {"lane": lookup.lane(C("kind"))}, _case({k: v[0] for k, v in TAXONOMY.items()}, "kind", "'optional_signal'") + " AS lane")
over_obs(
    "fn_provenance",
    lambda: {"provenance": lookup.provenance(C("kind"), C("urgency"), C("certainty"))},
    """CASE WHEN kind IN ('weather_alert','tropical_cyclone','tsunami') THEN 'Warning' WHEN kind = 'aviation_hazard' THEN 'Official advisory'
 WHEN kind = 'disaster_declaration' THEN 'Administrative declaration' WHEN kind IN ('news_item') THEN 'Media coverage'
 WHEN urgency = 'Future' OR certainty IN ('Possible','Unlikely') THEN 'Forecast' ELSE 'Observation' END AS provenance""",
)
over_obs(
    "fn_category_filter",
    lambda: {k: lookup.in_filter(C("kind"), k) for k in [*FILTER_KINDS, "global"]},
    ", ".join(f"kind IN ({', '.join(repr(x) for x in v)}) AS {k}" for k, v in FILTER_KINDS.items()) + ", true AS \"global\"",
)
_KN = [(34, "TS"), (64, "C1"), (83, "C2"), (96, "C3"), (113, "C4"), (137, "C5")]
_steps = lambda c, steps, under: "CASE " + " ".join(f"WHEN {c} >= {n} THEN '{x}'" for n, x in sorted(steps, reverse=True)) + f" ELSE '{under}' END"
over_obs("fn_storm_category", lambda: {"category": lookup.bucket(C("value"), _KN, "TD")}, _steps("value", _KN, "TD") + " AS category")
_MAG = [(4, "moderate"), (5, "strong"), (6, "major")]
over_obs("fn_mag_class", lambda: {"class": lookup.bucket(C("k") / 10, _MAG, "minor")}, _steps("k / 10.0", _MAG, "minor") + " AS class")
_KP = [(4, "active"), (5, "storm"), (7, "severe")]
over_obs("fn_kp_class", lambda: {"class": lookup.bucket(C("k") % 10, _KP, "quiet")}, _steps("k % 10", _KP, "quiet") + " AS class")
over_obs("fn_compass", lambda: {"point": geo.compass_point((C("k") * 3.7) % 360)}, "(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(floor(((k * 3.7) % 360) / 22.5 + 0.5) AS INT) % 16 + 1] AS point")
over_obs("fn_metric_get", lambda: {"hazard": F.create_map(F.lit("hazard_type"), C("hazard_type"), F.lit("storm_name"), C("storm_name"))["hazard_type"]}, "hazard_type AS hazard")
over_obs("fn_ids", lambda: {"observation_id": C("observation_id"), "incident_id": F.concat(F.lit("incident:"), C("kind"), F.lit(":"), F.substring(F.sha2("observation_id", 256), 1, 24))}, "observation_id, concat('incident:', kind, ':', substr(sha256(observation_id), 1, 24)) AS incident_id")
over_obs("fn_content_hash", lambda: {"content_hash": C("content_hash")}, "content_hash")
over_obs("fn_edit_delta", lambda: {"delta": F.coalesce(C("k") - F.when(C("k") % 4 != 0, F.length("headline")), F.lit(0))}, "coalesce(k - CASE WHEN k % 4 <> 0 THEN length(headline) END, 0) AS delta")
over_obs("fn_norm_lon", lambda: {"lon360": geo.normalized_longitude(C("slon") * 3)}, "CASE WHEN ((slon * 3 + 180) - 360 * floor((slon * 3 + 180) / 360)) - 180 = -180 AND slon > 0 THEN 180 ELSE ((slon * 3 + 180) - 360 * floor((slon * 3 + 180) / 360)) - 180 END AS lon360")
over_obs("fn_valid_point", lambda: {"valid": geo.valid_point(C("slon") * 1.5, C("slat") * 1.2)}, "(slon * 1.5 BETWEEN -180 AND 180 AND slat * 1.2 BETWEEN -90 AND 90) AS valid")
over_obs("fn_in_bounds", lambda: {"inside": geo.in_bounds(C("slon"), C("slat"), 150, -20, -120, 45), "plain": geo.in_bounds(C("slon"), C("slat"), -20, -95, 60, 45)}, "((slon >= 150 OR slon <= -120) AND slat BETWEEN -20 AND 45) AS inside, (slon BETWEEN -20 AND 60 AND slat BETWEEN -90 AND 45) AS plain")
over_obs("fn_bbox_overlap", lambda: {"hit": geo.boxes_overlap(C("slon") - 1, C("slat") - 1, C("slon") + 1, C("slat") + 1, -30.0, -10.0, 40.0, 50.0)}, "(slon - 1 <= 40 AND slon + 1 >= -30 AND slat - 1 <= 50 AND slat + 1 >= -10) AS hit")
_HAV = "6371.0088 * 2 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


def sql_km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return _HAV.format(lat1, lon1, lat2, lon2)


over_obs("fn_haversine", lambda: {"km": F.round(geo.haversine_km(C("lon"), C("lat"), C("slon"), C("slat")), 3)}, f"round({sql_km('lon', 'lat', 'slon', 'slat')}, 3) AS km")
over_obs("fn_location_label", lambda: {"label": geo.location_label(C("lon"), C("lat"))}, "concat(printf('%.1f', floor(round(abs(lat) * 10, 6) + 0.5) / 10), '°', CASE WHEN lat < 0 THEN 'S' ELSE 'N' END, ', ', printf('%.1f', floor(round(abs(lon) * 10, 6) + 0.5) / 10), '°', CASE WHEN lon < 0 THEN 'W' ELSE 'E' END) AS label")
query("fn_age_label", f"SELECT event_id, CASE WHEN s < 60 THEN concat(CAST(s AS BIGINT), 's ago') WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ago') WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h ago') ELSE concat(CAST(floor(s / 86400) AS BIGINT), 'd ago') END AS label FROM (SELECT event_id, greatest(floor((epoch_us({_NOW}) - epoch_us(ingested_at)) / 1e6), 0) AS s FROM o)")(lambda spark, sf_dir: _obs(spark, sf_dir).select("event_id", times.age_label(C("ingested_at"), _now()).alias("label")))
over_obs("fn_utc_label", lambda: {"label": times.utc_label(F.date_trunc("second", C("source_updated_at")))}, "coalesce(strftime(source_updated_at, '%Y-%m-%d %H:%M:%S UTC'), 'Not reported') AS label")
over_obs("fn_expiration", lambda: {"state": times.expiration_state(C("status"), C("expires_at"), _now())}, f"CASE WHEN status = 'cancelled' THEN 'Cancelled' WHEN status = 'ended' THEN 'Ended' WHEN expires_at <= {_NOW} THEN 'Expired' ELSE 'Current' END AS state")
over_obs("fn_quiet_hours", lambda: {"quiet": times.quiet(C("event_at"), 1320, 420), "day": times.quiet(C("event_at"), 540, 1020), "never": times.quiet(C("event_at"), 60, 60)}, "(hour(event_at) * 60 + minute(event_at) >= 1320 OR hour(event_at) * 60 + minute(event_at) < 420) AS quiet, (hour(event_at) * 60 + minute(event_at) >= 540 AND hour(event_at) * 60 + minute(event_at) < 1020) AS day, false AS never")
over_obs("fn_window_state", lambda: {"state": times.window_state(C("event_at"), C("expires_at"), _now())}, f"CASE WHEN expires_at IS NULL OR expires_at <= event_at THEN 'invalid' WHEN {_NOW} >= expires_at THEN 'expired' WHEN {_NOW} < event_at THEN 'future' ELSE 'current' END AS state")
over_obs("fn_epoch_ms", lambda: {"us": F.unix_micros(times.epoch_ms(F.unix_millis("event_at"))), "bad": F.unix_micros(times.epoch_ms(F.lit(-1) * C("event_id") - 1))}, "(epoch_us(event_at) // 1000) * 1000 AS us, CAST(NULL AS BIGINT) AS bad")
_TEXTS = "CASE k % 4 WHEN 0 THEN strftime(event_at, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(event_at, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(event_at, '%Y-%m-%dT%H:%M') ELSE 'soon' END"


def _stamp():
    return F.expr("CASE k % 4 WHEN 0 THEN date_format(event_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(event_at, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(event_at, \"yyyy-MM-dd'T'HH:mm\") ELSE 'soon' END")


over_obs("fn_rfc3339", lambda: {"s": F.unix_seconds(times.rfc3339(_stamp()))}, "CASE WHEN k % 4 = 0 THEN CAST(floor(epoch_us(event_at) / 1e6) AS BIGINT) END AS s")
over_obs("fn_provider_utc", lambda: {"s": F.unix_seconds(times.provider_utc(_stamp()))}, "CASE k % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(floor(epoch_us(event_at) / 6e7) AS BIGINT) * 60 ELSE CAST(floor(epoch_us(event_at) / 1e6) AS BIGINT) END AS s")


def _rss():
    return F.when(C("k") % 2 == 0, F.date_format("event_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(_stamp())


over_obs("fn_rss_time", lambda: {"s": F.unix_seconds(times.rss_time(_rss()))}, "CASE WHEN k % 2 = 0 THEN CAST(floor(epoch_us(event_at) / 1e6) AS BIGINT) END AS s")
over_obs("fn_single_line", lambda: {"line": text.single_line(F.concat(F.lit("  "), "headline", F.lit(" \n\t "), F.coalesce("location_name", F.lit("")), F.lit("  "))), "blank": text.single_line(F.lit(" \n "), "none")}, "trim(regexp_replace(concat('  ', headline, ' ', chr(10), chr(9), ' ', coalesce(location_name, ''), '  '), '\\s+', ' ', 'g')) AS line, 'none' AS blank")
over_obs(
    "fn_score_text",
    lambda: {"words": F.concat_ws(" · ", F.when(lookup.severity_points(C("severity")) != 0, F.concat(F.lit("impact +"), lookup.severity_points(C("severity")).cast("string"))), F.when(lookup.urgency_points(C("urgency")) != 0, F.concat(F.lit("urgency +"), lookup.urgency_points(C("urgency")).cast("string"))), F.when(C("status").isin("cancelled", "ended"), F.lit("status/age -40")))},
    f"concat_ws(' · ', CASE WHEN sp <> 0 THEN concat('impact +', sp) END, CASE WHEN up <> 0 THEN concat('urgency +', up) END, CASE WHEN status IN ('cancelled','ended') THEN 'status/age -40' END) AS words FROM (SELECT *, {_case(SEVERITY_POINTS, 'severity', '0')} AS sp, CASE urgency WHEN 'Immediate' THEN 20 WHEN 'Expected' THEN 15 WHEN 'Future' THEN 8 ELSE 0 END AS up FROM o) o --",
)
_LEVELS = {"quakes": (20, 8), "alerts": (5, 0), "hotspots": (10, 3), "conflict": (30, 0), "warnings": (100, 30), "storms": (3, 0)}


@query("fn_panel_level", "SELECT kind, n, " + ", ".join(f"CASE WHEN n > {a} THEN 'hot' WHEN n > {b} THEN 'warn' ELSE 'ok' END AS {p}" for p, (a, b) in _LEVELS.items()) + " FROM (SELECT kind, count(*) AS n FROM l GROUP BY kind)")
def panel_level(spark, sf_dir):
    from ..views import latest_observations

    n = latest_observations(_obs(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))
    return n.select("kind", "n", *(F.when(C("n") > a, "hot").when(C("n") > b, "warn").otherwise("ok").alias(p) for p, (a, b) in _LEVELS.items()))


@query("fn_norm_title", f"SELECT doc_id, array_to_string({_TOKENS.format(_ASCII.format(_FOLDED))}, ' ') AS title FROM art")
def norm_title(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", text.normalized_title(C("title")).alias("title"))


@query("fn_norm_area", "SELECT event_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(location_name, '')), '[a-z0-9]+'), lambda w: w NOT IN ('county','parish','borough','census','area','municipality','city','and','of','a','an','at','for','in','on','the','to','update')), ' ') AS area FROM o")
def norm_area(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", text.normalized_area(F.coalesce("location_name", F.lit(""))).alias("area"))


@query("fn_jaccard", f"SELECT event_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS likeness FROM (SELECT event_id, {_TOKENS.format('headline')} AS a, {_TOKENS.format('summary')} AS b FROM o)")
def jaccard(spark, sf_dir):
    return _obs(spark, sf_dir).select("event_id", F.round(text.jaccard(text.title_tokens(C("headline")), text.title_tokens(C("summary"))), 6).alias("likeness"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("fn_clean_markup", f"SELECT page_id, substr(trim(regexp_replace(regexp_replace({_UNESCAPE}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 4000) AS plain FROM pages")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_markup(C("html")).alias("plain"))


_SAFE = "CASE WHEN regexp_matches(url, '^(?i)https?://[^/@\\s]+(/[^\\s]*)?([?#][^\\s]*)?$') THEN url END"


@query("fn_safe_url", f"SELECT page_id, {_SAFE} AS safe FROM pages")
def safe_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_url(C("url")).alias("safe"))


@query("fn_redact_url", "SELECT page_id, " + _SAFE.replace("url", "concat(url, '&token=abc', page_id, '&x=1')").replace("THEN concat(url, '&token=abc', page_id, '&x=1')", "THEN concat(url, '&token=REDACTED&x=1')") + " AS redacted FROM pages")
def redact_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.redacted_url(F.concat("url", F.lit("&token=abc"), C("page_id").cast("string"), F.lit("&x=1"))).alias("redacted"))


@query("fn_host_label", "SELECT page_id, split_part(regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', ''), '.', 1) AS label FROM pages")
def host_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host_label(C("url")).alias("label"))


@query("fn_circular_center", "SELECT site, round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 4) AS lon, round(avg(lat), 6) AS lat FROM o GROUP BY site")
def circular_center(spark, sf_dir):
    lon = F.degrees(F.atan2(F.sum(F.sin(F.radians("lon"))), F.sum(F.cos(F.radians("lon")))))
    return _obs(spark, sf_dir).groupBy("site").agg(F.round(lon, 4).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("fn_point_in_poly", "SELECT event_id, CASE WHEN slon BETWEEN -40 AND 60 AND slat BETWEEN -30 AND 50 AND NOT (slon > 0 AND slon < 20 AND slat > 0 AND slat < 20) THEN true ELSE false END AS box, (slon >= 170 OR slon <= -160) AND slat BETWEEN -10 AND 10 AS dateline FROM o")
def point_in_poly(spark, sf_dir):
    def ring(*points):
        return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points))

    box = F.array(ring((-40, -30), (60, -30), (60, 50), (-40, 50), (-40, -30)), ring((0, 0), (20, 0), (20, 20), (0, 20), (0, 0)))
    line = F.array(ring((170, -10), (-160, -10), (-160, 10), (170, 10), (170, -10)))
    return _obs(spark, sf_dir).select("event_id", geo.in_polygon(C("slon"), C("slat"), box).alias("box"), geo.in_polygon(C("slon"), C("slat"), line).alias("dateline"))


_FRESH = "CASE WHEN bool_and(s = 'error') THEN 'error' WHEN bool_or(s IN ('error','stale')) THEN 'stale' WHEN bool_or(s = 'cached') THEN 'cached' ELSE 'live' END"
_STATE = "CASE k % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'stale' WHEN 2 THEN 'cached' ELSE 'live' END"


@query("fn_combine_freshness", f"SELECT user_id, {_FRESH} AS state FROM (SELECT user_id, {_STATE} AS s FROM o) GROUP BY user_id")
def combine_freshness(spark, sf_dir):
    s = _obs(spark, sf_dir).select("user_id", F.expr(_STATE).alias("s"))
    every, some = F.bool_and(C("s") == "error"), lambda *v: F.bool_or(C("s").isin(*v))
    return s.groupBy("user_id").agg(F.when(every, "error").when(some("error", "stale"), "stale").when(some("cached"), "cached").otherwise("live").alias("state"))


@query("fn_worst_freshness", f"SELECT user_id, (['live','cached','stale','error'])[max(CASE s WHEN 'live' THEN 1 WHEN 'cached' THEN 2 WHEN 'stale' THEN 3 ELSE 4 END)] AS state FROM (SELECT user_id, {_STATE} AS s FROM o) GROUP BY user_id")
def worst_freshness(spark, sf_dir):
    s = _obs(spark, sf_dir).select("user_id", F.expr(_STATE).alias("s"))
    return s.groupBy("user_id").agg(F.max_by("s", lookup.rank(C("s"), ("error", "stale", "cached", "live"))).alias("state"))

