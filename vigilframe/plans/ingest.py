"""Ingestion jobs over payloads that Spark builds out of the events, fifty to a body."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_markup, host_label
from ..functions.times import rss_time
from ..sources.ingest import PROVIDERS, RECORDS, centre, diagnostics, items, normalize
from ..streaming.streams import run_available, shared_folder
from ..views import NOW, observations, table
from .registry import query

C = F.col
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _iso(c):
    return F.date_format(c, _ISO)


def payloads(o, provider: str, item, before: str, after: str, between: str = ","):
    """Bodies of fifty neighbouring events each; item is the text of one."""
    one = o.select(F.floor(C("event_id") / 50).alias("batch"), F.struct("event_id", item.alias("x")).alias("i"))
    g = one.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), between).alias("x"))
    return g.select(F.lit(provider).alias("provider_id"), F.concat(F.lit(before), "x", F.lit(after)).alias("body"), F.expr(f"TIMESTAMP '{NOW}'").alias("ingested_at"))


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _tag(name: str, c):
    return F.concat(F.lit(f"<{name}>"), F.coalesce(c.cast("string"), F.lit("")), F.lit(f"</{name}>"))


def _id():
    return F.concat(F.lit("x"), C("event_id").cast("string"))


def _around():
    """A square of two degrees around the place; its corners' mean with the first corner twice is off the middle by a fifth of a degree."""
    at = lambda dx, dy: F.array(F.round(F.greatest(F.lit(-178.0), F.least(F.lit(178.0), "lon")) + dx, 2), F.round(C("lat") + dy, 2))
    ring = F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def _point():
    return F.struct(F.lit("Point").alias("type"), F.array("slon", "slat").alias("coordinates"))


def _build(name: str, o):
    """Payloads of a provider, in its own shape."""
    s = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    iso = _iso("event_at")
    if name == "usgs_earthquakes":
        p = s(mag=C("k") / 10, place=C("headline"), title=C("headline"), time=F.unix_millis("event_at"), updated=F.unix_millis("ingested_at"), url=F.lit("https://example.org/q"), status=F.when(C("k") % 10 == 0, "deleted").otherwise("reviewed"), tsunami=C("k") % 2, sig=C("k"))
        return payloads(o, name, _json(id=_id(), geometry=_point(), properties=p), '{"features":[', "]}")
    if name == "nws_alerts":
        p = s(id=_id(), event=F.when(C("k") % 9 != 4, C("kind")), headline=C("headline"), senderName=F.lit("NWS"), instruction=F.when(C("k") % 2 == 0, F.lit("Stay &lt;b&gt;inside&lt;/b&gt;")), description=F.concat(F.lit("<p>"), "summary", F.lit("</p>")), messageType=F.when(C("k") % 10 == 0, "Cancel").when(C("k") % 10 == 1, "Update").otherwise("Alert"), severity=C("severity"), urgency=C("urgency"), certainty=C("certainty"), onset=iso, effective=iso, sent=iso, expires=_iso("expires_at"), areaDesc=C("location_name"), geocode=s(UGC=F.array(F.lit("TXC001"), F.lit("LAZ002"), F.lit("TXC003"), F.lit("bad"))))
        return payloads(o, name, _json(id=F.concat(F.lit("https://example.org/"), _id()), geometry=F.when(C("k") % 4 != 0, _around()), properties=p), '{"features":[', "]}")
    if name == "noaa_aviation_weather":
        p = s(icaoId=_id(), altitudeHi1=C("k") * 100, movementSpd=F.when(C("k") % 2 == 0, C("site")), airSigmetType=F.lit("SIGMET"), alphaChar=F.lit("A"), hazard=C("hazard_type"), seriesId=F.lit("7"), validTimeFrom=iso, validTimeTo=_iso("expires_at"), rawAirSigmet=C("summary"))
        return payloads(o, name, _json(geometry=_around(), properties=p), '{"features":[', "]}")
    if name == "openfema_declarations":
        either = lambda c, k: F.when(C("event_id") % 2 == k, c)
        p = _json(
            id=_id(), disasterNumber=C("event_id").cast("string"), state=F.when(C("k") % 9 == 0, "texas").otherwise("tx"), declarationType=either(F.lit("DR"), 0), disasterType=either(F.lit("EM"), 1), declarationDate=iso, incidentType=C("incident_type"),
            declarationTitle=either(C("headline"), 0), title=either(C("headline"), 1), incidentBeginDate=iso, incidentEndDate=_iso("expires_at"), disasterCloseoutDate=F.when(C("k") % 10 == 0, iso), disasterCloseOutDate=F.when(C("k") % 10 == 1, iso),
            designatedArea=F.when(C("event_id") % 3 == 0, F.lit("")).otherwise(C("location_name")), declaredCountyArea=F.lit("Elm County"), lastRefresh=iso, iaProgramDeclared=C("k") % 2 == 0,
        )
        return payloads(o, name, p, '{"DisasterDeclarationsSummaries":[', "]}")
    if name == "ndbc_observations":
        guid = F.concat(F.lit("NDBC-"), _id(), F.lit("-"), F.date_format("event_at", "yyyyMMddHHmmss"))
        n = lambda c: c.cast("string")
        told = (
            "<b>Location:</b> 1N 2E<br/><b>Wind Direction:</b> NE (", n(C("k") % 360), "°)<br/><b>Wind Speed:</b> ", n(C("k")), " knots<br/><b>Wind Gust:</b> ", n(C("k") + 5), " knots<br/><b>Significant Wave Height:</b> ", n(C("site")), " ft<br/><b>Dominant Wave Period:</b> 7 sec<br/><b>Average Period:</b> 4.5 sec<br/>",
            "<b>Mean Wave Direction:</b> SSW (200°)<br/><b>Atmospheric Pressure:</b> 29.9 in (1012.5 mb)<br/><b>Pressure Tendency:</b> +0.1 in (-1.2 mb)<br/><b>Air Temperature:</b> 50 F (", n(C("site") * 2), " °C)<br/><b>Dew Point:</b> 40 F (4.4 °C)<br/><b>Water Temperature:</b> 60 F (15.5 °C)<br/><b>Visibility:</b> 9 nmi<br/><b>Tide:</b> 1.5 ft<br/><b>Ice Cover:</b> none </item> seen<br/>",
        )
        said = F.concat(F.lit("<![CDATA["), *(F.lit(x) if isinstance(x, str) else x for x in told), F.lit("]]>"))
        x = F.concat(F.lit("<item>"), _tag("title", C("headline")), _tag("description", said), _tag("link", F.lit("https://example.org/b")), F.lit('<guid isPermaLink="false">'), guid, F.lit("</guid>"), _tag("georss:point", F.concat_ws(" ", C("slat").cast("string"), C("slon").cast("string"))), F.lit("</item>"))
        return payloads(o, name, x.alias("x"), '<rss xmlns:georss="g"><channel>', "</channel></rss>", "")
    if name == "noaa_coops_water_levels":
        row = lambda c: F.to_json(F.struct(F.date_format("event_at", "yyyy-MM-dd HH:mm").alias("t"), c.cast("string").alias("v")))
        one = o.select(F.floor(C("event_id") / 50).alias("batch"), row(C("value")).alias("a"), row(C("k") / 4).alias("b"))
        g = one.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("a"), F.array_join(F.array_sort(F.collect_list("b")), ",").alias("b"))
        body = F.concat(F.lit('{"metadata":{"id":"'), C("batch").cast("string"), F.lit('","name":"S","lat":"1.5","lon":"2.5"},"data":['), "a", F.lit('],"predictions":['), "b", F.lit("]}"))
        return g.select(F.lit(name).alias("provider_id"), body.alias("body"), F.expr(f"TIMESTAMP '{NOW}'").alias("ingested_at"))
    if name == "nasa_jpl_fireballs":
        row = F.to_json(F.array(F.date_format("event_at", "yyyy-MM-dd HH:mm:ss"), C("event_id").cast("string"), F.abs("slat").cast("string"), F.when(C("slat") < 0, "S").otherwise("N"), F.abs("slon").cast("string"), F.when(C("slon") < 0, "W").otherwise("E"), C("k").cast("string")))
        one = o.groupBy(F.floor(C("event_id") / 50).alias("batch")).agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("x"), F.count("*").alias("n"))
        body = F.concat(F.lit('{"signature":{"version":"1.2"},"count":"'), C("n").cast("string"), F.lit('","fields":["date","energy","lat","lat-dir","lon","lon-dir","vel"],"data":['), "x", F.lit("]}"))
        return one.select(F.lit(name).alias("provider_id"), body.alias("body"), F.expr(f"TIMESTAMP '{NOW}'").alias("ingested_at"))
    if name == "nhc_storms":
        p = _json(id=_id(), name=C("storm_name"), classification=F.lit("HU"), intensity=C("k").cast("string"), pressure=F.lit("990"), latitude_numeric=C("slat"), longitude_numeric=C("slon"), lastUpdate=iso)
        return payloads(o, name, p, '{"activeStorms":[', "]}")
    if name == "noaa_tsunami":
        x = F.concat(F.lit("<entry>"), _tag("id", _id()), _tag("title", F.when(C("k") % 10 == 0, "Cancellation").otherwise("Warning")), _tag("summary", C("summary")), _tag("updated", iso), _tag("georss:point", F.concat_ws(" ", C("slat").cast("string"), C("slon").cast("string"))), F.lit('<link href="https://example.org/'), C("relation_candidate"), F.lit("S-"), C("event_id").cast("string"), F.lit('"/></entry>'))
        return payloads(o, name, x, '<feed xmlns:georss="g">', "</feed>", "")
    if name == "gdacs":
        p = s(eventtype=F.element_at(F.array(*map(F.lit, ("EQ", "TC", "VO", "WF", "FL", "XX"))), (C("k") % 6 + 1).cast("int")), eventid=C("event_id").cast("string"), name=C("headline"), description=C("summary"), alertlevel=F.lit("Green"), affectedcountries=F.array(s(iso2=F.lit("JP")), s(iso2=F.lit("long"))), iscurrent=F.when(C("k") % 10 == 0, "false").otherwise("true"), fromdate=F.date_format("event_at", "yyyy-MM-dd'T'HH:mm:ss"), population=C("k").cast("string"))
        return payloads(o, name, _json(geometry=_point(), properties=p), '{"features":[', "]}")
    if name == "nasa_eonet":
        shape = lambda d: s(date=d, type=F.lit("Point"), coordinates=F.array("slon", "slat"), magnitudeValue=C("value"), magnitudeUnit=F.lit("kts"))
        p = _json(id=_id(), title=C("headline"), closed=F.when(C("k") % 10 == 0, iso), categories=F.array(s(id=F.lit("odd")), s(id=F.when(C("k") % 2 == 0, "wildfires").otherwise("volcanoes"))), sources=F.array(s(id=F.lit("a"), url=F.lit("https://example.org/e"))), geometry=F.array(shape(F.lit("2020-01-01T00:00:00Z")), shape(iso)))
        return payloads(o, name, p, '{"events":[', "]}")
    if name == "noaa_space_weather":
        tag, kp = F.date_format("event_at", "yyyy-MM-dd HH:mm:ss"), (C("k") / 10).cast("string")
        even = F.floor(C("event_id") / 50) % 2 == 0
        objects = payloads(o.where(even), name, _json(time_tag=tag, Kp=kp, a_running=C("k").cast("string"), station_count=F.lit("8")), "[", "]")
        rows = payloads(o.where(~even), name, F.to_json(F.array(tag, kp, C("k").cast("string"), F.lit("8"))), '[["time_tag","Kp","a_running","station_count"],', "]")
        return objects.unionByName(rows)
    x = F.concat(F.lit("<item>"), _tag("guid", _id()), _tag("title", C("headline")), _tag("description", F.concat(F.lit("&lt;p&gt;"), "summary", F.lit("&lt;/p&gt;"))), _tag("link", F.lit("https://www.example.org/r")), _tag("pubDate", F.date_format("event_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), _tag("dc:creator", F.lit("OCHA")), F.lit("</item>"))
    return payloads(o, name, x, '<rss xmlns:dc="d"><channel>', "</channel></rss>", "")


def _facts(df, *more):
    return df.select("record_id", "kind", "status", F.unix_seconds(F.coalesce("event_at", "updated_at", "effective_at")).alias("at"), F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), *more)


def _job(name: str, provider: str, sql: str, *more: str):
    @query(name, sql)
    def run(spark, sf_dir):
        o = observations(spark, sf_dir)
        return _facts(PROVIDERS[provider](_build(provider, o)), *(F.element_at("metrics", m).alias(m) for m in more))

    return run


_S = "CAST(floor(epoch_us(event_at) / 1e6) AS BIGINT)"
_XY = "round(slon, 2) AS lon, round(slat, 2) AS lat"
_NO = "CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat"
_RING = {n: f"round((3 * round({x} - 1, 2) + 2 * round({x} + 1, 2)) / 5, 2)" for n, x in (("lon", "greatest(-178.0, least(178.0, lon))"), ("lat", "lat"))}
_CANCEL = "CASE WHEN k % 10 = 0 THEN 'cancelled' ELSE 'active' END AS status"
_ENDED = "CASE WHEN k % 10 = 0 THEN 'ended' ELSE 'active' END AS status"
_X = "concat('x', event_id) AS record_id"
_job("ing_usgs", "usgs_earthquakes", f"SELECT {_X}, 'earthquake' AS kind, {_CANCEL}, {_S} AS at, {_XY}, CAST(k AS VARCHAR) AS significance FROM o", "significance")
_job("ing_nws", "nws_alerts", f"SELECT {_X}, 'weather_alert' AS kind, CASE WHEN k % 10 = 0 THEN 'cancelled' WHEN k % 10 = 1 THEN 'updated' ELSE 'active' END AS status, {_S} AS at, CASE WHEN k % 4 <> 0 THEN {_RING['lon']} END AS lon, CASE WHEN k % 4 <> 0 THEN {_RING['lat']} END AS lat, 'LA,TX' AS state_codes, kind AS event_name, CASE WHEN k % 2 = 0 THEN 'Stay inside' END AS instruction, 'NWS' AS sender FROM o WHERE k % 9 <> 4", "state_codes", "event_name", "instruction", "sender")
_job("ing_sigmet", "noaa_aviation_weather", f"SELECT concat_ws(':', concat('x', event_id), 'SIGMET', '7', strftime(event_at, '%Y-%m-%dT%H:%M:%SZ')) AS record_id, 'aviation_hazard' AS kind, CASE WHEN date_trunc('second', expires_at) <= TIMESTAMP '{NOW}' THEN 'ended' ELSE 'active' END AS status, {_S} AS at, {_RING['lon']} AS lon, {_RING['lat']} AS lat, hazard_type, CAST(CAST(k * 100 AS DOUBLE) AS VARCHAR) AS altitude_high_1, CASE WHEN k % 2 = 0 THEN CAST(CAST(site AS DOUBLE) AS VARCHAR) END AS movement_speed, CASE WHEN date_trunc('second', expires_at) <= TIMESTAMP '{NOW}' THEN 'expired' WHEN date_trunc('second', event_at) > TIMESTAMP '{NOW}' THEN 'future' ELSE 'current' END AS validity_state FROM o WHERE date_trunc('second', expires_at) > date_trunc('second', event_at)", "hazard_type", "altitude_high_1", "movement_speed", "validity_state")
_job("ing_fema", "openfema_declarations", f"SELECT {_X}, 'disaster_declaration' AS kind, CASE WHEN k % 10 < 2 THEN 'ended' ELSE 'unknown' END AS status, {_S} AS at, {_NO}, 'TX' AS state_code, CASE WHEN event_id % 2 = 0 THEN 'DR' ELSE 'EM' END AS declaration_type, incident_type, coalesce(CASE WHEN event_id % 3 <> 0 THEN location_name END, 'Elm County') AS declared_area, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS ia_program_declared FROM o WHERE k % 9 <> 0", "state_code", "declaration_type", "incident_type", "declared_area", "ia_program_declared")
_job("ing_ndbc", "ndbc_observations", f"SELECT concat('X', event_id) AS record_id, 'marine_observation' AS kind, 'active' AS status, {_S} AS at, {_XY}, concat(CAST(k AS DOUBLE), ' kn') AS wind_speed, concat(CAST(k + 5 AS DOUBLE), ' kn') AS wind_gust, concat(CAST(site AS DOUBLE), ' ft') AS significant_wave_height, '7.0 s' AS dominant_wave_period, '4.5 s' AS average_wave_period, '9.0 nmi' AS visibility, '1.5 ft' AS tide, concat(CAST(site * 2 AS DOUBLE), ' °C') AS air_temperature, '15.5 °C' AS water_temperature, '4.4 °C' AS dew_point, '1012.5 hPa' AS atmospheric_pressure, '-1.2 hPa' AS pressure_tendency, concat(CAST(k % 360 AS DOUBLE), ' degrees') AS wind_direction, 'NE' AS wind_direction_cardinal, '200.0 degrees' AS mean_wave_direction, 'SSW' AS mean_wave_direction_cardinal, 'none seen' AS source_ice_cover FROM o", "wind_speed", "wind_gust", "significant_wave_height", "dominant_wave_period", "average_wave_period", "visibility", "tide", "air_temperature", "water_temperature", "dew_point", "atmospheric_pressure", "pressure_tendency", "wind_direction", "wind_direction_cardinal", "mean_wave_direction", "mean_wave_direction_cardinal", "source_ice_cover")
_job("ing_coops", "noaa_coops_water_levels", "SELECT concat_ws(':', event_id // 50, strftime(max(event_at), '%Y-%m-%d %H:%M')) AS record_id, 'water_level' AS kind, 'active' AS status, CAST(floor(epoch_us(max(event_at)) / 6e7) AS BIGINT) * 60 AS at, 2.5 AS lon, 1.5 AS lat FROM o GROUP BY event_id // 50")
_job("ing_fireball", "nasa_jpl_fireballs", f"SELECT concat_ws(':', strftime(event_at, '%Y-%m-%d %H:%M:%S'), event_id) AS record_id, 'fireball' AS kind, 'ended' AS status, {_S} AS at, {_XY}, CAST(k AS VARCHAR) AS velocity FROM o", "velocity")
_job("ing_nhc", "nhc_storms", f"SELECT {_X}, 'tropical_cyclone' AS kind, 'active' AS status, {_S} AS at, {_XY}, storm_name FROM o", "storm_name")
_job("ing_tsunami", "noaa_tsunami", f"SELECT {_X}, 'tsunami' AS kind, {_CANCEL}, {_S} AS at, {_XY}, concat(relation_candidate, 'S') AS relation_candidate FROM o", "relation_candidate")
_job("ing_gdacs", "gdacs", f"SELECT concat((['EQ','TC','VO','WF','FL'])[k % 6 + 1], ':', event_id) AS record_id, (['earthquake','tropical_cyclone','volcano','wildfire','disaster'])[k % 6 + 1] AS kind, {_ENDED}, {_S} AS at, {_XY}, 'JP' AS countries FROM o WHERE k % 6 < 5", "countries")
_job("ing_eonet", "nasa_eonet", f"SELECT {_X}, CASE WHEN k % 2 = 0 THEN 'wildfire' ELSE 'volcano' END AS kind, {_ENDED}, {_S} AS at, {_XY}, '2' AS history FROM o", "history")
_job("ing_volcano", "smithsonian_volcano", f"SELECT {_X}, 'volcano' AS kind, 'active' AS status, {_S} AS at, {_NO} FROM o")
_job("ing_kp", "noaa_space_weather", f"SELECT strftime(event_at, '%Y-%m-%d %H:%M:%S') AS record_id, 'space_weather' AS kind, 'active' AS status, {_S} AS at, {_NO}, '8' AS stations FROM o", "stations")
_job("ing_relief", "reliefweb_rss", f"SELECT {_X}, 'humanitarian_report' AS kind, 'active' AS status, {_S} AS at, {_NO}, 'OCHA' AS publisher FROM o", "publisher")


@query("ing_dispatch", "SELECT 'nhc_storms' AS provider_id, count(*) AS n FROM o UNION ALL SELECT 'reliefweb_rss', count(*) FROM o UNION ALL SELECT 'openfema_declarations', count(*) FILTER (k % 9 <> 0) FROM o")
def ing_dispatch(spark, sf_dir):
    """Bodies of three providers and of one that nobody knows, which strict dispatch would refuse."""
    o = observations(spark, sf_dir)
    landed = _build("nhc_storms", o).unionByName(_build("reliefweb_rss", o)).unionByName(_build("openfema_declarations", o)).unionByName(_build("other", o).withColumn("provider_id", F.lit("nobody")))
    return normalize(landed, strict=False).groupBy("provider_id").agg(F.count("*").alias("n"))


_DRIFT_SQL = "SELECT concat('prov_', event_id % 4) AS provider_id, CASE event_id % 4 WHEN 3 THEN 'unknown provider' ELSE CASE k % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'wrong root' ELSE 'unknown' END END AS problem, CASE WHEN event_id % 4 = 3 OR k % 10 < 2 THEN '' ELSE 'k' END AS field, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT concat('prov_', event_id % 4), 'missing', 'id', count(*) FROM o WHERE event_id % 4 < 3 AND k % 10 > 1 GROUP BY ALL UNION ALL SELECT 'nhc_storms', CASE k % 5 WHEN 0 THEN 'invalid record' WHEN 1 THEN 'unknown' ELSE 'missing' END, CASE k % 5 WHEN 0 THEN 'activeStorms' WHEN 1 THEN 'activeStorms.speed' ELSE 'activeStorms.name' END, count(*) FROM o WHERE k % 5 < 3 GROUP BY ALL"


@query("ing_drift", _DRIFT_SQL)
def ing_drift(spark, sf_dir):
    """Bodies that fit nobody, don't parse or have another root, fields too many or too few, and the same for records of a list."""
    o = observations(spark, sf_dir)
    body = F.when(C("k") % 10 == 0, F.lit('{"k": ')).when(C("k") % 10 == 1, F.lit("[1]")).otherwise(F.to_json(F.struct("k")))
    landed = o.select(F.concat(F.lit("prov_"), (C("event_id") % 4).cast("string")).alias("provider_id"), body.alias("body"))
    good = F.struct(_id().alias("id"), C("storm_name").alias("name"))
    record = F.when(C("k") % 5 == 0, F.lit("7")).when(C("k") % 5 == 1, F.to_json(F.struct(_id().alias("id"), C("storm_name").alias("name"), C("k").alias("speed")))).when(C("k") % 5 == 2, F.to_json(F.struct(_id().alias("id")))).otherwise(F.to_json(good))
    storms = payloads(o, "nhc_storms", record, '{"activeStorms":[', "]}").select("provider_id", "body")
    known = {f"prov_{k}": ("id",) for k in range(3)} | {"nhc_storms": ("activeStorms",)}
    return diagnostics(landed.unionByName(storms), known, {"nhc_storms": RECORDS["nhc_storms"]}).groupBy("provider_id", "problem", "field").agg(F.count("*").alias("n"))


# Panel scans


def feed(bodies):
    """Items of RSS bodies: (guid, ts, title, link, summary), the summary cut at 280 characters as a feed shows it."""
    r = items(bodies, "title string, description string, link string, pubDate string, guid string")
    at = F.coalesce(F.unix_seconds(rss_time(C("r.pubDate"))), F.lit(0))
    return r.where(F.trim("r.title") != "").select(C("r.guid").alias("guid"), at.alias("ts"), C("r.title").alias("title"), C("r.link").alias("link"), clean_markup(C("r.description"), 280).alias("summary"))


@query("scan_feed_items", f"SELECT concat('x', event_id) AS guid, {_S} AS ts, headline AS title, 'https://www.example.org/r' AS link, summary FROM o")
def scan_feed_items(spark, sf_dir):
    return feed(_build("reliefweb_rss", observations(spark, sf_dir)))


@query("scan_popular", f"SELECT * FROM (SELECT 'posts' AS list, concat('x', event_id) AS guid, {_S} AS ts, 'example' AS site FROM o WHERE event_type = 'view' ORDER BY ts DESC, guid LIMIT 25) UNION ALL SELECT * FROM (SELECT 'updates', concat('x', event_id) AS guid, {_S} AS ts, 'example' FROM o WHERE event_type <> 'view' ORDER BY ts DESC, guid LIMIT 40)")
def scan_popular(spark, sf_dir):
    """Two lists: the newest 25 of an Atom feed of posts, and the newest 40 of an RSS feed of updates."""
    o = observations(spark, sf_dir)
    entry = F.concat(F.lit("<entry>"), _tag("id", _id()), _tag("title", C("headline")), _tag("updated", _iso("event_at")), F.lit('<link href="https://www.example.org/p"/></entry>'))
    atom = items(payloads(o.where("event_type = 'view'"), "posts", entry, '<feed xmlns="a">', "</feed>", ""), "id string, title string, updated string, link struct<_href string>", "entry")
    posts = atom.select(C("r.id").alias("guid"), F.unix_seconds(rss_time(C("r.updated"))).alias("ts"), host_label(C("r.link._href")).alias("site"))
    updates = feed(_build("reliefweb_rss", o.where("event_type <> 'view'"))).select("guid", "ts", host_label(C("link")).alias("site"))
    top = lambda rows, name, n: rows.orderBy(F.desc("ts"), "guid").limit(n).select(F.lit(name).alias("list"), "guid", "ts", "site")
    return top(posts, "posts", 25).unionByName(top(updates, "updates", 40))


@query("scan_gdacs_rss", f"SELECT headline AS title, {_S} AS ts, CASE WHEN k % 3 = 0 THEN 'Green' ELSE 'Orange' END AS alert, CASE WHEN k % 5 = 4 THEN NULL ELSE round(slat, 2) END AS lat, CASE WHEN k % 5 = 4 THEN NULL ELSE round(slon, 2) END AS lon, event_id FROM o ORDER BY ts DESC, event_id LIMIT 60")
def scan_gdacs_rss(spark, sf_dir):
    """Disasters of an RSS feed: without an alert level Green, places from two tags or one point, the newest 60."""
    two = F.concat(_tag("geo:lat", C("slat")), _tag("geo:long", C("slon")))
    where = F.when(C("k") % 5 < 2, two).when(C("k") % 5 < 4, _tag("georss:point", F.concat_ws(" ", C("slat").cast("string"), C("slon").cast("string")))).otherwise(_tag("georss:point", F.lit("off the map")))
    x = F.concat(F.lit("<item>"), _tag("title", C("headline")), _tag("description", F.lit("&lt;i&gt;d&lt;/i&gt;")), _tag("guid", C("event_id")), _tag("pubDate", F.date_format("event_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), F.when(C("k") % 3 == 0, F.lit("")).otherwise(_tag("gdacs:alertlevel", F.lit("Orange"))), where, F.lit("</item>"))
    body = payloads(observations(spark, sf_dir), "gdacs_rss", x, '<rss xmlns:geo="g" xmlns:georss="r" xmlns:gdacs="d"><channel>', "</channel></rss>", "")
    r = items(body, "title string, description string, guid bigint, pubDate string, lat string, long string, point string, alertlevel string")
    point = F.split(F.trim("r.point"), r"\s+")
    number = lambda c, k: F.round(F.coalesce(c, F.get(point, k)).try_cast("double"), 2)
    lat, lon = number(C("r.lat"), 0), number(C("r.long"), 1)
    both = lat.isNotNull() & lon.isNotNull()
    d = r.where(F.trim("r.title") != "").select(C("r.title").alias("title"), F.coalesce(F.unix_seconds(rss_time(C("r.pubDate"))), F.lit(0)).alias("ts"), F.coalesce("r.alertlevel", F.lit("Green")).alias("alert"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), C("r.guid").alias("event_id"))
    return d.orderBy(F.desc("ts"), "event_id").limit(60)


@query("scan_filings", "SELECT concat('Filing ', event_id) AS title, strftime(event_at, '%Y-%m-%dT%H:%M:%SZ') AS updated, CASE k % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '10-Q' ELSE '' END AS form, concat('https://example.org/f/', event_id) AS link FROM o ORDER BY event_id LIMIT 40")
def scan_filings(spark, sf_dir):
    """Atom filings in feed order, the first 40: title, time, form type out of the category's term, link."""
    form = F.when(C("k") % 3 == 0, F.lit('<category label="form type" term="8-K"/>')).when(C("k") % 3 == 1, F.lit('<category label="form type" term="10-Q"/>')).otherwise(F.lit(""))
    x = F.concat(F.lit("<entry>"), _tag("title", F.concat(F.lit("Filing "), C("event_id").cast("string"))), _tag("updated", _iso("event_at")), form, F.lit('<link href="https://example.org/f/'), C("event_id").cast("string"), F.lit('"/></entry>'))
    r = items(payloads(observations(spark, sf_dir), "filings", x, '<feed xmlns="a">', "</feed>", "").withColumn("first", F.regexp_extract("body", "Filing ([0-9]+)", 1).cast("long")), "title string, updated string, category struct<_term string>, link struct<_href string>", "entry")
    top = r.orderBy("first", "place").limit(40)
    return top.select(C("r.title").alias("title"), C("r.updated").alias("updated"), F.coalesce("r.category._term", F.lit("")).alias("form"), C("r.link._href").alias("link"))


@query("scan_tsunami_rss", f"SELECT concat('x', event_id) AS id, {_S} AS ts FROM o WHERE k % 10 <> 0 ORDER BY ts DESC, id LIMIT 20")
def scan_tsunami_rss(spark, sf_dir):
    """Two feeds, cancellations out, the newest twenty."""
    o = observations(spark, sf_dir)
    both = [PROVIDERS["noaa_tsunami"](_build("noaa_tsunami", o.where(C("event_id") % 2 == k))) for k in (0, 1)]
    t = both[0].unionByName(both[1]).where(~F.lower("headline").contains("cancellation"))
    return t.select(C("record_id").alias("id"), F.unix_seconds("updated_at").alias("ts")).orderBy(F.desc("ts"), "id").limit(20)


@query("scan_volcano_rss", "SELECT event_id, headline AS title, CASE WHEN k % 4 <> 0 THEN round(slat, 2) END AS lat, CASE WHEN k % 4 <> 0 THEN round(slon, 2) END AS lon FROM o ORDER BY event_id LIMIT 30")
def scan_volcano_rss(spark, sf_dir):
    """Volcanoes of an RSS feed in its order, the first 30; their places are read out of the description."""
    said = F.when(C("k") % 4 == 0, F.lit("no place")).otherwise(F.concat(F.lit("&lt;p&gt;Latitude: "), C("slat").cast("string"), F.lit(" Longitude: "), C("slon").cast("string"), F.lit("&lt;/p&gt;")))
    x = F.concat(F.lit("<item>"), _tag("guid", C("event_id")), _tag("title", C("headline")), _tag("description", said), F.lit("</item>"))
    r = items(payloads(observations(spark, sf_dir), "volcanoes", x, "<rss><channel>", "</channel></rss>", ""), "guid bigint, title string, description string")
    number = lambda k: F.round(F.regexp_extract("r.description", r"Latitude: (-?\d+(?:\.\d+)?) Longitude: (-?\d+(?:\.\d+)?)", k).try_cast("double"), 2)
    return r.orderBy("r.guid").limit(30).select(C("r.guid").alias("event_id"), C("r.title").alias("title"), number(1).alias("lat"), number(2).alias("lon"))


FIRE_LINES, FIRE_ROWS = 4999, 1500


@query("scan_fire_csv", f"SELECT event_id AS line, round(slat, 2) AS lat, round(slon, 2) AS lon, CAST(k AS DOUBLE) AS frp, CASE WHEN k % 2 = 0 THEN 'n' ELSE 'h' END AS confidence FROM o WHERE k % 7 <> 0 AND k % 11 <> 0 AND event_id <= {FIRE_LINES} ORDER BY event_id LIMIT {FIRE_ROWS}".replace("event_id <= ", "event_id < "))
def scan_fire_csv(spark, sf_dir):
    """A fire file's lines in order, read by Spark's CSV parser: of the first 4999 short and uncastable ones go, and the first 1500 of the rest stay."""
    frp = F.when(C("k") % 7 == 0, "n/a").otherwise(C("k").cast("string"))
    rest = F.when(C("k") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(",2024-01-01,0101,"), F.when(C("k") % 2 == 0, "n").otherwise("h")))
    lines = observations(spark, sf_dir).select(C("event_id").alias("line"), F.concat(F.concat_ws(",", C("slat").cast("string"), C("slon").cast("string"), frp), rest).alias("text"))
    row = F.from_csv("text", F.lit("latitude string, longitude string, frp string, acq_date string, acq_time string, confidence string"))
    r = lines.where(C("line") < FIRE_LINES).select("line", row.alias("r")).where(C("r.confidence").isNotNull())
    number = lambda c: C(f"r.{c}").try_cast("double")
    r = r.select("line", F.round(number("latitude"), 2).alias("lat"), F.round(number("longitude"), 2).alias("lon"), number("frp").alias("frp"), C("r.confidence").alias("confidence")).dropna()
    return r.orderBy("line").limit(FIRE_ROWS)


@query("scan_eonet_points", f"SELECT concat('x', event_id) AS id, CASE WHEN k % 3 = 0 THEN {_RING['lon']} ELSE round(slon, 2) END AS lon, CASE WHEN k % 3 = 0 THEN {_RING['lat']} ELSE round(slat, 2) END AS lat, least(k % 5, 3) AS n_sources FROM o WHERE k % 10 <> 0")
def scan_eonet_points(spark, sf_dir):
    """Open events with the place of their last geometry, a point or the mean of a ring's vertices, and three of their sources at most."""
    s = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    shape = F.when(C("k") % 3 == 0, s(date=_iso("event_at"), type=F.lit("Polygon"), coordinates=F.to_json(_around()["coordinates"]))).otherwise(s(date=_iso("event_at"), type=F.lit("Point"), coordinates=F.to_json(F.array("slon", "slat"))))
    text_ = F.concat(F.lit('{"date":"'), shape["date"], F.lit('","type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}"))
    sources = F.transform(F.slice(F.sequence(F.lit(0), C("k") % 5), F.lit(2), F.lit(9)), lambda i: F.struct(i.cast("string").alias("id"), F.lit("https://example.org/e").alias("url")))
    event = F.concat(F.lit('{"id":"'), _id(), F.lit('","closed":'), F.when(C("k") % 10 == 0, F.lit('"2024-01-01T00:00:00Z"')).otherwise(F.lit("null")), F.lit(',"sources":'), F.to_json(sources), F.lit(',"geometry":[{"date":"2020-01-01T00:00:00Z","type":"Point","coordinates":[0,0]},'), text_, F.lit("]}"))
    r = payloads(observations(spark, sf_dir), "eonet", event, '{"events":[', "]}").select(F.explode(F.from_json("body", "events array<struct<id string, closed string, sources array<struct<id string, url string>>, geometry array<string>>>")["events"]).alias("r"))
    last = F.element_at("r.geometry", -1)
    return r.where("r.closed is null").select(C("r.id").alias("id"), F.round(centre(last, 0), 2).alias("lon"), F.round(centre(last, 1), 2).alias("lat"), F.size(F.slice("r.sources", 1, 3)).alias("n_sources"))


@query("scan_edits", "SELECT event_id, substr(concat(headline, repeat('.', k)), 1, 140) AS title, substr(concat(summary, repeat('-', k * 5)), 1, 500) AS comment, CASE WHEN event_type = 'view' THEN 'edit' ELSE 'new' END AS type, CASE WHEN k % 6 <> 0 THEN k * 1000 END AS size FROM o WHERE event_type IN ('view','click')")
def scan_edits(spark, sf_dir):
    """Edits of a stream of JSON lines: of types edit and new, texts and numbers within their bounds."""
    kind = F.when(C("event_type") == "view", "edit").when(C("event_type") == "click", "new").otherwise("log")
    size = F.when(C("k") % 6 == 0, F.lit(10**15)).otherwise(C("k") * 1000)
    o = observations(spark, sf_dir)
    lines = o.select(F.to_json(F.struct("event_id", F.concat("headline", F.expr("repeat('.', k)")).alias("title"), F.concat("summary", F.expr("repeat('-', k * 5)")).alias("comment"), kind.alias("type"), size.alias("size"))).alias("line"))
    # What a feed brings besides: lines cut short, lines that hold no record, and one record longer than a line may be.
    broken = o.where("event_id % 13 = 0").select(F.expr("substr(to_json(struct(event_id, headline AS title, 'edit' AS type)), 1, 20)").alias("line"))
    blank = o.where("event_id % 29 = 0").select(F.lit("[]").alias("line"))
    long = o.where("event_id = 1").select(F.expr(f"concat('{{\"event_id\":1,\"type\":\"edit\",\"title\":\"', repeat('x', {MOST_BYTES}), '\"}}')").alias("line"))
    landing = shared_folder(spark)
    lines.unionByName(broken).unionByName(blank).unionByName(long).write.text(landing)
    return run_available(edit_stream(spark, landing))


#: Bytes of a line of the edit feed; longer lines go. Files that a batch of the stream takes at most.
MOST_BYTES, FILES_EACH = 64 * 1024, 4


def edit_stream(spark, folder: str, files_each: int = FILES_EACH):
    """Edits of JSON lines that land in a folder, as a stream: a batch takes so many files, so a backlog is worked off in pieces."""
    return edits(spark.readStream.schema("line string").option("maxFilesPerTrigger", files_each).text(folder))


def edits(lines):
    """(event_id, title, comment, type, size) of lines, a table or a stream: titles of 140 characters, comments of 500, sizes up to a thousand million.

    Lines that are too long, aren't JSON, or have no event id are left out.
    """
    whole = lines.where(F.octet_length("line") <= MOST_BYTES)
    shape = "event_id bigint, title string, comment string, type string, size bigint, _corrupt_record string"
    r = whole.select(F.from_json("line", shape, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    r = r.where("_corrupt_record IS NULL AND event_id IS NOT NULL")
    return r.where(C("type").isin("edit", "new")).select("event_id", F.substring("title", 1, 140).alias("title"), F.substring("comment", 1, 500).alias("comment"), "type", F.when(F.abs("size") <= 10**9, C("size")).alias("size"))


@query("scan_market_assets", "SELECT 'asset' AS list, concat('A', p_partkey) AS symbol, round(p_retailprice, 2) AS price, round(p_size / 10.0 - 2, 2) AS pct FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) UNION ALL SELECT 'pair', CASE WHEN n_nationkey = 12 THEN 'USD/JPY' ELSE concat('C', n_nationkey, '/USD') END, round(CASE WHEN n_nationkey = 12 THEN 1.0 + n_nationkey ELSE 1 / (1.0 + n_nationkey) END, 6), NULL FROM nation WHERE n_nationkey % 5 <> 4")
def scan_market_assets(spark, sf_dir):
    """Assets of a JSON list with price and change over a day, the dearest thirty; rates against the dollar turned round, but for the yen's."""
    one = F.to_json(F.struct(F.concat(F.lit("A"), C("p_partkey").cast("string")).alias("symbol"), C("p_partkey").alias("rank"), F.struct(F.struct(C("p_retailprice").alias("price"), F.round(C("p_size") / 10 - 2, 2).alias("percent_change_24h")).alias("USD")).alias("quotes")))
    assets = table(spark, sf_dir, "part").select(F.from_json(one, "symbol string, rank bigint, quotes struct<USD: struct<price: double, percent_change_24h: double>>").alias("a"))
    top = assets.orderBy(F.desc("a.quotes.USD.price"), "a.rank").limit(30).select(F.lit("asset").alias("list"), C("a.symbol").alias("symbol"), F.round("a.quotes.USD.price", 2).alias("price"), F.round("a.quotes.USD.percent_change_24h", 2).alias("pct"))
    code = F.when(C("n_nationkey") == 12, "JPY").otherwise(F.concat(F.lit("C"), C("n_nationkey").cast("string")))
    body = F.to_json(F.create_map(code, F.when(C("n_nationkey") % 5 != 4, (C("n_nationkey") + 1).cast("double"))))
    rates = table(spark, sf_dir, "nation").select(F.explode(F.from_json(body, "map<string, double>")).alias("code", "rate")).where("rate > 0")
    yen = C("code") == "JPY"
    pairs = rates.select(F.lit("pair").alias("list"), F.when(yen, "USD/JPY").otherwise(F.concat("code", F.lit("/USD"))).alias("symbol"), F.round(F.when(yen, C("rate")).otherwise(1 / C("rate")), 6).alias("price"), F.lit(None).cast("double").alias("pct"))
    return top.unionByName(pairs)


@query("scan_dev_events", "SELECT event_id, CASE event_type WHEN 'click' THEN 'pushed to' WHEN 'view' THEN 'starred' WHEN 'signup' THEN 'forked' ELSE 'acted on' END AS verb, concat('user', user_id) AS actor, concat('org/repo', k) AS repo FROM o ORDER BY event_id DESC LIMIT 30")
def scan_dev_events(spark, sf_dir):
    """Code-hosting events of JSON bodies: a verb for each type, who and where, the newest thirty."""
    verbs = F.create_map(*map(F.lit, ("PushEvent", "pushed to", "WatchEvent", "starred", "ForkEvent", "forked")))
    kind = F.when(C("event_type") == "click", "PushEvent").when(C("event_type") == "view", "WatchEvent").when(C("event_type") == "signup", "ForkEvent").otherwise("OddEvent")
    s = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    item = _json(id=C("event_id").cast("string"), type=kind, actor=s(login=F.concat(F.lit("user"), C("user_id").cast("string"))), repo=s(name=F.concat(F.lit("org/repo"), C("k").cast("string"))))
    body = payloads(observations(spark, sf_dir), "dev", item, "[", "]")
    e = body.select(F.explode(F.from_json("body", "array<struct<id: string, type: string, actor: struct<login: string>, repo: struct<name: string>>>")).alias("e"))
    top = e.select(C("e.id").cast("long").alias("event_id"), "e").orderBy(F.desc("event_id")).limit(30)
    return top.select("event_id", F.coalesce(F.try_element_at(verbs, C("e.type")), F.lit("acted on")).alias("verb"), C("e.actor.login").alias("actor"), C("e.repo.name").alias("repo"))


@query("scan_aircraft", "SELECT event_id, trim(storm_name) AS callsign, round(slon, 2) AS lon, round(slat, 2) AS lat, CAST(CASE WHEN k % 4 <> 0 THEN k * 10 WHEN k % 8 = 0 THEN k * 10 + 5 END AS DOUBLE) AS altitude, CAST(coalesce(CASE WHEN k % 3 <> 0 THEN k END, CASE WHEN k % 2 = 0 THEN site END, 0) AS DOUBLE) AS heading FROM o WHERE k % 5 <> 0 ORDER BY event_id LIMIT 250")
def scan_aircraft(spark, sf_dir):
    """State vectors of a JSON matrix: those with a place; altitude by pressure, else geometric; heading the track, else the true heading, else 0; the first 250."""
    text_ = lambda c: c.cast("string")
    cells = (
        text_(C("event_id")), F.concat(F.lit(" "), "storm_name", F.lit("  ")), F.when(C("k") % 5 != 0, text_(C("slon"))), F.when(C("k") % 5 != 0, text_(C("slat"))),
        F.when(C("k") % 4 != 0, text_(C("k") * 10)), F.when(C("k") % 8 == 0, text_(C("k") * 10 + 5)), F.when(C("k") % 3 != 0, text_(C("k"))), F.when(C("k") % 2 == 0, text_(C("site"))),
    )
    row = F.concat(F.lit("["), F.array_join(F.array(*(F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null")) for x in cells)), ","), F.lit("]"))
    body = payloads(observations(spark, sf_dir), "aircraft", row, '{"states":[', "]}")
    v = body.select(F.explode(F.from_json("body", "states array<array<string>>")["states"]).alias("v"))
    at = lambda k: F.get("v", k).try_cast("double")
    r = v.where(at(2).isNotNull() & at(3).isNotNull()).withColumn("event_id", F.get("v", 0).cast("long")).orderBy("event_id").limit(250)
    return r.select("event_id", F.trim(F.get("v", 1)).alias("callsign"), F.round(at(2), 2).alias("lon"), F.round(at(3), 2).alias("lat"), F.coalesce(at(4), at(5)).alias("altitude"), F.coalesce(at(6), at(7), F.lit(0.0)).alias("heading"))


STATIONS_LEAST = 300


def station_catalogue(lines, least: int = STATIONS_LEAST):
    """Stations of JSON lines(line): whole records in range only, ids once. A catalogue of fewer than `least` is an error when it is read."""
    r = lines.select(F.from_json("line", "id string, name string, lat double, lng double, greatlakes boolean").alias("r")).select("r.*")
    good = C("id").rlike("^[A-Za-z0-9]+$") & (F.trim("name") != "") & C("lat").between(-90, 90) & C("lng").between(-180, 180)
    s = r.where(good).groupBy("id").agg(F.min(F.struct(F.trim("name").alias("name"), "lat", "lng", F.coalesce("greatlakes", F.lit(False)).alias("lakes"))).alias("s")).select("id", "s.*")
    n = F.broadcast(s.agg(F.count("*").alias("n_stations")))  # one row
    return s.crossJoin(n).where(F.when(C("n_stations") >= least, True).otherwise(F.raise_error(F.lit("the station catalogue is too short")))).drop("n_stations")


@query("scan_stations", "SELECT concat('c', c_custkey) AS id, trim(c_name) AS name, c_nationkey IN (3, 24) AS lakes FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT concat('p', p_partkey), trim(p_name), false FROM part WHERE p_partkey % 9 <> 0")
def scan_stations(spark, sf_dir):
    """Customers and parts as a catalogue's JSON lines, some of them out of range, all of them twice."""
    line = lambda key, name, lakes, sign: F.to_json(F.struct(F.concat(F.lit(sign), C(key).cast("string")).alias("id"), C(name).alias("name"), F.when(C(key) % 9 == 0, 99.0).otherwise(10.0).alias("lat"), F.lit(20.0).alias("lng"), lakes.alias("greatlakes"))).alias("line")
    c = table(spark, sf_dir, "customer").select(line("c_custkey", "c_name", C("c_nationkey").isin(3, 24), "c"))
    c = c.unionByName(table(spark, sf_dir, "part").select(line("p_partkey", "p_name", F.lit(False), "p")))
    return station_catalogue(c.unionByName(c)).select("id", "name", "lakes")


@query("scan_registry", "SELECT concat('provider_', n_nationkey) AS id, n_name AS name, concat('https://example.org/', n_nationkey) AS docs, n_regionkey * 60 AS refresh_seconds, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS overview FROM nation WHERE n_nationkey % 6 <> 5 ORDER BY id LIMIT 100")
def scan_registry(spark, sf_dir):
    """A registry's JSON list: providers that are switched on, with what is public of them, and whether they are in the overview; by id, a hundred at most."""
    in_view = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("provider_"), C("s_nationkey").cast("string")).alias("id")).distinct().withColumn("overview", F.lit(True))
    one = F.struct(F.concat(F.lit("provider_"), C("n_nationkey").cast("string")).alias("id"), C("n_name").alias("name"), F.concat(F.lit("https://example.org/"), C("n_nationkey").cast("string")).alias("docs"), (C("n_regionkey") * 60).alias("refresh_seconds"), F.lit("secret").alias("key_name"), (C("n_nationkey") % 6 != 5).alias("enabled"))
    doc = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(one).alias("providers"))).alias("body"))
    p = doc.select(F.explode(F.from_json("body", "providers array<struct<id: string, name: string, docs: string, refresh_seconds: int, enabled: boolean>>")["providers"]).alias("p")).select("p.*").where("enabled")
    return p.join(in_view, "id", "left").select("id", "name", "docs", "refresh_seconds", F.coalesce("overview", F.lit(False)).alias("overview")).orderBy("id").limit(100)
