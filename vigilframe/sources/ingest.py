"""Ingestion jobs: landed payloads to observations and drift diagnostics, one DataFrame function for each provider.

All take payloads(provider_id, body, ingested_at) and give rows of OBSERVATION. One bad record never drops the others:
what doesn't parse or lacks its key leaves no row here and a row in diagnostics().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import clean_markup, safe_url, unescaped
from ..functions.times import epoch_ms, provider_utc, rfc3339, rss_time

C = F.col
#: Columns of every job's result; metrics are texts by key.
OBSERVATION = ("provider_id", "record_id", "kind", "headline", "summary", "status", "severity", "urgency", "certainty", "event_at", "effective_at", "updated_at", "expires_at", "geometry", "lon", "lat", "location_name", "metrics", "source_url", "ingested_at")
_TYPES = {"event_at": "timestamp", "effective_at": "timestamp", "updated_at": "timestamp", "expires_at": "timestamp", "lon": "double", "lat": "double", "metrics": "map<string,string>"}
_DEFAULTS = {"status": "active", "severity": "Unknown", "urgency": "Unknown", "certainty": "Unknown"}
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_provider(provider_id: str):
    """Adds fn(payloads) -> observations under an id; the extension point for further providers."""

    def put(fn):
        PROVIDERS[provider_id] = fn
        return fn

    return put


def observation(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Projects to OBSERVATION: named columns as given, ranks Unknown where the source has none, rows without a record id out."""
    out = []
    for name in OBSERVATION:
        c = columns.get(name, C(name) if name in ("provider_id", "ingested_at") else F.lit(_DEFAULTS.get(name)))
        c = F.lit(c) if isinstance(c, str) else c
        out.append(c.cast(_TYPES.get(name, "timestamp" if name == "ingested_at" else "string")).alias(name))
    return df.select(*out).where(C("record_id").isNotNull() & (F.trim("record_id") != ""))


def metrics(**values: Column) -> Column:
    """Map of the metrics that are there."""
    pairs = F.map_from_entries(F.array(*(F.struct(F.lit(k), v.cast("string")) for k, v in values.items())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _each(payloads: DataFrame, schema: str, path: str, alias: str = "r") -> DataFrame:
    parsed = payloads.withColumn("doc", F.from_json("body", schema))
    return parsed.select("*", F.explode(f"doc.{path}").alias(alias))


def centre(shape: Column, k: int) -> Column:
    """Longitude (0) or latitude (1) of the middle of a GeoJSON geometry given as text; null if it isn't a valid one."""
    kind, coordinates = F.get_json_object(shape, "$.type"), F.get_json_object(shape, "$.coordinates")
    return F.when(geometry.valid(kind, coordinates), geometry.centroid(geometry.points(kind, coordinates), k))


def placed(shape: Column) -> dict[str, Column]:
    """A record's geometry, where it is a valid one, and its middle."""
    kind, coordinates = F.get_json_object(shape, "$.type"), F.get_json_object(shape, "$.coordinates")
    return {"geometry": F.when(geometry.valid(kind, coordinates), shape), "lon": centre(shape, 0), "lat": centre(shape, 1)}


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty: a field under one of its names."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


@register_provider("usgs_earthquakes")
def usgs(p: DataFrame) -> DataFrame:
    r = _each(p, "features array<struct<id string, geometry struct<coordinates array<double>>, properties struct<mag double, place string, title string, time bigint, updated bigint, url string, status string, tsunami int, sig int>>>", "features")
    q, xyz = C("r.properties"), C("r.geometry.coordinates")
    return observation(
        r, record_id=C("r.id"), kind="earthquake", headline=F.coalesce(q["title"], q["place"]), summary=q["place"], status=F.when(q["status"] == "deleted", "cancelled").otherwise("active"), event_at=epoch_ms(q["time"]), updated_at=epoch_ms(q["updated"]),
        lon=F.get(xyz, 0), lat=F.get(xyz, 1), metrics=metrics(magnitude=q["mag"], depth=F.get(xyz, 2), tsunami_flag=q["tsunami"], significance=q["sig"]), source_url=safe_url(q["url"]),
    )


@register_provider("nws_alerts")
def nws(p: DataFrame) -> DataFrame:
    fields = "id string, event string, headline string, description string, instruction string, messageType string, severity string, urgency string, certainty string, onset string, effective string, expires string, sent string, areaDesc string, senderName string, geocode struct<UGC array<string>>"
    q = C("r.properties")
    states = F.array_sort(F.array_distinct(F.transform(F.filter(q["geocode"]["UGC"], lambda u: u.rlike("^[A-Z]{2}[CZ][0-9]{3}$")), lambda u: F.substring(u, 1, 2))))
    known = lambda c, *v: F.when(c.isin(*v), c).otherwise("Unknown")
    r = _each(p, f"features array<struct<id string, geometry string, properties struct<{fields}>>>", "features")
    r = r.where(first_filled(q["event"]).isNotNull() & first_filled(q["headline"]).isNotNull())
    told = F.nullif(clean_markup(q["instruction"], 1500), F.lit(""))
    said = F.substring(F.trim(F.concat(F.coalesce(clean_markup(q["description"]), F.lit("")), F.coalesce(F.concat(F.lit("\n\nInstructions: "), told), F.lit("")))), 1, 4000)
    return observation(
        r, record_id=F.coalesce(q["id"], C("r.id")), kind="weather_alert", headline=F.substring(q["headline"], 1, 300), summary=said, **placed(C("r.geometry")), location_name=F.substring(q["areaDesc"], 1, 300), source_url=safe_url(C("r.id")),
        status=F.when(q["messageType"] == "Cancel", "cancelled").when(q["messageType"] == "Update", "updated").otherwise("active"), severity=known(q["severity"], "Extreme", "Severe", "Moderate", "Minor"), urgency=known(q["urgency"], "Immediate", "Expected", "Future", "Past"), certainty=known(q["certainty"], "Observed", "Likely", "Possible", "Unlikely"),
        event_at=rfc3339(q["onset"]), effective_at=rfc3339(q["effective"]), updated_at=rfc3339(q["sent"]), expires_at=rfc3339(q["expires"]), metrics=metrics(event_name=q["event"], state_codes=F.nullif(F.array_join(states, ","), F.lit("")), affected_area=q["areaDesc"], instruction=F.when(F.length(told) <= 500, told), sender=F.nullif(q["senderName"], F.lit(""))),
    )


@register_provider("noaa_aviation_weather")
def sigmet(p: DataFrame) -> DataFrame:
    """Advisories: the key's parts, the window and a geometry are needed; the source's own severity stays a metric."""
    numbers = {"source_severity": "severity", "altitude_high_1": "altitudeHi1", "altitude_high_2": "altitudeHi2", "altitude_low_1": "altitudeLow1", "altitude_low_2": "altitudeLow2", "movement_direction": "movementDir", "movement_speed": "movementSpd"}
    fields = ", ".join(f"{v} double" for v in numbers.values())
    r = _each(p, f"features array<struct<geometry string, properties struct<icaoId string, airSigmetType string, alphaChar string, hazard string, seriesId string, validTimeFrom string, validTimeTo string, rawAirSigmet string, {fields}>>>", "features")
    q = C("r.properties")
    r = once(r, span=F.struct(provider_utc(q["validTimeFrom"]).alias("since"), provider_utc(q["validTimeTo"]).alias("until")))
    since, until = C("span.since"), C("span.until")
    needed = [first_filled(q[n]).isNotNull() for n in ("airSigmetType", "hazard", "seriesId", "validTimeFrom", "validTimeTo")]
    r = r.where(reduce(Column.__and__, needed) & C("r.geometry").isNotNull() & since.isNotNull() & until.isNotNull() & (until > since))
    state = F.when(C("ingested_at") >= until, "expired").when(C("ingested_at") < since, "future").otherwise("current")
    return observation(
        r, record_id=F.concat_ws(":", F.nullif(q["icaoId"], F.lit("")), q["airSigmetType"], q["seriesId"], q["validTimeFrom"]), kind="aviation_hazard", headline=F.concat_ws(" ", F.trim(q["hazard"]), F.trim(q["airSigmetType"]), F.trim(q["seriesId"])), summary=clean_markup(q["rawAirSigmet"]),
        status=F.when(state == "expired", "ended").otherwise("active"), effective_at=since, expires_at=until, **placed(C("r.geometry")), location_name=q["icaoId"], source_url="https://aviationweather.gov/sigmet",
        metrics=metrics(hazard_type=F.trim(q["hazard"]), advisory_type=q["airSigmetType"], series_id=q["seriesId"], validity_state=state, icao_id=F.nullif(q["icaoId"], F.lit("")), alpha_character=F.nullif(q["alphaChar"], F.lit("")), **{k: q[v] for k, v in numbers.items()}),
    )


@register_provider("openfema_declarations")
def fema(p: DataFrame) -> DataFrame:
    """Declarations. Some fields go by either of two names; the first that is filled holds. Without a closing date the status is unknown."""
    texts = "id disasterNumber state declarationType disasterType declarationDate incidentType declarationTitle title incidentBeginDate incidentEndDate disasterCloseoutDate designatedArea declaredCountyArea lastRefresh lastIAFilingDate placeCode fipsStateCode fipsCountyCode fyDeclared".split()
    flags = {"ih_program_declared": "ihProgramDeclared", "ia_program_declared": "iaProgramDeclared", "pa_program_declared": "paProgramDeclared", "hm_program_declared": "hmProgramDeclared", "tribal_request": "tribalRequest"}
    each = p.select("*", F.explode(F.from_json("body", "DisasterDeclarationsSummaries array<string>")["DisasterDeclarationsSummaries"]).alias("record"))
    r = each.withColumn("r", F.from_json("record", f"{', '.join(f'{n} string' for n in texts)}, {', '.join(f'{n} boolean' for n in flags.values())}"))
    q = C("r")
    kind, title, area, closed = first_filled(q["declarationType"], q["disasterType"]), first_filled(q["declarationTitle"], q["title"]), first_filled(q["designatedArea"], q["declaredCountyArea"]), first_filled(q["disasterCloseoutDate"], F.get_json_object("record", "$.disasterCloseOutDate"))
    declared = provider_utc(q["declarationDate"])
    needed = [c.isNotNull() for c in (first_filled(q["id"]), kind, title, first_filled(q["incidentType"]), declared)]
    r = r.where(reduce(Column.__and__, needed) & q["state"].rlike("^[A-Za-z]{2}$") & q["disasterNumber"].rlike("^[0-9]+$"))
    state = F.upper(q["state"])
    where = F.concat_ws(", ", area, state)
    iso = lambda c: F.date_format(provider_utc(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return observation(
        r, record_id=q["id"], kind="disaster_declaration", headline=F.substring(title, 1, 300), summary=F.format_string("FEMA %s declaration %s for %s. Incident type: %s.", kind, q["disasterNumber"], where, q["incidentType"]),
        status=F.when(provider_utc(closed).isNotNull(), "ended").otherwise("unknown"), effective_at=declared, updated_at=provider_utc(q["lastRefresh"]), location_name=where, source_url=F.concat(F.lit("https://www.fema.gov/disaster/"), q["disasterNumber"]),
        metrics=metrics(
            disaster_number=q["disasterNumber"], declaration_type=kind, incident_type=q["incidentType"], state_code=state, declared_area=area, declaration_date=iso(q["declarationDate"]), incident_begin=iso(q["incidentBeginDate"]), incident_end=iso(q["incidentEndDate"]), last_refresh=iso(q["lastRefresh"]),
            last_ia_filing_date=iso(q["lastIAFilingDate"]), place_code=q["placeCode"], fips_state_code=q["fipsStateCode"], fips_county_code=q["fipsCountyCode"], fiscal_year=q["fyDeclared"], **{k: q[v] for k, v in flags.items()},
        ),
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns worked out once a row: as a generator's output they are not worked out anew for each later use, nor in a filter moved before them."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def items(p: DataFrame, schema: str, tag: str = "item") -> DataFrame:
    """Rows of an XML feed's items or entries, whatever stands around them."""
    # What stands in CDATA or a comment is text, so an item's end inside it doesn't end the item.
    parts = F.regexp_extract_all("body", F.lit(f"(?s)<{tag}[ >](?:<!\\[CDATA\\[.*?\\]\\]>|<!--.*?-->|.)*?</{tag}>"), F.lit(0))
    rows = p.select("*", F.posexplode(parts).alias("place", "xml"))
    bare = F.regexp_replace(F.regexp_replace("xml", r"<(/?)[A-Za-z][\w.-]*:", "<$1"), r'\sxmlns(:\w+)?="[^"]*"', "")
    return once(rows, r=F.from_xml(bare, schema, {"rowTag": tag, "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"}))


def _point(c: Column, k: int) -> Column:
    """From "lat lon": 0 is the latitude."""
    return F.get(F.split(F.trim(c), r"[\s,]+"), k).try_cast("double")


#: A buoy report's labels, the metrics they become, the pattern of the number and its unit.
_READINGS = {
    "Wind Speed": ("wind_speed", r"(-?\d+(?:\.\d+)?)\s*knots?", "kn"),
    "Wind Gust": ("wind_gust", r"(-?\d+(?:\.\d+)?)\s*knots?", "kn"),
    "Significant Wave Height": ("significant_wave_height", r"(-?\d+(?:\.\d+)?)\s*ft", "ft"),
    "Dominant Wave Period": ("dominant_wave_period", r"(-?\d+(?:\.\d+)?)\s*sec", "s"),
    "Average Period": ("average_wave_period", r"(-?\d+(?:\.\d+)?)\s*sec", "s"),
    "Visibility": ("visibility", r"(-?\d+(?:\.\d+)?)\s*(?:nmi|nautical miles?)", "nmi"),
    "Tide": ("tide", r"(-?\d+(?:\.\d+)?)\s*ft", "ft"),
    "Air Temperature": ("air_temperature", r"\((-?\d+(?:\.\d+)?)\s*°C\)", "°C"),
    "Water Temperature": ("water_temperature", r"\((-?\d+(?:\.\d+)?)\s*°C\)", "°C"),
    "Dew Point": ("dew_point", r"\((-?\d+(?:\.\d+)?)\s*°C\)", "°C"),
    "Atmospheric Pressure": ("atmospheric_pressure", r"\((-?\d+(?:\.\d+)?)\s*mb\)", "hPa"),
    "Pressure Tendency": ("pressure_tendency", r"\((-?\d+(?:\.\d+)?)\s*mb\)", "hPa"),
    "Wind Direction": ("wind_direction", r"\((-?\d+(?:\.\d+)?)°\)", "degrees"),
    "Mean Wave Direction": ("mean_wave_direction", r"\((-?\d+(?:\.\d+)?)°\)", "degrees"),
}
_POINTED = ("Wind Direction", "Mean Wave Direction")


@register_provider("ndbc_observations")
def ndbc(p: DataFrame) -> DataFrame:
    """Buoy reports: known labels become numbers with their units ("12.0 kn"), directions their compass points too; other labels stay as text."""
    r = items(p, "title string, description string, link string, guid string, point string")
    station = F.upper(F.regexp_extract("r.guid", r"^NDBC-([A-Za-z0-9]+)-\d{14}$", 1))
    at = F.try_to_timestamp(F.regexp_extract("r.guid", r"-(\d{14})$", 1), F.lit("yyyyMMddHHmmss"))
    r = once(r, here=F.struct(station.alias("station"), at.alias("at"), _point(C("r.point"), 0).alias("lat"), _point(C("r.point"), 1).alias("lon")))
    station, at, lat, lon = (C(f"here.{x}") for x in ("station", "at", "lat", "lon"))
    whole = (station != "") & first_filled(C("r.title")).isNotNull() & at.isNotNull() & lat.isNotNull() & lon.isNotNull()
    r = once(r.where(whole), said=unescaped(C("r.description")))
    said = C("said")
    pair = r"(?is)<(?:b|strong)>\s*([^<:]+):\s*</(?:b|strong)>\s*(.*?)(?=<br\s*/?>|$)"
    names, values = (F.regexp_extract_all(said, F.lit(pair), F.lit(k)) for k in (1, 2))
    fields = F.map_from_arrays(F.transform(names, lambda x: clean_markup(x, 100)), F.transform(values, lambda x: clean_markup(x, 500)))
    r = once(r, fields=fields)
    of = lambda label: F.coalesce(C("fields")[label], F.lit(""))
    known = {}
    for label, (key, pattern, unit) in _READINGS.items():
        number = F.regexp_extract(of(label), "(?i)" + pattern, 1)
        known[key] = F.when(number != "", F.concat_ws(" ", number.cast("double").cast("string"), F.lit(unit)))
        if label in _POINTED:
            known[f"{key}_cardinal"] = F.nullif(F.regexp_extract(of(label), "^([A-Z]+)", 1), F.lit(""))
    other = F.map_filter("fields", lambda k, v: ~k.isin(*_READINGS, "Location") & (v != ""))
    slug = lambda k: F.concat(F.lit("source_"), F.substring(F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_|_$", ""), 1, 48))
    stable = F.regexp_replace(said, r"(?is)<(?:b|strong)>\s*Location:\s*</(?:b|strong)>.*?(?=<br\s*/?>|$)", "")
    told = F.map_concat(metrics(station_id=station, source_record_id=C("r.guid"), **known), F.transform_keys(other, lambda k, _: slug(k)))
    return observation(r, record_id=station, kind="marine_observation", headline=F.substring("r.title", 1, 300), summary=clean_markup(stable), event_at=at, updated_at=at, lat=lat, lon=lon, location_name=C("r.title"), metrics=told, source_url=safe_url(C("r.link")))


@register_provider("noaa_coops_water_levels")
def coops(p: DataFrame) -> DataFrame:
    """The latest row of each body, with its distance from the prediction for the same time."""
    doc = F.from_json("body", "metadata struct<id string, name string, lat string, lon string>, data array<struct<t string, v string>>, predictions array<struct<t string, v string>>")
    d = p.withColumn("doc", doc)
    last = F.element_at(F.array_sort(F.filter("doc.data", lambda x: x["v"].try_cast("double").isNotNull())), -1)
    d = d.where(F.size("doc.data") > 0).withColumn("x", last).where(C("x").isNotNull())
    said = F.get(F.filter("doc.predictions", lambda y: y["t"] == C("x.t")), 0)["v"].try_cast("double")
    at = provider_utc(C("x.t"))
    return observation(
        d, record_id=F.concat_ws(":", "doc.metadata.id", "x.t"), kind="water_level", headline=F.concat(F.lit("Water level at "), "doc.metadata.name"), event_at=at, lat=_number(C("doc.metadata.lat")), lon=_number(C("doc.metadata.lon")),
        metrics=metrics(water_level=C("x.v"), prediction=said, anomaly=F.round(C("x.v").try_cast("double") - said, 4)),
    )


@register_provider("nasa_jpl_fireballs")
def fireball(p: DataFrame) -> DataFrame:
    d = p.withColumn("doc", F.from_json("body", "signature struct<version string>, count string, fields array<string>, data array<array<string>>"))
    d = d.where((C("doc.signature.version") == "1.2") & (F.size("doc.data") == C("doc.count").try_cast("int")))
    r = d.select("*", F.explode(F.filter("doc.data", lambda x: F.size(x) == F.size("doc.fields"))).alias("row")).withColumn("m", F.map_from_arrays("doc.fields", "row"))
    signed = lambda v, way, less: F.when(C("m")[way] == less, -_number(C("m")[v])).otherwise(_number(C("m")[v]))
    return observation(r, record_id=F.concat_ws(":", C("m")["date"], C("m")["energy"]), kind="fireball", headline="Fireball", status="ended", event_at=provider_utc(C("m")["date"]), lat=signed("lat", "lat-dir", "S"), lon=signed("lon", "lon-dir", "W"), metrics=metrics(energy=C("m")["energy"], impact_energy=C("m")["impact-e"], altitude=C("m")["alt"], velocity=C("m")["vel"]))


@register_provider("nhc_storms")
def nhc(p: DataFrame) -> DataFrame:
    r = _each(p, "activeStorms array<struct<id string, name string, classification string, intensity string, pressure string, latitude_numeric double, longitude_numeric double, movementDir string, movementSpeed string, lastUpdate string, publicAdvisory struct<url string>>>", "activeStorms")
    q, at = C("r"), rfc3339(C("r.lastUpdate"))
    return observation(r, record_id=q["id"], kind="tropical_cyclone", headline=F.concat_ws(" ", q["classification"], q["name"]), effective_at=at, updated_at=at, lon=q["longitude_numeric"], lat=q["latitude_numeric"], metrics=metrics(storm_name=q["name"], intensity=q["intensity"], pressure=q["pressure"], movement_direction=q["movementDir"], movement_speed=q["movementSpeed"]), source_url=safe_url(q["publicAdvisory"]["url"]))


_ENTRY = "id string, title string, summary string, updated string, point string, link struct<_href string>"


@register_provider("noaa_tsunami")
def tsunami(p: DataFrame) -> DataFrame:
    r = items(p, _ENTRY, "entry")
    said = F.lower(F.concat_ws(" ", "r.title", "r.summary"))
    href = C("r.link._href")
    series = F.regexp_replace(F.regexp_extract(F.coalesce(href, C("r.id")), r"([^/]+)/?$", 1), r"[-.]?\d+$", "")
    centre = F.when(F.coalesce(C("r.id"), href).rlike("(?i)paaq|ntwc"), "NTWC").when(F.coalesce(C("r.id"), href).rlike("(?i)phe?b|ptwc"), "PTWC")
    return observation(r, record_id=C("r.id"), kind="tsunami", headline=C("r.title"), summary=clean_markup(C("r.summary")), status=F.when(F.contains(said, F.lit("cancel")), "cancelled").otherwise("active"), updated_at=rfc3339(C("r.updated")), lat=_point(C("r.point"), 0), lon=_point(C("r.point"), 1), metrics=metrics(relation_candidate=F.nullif(series, F.lit("")), centre=centre), source_url=safe_url(href))


_GDACS = {"EQ": "earthquake", "TC": "tropical_cyclone", "VO": "volcano", "WF": "wildfire", "FL": "disaster", "DR": "disaster"}


@register_provider("gdacs")
def gdacs(p: DataFrame) -> DataFrame:
    r = _each(p, "features array<struct<geometry struct<coordinates array<double>>, properties struct<eventtype string, eventid string, name string, description string, alertlevel string, affectedcountries array<struct<iso2 string>>, iscurrent string, fromdate string, todate string, datemodified string, population string>>>", "features")
    q = C("r.properties")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in _GDACS.items() for x in kv)), q["eventtype"])
    countries = F.array_join(F.array_distinct(F.filter(q["affectedcountries"]["iso2"], lambda x: F.length(x) == 2)), ",")
    return observation(
        r.where(q["eventtype"].isin(*_GDACS)), record_id=F.concat_ws(":", q["eventtype"], q["eventid"]), kind=kind, headline=q["name"], summary=clean_markup(q["description"]), status=F.when(F.lower(q["iscurrent"]) == "false", "ended").otherwise("active"), event_at=provider_utc(q["fromdate"]), updated_at=provider_utc(q["datemodified"]), expires_at=provider_utc(q["todate"]),
        lon=F.get(C("r.geometry.coordinates"), 0), lat=F.get(C("r.geometry.coordinates"), 1), metrics=metrics(alert_level=q["alertlevel"], population=q["population"], countries=F.nullif(countries, F.lit(""))),
    )


_EONET = {"wildfires": "wildfire", "volcanoes": "volcano", "severeStorms": "natural_event", "earthquakes": "earthquake", "floods": "natural_event", "seaLakeIce": "natural_event"}


@register_provider("nasa_eonet")
def eonet(p: DataFrame) -> DataFrame:
    r = _each(p, "events array<struct<id string, title string, closed string, categories array<struct<id string>>, sources array<struct<id string, url string>>, geometry array<struct<date string, type string, coordinates string, magnitudeValue double, magnitudeUnit string>>>>", "events")
    q, last = C("r"), F.try_element_at("r.geometry", F.lit(-1))
    mapped = F.filter(F.transform(q["categories"], lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in _EONET.items() for x in kv)), c["id"])), lambda k: k.isNotNull())
    xy = F.from_json(last["coordinates"], "array<double>")
    return observation(r, record_id=q["id"], kind=F.coalesce(F.get(mapped, 0), F.lit("natural_event")), headline=q["title"], status=F.when(q["closed"].isNotNull(), "ended").otherwise("active"), event_at=rfc3339(last["date"]), expires_at=rfc3339(q["closed"]), lon=F.get(xy, 0), lat=F.get(xy, 1), metrics=metrics(magnitude=last["magnitudeValue"], unit=last["magnitudeUnit"], history=F.size(q["geometry"])), source_url=safe_url(F.get(q["sources"], 0)["url"]))


_RSS = "title string, description string, link string, guid string, pubDate string, creator string, date string, point string"


@register_provider("smithsonian_volcano")
def volcano(p: DataFrame) -> DataFrame:
    r = items(p, _RSS)
    return observation(r, record_id=F.coalesce("r.guid", "r.link", "r.title"), kind="volcano", headline=C("r.title"), summary=clean_markup(C("r.description")), updated_at=rss_time(C("r.pubDate")), source_url=safe_url(C("r.link")))


@register_provider("noaa_space_weather")
def kp(p: DataFrame) -> DataFrame:
    """Objects, or a header and rows; both forms come out alike."""
    objects = p.select("*", F.explode(F.from_json("body", "array<map<string,string>>")).alias("m"))
    matrix = p.withColumn("t", F.from_json("body", "array<array<string>>")).where(F.size("t") > 1)
    rows = matrix.select("provider_id", "body", "ingested_at", F.explode(F.slice("t", 2, 1 << 20)).alias("row"), F.get("t", 0).alias("head")).where(F.size("row") == F.size("head"))
    both = objects.select("provider_id", "body", "ingested_at", "m").unionByName(rows.select("provider_id", "body", "ingested_at", F.map_from_arrays("head", "row").alias("m")))
    index = F.coalesce(C("m")["Kp"], C("m")["kp"], C("m")["kp_index"])
    return observation(both.where(index.try_cast("double").isNotNull()), record_id=C("m")["time_tag"], kind="space_weather", headline=F.concat(F.lit("Planetary K index "), index), event_at=provider_utc(F.regexp_replace(C("m")["time_tag"], r"\.000$", "")), metrics=metrics(kp_index=index, stations=C("m")["station_count"]))


@register_provider("reliefweb_rss")
def relief(p: DataFrame) -> DataFrame:
    r = items(p, _RSS)
    return observation(r, record_id=F.coalesce("r.guid", "r.link", "r.title"), kind="humanitarian_report", headline=C("r.title"), summary=clean_markup(C("r.description")), updated_at=rss_time(C("r.pubDate")), metrics=metrics(publisher=C("r.creator")), source_url=safe_url(C("r.link")))


def normalize(payloads: DataFrame, strict: bool = False) -> DataFrame:
    """Every provider's payloads through its own job; a provider is a filter, so a scan partitioned by provider prunes.

    A payload of an unknown provider leaves a row in diagnostics() only; strict, it is an error when the result is read.
    """
    out = None
    for name, job in PROVIDERS.items():
        rows = job(payloads.where(C("provider_id") == name))
        out = rows if out is None else out.unionByName(rows)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("no job for provider "), F.coalesce("provider_id", F.lit("null"))))
        wrong = payloads.where(~F.coalesce(C("provider_id").isin(*PROVIDERS), F.lit(False)))
        out = out.unionByName(observation(wrong, record_id=unknown.cast("string")))
    return out


#: What diagnostics() checks of the records of a body: where they stand, fields that a record must have, fields it may have.
RECORDS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "nhc_storms": ("activeStorms", ("id", "name"), ("id", "name", "classification", "intensity", "pressure", "latitude_numeric", "longitude_numeric", "movementDir", "movementSpeed", "lastUpdate", "publicAdvisory")),
    "nws_alerts": ("features", ("properties",), ("id", "type", "geometry", "properties", "@context")),
    "usgs_earthquakes": ("features", ("id", "properties", "geometry"), ("id", "type", "geometry", "properties")),
}


def diagnostics(payloads: DataFrame, known: dict[str, tuple[str, ...]], records: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] | None = None) -> DataFrame:
    """(provider_id, problem, field) of payloads. Names only, never values.

    Bodies: unknown provider, malformed (no JSON), wrong root (no object, or nothing at all), missing and unknown fields. Records of the
    providers in `records`: invalid record (no object), and their missing and unknown fields.
    """
    names = F.array(*(F.struct(F.lit(p).alias("p"), F.array(*map(F.lit, f)).alias("f")) for p, f in known.items()))
    expected = F.get(F.filter(names, lambda x: x["p"] == C("provider_id")), 0)["f"]
    keys = F.json_object_keys("body")
    parsed = F.expr("try_parse_json(body)").isNotNull()
    d = payloads.select("provider_id", "body", expected.alias("expected"), keys.alias("keys"), parsed.alias("parsed"))
    say = lambda problem, fields: F.transform(fields, lambda f: F.struct(F.lit(problem).alias("problem"), f.alias("field")))
    one = lambda problem: F.array(F.struct(F.lit(problem).alias("problem"), F.lit("").alias("field")))
    both = F.concat(say("missing", F.array_except("expected", "keys")), say("unknown", F.array_except("keys", "expected")))
    found = F.when(C("expected").isNull(), one("unknown provider")).when(C("body").isNotNull() & ~C("parsed"), one("malformed")).when(C("keys").isNull(), one("wrong root")).otherwise(both)
    out = d.select("provider_id", F.explode(found).alias("x")).select("provider_id", "x.problem", "x.field")
    for provider, (root, needed, allowed) in (records or {}).items():
        each = d.where(C("provider_id") == provider).select("provider_id", F.explode(F.from_json(F.get_json_object("body", f"$.{root}"), "array<string>")).alias("record"))
        mine = F.json_object_keys("record")
        need, may = F.array(*map(F.lit, needed)), F.array(*map(F.lit, allowed))
        wrong = F.when(mine.isNull(), one("invalid record")).otherwise(F.concat(say("missing", F.array_except(need, mine)), say("unknown", F.array_except(mine, may))))
        out = out.unionByName(each.select("provider_id", F.explode(wrong).alias("x")).select("provider_id", "x.problem", F.concat_ws(".", F.lit(root), F.nullif("x.field", F.lit(""))).alias("field")))
    return out
