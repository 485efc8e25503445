"""Observation-shaped views over the plain tables, and the same views in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The moment that ages and windows are measured from.
NOW = "2024-01-31 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KIND = """CASE event_type WHEN 'click' THEN 'earthquake' WHEN 'view' THEN 'news_item'
 WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'weather_alert' WHEN 1 THEN 'aviation_hazard' ELSE 'disaster_declaration' END
 WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'wildfire' ELSE 'volcano' END
 ELSE CASE WHEN k % 2 = 0 THEN 'tropical_cyclone' ELSE 'tsunami' END END"""
_SEVERITY = "CASE WHEN value >= 150 THEN 'Extreme' WHEN value >= 100 THEN 'Severe' WHEN value >= 50 THEN 'Moderate' WHEN value >= 10 THEN 'Minor' ELSE 'Unknown' END"
_URGENCY = "CASE k % 5 WHEN 0 THEN 'Immediate' WHEN 1 THEN 'Expected' WHEN 2 THEN 'Future' WHEN 3 THEN 'Past' ELSE 'Unknown' END"
_CERTAINTY = "CASE k % 5 WHEN 0 THEN 'Observed' WHEN 1 THEN 'Likely' WHEN 2 THEN 'Possible' WHEN 3 THEN 'Unlikely' ELSE 'Unknown' END"
_STATUS = "CASE k % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'ended' WHEN 2 THEN 'unknown' WHEN 3 THEN 'updated' ELSE 'active' END"
_LON = "greatest(-180.0, least(180.0, (site * 5077 % 36001) / 100.0 - 180 + ((event_id % 11) - 5) * 0.1))"
_LAT = "(site * 2909 % 12001) / 100.0 - 60 + ((event_id % 7) - 3) * 0.1"
_HAZARD = "CASE k % 5 WHEN 0 THEN 'CONVECTIVE' WHEN 1 THEN 'TURB' WHEN 2 THEN 'ICING' WHEN 3 THEN 'VOLCANIC ASH' ELSE 'MTN WAVE' END"
_HEADLINE = """CASE WHEN event_type = 'purchase' THEN concat('Hazard at the site H', site) WHEN event_type = 'error' THEN concat('Flood warning number ', user_id % 12, ' site ', site) WHEN event_type = 'view' THEN concat('Report of flood and storm number ', user_id % 12, ' near site ', site)
 ELSE concat(event_type, ' update for user ', user_id) END"""
#: Columns that read alike in both dialects.
_COLUMNS = {
    "provider_id": "concat('prov_', event_id % 4)",
    "record_id": "concat(user_id, ':', event_type)",
    "kind": _KIND,
    "severity": _SEVERITY,
    "urgency": _URGENCY,
    "certainty": _CERTAINTY,
    "status": _STATUS,
    "lon": f"CAST({_LON} AS DOUBLE)",
    "lat": f"CAST({_LAT} AS DOUBLE)",
    "slon": "CAST((event_id * 7919 % 36001) / 100.0 - 180 AS DOUBLE)",
    "slat": "CAST((event_id * 104729 % 17001) / 100.0 - 85 AS DOUBLE)",
    "headline": _HEADLINE,
    "summary": "concat(event_type, ' at site ', site, ' with value ', k)",
    "location_name": "CASE WHEN k % 4 = 0 THEN NULL ELSE concat('Site ', site, ' County') END",
    "storm_name": "concat('S', site)",
    "relation_candidate": "concat('T', user_id % 20)",
    "hazard_type": _HAZARD,
    "state_code": "concat('ST', user_id % 25)",
    "state_codes": "concat('ST', user_id % 25, ', st', k % 25)",
    "declared_area": "CASE k % 4 WHEN 0 THEN 'Statewide' WHEN 1 THEN '' ELSE concat('Site ', site, ' (County)') END",
    "incident_type": "CASE k % 7 WHEN 0 THEN 'Earthquake' WHEN 1 THEN 'Hurricane' WHEN 2 THEN 'Tsunami' WHEN 3 THEN 'Volcanic Eruption' WHEN 4 THEN 'Wild Fire' WHEN 5 THEN 'Severe Storm(s)' ELSE 'Chemical' END",
}
#: Columns of moments: name, minutes after ts, condition.
_MOMENTS = {"event_at": ("0", "true"), "effective_at": ("0", "true"), "source_updated_at": ("(event_id % 7)", "event_id % 3 = 0"), "ingested_at": ("5", "true"), "expires_at": ("k * 60", "k % 7 <> 0")}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each version of each observation."""
    return as_observations(table(spark, sf_dir, "events"))


def as_observations(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as versions of observations."""
    e = events.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("user_id") % 8).alias("site")
    )
    moments = {n: F.expr(f"CASE WHEN {c} THEN timestamp_micros(unix_micros(ts) + CAST({m} AS BIGINT) * 60000000) END") for n, (m, c) in _MOMENTS.items()}
    o = e.select("*", *(F.expr(x).alias(n) for n, x in _COLUMNS.items()), *(c.alias(n) for n, c in moments.items()))
    o = o.withColumn("observation_id", F.concat_ws(":", "provider_id", F.substring(F.sha2("record_id", 256), 1, 24)))
    return o.withColumn("content_hash", F.sha2(F.concat_ws("|", "kind", "headline", "severity", "urgency", "status"), 256))


def latest_observations(o: DataFrame) -> DataFrame:
    """Last version of each observation."""
    w = W.partitionBy("observation_id").orderBy(F.desc("ingested_at"), F.desc("event_id"))
    return o.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def members(o: DataFrame) -> DataFrame:
    """Latest observations with the incident they are evidence of."""
    return latest_observations(o).withColumn("incident_id", F.concat_ws(":", F.lit("incident"), "kind", F.col("site").cast("string")))


#: The last line of an article: what it is about and where, since the invented prose names no topics and places.
_TOPIC = "CASE doc_id % 6 WHEN 0 THEN 'Ceasefire talks resume' WHEN 1 THEN 'Drone strike reported' WHEN 2 THEN 'Harvest figures out' WHEN 3 THEN 'Troops and insurgents move' WHEN 4 THEN 'Insurgency eases' ELSE 'Protest against the junta' END"
_WHERE = "CASE doc_id % 13 WHEN 0 THEN 'Kyiv' WHEN 1 THEN 'Gaza' WHEN 2 THEN 'South Sudan' WHEN 3 THEN 'Taipei' WHEN 4 THEN 'Bamako in Mali' WHEN 5 THEN 'Seoul' WHEN 6 THEN 'Tijuana' WHEN 7 THEN 'Kashmir' WHEN 8 THEN 'Lima' WHEN 9 THEN 'Oslo' WHEN 10 THEN 'Port-au-Prince' WHEN 11 THEN 'Niger' ELSE 'Belgrade' END"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed articles out of documents: the first line is the title, the whole text with a last line of topic and place the summary."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr(f"text || ' ' || {_TOPIC} || ' in ' || {_WHERE}").alias("summary"),
        F.concat(F.lit("feed_"), (F.col("doc_id") % 3).cast("string")).alias("src"),
        (F.lit(1706702400) - F.col("doc_id") * 97 % 200000).alias("ts"),
    )


_SQL_MOMENTS = ", ".join(f"CASE WHEN {c} THEN ts + to_minutes(CAST({m} AS BIGINT)) END AS {n}" for n, (m, c) in _MOMENTS.items())
_SQL_COLUMNS = ", ".join(f"{x} AS {n}" for n, x in _COLUMNS.items())
#: The oracle's views; every oracle text starts with them.
SQL = f"""WITH e AS (
 SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 8 AS site FROM events
), o0 AS (SELECT *, {_SQL_COLUMNS}, {_SQL_MOMENTS} FROM e
), o AS (SELECT *, concat(provider_id, ':', substr(sha256(record_id), 1, 24)) AS observation_id, sha256(concat_ws('|', kind, headline, severity, urgency, status)) AS content_hash FROM o0
), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at DESC, event_id DESC) = 1
), m AS (SELECT *, concat('incident:', kind, ':', site) AS incident_id FROM l
), art AS (
 SELECT doc_id, split_part(text, chr(10), 1) AS title, text || ' ' || {_TOPIC} || ' in ' || {_WHERE} AS summary, concat('feed_', doc_id % 3) AS src, 1706702400 - doc_id * 97 % 200000 AS ts FROM documents
)
"""
