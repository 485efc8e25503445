"""Exports and table writes: CSV and GeoJSON of incidents, dense cursors, merges by overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import valid
from ..functions.text import csv_cell, safe_url

#: The columns of the CSV export, and those of them that are numbers.
CSV_COLUMNS = (
    "schema_version", "incident_id", "kind", "headline", "summary", "status", "severity", "urgency", "certainty", "priority_score",
    "first_seen_at", "last_changed_at", "last_observed_at", "longitude", "latitude", "sources",
)
CSV_NUMBERS = ("schema_version", "priority_score", "longitude", "latitude")
EXPORT_ROWS, EXPORT_SOURCES = 200, 20


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sources_of(provider: Column, url: Column) -> Column:
    """Aggregate: an incident's first sources in order of provider, each with an address that is safe to show or null."""
    return F.slice(F.array_sort(F.collect_set(F.struct(provider.alias("provider_id"), safe_url(url).alias("source_url")))), 1, EXPORT_SOURCES)


def exported(incidents: DataFrame) -> DataFrame:
    """The first EXPORT_ROWS incidents with their place; more than that an export never holds."""
    first = incidents.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id").limit(EXPORT_ROWS)
    return first.withColumn("place", F.row_number().over(W.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id")))


def csv_lines(incidents: DataFrame) -> DataFrame:
    """(place, line): a header with a byte order mark, then a line for each exported incident; every cell quoted, lines end with CR LF."""
    said = F.transform("sources", lambda s: F.when(s["source_url"].isNull(), s["provider_id"]).otherwise(F.concat(s["provider_id"], F.lit(" ("), s["source_url"], F.lit(")"))))
    values = exported(incidents).select(
        "place", F.lit(1).alias("schema_version"), "incident_id", "kind", "headline", "summary", "status", "severity", "urgency", "certainty", "priority_score",
        iso(F.col("first_seen")).alias("first_seen_at"), iso(F.col("last_changed")).alias("last_changed_at"), iso(F.col("last_observed")).alias("last_observed_at"),
        F.round("lon", 4).alias("longitude"), F.round("lat", 4).alias("latitude"), F.array_join(said, "; ").alias("sources"),
    )
    line = F.concat(F.concat_ws(",", *(csv_cell(F.col(c), numeric=c in CSV_NUMBERS) for c in CSV_COLUMNS)), F.lit("\r\n"))
    head = "\ufeff" + ",".join(f'"{c}"' for c in CSV_COLUMNS) + "\r\n"
    return incidents.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(head).alias("line")).unionByName(values.select("place", line.alias("line")))


def geojson_collection(incidents: DataFrame, at: str) -> DataFrame:
    """One row, collection: the exported incidents as a FeatureCollection.

    Columns shape and coordinates, a GeoJSON type and text, give a feature's geometry where they are valid; else it is
    the point, and without a place there is none.
    """
    point = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 4), F.round("lat", 4)).alias("coordinates"))))
    if "shape" in incidents.columns:
        drawn = F.concat(F.lit('{"type":"'), F.col("shape"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}"))
        point = F.when(valid(F.col("shape"), F.col("coordinates")), drawn).otherwise(point)
    named = F.transform("sources", lambda s: F.struct(s["provider_id"].alias("provider_id"), s["provider_id"].alias("attribution"), s["source_url"].alias("source_url")))
    facts = F.struct(
        F.lit(1).alias("schema_version"), "incident_id", "kind", "headline", "summary", "status", "severity", "urgency", "certainty", "priority_score",
        iso(F.col("first_seen")).alias("first_seen_at"), iso(F.col("last_changed")).alias("last_changed_at"), iso(F.col("last_observed")).alias("last_observed_at"), named.alias("sources"),
    )
    id_ = F.to_json(F.array("incident_id"))
    feature = F.concat(F.lit('{"type":"Feature","id":'), F.substring(id_, F.lit(2), F.length(id_) - 2), F.lit(',"geometry":'), F.coalesce(point, F.lit("null")), F.lit(',"properties":'), F.to_json(facts, {"ignoreNullFields": "false"}), F.lit("}"))
    all_ = exported(incidents).select(F.struct("place", feature.alias("feature")).alias("f")).agg(F.array_sort(F.collect_list("f")).alias("f"))  # EXPORT_ROWS at most
    head = f'{{"type":"FeatureCollection","schema_version":1,"generated_at":"{at}","features":['
    return all_.select(F.concat(F.lit(head), F.array_join(F.transform("f", lambda f: f["feature"]), ","), F.lit("]}")).alias("collection"))


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """Writes what csv_lines or geojson_collection made as one text file; line ends are in the lines."""
    order = ["place"] if "place" in lines.columns else []
    one = lines.orderBy(*order).coalesce(1) if order else lines.coalesce(1)
    one.select(column).write.mode("overwrite").option("lineSep", "").text(path)


def dense_cursor(rows: DataFrame, at: str, order: list[str], after: int | DataFrame = 0) -> DataFrame:
    """rows with cursor: numbers without gaps from the one after `after` on, in order of the moment `at`, then of `order`.

    Hours are counted first, so each hour is numbered by itself; only the hours' counts are ordered in one task, a row
    for each hour of the log. after may be a frame of one row with column last.
    """
    hour = F.date_trunc("hour", at)
    counts = rows.groupBy(hour.alias("hour")).agg(F.count("*").alias("hour_rows"))
    before = F.coalesce(F.sum("hour_rows").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("hour", before.alias("hour_before"))
    inside = F.row_number().over(W.partitionBy("hour").orderBy(at, *order))
    out = rows.withColumn("hour", hour).join(offsets, "hour").withColumn("cursor", F.col("hour_before") + inside)
    if isinstance(after, DataFrame):
        out = out.crossJoin(F.broadcast(after)).withColumn("cursor", F.col("cursor") + F.coalesce("last", F.lit(0))).drop("last")  # one row
    else:
        out = out.withColumn("cursor", F.col("cursor") + after)
    return out.drop("hour", "hour_before")


def merge_latest(old: DataFrame | None, new: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """The table after an upsert: the last row of each key, with changed, whether the key is new or its digest differs from before.

    A row whose digest stays still brings its own times in. Old rows without a newer one stay, unchanged.
    """
    last = F.struct(*order)
    columns = new.columns
    fresh = new.groupBy(key).agg(F.max_by(F.struct(*columns), last).alias("r")).select("r.*")
    if old is None:
        return fresh.withColumn("changed", F.lit(True))
    was = old.select(F.col(key), F.col(digest).alias("was"))
    came = fresh.join(was, key, "left").withColumn("changed", ~F.col(digest).eqNullSafe(F.col("was"))).drop("was")
    return came.unionByName(old.select(*columns).join(fresh.select(key), key, "left_anti").withColumn("changed", F.lit(False)))


def upsert_table(spark, path: str, new: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """merge_latest into versions of a Parquet table at path: a version is written beside the old one, then named in _latest; readers of the old one go on undisturbed.

    Returns the new version.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = spark._jvm.org.apache.hadoop.fs.Path
    pointer = there(f"{path}/_latest")
    number = int(spark.read.text(pointer.toString()).agg(F.max(F.col("value").cast("int"))).first()[0]) if files.exists(pointer) else 0
    old = spark.read.parquet(f"{path}/version={number}") if number else None
    merged = merge_latest(old.drop("changed") if old is not None else None, new, key, order, digest)
    merged.write.mode("overwrite").parquet(f"{path}/version={number + 1}")
    spark.range(1).select(F.lit(str(number + 1)).alias("value")).coalesce(1).write.mode("overwrite").text(pointer.toString())
    return spark.read.parquet(f"{path}/version={number + 1}")


def upsert_actions(old: DataFrame, new: DataFrame, key: str, revision: str, content: str) -> DataFrame:
    """(key, revision, action): inserted, updated to a higher revision, or rejected for other content under the same revision. All else is left out."""
    was = old.select(key, F.col(revision).alias("was"), F.col(content).alias("content_was"))
    action = F.when(F.col("was").isNull(), "inserted").when(F.col(revision) > F.col("was"), "updated").when((F.col(revision) == F.col("was")) & ~F.col(content).eqNullSafe(F.col("content_was")), "rejected")
    return new.join(was, key, "left").select(key, revision, action.alias("action")).where("action is not null")


def upsert_incidents(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, cursor: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actions, edges, log) of incidents laid over older ones: incident_id, revision, said and last_changed of each, edges (incident_id, observation_id).

    Where an incident is inserted or updated its edges are written anew and the log gets a row, with cursors without gaps
    from the one after `cursor` (one row, last) on, in order of change; everywhere else edges stay as they were.
    """
    actions = upsert_actions(old, new, "incident_id", "revision", "said")
    accepted = actions.where("action <> 'rejected'").select("incident_id")
    edges = new_edges.join(accepted, "incident_id", "left_semi").unionByName(old_edges.join(accepted, "incident_id", "left_anti"))
    written = new.join(accepted, "incident_id", "left_semi").select("incident_id", "revision", "last_changed")
    return actions, edges, dense_cursor(written, "last_changed", ["incident_id"], cursor)
