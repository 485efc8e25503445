"""Incidents out of their evidence: priority score, status, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import certainty_rank, lane, severity_points, severity_rank, urgency_points, urgency_rank
from ..functions.times import seconds_between
from ..model import CERTAINTIES, SEVERITIES, TERMINAL, URGENCIES

EFFECTIVE = ("event_at", "source_updated_at", "ingested_at")
UPDATED = ("source_updated_at", "event_at", "ingested_at")


def latest_key() -> Column:
    """What orders the members of an incident; the last is the latest."""
    return F.struct(F.coalesce(*UPDATED), "observation_id")


def score_parts() -> list[Column]:
    """Aggregates that a score is made of."""
    return [
        F.max(severity_points(F.col("severity"))).alias("impact"),
        F.max(urgency_points(F.col("urgency"))).alias("urgency_points"),
        F.max(F.coalesce(*EFFECTIVE)).alias("newest"),
        F.countDistinct("provider_id").alias("source_count"),
        F.max_by("status", latest_key()).alias("latest_status"),
        F.max(F.coalesce("expires_at", F.expr("TIMESTAMP '9999-12-31'"))).alias("last_expiry"),
        F.min_by("kind", "observation_id").alias("first_kind"),
    ]


def scored_columns(moment: Column, watch: Column | int = 0) -> dict[str, Column]:
    """Explainable priority 0..100 and its components, from score_parts() at a moment."""
    age = F.greatest(seconds_between(F.col("newest"), moment) / 3600, F.lit(0.0))
    fresh = F.when(age <= 1, 15).when(age <= 6, 10).when(age <= 24, 5).otherwise(0)
    penalty = F.when((F.col("last_expiry") <= moment) | F.col("latest_status").isin(*TERMINAL), -40).when(age > 168, -20).otherwise(0)
    parts = {
        "impact": F.col("impact"),
        "urgency": F.col("urgency_points"),
        "freshness": fresh,
        "corroboration": F.least(F.lit(15), 5 * (F.col("source_count") - 1)).cast("int"),
        "watch_region": F.lit(watch) if isinstance(watch, int) else watch,
        "penalty": penalty,
    }
    total = sum(parts.values(), F.lit(0))
    return parts | {"age_hours": F.round(age, 3), "source_count": F.col("source_count"), "lane": lane(F.col("first_kind")), "priority_score": F.greatest(F.lit(0), F.least(F.lit(100), total))}


def incident_scores(members: DataFrame, now: str | Column, watch: Column | int = 0, by: str | list[str] = "incident_id", more: tuple = ()) -> DataFrame:
    """The score of each incident, or of each group of `by`; a moment that is a column is one of these. One grouping; partial sums before the shuffle.

    more: further aggregates to take in the same grouping, kept under their names.
    """
    keys = [by] if isinstance(by, str) else by
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    g = members.groupBy(*keys).agg(*score_parts(), *more)
    return g.select(*keys, *(c.alias(n) for n, c in scored_columns(moment, watch).items()), *g.columns[len(g.columns) - len(more) :])


def incident_status() -> Column:
    """Aggregate: a terminal latest member decides; else anything alive makes it active."""
    last = F.max_by("status", latest_key())
    return F.when(last.isin(*TERMINAL), last).when(F.bool_or(F.col("status").isin("active", "updated")), "active").otherwise("unknown")


def snapshot_parts() -> list[Column]:
    """Aggregates that an incident's snapshot is made of: text from the latest member, worst ranks, first and last times, members in order."""
    name = lambda c, order: F.element_at(F.array(*map(F.lit, reversed(order))), F.max(c).cast("int") + 1)
    placed = F.when(F.col("lon").isNotNull(), latest_key())
    return [
        F.max_by("headline", latest_key()).alias("headline"),
        F.max_by("summary", latest_key()).alias("summary"),
        F.max_by("kind", latest_key()).alias("kind"),
        incident_status().alias("status"),
        name(severity_rank(F.col("severity")), SEVERITIES).alias("severity"),
        name(urgency_rank(F.col("urgency")), URGENCIES).alias("urgency_name"),
        name(certainty_rank(F.col("certainty")), CERTAINTIES).alias("certainty"),
        F.min(F.coalesce(*EFFECTIVE)).alias("first_seen"),
        F.max(F.coalesce(*EFFECTIVE)).alias("last_observed"),
        F.max_by("lon", placed).alias("lon"),
        F.max_by("lat", placed).alias("lat"),
        F.count("*").alias("n_members"),
        F.sort_array(F.collect_set("observation_id")).alias("observation_ids"),
        F.max("ingested_at").alias("last_changed"),
        F.max_by("location_name", F.when(F.col("location_name").isNotNull(), F.struct("ingested_at", "observation_id"))).alias("location_name"),
    ]


def build_incidents(members: DataFrame, by: str = "incident_id") -> DataFrame:
    return members.groupBy(by).agg(*snapshot_parts()).withColumnRenamed("urgency_name", "urgency")


def scored_incidents(members: DataFrame, now: str, by: str = "incident_id") -> DataFrame:
    """Snapshot and score of each incident in one grouping."""
    s = incident_scores(members, now, by=by, more=tuple(snapshot_parts()))
    return s.withColumnRenamed("urgency", "urgency_points").withColumnRenamed("urgency_name", "urgency")
