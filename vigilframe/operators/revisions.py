"""Revision chains of incidents by a sweep in order of arrival."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lookup import severity_points, urgency_points
from ..model import TERMINAL
from .joins import checkpoint_dir
from .scoring import EFFECTIVE, UPDATED, scored_columns

C = F.col
#: Arrivals of one slot of an incident, but for those of one hour more.
SLOT = 4096
#: What is known of an incident at an arrival.
STATE = "incident_id string, slot long, moment_us long, arrival long, impact int, urgency_points int, newest_us long, source_count long, latest_status string, expiry_us long, status string"
_FAR = 1 << 62


#: Columns of a version as it is swept, and rows given out at once.
VERSION = ("incident_id", "slot", "mine", "from_us", "from_id", "until_us", "until_id", "observation_id", "impact", "urgency_points", "provider_id", "status", "effective_us", "updated_us", "expiry_us")
OUT_ROWS = 8192


class Evidence:
    """The versions that hold at a moment, put in and taken out one by one; maxima from sorted lists and counts."""

    def __init__(self):
        self.counts: tuple[dict, ...] = ({}, {}, {}, {})
        self.newest, self.latest, self.expiry = [], [], []

    def put(self, v: tuple) -> None:
        *_, name, impact, urgency, provider, status, effective, updated, expiry = v
        for n, key in zip(self.counts, (impact, urgency, provider, status), strict=True):
            n[key] = n.get(key, 0) + 1
        insort(self.newest, effective)
        insort(self.latest, (updated, name, status or ""))
        insort(self.expiry, expiry)

    def take(self, v: tuple) -> None:
        *_, name, impact, urgency, provider, status, effective, updated, expiry = v
        for n, key in zip(self.counts, (impact, urgency, provider, status), strict=True):
            if n[key] == 1:
                del n[key]
            else:
                n[key] -= 1
        for held, key in ((self.newest, effective), (self.latest, (updated, name, status or "")), (self.expiry, expiry)):
            del held[bisect_left(held, key)]

    def told(self) -> tuple:
        """From impact on, as in STATE."""
        impact, urgency, provider, status = self.counts
        last = self.latest[-1][2]
        alive = "active" if "active" in status or "updated" in status else "unknown"
        return max(impact), max(urgency), self.newest[-1], len(provider) - (None in provider), last, self.expiry[-1], last if last in TERMINAL else alive


def _sweep(versions: list[tuple]) -> list[tuple]:
    """What is known at each arrival of a slot, from its versions; mine: it arrives in the slot."""
    held, out, turns, key = Evidence(), [], [], versions[0][:2]
    for k, (_, _, mine, from_us, from_id, until_us, until_id, *_) in enumerate(versions):
        if mine:
            turns.append((from_us, from_id, 1, k))
        else:
            held.put(versions[k])
        if until_us is not None:  # some of them in a later slot
            turns.append((until_us, until_id, 0, k))
    for us, id, comes, k in sorted(turns):  # what ends at a moment is gone before what comes then
        if comes:
            held.put(versions[k])
            out.append((*key, us, id, *held.told()))
        else:
            held.take(versions[k])
    return out


def _sweep_all():
    """Sweeps rows of VERSION, sorted by incident and slot, whose groups may go on from batch to batch."""
    schema = to_arrow_schema(StructType.fromDDL(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, itemgetter(0, 1)):
            out += _sweep(list(group))
            if len(out) >= OUT_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def held_versions(versions: DataFrame) -> DataFrame:
    """Versions that differ from the one before them, from when and until when they hold."""
    mine = W.partitionBy("observation_id").orderBy("ingested_at", "event_id")
    new = versions.withColumn("was", F.lag("content_hash").over(mine)).where(~C("content_hash").eqNullSafe(C("was"))).drop("was")
    micros = lambda *c: F.unix_micros(F.coalesce(*c))
    return new.select(
        "incident_id", "observation_id", "provider_id", "status", severity_points(C("severity")).cast("int").alias("impact"), urgency_points(C("urgency")).cast("int").alias("urgency_points"),
        micros(*EFFECTIVE).alias("effective_us"), micros(*UPDATED).alias("updated_us"), F.coalesce(F.unix_micros("expires_at"), F.lit(_FAR)).alias("expiry_us"),
        F.unix_micros("ingested_at").alias("from_us"), C("event_id").alias("from_id"), F.unix_micros(F.lead("ingested_at").over(mine)).alias("until_us"), F.lead("event_id").over(mine).alias("until_id"),
    )


def in_slots(held: DataFrame, slot_rows: int) -> DataFrame:
    """held with a row for each slot of its incident that a version holds in. Slots are hours of arrival taken together, up to about slot_rows arrivals."""
    hour = F.floor(C("from_us") / 3_600_000_000)
    hours = held.groupBy("incident_id", hour.alias("hour")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("incident_id").orderBy("hour")) - C("n")
    starts = hours.withColumn("slot", F.floor(upto / slot_rows)).groupBy("incident_id", "slot").agg(F.min("hour").alias("hour"))
    # An incident's slots are its arrivals over slot_rows; most incidents have one, and only of others are the starts joined.
    many = starts.groupBy("incident_id").agg(F.array_sort(F.collect_list("hour")).alias("starts")).where(F.size("starts") > 1)
    placed = held.join(many, "incident_id", "left").withColumn("starts", F.coalesce("starts", F.array(F.lit(0).cast("long"))))
    at = lambda us: F.greatest(F.size(F.filter("starts", lambda s: s <= F.floor(us / 3_600_000_000))) - 1, F.lit(0))
    first, last = at(C("from_us")), F.when(C("until_us").isNull(), F.size("starts") - 1).otherwise(at(C("until_us")))
    return placed.withColumn("first", first).withColumn("slot", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("mine", C("slot") == C("first")).drop("starts", "first")


def revision_chain(versions: DataFrame, slot_rows: int = SLOT) -> DataFrame:
    """(incident_id, revision, event_id, priority_score, change_type): one revision for each arrival, scored as of then, typed against the one before.

    versions hold all versions of all observations, each with its incident. A version equal to the one before it makes
    no revision. At an arrival every observation stands in its last version so far. Arrivals are swept in order, a
    version put in when it comes and taken out when the next one does; an incident's sweep is cut into slots of time,
    each of which starts with the versions that hold then, so that no task has all of a long incident.
    """
    checkpoint_dir(versions.sparkSession)
    held = held_versions(versions).checkpoint()
    tasks = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = in_slots(held, slot_rows).select(*VERSION).repartition(tasks, "incident_id", "slot")
    known = slots.sortWithinPartitions("incident_id", "slot").mapInArrow(_sweep_all(), STATE)
    moment = F.timestamp_micros("moment_us")
    state = known.withColumns({"newest": F.timestamp_micros("newest_us"), "last_expiry": F.when(C("expiry_us") == _FAR, F.expr("TIMESTAMP '9999-12-31'")).otherwise(F.timestamp_micros("expiry_us")), "first_kind": F.lit("unknown")})
    scored = state.select("incident_id", "slot", "moment_us", "arrival", "status", scored_columns(moment)["priority_score"].cast("int").alias("priority_score")).checkpoint()
    inside = W.partitionBy("incident_id", "slot").orderBy("moment_us", "arrival")
    ends = scored.groupBy("incident_id", "slot").agg(F.count("*").alias("n"), F.max_by("priority_score", F.struct("moment_us", "arrival")).alias("last"))
    along = W.partitionBy("incident_id").orderBy("slot")
    carried = ends.select("incident_id", "slot", (F.sum("n").over(along) - C("n")).alias("upto"), F.lag("last").over(along).alias("carry"))
    s = scored.join(carried, ["incident_id", "slot"]).withColumn("before", F.coalesce(F.lag("priority_score").over(inside), "carry"))
    before, score = C("before"), C("priority_score")
    kind = F.when(before.isNull(), "new").when(C("status") == "cancelled", "cancelled").when(C("status") == "ended", "resolved").when(score >= before + 10, "escalated").when(score <= before - 10, "downgraded").otherwise("updated")
    return s.select("incident_id", (C("upto") + F.row_number().over(inside)).alias("revision"), C("arrival").alias("event_id"), "priority_score", kind.alias("change_type"))
