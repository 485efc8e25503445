"""Filters, top-k, paging, set operations, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, lookup, text
from ..model import CONFLICT_WORDS, MEDIA_KINDS, THEATRES
from ..operators.commits import new_folder
from ..operators.geo_table import GeoTable
from ..operators.scoring import incident_scores, latest_key, scored_incidents
from ..operators.search import SearchIndex
from ..streaming.state import failure_streaks
from ..views import NOW, articles, latest_observations, members, observations, table
from .registry import query
from .scalars import sql_km

C = F.col
_NOW = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")


#: The scored incidents in SQL, as a continuation of the views.
INC = f""", s AS (
 SELECT incident_id, max(CASE severity WHEN 'Extreme' THEN 40 WHEN 'Severe' THEN 30 WHEN 'Moderate' THEN 20 WHEN 'Minor' THEN 10 ELSE 0 END) AS impact,
  max(CASE urgency WHEN 'Immediate' THEN 20 WHEN 'Expected' THEN 15 WHEN 'Future' THEN 8 ELSE 0 END) AS urgency,
  greatest((epoch_us({_NOW}) - max(epoch_us(coalesce(event_at, source_updated_at, ingested_at)))) / 1e6 / 3600, 0) AS age, count(DISTINCT provider_id) AS source_count,
  arg_max(status, {{'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id}}) AS last_status, bool_and(coalesce(expires_at <= {_NOW}, false)) AS expired, any_value(kind) AS kind, max(ingested_at) AS last_changed
 FROM m GROUP BY incident_id
), sc AS (
 SELECT *, CASE WHEN age <= 1 THEN 15 WHEN age <= 6 THEN 10 WHEN age <= 24 THEN 5 ELSE 0 END AS freshness, least(15, 5 * (source_count - 1)) AS corroboration,
  CASE WHEN expired OR last_status IN ('cancelled','ended') THEN -40 WHEN age > 168 THEN -20 ELSE 0 END AS penalty FROM s
), inc AS (SELECT *, greatest(0, least(100, impact + urgency + freshness + corroboration + penalty)) AS priority_score FROM sc)
"""
INC = INC.rstrip() + "\n"


def scored(spark, sf_dir):
    """Scores of the incidents, and their members."""
    m = members(observations(spark, sf_dir))
    return incident_scores(m, NOW), m


def incidents(spark, sf_dir):
    return scored_incidents(members(observations(spark, sf_dir)), NOW)


@query("flt_kinds", "SELECT incident_id, kind FROM m WHERE kind NOT IN ('news_item') GROUP BY ALL")
def flt_kinds(spark, sf_dir):
    return members(observations(spark, sf_dir)).where(~C("kind").isin(*MEDIA_KINDS)).select("incident_id", "kind").distinct()


@query("flt_incidents", INC + "SELECT incident_id, priority_score FROM inc WHERE kind IN ('earthquake','tsunami','volcano','wildfire') AND incident_id IN (SELECT incident_id FROM m GROUP BY incident_id HAVING arg_max(lon, {'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id}) BETWEEN -60 AND 120)")
def flt_incidents(spark, sf_dir):
    i = incidents(spark, sf_dir).where(C("lane") == "hazards").where(C("kind").isin("earthquake", "tsunami", "volcano", "wildfire"))
    return i.where(geo.in_bounds(C("lon"), C("lat"), -60, -90, 120, 90)).select("incident_id", "priority_score")


#: Boxes asked for: west, south, east, north; the second one crosses the antimeridian.
_BOXES = {"land": (-30.0, -10.0, 40.0, 50.0), "sea": (165.0, -40.0, -150.0, 20.0)}
_BOX_SQL = " UNION ALL ".join(f"(SELECT '{n}' AS box, event_id, observation_id FROM l WHERE slat BETWEEN {s} AND {t} AND (slon >= {w} {'AND' if w <= e else 'OR'} slon <= {e}) ORDER BY ingested_at DESC, event_id LIMIT 100)" for n, (w, s, e, t) in _BOXES.items())


@query("flt_bbox_obs", _BOX_SQL)
def flt_bbox_obs(spark, sf_dir):
    """The newest hundred of each box, out of a table laid out by cells."""
    laid = GeoTable(spark, new_folder(spark, "geo-"), "slon", "slat").put(latest_observations(observations(spark, sf_dir)).select("event_id", "observation_id", "ingested_at", "slon", "slat"))
    newest = lambda name, box: laid.within(*box).orderBy(F.desc("ingested_at"), "event_id").limit(100).select(F.lit(name).alias("box"), "event_id", "observation_id")
    found = [newest(n, b) for n, b in _BOXES.items()]
    return found[0].unionByName(found[1])


@query("flt_radius", f"SELECT event_id, round({sql_km('10.0', '45.0', 'slon', 'slat')}, 3) AS km FROM o WHERE {sql_km('10.0', '45.0', 'slon', 'slat')} <= 500 * 1.852")
def flt_radius(spark, sf_dir):
    """A box first, which a scan can use, then the exact distance."""
    most = 500 * 1.852
    high = geo.band_degrees(most)
    km = geo.haversine_km(F.lit(10.0), F.lit(45.0), C("slon"), C("slat"))
    near = observations(spark, sf_dir).where(C("slat").between(45 - high, 45 + high))
    return near.where(km <= most).select("event_id", F.round(km, 3).alias("km"))


@query("flt_keyword_regex", f"SELECT doc_id FROM art WHERE src = 'feed_0' OR regexp_matches(concat(title, ' ', summary), '(?i){CONFLICT_WORDS}')")
def flt_keyword_regex(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.where((C("src") == "feed_0") | F.concat_ws(" ", "title", "summary").rlike("(?i)" + CONFLICT_WORDS)).select("doc_id")


_THEATRE_SQL = " UNION ALL ".join([f"SELECT doc_id, '{n}' AS theatre FROM art WHERE regexp_matches(summary, '(?i){k}')" for n, k in THEATRES.items()] + ["SELECT doc_id, 'global' AS theatre FROM art"])


@query("flt_theater", _THEATRE_SQL)
def flt_theater(spark, sf_dir):
    """Articles by theatre; each is in the worldwide one too."""
    a = articles(spark, sf_dir)
    named = F.array(*(F.when(C("summary").rlike("(?i)" + k), F.lit(n)) for n, k in THEATRES.items()), F.lit("global"))
    return a.select("doc_id", F.explode(F.array_compact(named)).alias("theatre"))


@query("flt_watchlist", "SELECT doc_id FROM art WHERE contains(lower(summary), 'thing') OR contains(lower(summary), 'über')")
def flt_watchlist(spark, sf_dir):
    words = F.array(F.lit("thing"), F.lit("über"))
    return articles(spark, sf_dir).where(F.exists(words, lambda w: F.contains(F.lower("summary"), w))).select("doc_id")


#: Queries of the searches, alike in both dialects: beginnings of the first words of benchmark items, of kinds and statuses.
_ASKED_DOCS = "concat(left(split_part(text, ' ', 1), 4), ', ', left(split_part(text, ' ', 2), 4))"
_ASKED_OBS = "concat('SITE ', left(status, 3), '; ', left(kind, 4))"
_WORDS = "concat(' ', regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_FOUND_SQL = (
    ", ask AS (SELECT DISTINCT 'documents' AS part, {docs} AS query FROM benchmark UNION ALL SELECT DISTINCT 'observations', {obs} FROM o)\n"
    ", ask1 AS (SELECT part, query, list_filter(string_split({asked}, ' '), lambda t: t <> '')[:8] AS terms FROM ask WHERE length(trim(query)) BETWEEN 2 AND 100)\n"
    ", said AS (SELECT 'documents' AS part, doc_id AS id, {doc_words} AS w FROM art UNION ALL SELECT 'observations', event_id, {obs_words} FROM l)\n"
).format(docs=_ASKED_DOCS, obs=_ASKED_OBS, asked=_WORDS.format("query"), doc_words=_WORDS.format("concat_ws(' ', title, summary, src)"), obs_words=_WORDS.format("concat_ws(' ', headline, summary, location_name, kind, status)"))
_OBS_WORDS = ["headline", "summary", "location_name", "kind", "status"]


def found(spark, rows, id: str, said: list[str], asked):
    """(query, id) of the rows that each query finds, by an index made for them; queries are strings of the column `query`."""
    index = SearchIndex(spark, new_folder(spark, "search-")).put(rows, id, said)
    return index.search(asked.select("query", C("query").alias("asked")).distinct())


@query("flt_search", _FOUND_SQL + "SELECT part, query, id FROM ask1 JOIN said USING (part) WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(w, ' ' || t))) = 0")
def flt_search(spark, sf_dir):
    """Articles by title, text and feed, and latest observations by headline, summary, place, kind and status, for the queries of two tables."""
    latest = latest_observations(observations(spark, sf_dir))
    docs = found(spark, articles(spark, sf_dir), "doc_id", ["title", "summary", "src"], table(spark, sf_dir, "benchmark").select(F.expr(_ASKED_DOCS).alias("query")))
    obs = found(spark, latest, "event_id", _OBS_WORDS, observations(spark, sf_dir).select(F.expr(_ASKED_OBS).alias("query")))
    return docs.select(F.lit("documents").alias("part"), "query", "id").unionByName(obs.select(F.lit("observations").alias("part"), "query", "id"))


@query("flt_timeline_window", f"SELECT event_id, h FROM (SELECT event_id, unnest([1, 6, 24, 168]) AS h, ingested_at FROM o) WHERE epoch_us(ingested_at) >= epoch_us({_NOW}) - h * 3600000000 AND ingested_at <= {_NOW}")
def flt_timeline_window(spark, sf_dir):
    o = observations(spark, sf_dir).where(C("ingested_at").between(F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 168 HOURS"), _now()))
    hours = o.select("event_id", "ingested_at", F.explode(F.array(*map(F.lit, (1, 6, 24, 168)))).alias("h"))
    return hours.where(F.unix_micros("ingested_at") >= F.unix_micros(_now()) - C("h") * F.lit(3600000000)).select("event_id", "h")


@query("flt_active", "SELECT event_id FROM l WHERE status IN ('active','updated') AND lon IS NOT NULL AND kind NOT IN ('marine_observation','water_level','fireball')")
def flt_active(spark, sf_dir):
    return latest_observations(observations(spark, sf_dir)).where(C("status").isin("active", "updated") & C("lon").isNotNull() & ~C("kind").isin("marine_observation", "water_level", "fireball")).select("event_id")


@query("flt_hot_alerts", "SELECT event_id, alert FROM (SELECT event_id, CASE WHEN value >= 100 THEN 'red' WHEN value >= 50 THEN 'orange' ELSE 'green' END AS alert FROM o) WHERE alert IN ('red','orange')")
def flt_hot_alerts(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", F.when(C("value") >= 100, "red").when(C("value") >= 50, "orange").otherwise("green").alias("alert")).where(C("alert").isin("red", "orange"))


@query("flt_quake_min", "SELECT event_id, least(k // 10, 6) AS cut FROM o WHERE kind = 'earthquake' AND k >= 20")
def flt_quake_min(spark, sf_dir):
    return observations(spark, sf_dir).where((C("kind") == "earthquake") & (C("k") >= 20)).select("event_id", F.least(F.floor(C("k") / 10).cast("int"), F.lit(6)).alias("cut"))


@query("flt_category", INC + "SELECT incident_id, kind, priority_score, row_number() OVER (ORDER BY priority_score DESC, last_changed DESC, incident_id) AS place FROM inc WHERE kind IN ('earthquake','tropical_cyclone','tsunami','volcano','wildfire','natural_event','disaster','disaster_declaration') ORDER BY place LIMIT 40")
def flt_category(spark, sf_dir):
    i = incidents(spark, sf_dir).where(lookup.in_filter(C("kind"), "natural"))
    top = i.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id").limit(40)
    place = F.row_number().over(W.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id"))  # over 40 rows
    return top.select("incident_id", "kind", "priority_score", place.alias("place"))


@query("flt_quality", "SELECT event_id, (length(headline) BETWEEN 1 AND 200) AS text_ok, status IN ('active','updated') AS enum_ok, location_name IS NOT NULL AS required_ok FROM o")
def flt_quality(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", F.length("headline").between(1, 200).alias("text_ok"), C("status").isin("active", "updated").alias("enum_ok"), C("location_name").isNotNull().alias("required_ok"))


# Top-k and paging


@query("top_incidents", INC + "SELECT incident_id, kind, impact, urgency, freshness, corroboration, penalty, round(age, 3) AS age_hours, source_count, priority_score FROM inc ORDER BY priority_score DESC, last_changed DESC, incident_id LIMIT 50")
def top_incidents(spark, sf_dir):
    """The flagship: incidents by explainable priority."""
    more = (F.max("ingested_at").alias("last_changed"), F.max("kind").alias("kind"))
    s = incident_scores(members(observations(spark, sf_dir)), NOW, more=more)
    top = s.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id").limit(50)
    return top.select("incident_id", "kind", "impact", "urgency", "freshness", "corroboration", "penalty", "age_hours", "source_count", "priority_score")


@query("page_incidents", INC + "SELECT incident_id, priority_score, (SELECT count(*) FROM inc) AS total FROM inc ORDER BY priority_score DESC, last_changed DESC, incident_id LIMIT 10 OFFSET 20")
def page_incidents(spark, sf_dir):
    i = incidents(spark, sf_dir).select("incident_id", "priority_score", "last_changed")
    total = i.agg(F.count("*").alias("total"))
    page = i.orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id").offset(20).limit(10)
    return page.crossJoin(F.broadcast(total)).select("incident_id", "priority_score", "total")  # one row


@query("top_provider_obs", "SELECT provider_id, event_id FROM l QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY ingested_at DESC, event_id) <= 1000")
def top_provider_obs(spark, sf_dir):
    w = W.partitionBy("provider_id").orderBy(F.desc("ingested_at"), "event_id")
    return latest_observations(observations(spark, sf_dir)).withColumn("rn", F.row_number().over(w)).where("rn <= 1000").select("provider_id", "event_id")


REV = """, rev AS (
 SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at, event_id) AS revision,
  CASE severity WHEN 'Extreme' THEN 40 WHEN 'Severe' THEN 30 WHEN 'Moderate' THEN 20 WHEN 'Minor' THEN 10 ELSE 0 END + CASE urgency WHEN 'Immediate' THEN 20 WHEN 'Expected' THEN 15 WHEN 'Future' THEN 8 ELSE 0 END AS score FROM o
)
"""


def revisions(spark, sf_dir):
    """Version chain of each observation, with a simple score."""
    w = W.partitionBy("observation_id").orderBy("ingested_at", "event_id")
    o = observations(spark, sf_dir)
    return o.select("*", F.row_number().over(w).alias("revision"), (lookup.severity_points(C("severity")) + lookup.urgency_points(C("urgency"))).alias("score"))


@query("top_timeline", REV + "SELECT observation_id, revision, score FROM rev WHERE observation_id = (SELECT min(observation_id) FROM o) ORDER BY revision DESC LIMIT 100")
def top_timeline(spark, sf_dir):
    r = revisions(spark, sf_dir)
    one = F.broadcast(observations(spark, sf_dir).agg(F.min("observation_id").alias("observation_id")))  # one row
    return r.join(one, "observation_id", "left_semi").orderBy(F.desc("revision")).limit(100).select("observation_id", "revision", "score")


@query("top_changes", "SELECT event_id AS cursor, observation_id FROM o WHERE event_id > 400 ORDER BY event_id LIMIT 100")
def top_changes(spark, sf_dir):
    return observations(spark, sf_dir).where("event_id > 400").orderBy("event_id").limit(100).select(C("event_id").alias("cursor"), "observation_id")


_REP_SQL = ", rep AS (SELECT incident_id, arg_max({'h': headline, 's': summary, 'l': location_name, 'k': kind, 't': status}, {'a': coalesce(source_updated_at, event_at, ingested_at), 'b': observation_id}) AS d FROM m GROUP BY incident_id)\n"
_REP_WORDS = "concat_ws(' ', d.h, d.s, d.l, d.k, d.t)"
_TOP_ASK = "concat(left(kind, 3), ' ', left(status, 2))"


@query("top_search", INC + _REP_SQL + f", ask AS (SELECT DISTINCT {_TOP_ASK} AS query FROM o), ask1 AS (SELECT query, list_filter(string_split({_WORDS.format('query')}, ' '), lambda t: t <> '')[:8] AS terms FROM ask), said AS (SELECT incident_id, {_WORDS.format(_REP_WORDS)} AS w FROM rep) SELECT query, incident_id, priority_score FROM ask1, said JOIN inc USING (incident_id) WHERE len(list_filter(terms, lambda t: NOT contains(w, ' ' || t))) = 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority_score DESC, last_changed DESC, incident_id) <= 20")
def top_search(spark, sf_dir):
    """Incidents that each query finds by the words of their latest evidence, the first 20 by priority, change and id. A query's best are taken before the shuffle."""
    m = members(observations(spark, sf_dir))
    s = incident_scores(m, NOW, more=(F.max("ingested_at").alias("last_changed"),))
    said = m.groupBy("incident_id").agg(F.max_by(F.struct(*_OBS_WORDS), latest_key()).alias("d")).select("incident_id", "d.*")
    hits = found(spark, said, "incident_id", _OBS_WORDS, observations(spark, sf_dir).select(F.expr(_TOP_ASK).alias("query")))
    w = W.partitionBy("query").orderBy(F.desc("priority_score"), F.desc("last_changed"), "incident_id")
    best = s.join(hits.withColumnRenamed("id", "incident_id"), "incident_id").withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return best.select("query", "incident_id", "priority_score")


@query("top_severity_list", "SELECT event_id, severity FROM o ORDER BY CASE severity WHEN 'Extreme' THEN 4 WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END DESC, event_id LIMIT 40")
def top_severity_list(spark, sf_dir):
    return observations(spark, sf_dir).orderBy(F.desc(lookup.severity_rank(C("severity"))), "event_id").limit(40).select("event_id", "severity")


@query("top_quakes", "SELECT 'newest' AS list, event_id FROM (SELECT event_id FROM o WHERE kind = 'earthquake' ORDER BY event_at DESC, event_id LIMIT 30) UNION ALL SELECT 'strong', event_id FROM (SELECT event_id FROM o WHERE kind = 'earthquake' AND k >= 50 ORDER BY event_at DESC, event_id LIMIT 8)")
def top_quakes(spark, sf_dir):
    q = observations(spark, sf_dir).where(C("kind") == "earthquake")
    top = lambda df, n, name: df.orderBy(F.desc("event_at"), "event_id").limit(n).select(F.lit(name).alias("list"), "event_id")
    return top(q, 30, "newest").unionByName(top(q.where("k >= 50"), 8, "strong"))


@query("top_oldest", "SELECT observation_id FROM l ORDER BY ingested_at, observation_id LIMIT 100")
def top_oldest(spark, sf_dir):
    return latest_observations(observations(spark, sf_dir)).orderBy("ingested_at", "observation_id").limit(100).select("observation_id")


@query("top_source_names", "SELECT incident_id, concat(array_to_string(list_slice(p, 1, 3), ', '), CASE WHEN len(p) > 3 THEN concat(' +', len(p) - 3) ELSE '' END) AS names FROM (SELECT incident_id, list_sort(list_distinct(list(provider_id))) AS p FROM m GROUP BY incident_id)")
def top_source_names(spark, sf_dir):
    p = members(observations(spark, sf_dir)).groupBy("incident_id").agg(F.sort_array(F.collect_set("provider_id")).alias("p"))
    more = F.when(F.size("p") > 3, F.concat(F.lit(" +"), (F.size("p") - 3).cast("string"))).otherwise("")
    return p.select("incident_id", F.concat(F.array_join(F.slice("p", 1, 3), ", "), more).alias("names"))


# Windows


@query("win_row_number", "SELECT incident_id, observation_id, row_number() OVER (PARTITION BY incident_id ORDER BY observation_id) AS n FROM m")
def win_row_number(spark, sf_dir):
    return members(observations(spark, sf_dir)).select("incident_id", "observation_id", F.row_number().over(W.partitionBy("incident_id").orderBy("observation_id")).alias("n"))


@query("win_latest_per_key", "SELECT observation_id, event_id FROM l")
def win_latest_per_key(spark, sf_dir):
    return latest_observations(observations(spark, sf_dir)).select("observation_id", "event_id")


@query("win_latest_location", "SELECT incident_id, location_name FROM m WHERE location_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ingested_at DESC, observation_id) = 1")
def win_latest_location(spark, sf_dir):
    w = W.partitionBy("incident_id").orderBy(F.desc("ingested_at"), "observation_id")
    return members(observations(spark, sf_dir)).where(C("location_name").isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("incident_id", "location_name")


#: A revision without a known status stands for the loss of its source; what comes after a loss is an update, whatever the score.
_CHANGE = "CASE WHEN before IS NULL THEN 'new' WHEN status = 'unknown' THEN 'source_lost' WHEN status = 'cancelled' THEN 'cancelled' WHEN status = 'ended' THEN 'resolved' WHEN status_before = 'unknown' THEN 'updated' WHEN score >= before + 10 THEN 'escalated' WHEN score <= before - 10 THEN 'downgraded' ELSE 'updated' END"


def changes(spark, sf_dir):
    """Change type of each revision against the one before it."""
    w = W.partitionBy("observation_id").orderBy("revision")
    r = revisions(spark, sf_dir).withColumns({"before": F.lag("score").over(w), "status_before": F.lag("status").over(w)})
    return r.withColumn("change_type", F.expr(_CHANGE))


CHG = REV.rstrip() + f", chg AS (SELECT *, {_CHANGE} AS change_type FROM (SELECT *, lag(score) OVER w AS before, lag(status) OVER w AS status_before FROM rev WINDOW w AS (PARTITION BY observation_id ORDER BY revision)))\n"


@query("win_change_type", CHG + "SELECT event_id, revision, change_type FROM chg")
def win_change_type(spark, sf_dir):
    return changes(spark, sf_dir).select("event_id", "revision", "change_type")


#: Field -> what a change of it is called.
_DIFF = {"headline": "headline", "summary": "summary", "status": "status", "severity": "severity", "urgency": "urgency", "certainty": "certainty", "score": "priority", "place": "location", "source": "sources"}


@query("win_revision_diff", REV + "SELECT event_id, CASE WHEN revision = 1 THEN 'initial record' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER w THEN '{n}' END" for c, n in _DIFF.items()) + ") END AS changed FROM (SELECT *, {'x': lon, 'y': lat} AS place, concat(provider_id, k % 2) AS source FROM rev) WINDOW w AS (PARTITION BY observation_id ORDER BY revision)")
def win_revision_diff(spark, sf_dir):
    """Which of nine fields changed against the revision before; a source is a provider and one of its two feeds."""
    w = W.partitionBy("observation_id").orderBy("revision")
    r = revisions(spark, sf_dir).withColumns({"place": F.struct("lon", "lat"), "source": F.concat("provider_id", (C("k") % 2).cast("string"))})
    r = r.withColumn("was", F.lag(F.struct(*_DIFF)).over(w))
    changed = F.concat_ws(",", *(F.when(~C(c).eqNullSafe(C(f"was.{c}")), F.lit(n)) for c, n in _DIFF.items()))
    return r.select("event_id", F.when(C("revision") == 1, "initial record").otherwise(changed).alias("changed"))


@query("win_pct_change", ", d AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS close FROM orders GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, round(CASE WHEN lag(close) OVER (ORDER BY day) = 0 THEN 0 ELSE (close / lag(close) OVER (ORDER BY day) - 1) * 100 END, 6) AS pct FROM d")
def win_pct_change(spark, sf_dir):
    """Against the close before it. Days are few whatever the orders, so one ordered window over them is bounded."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))
    before = F.lag("close").over(W.orderBy("day"))
    return d.select(C("day").cast("string").alias("day"), F.round(F.when(before == 0, 0.0).otherwise((C("close") / before - 1) * 100), 6).alias("pct"))


_POLL = ", poll AS (SELECT event_id, user_id % 14 AS provider, event_type = 'error' AS failed FROM events), isl AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY event_id) AS g FROM poll)\n"


def polls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (C("user_id") % 14).alias("provider"), (C("event_type") == "error").alias("failed"))


@query("win_failure_streak", _POLL + "SELECT event_id, provider, n AS streak, n >= 3 AS open, n = 3 AS lost FROM (SELECT *, CASE WHEN failed THEN sum(CAST(failed AS INT)) OVER (PARTITION BY provider, g ORDER BY event_id) ELSE 0 END AS n FROM isl)")
def win_failure_streak(spark, sf_dir):
    s = failure_streaks(polls(spark, sf_dir))
    return s.select("event_id", "provider", "streak", (C("streak") >= 3).alias("open"), (C("streak") == 3).alias("lost"))


@query("win_rolling_last_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30")
def win_rolling_last_n(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 30").select("user_id", "event_id")


@query("win_new_since_last", ", b AS (SELECT *, event_id // 100 AS batch FROM o), q AS (SELECT * FROM b WHERE kind = 'earthquake'), r AS (SELECT * FROM b WHERE kind = 'weather_alert' AND severity = 'Extreme') SELECT 'quake' AS list, batch, event_id FROM q WHERE k >= 40 AND batch > 0 AND NOT EXISTS (SELECT 1 FROM q p WHERE p.batch = q.batch - 1 AND p.observation_id = q.observation_id) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY event_id) = 1 UNION ALL SELECT 'red', batch, event_id FROM r WHERE event_id > (SELECT min(event_id) FROM r) AND NOT EXISTS (SELECT 1 FROM r p WHERE p.batch = r.batch - 1 AND p.observation_id = r.observation_id)")
def win_new_since_last(spark, sf_dir):
    """Of each poll the first strong quake that the poll before didn't hold, and all such red alerts but the very first one seen."""
    o = observations(spark, sf_dir).select("event_id", "observation_id", "kind", "severity", "k", F.floor(C("event_id") / 100).alias("batch"))

    def fresh(rows, wanted):
        before = rows.select((C("batch") + 1).alias("batch"), "observation_id")
        return rows.where(wanted).join(before, ["batch", "observation_id"], "left_anti")

    quakes, red = o.where("kind = 'earthquake'"), o.where("kind = 'weather_alert' and severity = 'Extreme'")
    strong = fresh(quakes, "k >= 40 and batch > 0").withColumn("rn", F.row_number().over(W.partitionBy("batch").orderBy("event_id"))).where("rn = 1")
    first = F.broadcast(red.agg(F.min("event_id").alias("first")))  # one row
    new = fresh(red, "true").crossJoin(first).where("event_id > first")
    return strong.select(F.lit("quake").alias("list"), "batch", "event_id").unionByName(new.select(F.lit("red").alias("list"), "batch", "event_id"))


@query("win_block_advance", "SELECT event_id, k > max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS advanced FROM o")
def win_block_advance(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return observations(spark, sf_dir).select("event_id", (C("k") > F.max("k").over(w)).alias("advanced"))


@query("win_latest_valid", "SELECT user_id, arg_max(k, event_id) FILTER (k % 3 <> 0) AS value FROM o GROUP BY user_id")
def win_latest_valid(spark, sf_dir):
    raw = F.when(C("k") % 3 == 0, F.lit("n/a")).otherwise(C("k").cast("string")).try_cast("int")
    return observations(spark, sf_dir).select("user_id", "event_id", raw.alias("v")).groupBy("user_id").agg(F.max_by("v", F.when(C("v").isNotNull(), C("event_id"))).alias("value"))


# Set operations


@query("set_merge_feeds", "SELECT src, doc_id, ts FROM art ORDER BY ts DESC, doc_id LIMIT 60")
def set_merge_feeds(spark, sf_dir):
    a = articles(spark, sf_dir)
    feeds = [a.where(C("src") == f"feed_{k}").select(F.lit(f"feed_{k}").alias("src"), "doc_id", "ts") for k in range(3)]
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2]).orderBy(F.desc("ts"), "doc_id").limit(60)


@query("set_merge_defense", "SELECT src, doc_id, ts FROM art ORDER BY ts DESC, doc_id LIMIT 80")
def set_merge_defense(spark, sf_dir):
    a = articles(spark, sf_dir).select("src", "doc_id", "ts")
    return a.where("src = 'feed_0'").union(a.where("src = 'feed_1'")).union(a.where("src = 'feed_2'")).orderBy(F.desc("ts"), "doc_id").limit(80)


@query("set_merge_headlines", "SELECT doc_id FROM (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY src ORDER BY doc_id) <= 8) ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 40")
def set_merge_headlines(spark, sf_dir):
    """First eight of each feed, in an order that hashes shuffle alike on every run."""
    first = articles(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("doc_id"))).where("rn <= 8")
    return first.orderBy(F.sha2(C("doc_id").cast("string"), 256)).limit(40).select("doc_id")


@query("set_merge_trending", "SELECT 'a' AS list, doc_id FROM (SELECT doc_id FROM art WHERE src = 'feed_0' AND title <> '' ORDER BY ts DESC, doc_id LIMIT 8) UNION ALL SELECT 'b', doc_id FROM (SELECT doc_id FROM art WHERE src = 'feed_1' ORDER BY ts DESC, doc_id LIMIT 8)")
def set_merge_trending(spark, sf_dir):
    a = articles(spark, sf_dir)
    top = lambda df, n: df.orderBy(F.desc("ts"), "doc_id").limit(8).select(F.lit(n).alias("list"), "doc_id")
    return top(a.where("src = 'feed_0' and title <> ''"), "a").unionByName(top(a.where("src = 'feed_1'"), "b"))


_PARTS = {"click": "fees", "view": "blocks", "signup": "height", "purchase": "mempool"}


_PARTS_SQL = (
    ", p AS (SELECT user_id, " + ", ".join(f"arg_max(k, event_id) FILTER (event_type = '{t}') AS {n}" for t, n in _PARTS.items()) + " FROM o GROUP BY user_id), f AS (SELECT *, "
    + ", ".join(f"CASE WHEN {n} IS NULL THEN 'error' WHEN {n} % 11 = 0 THEN 'stale' WHEN {n} % 3 = 0 THEN 'cached' ELSE 'live' END AS {n}_state" for n in _PARTS.values())
    + " FROM p), g AS (SELECT *, [" + ", ".join(f"{n}_state" for n in _PARTS.values()) + "] AS s FROM f) SELECT user_id, "
    + ", ".join(f"CASE WHEN {n} % 5 <> 0 THEN {n} END AS {n}, {n}_state" for n in _PARTS.values())
    + ", CASE WHEN len(list_filter(s, lambda x: x <> 'error')) = 0 THEN 'error' WHEN list_contains(s, 'error') OR list_contains(s, 'stale') THEN 'stale' WHEN list_contains(s, 'cached') THEN 'cached' ELSE 'live' END AS freshness FROM g"
)


@query("set_join_endpoints", _PARTS_SQL)
def set_join_endpoints(spark, sf_dir):
    """Four endpoints' last answers folded into one row a user, each with its freshness; an answer that can't be read (every fifth number) is null."""
    p = observations(spark, sf_dir).groupBy("user_id").pivot("event_type", list(_PARTS)).agg(F.max_by("k", "event_id"))
    p = p.select("user_id", *(C(t).alias(n) for t, n in _PARTS.items()))
    state = lambda c: F.when(c.isNull(), "error").when(c % 11 == 0, "stale").when(c % 3 == 0, "cached").otherwise("live")
    p = p.withColumns({f"{n}_state": state(C(n)) for n in _PARTS.values()}).withColumn("s", F.array(*(f"{n}_state" for n in _PARTS.values())))
    has = lambda v: F.array_contains("s", v)
    fresh = F.when(F.forall("s", lambda x: x == "error"), "error").when(has("error") | has("stale"), "stale").when(has("cached"), "cached").otherwise("live")
    return p.select("user_id", *(x for n in _PARTS.values() for x in (F.when(C(n) % 5 != 0, C(n)).alias(n), C(f"{n}_state"))), fresh.alias("freshness"))


@query("set_unique_ordered", "SELECT user_id, array_to_string(list(kind ORDER BY f), ',') AS kinds FROM (SELECT user_id, kind, min(event_id) AS f FROM o GROUP BY ALL) GROUP BY user_id")
def set_unique_ordered(spark, sf_dir):
    first = observations(spark, sf_dir).groupBy("user_id", "kind").agg(F.min("event_id").alias("f"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("f", "kind"))), lambda x: x["kind"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("set_dedupe_batch", "SELECT event_id // 1000 AS batch, observation_id, max(event_id) AS event_id FROM o GROUP BY ALL")
def set_dedupe_batch(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(F.floor(C("event_id") / 1000).alias("batch"), "observation_id").agg(F.max("event_id").alias("event_id"))


@query("set_dedupe_hash", "SELECT event_id FROM o QUALIFY content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY observation_id ORDER BY ingested_at, event_id)")
def set_dedupe_hash(spark, sf_dir):
    w = W.partitionBy("observation_id").orderBy("ingested_at", "event_id")
    return observations(spark, sf_dir).withColumn("was", F.lag("content_hash").over(w)).where(~C("content_hash").eqNullSafe(C("was"))).select("event_id")


@query("set_merge_changes", "SELECT observation_id, max(event_id) AS cursor FROM o GROUP BY observation_id")
def set_merge_changes(spark, sf_dir):
    """A change feed laid over a snapshot, the highest cursor of each id wins."""
    o = observations(spark, sf_dir).select("observation_id", C("event_id").alias("cursor"))
    both = o.where("cursor % 2 = 0").unionByName(o.where("cursor % 2 = 1"))
    return both.groupBy("observation_id").agg(F.max("cursor").alias("cursor"))

