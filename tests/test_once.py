"""Costly columns are worked out once a row, not for each use or in a filter as well."""

import re

from vigilframe.plans.ingest import _build
from vigilframe.plans.shapes import fn_simplify
from vigilframe.sources.ingest import PROVIDERS
from vigilframe.views import observations


def times(df, what: str) -> int:
    return len(re.findall(what, df._jdf.queryExecution().optimizedPlan().toString()))


def test_items_and_moments_are_read_once(spark):
    o = observations(spark, "/root/testdata/sf0.001")
    buoys, advisories = (PROVIDERS[p](_build(p, o)) for p in ("ndbc_observations", "noaa_aviation_weather"))
    assert times(buoys, r"xmltostructs|from_xml") == 1
    assert times(buoys, r"regexp_extract_all\(said") == 2
    assert times(advisories.select("effective_at", "expires_at"), r"RLIKE\(\S*validTimeFrom") == 2


def test_strides_are_found_once_a_shape(spark):
    assert times(fn_simplify(spark, "/root/testdata/sf0.001"), "sequence\\(|strides|from_json") <= 4


def test_rules_read_events_once(spark):
    from vigilframe.plans import QUERIES

    for name in ("cor_pairs", "join_media"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "get_json_object" not in plan and "Relation" not in plan, name
