"""Lookups of the data model as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CERTAINTIES, FILTER_KINDS, SEVERITIES, SEVERITY_POINTS, TAXONOMY, URGENCIES, URGENCY_POINTS


def _of(c: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in reversed(list(values.items())):
        out = F.when(c == k, v).otherwise(out)
    return out


def rank(c: Column, order: tuple[str, ...]) -> Column:
    """Place from the end; unknown values are the last."""
    return _of(c, {v: len(order) - 1 - i for i, v in enumerate(order)}, 0)


def severity_rank(c: Column) -> Column:
    return rank(c, SEVERITIES)


def urgency_rank(c: Column) -> Column:
    return rank(c, URGENCIES)


def certainty_rank(c: Column) -> Column:
    return rank(c, CERTAINTIES)


def severity_points(c: Column) -> Column:
    return _of(c, SEVERITY_POINTS, 0)


def urgency_points(c: Column) -> Column:
    return _of(c, URGENCY_POINTS, 0)


def lane(c: Column) -> Column:
    return _of(c, {k: v[0] for k, v in TAXONOMY.items()}, "optional_signal")


def retention_days(c: Column) -> Column:
    return _of(c, {k: v[1] for k, v in TAXONOMY.items()}, None)


def in_filter(c: Column, name: str) -> Column:
    return c.isin(*FILTER_KINDS[name]) if name in FILTER_KINDS else F.lit(True)


def provenance(kind: Column, urgency: Column, certainty: Column) -> Column:
    return (
        F.when(kind.isin("weather_alert", "tropical_cyclone", "tsunami"), "Warning")
        .when(kind == "aviation_hazard", "Official advisory")
        .when(kind == "disaster_declaration", "Administrative declaration")
        .when(kind.isin("marine_observation", "water_level", "fireball"), "Source measurement")
        .when(kind.isin("conflict_report", "humanitarian_report", "news_item"), "Media coverage")
        .when(kind == "aircraft", "Community signal")
        .when(kind.isin("market_snapshot", "technology_activity"), "Market / internet signal")
        .when((urgency == "Future") | certainty.isin("Possible", "Unlikely"), "Forecast")
        .otherwise("Observation")
    )


def bucket(c: Column, steps: list[tuple[float, str]], under: str) -> Column:
    """Name of the highest step that c reaches."""
    out = F.lit(under)
    for least, name in sorted(steps):
        out = F.when(c >= least, name).otherwise(out)
    return out
