"""Query plans over the views, each beside its oracle SQL."""

from . import aggregates, coastal, filters, ingest, joins, relations, scalars, shapes, sinks, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "coastal", "filters", "ingest", "joins", "relations", "scalars", "shapes", "sinks", "streams"]
