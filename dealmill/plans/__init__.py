"""Named queries over the domain, each with its DuckDB oracle where SQL can express it."""

from dealmill.plans import advanced, companies, evidence, extraction, graph, ingest, intelligence, lists, market, profiles, relational, reports, search, streams, telemetry

_MODULES = (market, relational, companies, profiles, advanced, evidence, lists, reports, search, graph, telemetry, extraction, ingest, intelligence, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
