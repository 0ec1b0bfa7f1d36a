"""All queries of the ledger operators by name."""

from __future__ import annotations

from ledgerloom.plans import check_queries, flow_queries, metric_queries, text_queries, view_queries

_PARTS = (view_queries, metric_queries, check_queries, text_queries, flow_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
