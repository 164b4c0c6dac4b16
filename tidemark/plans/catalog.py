"""The registered queries over the bar tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import bars_queries, evidence_queries, report_queries, studies, trade_queries

PARTS = (bars_queries, trade_queries, evidence_queries, report_queries, studies)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
