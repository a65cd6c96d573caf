"""Queries by name with their DuckDB counterparts."""

from __future__ import annotations

from factorlake.plans import model_queries, panel_queries, risk_queries, stream_queries

QUERIES: dict = panel_queries.QUERIES | risk_queries.QUERIES | model_queries.QUERIES | stream_queries.QUERIES
ORACLES: dict = panel_queries.ORACLES | risk_queries.ORACLES | model_queries.ORACLES | stream_queries.ORACLES
