"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import gate_queries, graph_queries, record_queries, retrieval_queries, scoring_queries

QUERIES: dict = retrieval_queries.QUERIES | scoring_queries.QUERIES | record_queries.QUERIES | gate_queries.QUERIES | graph_queries.QUERIES
ORACLES: dict[str, str] = retrieval_queries.ORACLES | scoring_queries.ORACLES | record_queries.ORACLES | gate_queries.ORACLES | graph_queries.ORACLES
