"""Every query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lexloom.plans import cluster_queries, corpus_queries, learning_queries, relation_queries, search_queries, service_queries, source_queries, text_queries, vector_queries  # noqa: F401  (each module registers its queries)
from lexloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
