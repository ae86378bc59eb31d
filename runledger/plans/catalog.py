"""All registered queries."""

from __future__ import annotations

from runledger.plans import registry
from runledger.plans import check_queries, evidence_queries, graph_queries, ingest_queries, lineage_queries, normalize_queries, stream_queries, timeline_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
