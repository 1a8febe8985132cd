"""All registered queries with their check SQL."""

from __future__ import annotations

from prodseries.plans import core_queries, load_queries, quality_queries, report_queries

MODULES = (core_queries, load_queries, quality_queries, report_queries)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
