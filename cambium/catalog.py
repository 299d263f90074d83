"""Names of queries, what they run, and the same in DuckDB SQL."""

from __future__ import annotations

from cambium.plans import cohort_queries, duplicate_queries, label_queries, report_queries, scoring_queries, task_queries

FLAGSHIP = "duplicate_summary"
_parts = (duplicate_queries.catalog, label_queries.catalog, cohort_queries.catalog, report_queries.catalog, scoring_queries.catalog, task_queries.catalog)
QUERIES = {k: v for part in _parts for k, v in part.queries.items()}
ORACLES = {k: v for part in _parts for k, v in part.oracles.items()}
