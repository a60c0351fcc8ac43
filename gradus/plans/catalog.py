"""Every registered query with its SQL twin, gathered from the plan modules."""

from __future__ import annotations

from gradus.plans import artifact_plans, curriculum_plans, evaluation_plans, extraction_plans, integrity_plans, log_plans, selection_plans, star_plans

_MODULES = (artifact_plans, curriculum_plans, evaluation_plans, extraction_plans, integrity_plans, log_plans, selection_plans, star_plans)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    if QUERIES.keys() & _m.R.queries.keys():
        raise ValueError("a query name is used twice")
    QUERIES |= _m.R.queries
    ORACLE_SQL |= _m.R.sql

FLAGSHIP = "continual_metrics"
