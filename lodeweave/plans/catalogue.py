"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from lodeweave.plans import decision_plans, evaluation_plans, evidence_plans, lifecycle_plans, retrieval_plans, review_plans, text_plans

_MODULES = (text_plans, retrieval_plans, decision_plans, review_plans, evidence_plans, lifecycle_plans, evaluation_plans)


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
