"""All core queries by name, and the SQL of those that have one."""

from __future__ import annotations

from paperloom.plans import answer_queries, check_queries, more_queries, registry, retrieval_queries, table_queries, text_queries  # noqa: F401
from paperloom.plans.registry import Query

FLAGSHIP = "hybrid_retrieve"


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
