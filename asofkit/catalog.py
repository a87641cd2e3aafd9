"""All queries of the engine by name, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from asofkit.plans import files, mixed, prep, ranking, state
from asofkit.plans.registry import ORACLES, QUERIES, Query

__all__ = ["files", "mixed", "oracle_sql", "prep", "queries", "ranking", "state"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
