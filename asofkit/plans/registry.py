"""Where queries are registered by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asofkit.plans.prelude import FEED_E, FEED_M, FEED_O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, feed: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name. *sql* follows the common tables of *feed* ("o", "e" or "m"): more of them after a comma, or SELECT."""

    def register(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            start = {"o": f"WITH {FEED_O}", "e": f"WITH {FEED_E}", "m": f"WITH {FEED_M}", "": ""}[feed]
            ORACLES[name] = f"{start}{sql}"
        return f

    return register
