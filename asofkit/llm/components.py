"""Connected components by alternating stars, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of *edges* (u, v bigint); no rows for no edges.

    Large-star steps hang a node's larger neighbours on its least neighbour, small-star steps its smaller ones, until
    nothing changes. Each step is written to the shared folder. A node with a great many neighbours is a hot join key, which
    adaptive execution splits; its least neighbour is found by partial aggregation.
    """
    now = saved(_sorted(edges), "edges")
    state = _state(now)
    while state[0]:
        now = saved(_small(_large(now)), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v"), F.col("v"))).distinct()


def _sorted(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _sorted(both.filter("v > u").join(saved(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    edges = saved(edges, "edges")
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _sorted(others.union(least.select("u", F.col("m").alias("v"))))
