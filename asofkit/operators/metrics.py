"""Ranking metrics, prediction blending and submissions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))


def reciprocal_ranks(df: DataFrame, group: str, score: str, clicked: str, tie: str = "item_id", no_click: str = "drop", single: bool = False) -> DataFrame:
    """One row per group: 1 / (place of the first clicked row by descending score). Groups without a click are dropped, or count 1 / their size ("size"). *single*: in single precision."""
    per = _placed(df, group, score, tie).groupBy(group).agg(F.min(F.when(F.col(clicked) == 1, F.col("_place"))).alias("p"), F.count(F.lit(1)).alias("n"))
    if no_click == "drop":
        per = per.filter("p is not null")
    rr = 1 / F.coalesce("p", "n")
    return per.select(group, (rr.cast("float") if single else rr).alias("rr"))


#: Ranges between the least and the greatest score.
_RANGES = 4_096


def auc(df: DataFrame, score: str, clicked: str) -> DataFrame:
    """Area under the ROC curve in one row, from counts by score: ties count half.

    Scores are aggregated first and cut into _RANGES ranges, whose totals go through one small window; no task sees all scores.
    """
    ends = df.agg(F.min(score).cast("double").alias("a"), F.max(score).cast("double").alias("b")).first()
    span = (ends["b"] - ends["a"]) or 1.0 if ends["a"] is not None else 1.0
    place = F.least(F.floor((F.col(score) - F.lit(ends["a"] or 0.0)) / F.lit(span) * _RANGES), F.lit(_RANGES - 1))
    counts = df.groupBy(score).agg(F.sum(F.col(clicked)).alias("pos"), F.sum(1 - F.col(clicked)).alias("neg")).withColumn("_range", place)
    totals = counts.groupBy("_range").agg(F.sum("neg").alias("t"))
    before = totals.select("_range", F.coalesce(F.sum("t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("inside", inside).join(F.broadcast(before), "_range")
    wins = F.sum(F.col("pos") * (F.col("inside") + F.col("before") + F.col("neg") / 2))
    return ranked.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def exact_quantile(df: DataFrame, column: str, q: float, few: int = 10_000) -> float | None:
    """The q-quantile of an integer column, interpolated between neighbours; null without rows.

    Counts by range narrow the search until few rows or one value are left: nowhere do all values meet.
    """
    row = df.agg(F.count(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    if not row["n"]:
        return None
    place = q * (row["n"] - 1)

    def at(k: int) -> int:
        low, high, skip = row["a"], row["b"], k
        while low < high:
            part = df.filter(F.col(column).between(low, high))
            width = (high - low) // 1_024 + 1
            counts = sorted(part.groupBy(F.expr(f"(`{column}` - {low}L) div {width}L").alias("r")).count().collect())
            for r, n in counts:
                if skip < n:
                    break
                skip -= n
            low, high = low + r * width, min(high, low + (r + 1) * width - 1)
            if n <= few:
                return sorted(x[0] for x in df.filter(F.col(column).between(low, high)).select(column).collect())[skip]
        return low

    below, above = at(int(place)), at(min(int(place) + 1, row["n"] - 1))
    return below + (above - below) * (place - int(place))


def blend(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(float(w))
    return df.withColumn("blend", total)


def recommendations(df: DataFrame, keys: Sequence[str], item: str, score: str) -> DataFrame:
    """One row per clickout: items joined by spaces, by descending score, then item."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["i"].cast("string")), " ").alias("item_recommendations"))


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int | None = 60, step: float = 0.25, close: float = 1e-3) -> np.ndarray:
    """Minimises *f* without derivatives; deterministic. Without a number of *rounds* it ends once all corners are within *close* of the best."""
    simplex = [np.array(start, float)] + [np.array(start, float) + step * np.eye(len(start))[i] for i in range(len(start))]
    values = [f(p) for p in simplex]
    for _ in range(rounds) if rounds is not None else itertools.count():
        if rounds is None and max(np.abs(p - simplex[int(np.argmin(values))]).max() for p in simplex) <= close:
            break
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        centre, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
        best = (values[-1], worst)
        for scale in (1.0, 2.0, 0.5, -0.5):  # reflect, expand, contract outside and inside
            point = centre + scale * (centre - worst)
            if scale == 2.0 and best[0] >= values[0] or abs(scale) == 0.5 and best[0] < values[-2]:
                continue
            if (value := f(point)) < best[0]:
                best = (value, point)
        if best[0] < values[-1]:
            values[-1], simplex[-1] = best
        else:
            simplex = [simplex[0]] + [(p + simplex[0]) / 2 for p in simplex[1:]]
            values = [values[0]] + [f(p) for p in simplex[1:]]
    return simplex[int(np.argmin(values))]


def powell(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int | None = 12, step: float = 0.5, close: float = 1e-3) -> np.ndarray:
    """Minimises *f* by line searches along directions, the least useful of which gives way to the whole way of a round; deterministic. Without a number of *rounds* it ends once a round gains nothing or moves less than *close*."""
    point, value, ways = np.array(start, float), f(np.array(start, float)), list(np.eye(len(start)))

    def along(p: np.ndarray, v: float, way: np.ndarray) -> tuple[np.ndarray, float]:
        size = step
        while size > close:
            tried = [(f(p + t * way), t) for t in (size, -size)]
            best, t = min(tried)
            if best < v:
                p, v = p + t * way, best
            else:
                size /= 2
        return p, v

    for _ in range(rounds) if rounds is not None else itertools.count():
        begun, gains = (point, value), []
        for way in ways:
            before = value
            point, value = along(point, value, way)
            gains.append(before - value)
        moved = point - begun[0]
        if begun[1] - value <= 0 or np.abs(moved).max() <= close:
            break
        ways.pop(int(np.argmax(gains)))
        ways.append(moved / np.abs(moved).max())
    return point


def _blocks(df: DataFrame, scores: Sequence[str], group: str, clicked: str, tie: str) -> DataFrame:
    """Lists with a click, many to a row: sizes, hit (whether a member was clicked), none (whether a score of it is null) and scores (one behind the other), each as bytes; members are in the order of *tie*."""
    named = [f"s{i}" for i in range(len(scores))]
    member = F.struct(F.col(tie).alias("t"), *[F.col(c).cast("double").alias(s) for c, s in zip(scores, named)], F.coalesce(F.col(clicked) == 1, F.lit(False)).alias("hit"))
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("x")).filter(F.exists("x", lambda m: m["hit"]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [c.flatten() for c in batch.columns]
            if not len(cols[0]):
                continue
            sizes = np.diff(batch.columns[0].offsets.to_numpy()).astype(np.int32)
            values = [c.to_numpy(zero_copy_only=False) for c in cols]
            none = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in cols[1:]], axis=0)
            parts = [sizes, values[0].astype(bool), none, np.stack(values[1:]).astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["sizes", "hit", "none", "scores"])

    return lists.select("x.hit", *[f"x.{s}" for s in named]).mapInArrow(run, "sizes binary, hit binary, none binary, scores binary")


def _places_of(weights: np.ndarray):
    """For blocks of lists: p, n, how many lists have their first clicked member at place p by descending blend; equal blends are in the order that they stand in."""
    weights = [float(w) for w in weights]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for sizes, hit, none, scores in zip(batch["sizes"], batch["hit"], batch["none"], batch["scores"]):
                sizes, hit, none = np.frombuffer(sizes, np.int32), np.frombuffer(hit, bool), np.frombuffer(none, bool)
                value = np.zeros(len(hit))
                for w, s in zip(weights, np.frombuffer(scores, np.float64).reshape(len(weights), -1)):
                    value = value + s * w
                value = np.where(none, -np.inf, np.where(np.isnan(value), np.inf, value))
                begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                best = np.repeat(np.maximum.reduceat(np.where(hit, value, -np.inf), begin), sizes)
                at = np.arange(len(hit))
                first = np.repeat(np.minimum.reduceat(np.where(hit & (value == best), at, len(hit)), begin), sizes)
                p, n = np.unique(1 + np.add.reduceat(((value > best) | (value == best) & (at < first)).astype(np.int32), begin), return_counts=True)
                yield pd.DataFrame({"p": p.astype(np.int32), "n": n.astype(np.int64)})

    return run


def fit_blend(df: DataFrame, scores: Sequence[str], group: str, clicked: str, rounds: int | None = None, tie: str = "item_id", method: str = "simplex") -> dict[str, float]:
    """Weights that maximise the mean reciprocal rank, found by Nelder-Mead, until its simplex is small, or, with "lines", by searches along conjugate directions, until none gains (or after so many *rounds*); lists are gathered once, and each try is a pass over them without a shuffle of rows."""

    blocks = _blocks(df, scores, group, clicked, tie).persist()

    def loss(w: np.ndarray) -> float:
        places = sorted(map(tuple, blocks.mapInPandas(_places_of(w), "p int, n bigint").groupBy("p").agg(F.sum("n")).collect()))
        return -sum(n / p for p, n in places) / max(1, sum(n for _, n in places))

    start = np.full(len(scores), 1 / len(scores))
    try:
        found = powell(loss, start, rounds) if method == "lines" else nelder_mead(loss, start, rounds)
    finally:
        blocks.unpersist()
    return dict(zip(scores, found.tolist()))
