"""As-of counters over lists, and 36 comparisons of each list member with its list.

Ratios are in hundredths, in single precision and truncated; a zero denominator gives NO_RATIO. Counters take all rows: test events, whose reference is
hidden, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import NO_COMPARISON, NO_RATIO, ratio100, single_divide, times
from asofkit.operators.prequential import before

TOPS = (3, 5, 7)


def counters(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """For each list member, counts of its item before: impressions, verified ones (down to the click), clicks, mean places (times 100) and top places."""
    place = F.when(F.col("idx") >= 0, F.col("idx"))
    clicked = F.col("rank") == place
    rows = obs.select(
        "seq", "rank", "item_id", F.lit(1).alias("imp"), (F.col("rank") <= F.coalesce(place, "n")).cast("int").alias("ver"), F.col("rank").alias("pos"),
        *[(F.col("rank") < t).cast("int").alias(f"t{t}") for t in TOPS], F.when(clicked, 1).alias("clk"), F.when(clicked, place).alias("cpos"),
    )
    sums = {"impressions": "imp", "verified": "ver", "clickouts": "clk", "pos": "pos", "cpos": "cpos"} | {f"top_{t}": f"t{t}" for t in TOPS}
    out = before(rows, ["item_id"], {f"_{k}": ("sum", c) for k, c in sums.items()})
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    mean = lambda s, n: F.when(zero(n) == 0, F.lit(NO_RATIO)).otherwise(times(single_divide(zero(s), zero(n)), 100))
    return out.select(
        "seq", "rank", "item_id", *[zero(c).alias(c) for c in ("impressions", "verified", "clickouts", *[f"top_{t}" for t in TOPS])], mean("pos", "impressions").alias("mean_rank"), mean("cpos", "clickouts").alias("clicked_mean_rank")
    )


def comparisons(counted: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Ratios of counters in ten-thousandths; NO_COMPARISON for a zero denominator."""
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(NO_COMPARISON)).otherwise(times(single_divide(F.col(a), F.col(b)), 10_000))
    return counted.select("seq", "rank", "item_id", *[ratio(a, b).alias(f"{a}_vs_{b}") for a, b in pairs])


def list_scores(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per event: each counter as a bar-joined list in list order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    grouped = counted.groupBy("seq").agg(ordered.alias("x"))
    joined = lambda c: F.array_join(F.transform(f"x.{c}", lambda v: v.cast("string")), "|").alias(c)
    return grouped.select("seq", *[joined(c) for c in columns])


def list_comparison(obs: DataFrame, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """The 36 comparisons of *value* at each place with the values of its list (or those of *names*)."""
    place = Window.partitionBy("seq").orderBy("rank")
    whole, before, after = (place.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    recent = place.rowsBetween(-3, 0)
    v, n = F.col(value), F.count(F.lit(1)).over(whole)
    out: dict[str, Column] = {"pure": v}

    def mean(c: Column, w) -> Column:
        return single_divide(F.sum(c).over(w), F.count(c).over(w))

    def against(c: Column, of: Column = v) -> Column:
        return ratio100(c, of)

    for label, w in (("", whole), ("_before", before), ("_after", after)):
        stats = {"mean": mean(v, w), "min": F.min(v).over(w), "max": F.max(v).over(w)}
        for s, c in stats.items():
            out[f"{s}{label}"] = times(c, 100) if s == "mean" else c
            out[f"{s}_vs_item{label}"] = against(c)
    for label, w in (("", whole), ("_before", before), ("_after", after)):
        lower = F.size(F.filter(F.collect_list(v).over(w), lambda x: x < v))
        out[f"value_rank{label}"] = lower
        out[f"value_rank_norm{label}"] = F.floor(100 * lower / F.count(F.lit(1)).over(w)).cast("int")
    first = F.when(F.col("rank") < 3, v)
    for s, c in (("min", F.min(first).over(whole)), ("max", F.max(first).over(whole)), ("mean", mean(first, whole))):
        out[f"first3_{s}_vs_item"] = against(c)
    values = F.collect_list(v).over(whole)
    for k in (-3, -2, -1, 1, 2):
        other = F.get(values, F.greatest(F.lit(0), F.least(F.col("rank") + k, n.cast("int") - 1)))
        out[f"vs_place_{'m' if k < 0 else 'p'}{abs(k)}"] = ratio100(v, other)
    for s, c in (("min", F.min(v).over(recent)), ("max", F.max(v).over(recent)), ("mean", mean(v, recent))):
        out[f"recent3_{s}_vs_item"] = against(c)
    return obs.select("seq", "rank", "item_id", *[c.alias(k) for k, c in out.items() if names is None or k in names])
