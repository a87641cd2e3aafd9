"""Transforms inside groups of rows (the members of one list), for ranking models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_features(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Rank minus one, ties at the larger place, both directions; a null has none."""
    up = lambda c, o: F.when(F.col(c).isNotNull(), F.count(c).over(Window.partitionBy(group).orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) - 1)
    return df.withColumns({f"{c}_rank_asc": up(c, F.col(c).asc()) for c in columns} | {f"{c}_rank_desc": up(c, F.col(c).desc_nulls_last()) for c in columns})


def lag_features(df: DataFrame, group: str, order: str, columns: Sequence[str], reach: int = 2) -> DataFrame:
    """The values *reach* places around, and what is between, 0 beyond the ends."""
    w = Window.partitionBy(group).orderBy(order)
    out = {}
    for c in columns:
        for k in range(1, reach + 1):
            for name, f in (("prev", F.lag), ("next", F.lead)):
                value = F.coalesce(f(c, k).over(w), F.lit(0))
                out[f"{c}_{name}_{k}"] = value
                out[f"{c}_{name}_{k}_diff"] = F.col(c) - value
    return df.withColumns(out)


def varying(df: DataFrame, group: str, columns: Sequence[str]) -> list[str]:
    """The columns with more than one value in some group."""
    per = df.groupBy(group).agg(*[(F.min(c) != F.max(c)).cast("int").alias(c) for c in columns])
    row = per.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if row and row[c]]


def normalised(df: DataFrame, group: str, column: str) -> DataFrame:
    """z-score (with one more in the deviation), minimum-maximum scale, centred value, and value over deviation + 1."""
    w = Window.partitionBy(group)
    x, sd = F.col(column).cast("double"), F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0))
    low, high, mean = F.min(column).over(w), F.max(column).over(w), F.avg(column).over(w)
    return df.withColumns({"zscore": (x - mean) / (sd + 1), "minmax": F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)), "centred": x - mean, "by_sd": x / (sd + 1)})


def value_at_rank(df: DataFrame, group: str, order: str, columns: Sequence[str], k: int, difference: bool = True) -> DataFrame:
    """The value of the row at place *k* of its group, and what each is above it."""
    w = Window.partitionBy(group)
    at = {f"{c}_rank_{k}": F.max(F.when(F.col(order) == k, F.col(c))).over(w) for c in columns}
    out = df.withColumns(at)
    return out.withColumns({f"{c}_minus_rank_{k}": F.col(c) - F.col(f"{c}_rank_{k}") for c in columns}) if difference else out


def divided_by_rank(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_by_rank": F.col(c) / (F.col(order) + 1) for c in columns})
