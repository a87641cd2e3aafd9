"""State strictly before an event, without state machines.

prior          one row per event: rows before it in its partition
prior_range    rows that share an order value don't see each other: members of one list
before         sums, counts and maxima over the rows of the same keys before, in two levels where keys may be hot
as_of          updates and probes with different keys: their union, and before() of it
last_n         the last n values before
first_seen     sets that only grow, as the first time of each element
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Input of so many bytes counts as one range: no key of a smaller input holds more rows than a task takes.
RANGE_BYTES = 1 << 30
MOST_RANGES = 100_000
#: name -> (kind, column): what is aggregated. Kinds are those of _FOLDS.
Aggregates = Mapping[str, tuple[str, str]]
_FOLDS = {"sum": F.sum, "count": F.count, "max": F.max}


def prior(*keys: str, order: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def prior_range(*keys: str, order: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that *df* is made of, from its plan: nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def before(rows: DataFrame, keys: Sequence[str], aggregates: Aggregates, order: str = "seq", ranges: int | None = None) -> DataFrame:
    """*rows* with aggregates over the rows of the same keys with a strictly smaller order value; nulls are skipped.

    Where one key may hold a large share of all rows, the order is cut into *ranges* of equal width (by default as many as the input
    has RANGE_BYTES): what lies inside a range comes from a window over (keys, range), what came before it from a window over the ranges'
    totals, of which there are few for each key. No task then holds more rows of a key than one range has. The result is the same for any number.
    """
    n = ranges or min(MOST_RANGES, -(-input_bytes(rows) // RANGE_BYTES))
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first() if n > 1 else None
    if not ends or ends["low"] is None:
        return rows.withColumns({name: _FOLDS[kind](c).over(prior_range(*keys, order=order)) for name, (kind, c) in aggregates.items()})
    width = (ends["high"] - ends["low"]) // n + 1
    cut = rows.withColumn("_range", F.expr(f"(`{order}` - {ends['low']}L) div {width}L"))
    inner = prior_range(*keys, "_range", order=order)
    within = cut.withColumns({f"_in_{name}": _FOLDS[kind](c).over(inner) for name, (kind, c) in aggregates.items()})
    totals = cut.groupBy(*keys, "_range").agg(*[_FOLDS[kind](c).alias(f"_past_{name}") for name, (kind, c) in aggregates.items()])
    # Counts of ranges are added up, sums and maxima folded again.
    past = totals.withColumns({f"_past_{name}": _FOLDS["sum" if kind == "count" else kind](f"_past_{name}").over(prior(*keys, order="_range")) for name, (kind, _) in aggregates.items()})
    same = [within[k].eqNullSafe(past[k]) for k in (*keys, "_range")]
    joined = within.join(past, same, "left").select(*[within[c] for c in within.columns], *[past[f"_past_{name}"] for name in aggregates])

    def both(name: str, kind: str) -> Column:
        here, there = F.col(f"_in_{name}"), F.col(f"_past_{name}")
        if kind == "max":
            return F.greatest(here, there)
        if kind == "count":
            return here + F.coalesce(there, F.lit(0))
        return F.coalesce(here + there, here, there)

    return joined.select(*rows.columns, *[both(name, kind).alias(name) for name, (kind, _) in aggregates.items()])


def as_of(updates: DataFrame, probes: DataFrame, keys: Sequence[str], aggregates: Aggregates, order: str = "seq", ranges: int | None = None) -> DataFrame:
    """*probes* with aggregates over updates of the same keys with a strictly smaller order value.

    The aggregated columns are those of *updates* and must not be columns of *probes*.
    """
    values = list(dict.fromkeys(c for _, c in aggregates.values()))
    carried = [c for c in probes.columns if c not in keys and c != order]
    kinds = dict(probes.dtypes) | dict(updates.dtypes)
    u = updates.select(*keys, order, *values, *[F.lit(None).cast(kinds[c]).alias(c) for c in carried], F.lit(False).alias("_probe"))
    p = probes.select(*keys, order, *[F.lit(None).cast(kinds[v]).alias(v) for v in values], *carried, F.lit(True).alias("_probe"))
    return before(u.unionByName(p), keys, aggregates, order, ranges).filter("_probe").select(*probes.columns, *aggregates)


def last_n(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column], n: int, order: str = "seq") -> DataFrame:
    """*rows* with arrays of the last n values of the keys before, oldest first; nulls are no values.

    Each value carries the n values up to it, from a frame of n rows, and the array is that of the last value: nobody's whole past is collected.
    """
    out = rows
    for name, value in values.items():
        upto = Window.partitionBy(*keys, "_is").orderBy(order).rowsBetween(1 - n, 0)
        out = out.withColumn("_value", value).withColumn("_is", F.col("_value").isNotNull())
        out = out.withColumn("_upto", F.when(F.col("_is"), F.collect_list("_value").over(upto)))
        out = out.withColumn(name, F.coalesce(F.last("_upto", ignorenulls=True).over(prior(*keys, order=order)), F.array())).drop("_value", "_is", "_upto")
    return out


def first_seen(rows: DataFrame, *keys: str, order: str = "seq", name: str = "first_seq") -> DataFrame:
    """When each combination of keys came up first."""
    return rows.groupBy(*keys).agg(F.min(order).alias(name))


def new_flag(*keys: str, order: str = "seq") -> Column:
    """1 on the first row of each combination of keys, else 0: running sums of it count distinct values."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1).cast("int")


def islands(changed: Column, window: WindowSpec) -> Column:
    """Numbers runs: a running count of changes."""
    return F.sum(F.coalesce(changed.cast("int"), F.lit(0))).over(window)
