"""Batch tables that features look up: prices, ranks, percentiles, ratings, transitions, sets, dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import is_numeric, time_bucket


def rank_max(order: Column, *keys: str) -> Column:
    """Rank in which ties share the largest place."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))


def mean_prices(obs: DataFrame) -> DataFrame:
    return obs.groupBy("item_id").agg(F.avg("price").alias("mean_price"))


def price_ranks(obs: DataFrame) -> DataFrame:
    """Distinct (item, price) with ranks and ranges among the item's prices."""
    whole = Window.partitionBy("item_id")
    d = obs.select("item_id", "price").distinct()
    low, high, n = F.min("price").over(whole), F.max("price").over(whole), F.count(F.lit(1)).over(whole)
    up = rank_max(F.col("price").asc(), "item_id")
    return d.select(
        "item_id", "price", up.alias("price_rank_asc"), rank_max(F.col("price").desc(), "item_id").alias("price_rank_desc"), (up / n).alias("price_rank_asc_pct"),
        low.alias("min_price"), high.alias("max_price"), n.alias("count_price"), F.try_divide("price", low).alias("price_relative_to_min"),
        (high - low).alias("price_range"), F.try_divide(high, low).alias("price_range_div"),
    )


def price_percentiles(obs: DataFrame, key: str) -> DataFrame:
    """For each (key, price): the average rank of the price among distinct (city, platform, item, price) of the key, as a share."""
    d = obs.select("city", "platform", "item_id", "price").distinct()
    counts = d.groupBy(key, "price").agg(F.count(F.lit(1)).alias("c"))
    # Ranks of tied rows from counts by price: the window has a row for each price of a key, not for each item.
    w = Window.partitionBy(key).orderBy("price")
    before = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("c").over(Window.partitionBy(key))
    return counts.select(key, "price", ((before + (F.col("c") + 1) / 2) / total).alias("pct"))


def dominance_ratings(events: DataFrame, score: Column) -> DataFrame:
    """wins / (wins + losses) of items over distinct ordered pairs (above, below) of lists; *score* filters events."""
    pairs = events.filter(score).select(
        F.explode(F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("above"), b.alias("below")))))).alias("p")
    ).select("p.*").distinct()
    sides = pairs.select(F.col("above").alias("item_id"), F.lit(1).alias("win")).union(pairs.select("below", F.lit(0)))
    return sides.groupBy("item_id").agg((F.sum("win") / F.count(F.lit(1))).alias("rating"))


def transition_probabilities(events: DataFrame, *extra: str, limit_s: int = 120, offsets: tuple[int, int] = (-10, 10), absolute: bool = False) -> DataFrame:
    """P(offset of the next click | time bucket) inside runs of one user's clicks on one list, cells without a count count 1.

    Runs are consecutive clicks of a user on the same list. *extra* are further keys; with *absolute*, cells are (first place, next place).
    """
    by = Window.partitionBy("user_id").orderBy("seq")
    clicks = events.filter("idx >= 0")
    same = F.lag("list_key").over(by) == F.col("list_key")
    steps = clicks.select(*extra, "idx", same.alias("same"), F.lag("idx").over(by).alias("before"), (F.col("ts") - F.lag("ts").over(by)).alias("dt"))
    bucket = time_bucket(F.col("dt")).cast("int").alias("bucket")
    kept = steps.filter(F.coalesce("same", F.lit(False)) & (F.col("dt") <= limit_s))
    if absolute:
        kept, keys = kept.select(*extra, bucket, F.col("before").alias("place"), F.col("idx").alias("offset")), [*extra, "bucket", "place"]
    else:
        kept, keys = kept.select(*extra, bucket, (F.col("idx") - F.col("before")).alias("offset")), [*extra, "bucket"]
    counts = kept.groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("c"))
    cells = counts.select(*keys).distinct().withColumn("offset", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1]))))
    filled = cells.join(counts, [*keys, "offset"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    return filled.select(*keys, "offset", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).alias("prob"))


def item_sets(events: DataFrame, top: int | None = None) -> DataFrame:
    """item -> distinct labels of the searches that show it (among the first *top* places)."""
    items = F.slice("items", 1, top) if top else F.col("items")
    return events.select("label", F.explode(items).alias("item_id")).groupBy("item_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def dwell_times(actions: DataFrame) -> DataFrame:
    """How long users stay with a reference: seconds from the start of a run of equal references to the next run's in the session.

    Runs go on across sessions of a user; the last run of a session has no end. Numeric references only.
    """
    user = Window.partitionBy("user_id").orderBy("session_id", "seq")
    starts = actions.withColumn("new", F.coalesce(F.lag("reference").over(user) != F.col("reference"), F.lit(True))).filter("new")
    end = F.lead("ts").over(Window.partitionBy("user_id", "session_id").orderBy("seq"))
    times = starts.select("reference", (end - F.col("ts")).alias("dwell")).filter(F.col("dwell").isNotNull() & is_numeric("reference"))
    return times.groupBy("reference").agg(F.min("dwell").alias("dwell_min"), F.max("dwell").alias("dwell_max"), F.avg("dwell").alias("dwell_mean"), F.percentile("dwell", 0.5).alias("dwell_median"))


def loo_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """For each of the distinct users by keys and stat, how many others there are: leave-one-out counts. One row per user, no list of them."""
    members = rows.select(*keys, "stat", "user_id").distinct()
    sizes = members.groupBy(*keys, "stat").agg(F.count(F.lit(1)).alias("n"))
    return members.join(sizes, [*keys, "stat"]).select(*keys, "stat", "user_id", (F.col("n") - 1).alias("others"))


def property_codes(properties: DataFrame) -> DataFrame:
    """property -> dense code in alphabetical order, for item -> array<property>."""
    names = properties.select(F.explode("properties").alias("property")).distinct()
    # Codes come from ranges of names, so no task sees all of them: (rank inside a range) + (names in ranges before).
    ranged = names.withColumn("part", F.substring("property", 1, 1))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("property"))
    return ranged.withColumn("inside", inside).join(offsets, "part").select("property", (F.col("before") + F.col("inside") - 1).cast("int").alias("code"))


def dense_properties(items: DataFrame, scales: dict[str, dict[str, int]], flags: dict[str, str]) -> DataFrame:
    """One column for each scale (the value of the last matching name in its order, null without one) and each flag (0/1), and n_properties."""
    out = {"n_properties": F.size("properties")}
    for name, scale in scales.items():
        pick = F.lit(None).cast("int")
        for prop, value in scale.items():  # later names win
            pick = F.when(F.array_contains("properties", prop), F.lit(value)).otherwise(pick)
        out[name] = pick
    for name, prop in flags.items():
        out[name] = F.array_contains("properties", prop).cast("int")
    return items.withColumns(out)
