"""Prequential features: what was known strictly before an event, for each member of its list.

ev has one row per event (seq, user_id, session_id, ts, items, prices, reference, idx, is_test, ...), obs one per event and list member
(rank, item_id, price, was_clicked), ac one per action (action_type, reference). Test events look but don't change anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import ACTION_LETTERS, ITEM_ACTIONS, MISSING, UNKNOWN, action_letter, jaccard, leading_int, list_key, sorted_key, time_bucket
from asofkit.operators.prequential import as_of, before, first_seen, input_bytes, last_n, new_flag, prior
from asofkit.sources.work import cleaned, written


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def clicks(ev: DataFrame, *carry: str) -> DataFrame:
    """Click updates of train events: seq, item_id, click (1) and *carry*."""
    return ev.filter("is_test = 0 and reference is not null").select("seq", F.col("reference").alias("item_id"), F.lit(1).alias("click"), *carry)


def counts_before(updates: DataFrame, probes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """*probes* with the number of updates of the same keys before."""
    marked = updates.select(*keys, "seq", F.lit(1).alias("_one"))
    return as_of(marked, probes, keys, {name: ("count", "_one")})


def marked(ev: DataFrame, obs: DataFrame, *carry: str) -> DataFrame:
    """Shown items as updates and probes at once: seq, rank, item_id, *carry*, imp and clk (1 or 0, only of train events).

    A click is marked on the first place of the item; one on an item that the list doesn't hold is a row without a rank, which is no probe.
    """
    train = F.col("is_test") == 0
    shown = obs.select("seq", "rank", "item_id", *carry, train.cast("int").alias("imp"), (train & (F.col("rank") == F.col("idx"))).cast("int").alias("clk"))
    strays = ev.filter("is_test = 0 and reference is not null and idx < 0")
    return shown.unionByName(strays.select("seq", F.lit(None).cast("int").alias("rank"), F.col("reference").alias("item_id"), *carry, F.lit(0).alias("imp"), F.lit(1).alias("clk")))


# ---------------------------------------------------------------- click-through


def item_ctr(ev: DataFrame, obs: DataFrame, *keys: str) -> DataFrame:
    """clicks, impressions, corrected impressions (down to the clicked place) and ratios of each shown item, by further keys."""
    by = ["item_id", *keys]
    rows = marked(ev, obs, *keys, "idx").withColumn("cor", F.when(F.col("rank") <= F.col("idx"), F.col("imp")))
    out = before(rows, by, {"clicks": ("sum", "clk"), "impressions": ("sum", "imp"), "corrected": ("sum", "cor")}).filter("rank is not null")
    out = out.select("seq", "rank", *by, *[_zero(F.col(c)).alias(c) for c in ("clicks", "impressions", "corrected")])
    return out.withColumns({"ctr": F.col("clicks") / (F.col("impressions") + 1), "ctr_corr": F.col("clicks") / (F.col("corrected") + 1)})


def ctr_rank_weighted(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Clicks weigh their place + 1, impressions theirs."""
    rows = marked(ev, obs, "idx").withColumns({"w_imp": F.col("imp") * (F.col("rank") + 1), "w_clk": F.col("clk") * (F.col("idx") + 1)})
    out = before(rows, ["item_id"], {"weighted_clicks": ("sum", "w_clk"), "weighted_impressions": ("sum", "w_imp")}).filter("rank is not null")
    out = out.select("seq", "rank", "item_id", *[_zero(F.col(c)).alias(c) for c in ("weighted_clicks", "weighted_impressions")])
    return out.withColumn("ctr", F.col("weighted_clicks") / (F.col("weighted_impressions") + 1))


def ctr_in_sequence(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Clicks and impressions in last clickouts of sessions, and the mean reverse place of clicks (+1 in the denominator).

    The last clickout of a session is told by the whole session, the future too: an input, not a prior state.
    """
    rev = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("seq").desc()))
    last = ev.withColumn("rev", rev)
    lasts = last.filter("rev = 1").select("seq")
    shown = obs.filter("is_test = 0").join(lasts, "seq", "left_semi").select("item_id", "seq", F.lit(1).alias("imp"), F.lit(0).alias("clk"), F.lit(None).cast("int").alias("pos"))
    clicked = clicks(last, "rev").select("item_id", "seq", F.lit(0).alias("imp"), (F.col("rev") == 1).cast("int").alias("clk"), F.col("rev").alias("pos"))
    out = as_of(shown.unionByName(clicked), obs.select("seq", "rank", "item_id"), ["item_id"], {"clicks": ("sum", "clk"), "impressions": ("sum", "imp"), "places": ("sum", "pos"), "n": ("count", "pos")})
    out = out.withColumns({c: _zero(F.col(c)) for c in ("clicks", "impressions", "places", "n")})
    return out.select("seq", "rank", "item_id", "clicks", "impressions", (F.col("clicks") / (F.col("impressions") + 1)).alias("ctr"), (F.col("places") / (F.col("n") + 1)).alias("avg_reverse_place"))


def rank_based_ctr(ev: DataFrame, obs: DataFrame, credit: str = "last") -> DataFrame:
    """Smoothed click rates (+1 / +2) of the item at its place and the two beside, weighted .25, .5, .25; a missing side counts .3 above and .2 below.

    With credit "last" a click is booked on the last item of the list, at the clicked place, with "clicked" on the clicked item.
    """
    target = F.element_at("items", -1) if credit == "last" else F.col("reference")
    shown = obs.filter("is_test = 0").select("item_id", F.col("rank").alias("place"), "seq", F.lit(1).alias("imp"), F.lit(0).alias("clk"))
    clicked = ev.filter("is_test = 0 and idx >= 0").select(target.alias("item_id"), F.col("idx").alias("place"), "seq", F.lit(0).alias("imp"), F.lit(1).alias("clk"))
    probes = obs.select("seq", "rank", "item_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side")).withColumn("place", F.col("rank") + F.col("side"))
    out = as_of(shown.unionByName(clicked), probes, ["item_id", "place"], {"c": ("sum", "clk"), "i": ("sum", "imp")})
    rate = (_zero(F.col("c")) + 1) / (_zero(F.col("i")) + 2)
    size = obs.groupBy("seq").agg((F.max("rank") + 1).alias("size"))
    valued = out.join(size, "seq").withColumn("v", F.when(F.col("place") < 0, 0.3).when(F.col("place") >= F.col("size"), 0.2).otherwise(rate))
    return valued.groupBy("seq", "rank", "item_id").agg(F.sum(F.col("v") * F.when(F.col("side") == 0, 0.5).otherwise(0.25)).alias("rank_ctr"))


def place_counts(ev: DataFrame, obs: DataFrame, *keys: str) -> DataFrame:
    """How often the keys' clicks stood at this place."""
    updates = ev.filter("is_test = 0 and idx >= 0").select(*keys, F.col("idx").alias("rank"), "seq")
    return counts_before(updates, obs.select("seq", "item_id", *keys, "rank"), [*keys, "rank"], "n")


def item_average_rank(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Last and mean clicked place of the item in the user's session (+1 in the denominator), -1 without one."""
    keys = ["user_id", "session_id", "item_id"]
    updates = ev.filter("is_test = 0 and idx >= 0").select("user_id", "session_id", F.col("reference").alias("item_id"), "seq", F.col("idx").alias("place"), F.struct(F.col("seq").alias("at"), F.col("idx").alias("place")).alias("latest"))
    out = as_of(updates, obs.select(*keys, "seq", "rank"), keys, {"last": ("max", "latest"), "s": ("sum", "place"), "n": ("count", "place")})
    return out.select("seq", "rank", "item_id", F.coalesce("last.place", F.lit(-1)).alias("last_place"), F.when(F.col("n") > 0, F.col("s") / (F.col("n") + 1)).otherwise(-1.0).alias("avg_place"))


def fresh_rank(obs: DataFrame) -> DataFrame:
    """Mean place of the item over events of the first two steps of sessions (+1 in the denominator), and that minus the place."""
    fresh = F.when((F.col("step") <= 2) & (F.col("is_test") == 0), F.col("rank"))
    out = before(obs.select("seq", "rank", "item_id", fresh.alias("fresh")), ["item_id"], {"s": ("sum", "fresh"), "n": ("count", "fresh")})
    return out.select("seq", "rank", "item_id", (_zero(F.col("s")) / (F.col("n") + 1)).alias("fresh_place")).withColumn("fresh_place_minus_rank", F.col("fresh_place") - F.col("rank"))


def last_click_holders(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """In how many sessions the item is the one clicked last by now: a click adds one for its item and takes one from the session's former."""
    train = ev.filter("is_test = 0 and reference is not null")
    former = F.lag("reference").over(Window.partitionBy("session_id").orderBy("seq"))
    moved = train.select("seq", "reference", former.alias("former")).filter(F.col("former").isNull() | (F.col("former") != F.col("reference")))
    deltas = moved.select("seq", F.col("reference").alias("item_id"), F.lit(1).alias("d")).unionByName(moved.filter("former is not null").select("seq", F.col("former").alias("item_id"), F.lit(-1).alias("d")))
    return as_of(deltas, obs.select("seq", "rank", "item_id"), ["item_id"], {"holders": ("sum", "d")}).withColumn("holders", _zero(F.col("holders")))


def list_clicks(ev: DataFrame, obs_keyed: DataFrame, key: str) -> DataFrame:
    """Clicks on the item under the same list key before."""
    updates = ev.filter("is_test = 0 and reference is not null").select(key, F.col("reference").alias("item_id"), "seq")
    return counts_before(updates, obs_keyed.select("seq", "rank", key, "item_id"), [key, "item_id"], "n")


#: Rows of one list's key beyond which no task takes them all; they are counted where the rows come from so many bytes.
HOT_LIST = 5_000_000
COUNT_BYTES = 128 << 20


def list_clicks_of_others(ev: DataFrame, obs_keyed: DataFrame, key: str, update_key: str | None = None) -> DataFrame:
    """Clicks on the item under the same list key by other users, all clicks of others there, and their ratio (+1).

    Updates may go by another key of *ev*, such as that of the list as it was shown when it was left out. Keys of lists are long: rows go by their hash.
    What one session did before a list, and the members of one list, are a row until all rows of a list's key are together: then one shuffle serves
    all four counts, unless a key has more than HOT_LIST rows. In that case each count cuts the order into ranges.
    """
    hashed = lambda c: F.unhex(F.md5(F.col(c))).alias("_list")
    own = [c for c in ("user_id", "session_id") if c in ev.columns and c in obs_keyed.columns]
    member = lambda item, rank: F.collect_list(F.struct("seq", item.alias("item_id"), rank.cast("int").alias("rank"))).alias("m")
    did = ev.filter("is_test = 0 and reference is not null").groupBy(*own, hashed(update_key or key)).agg(member(F.col("reference"), F.lit(None)))
    shown = obs_keyed.groupBy(*own, "seq", hashed(key)).agg(member(F.col("item_id"), F.col("rank")))
    lists = written(did.select("_list", "user_id", "m")).unionByName(written(shown.select("_list", "user_id", "m")))  # one after the other: each removes its shuffles
    hot = input_bytes(lists) >= COUNT_BYTES and (lists.groupBy("_list").agg(F.sum(F.size("m")).alias("rows")).agg(F.max("rows")).first()[0] or 0) > HOT_LIST
    rows = (lists if hot else lists.repartition("_list")).select("_list", "user_id", F.inline("m"))
    rows = rows.withColumn("_one", F.when(F.col("rank").isNull(), 1))
    for name, keys in (("ai", ["_list"]), ("au", ["_list", "user_id"]), ("ci", ["_list", "item_id"]), ("cu", ["_list", "item_id", "user_id"])):
        rows = before(rows, keys, {name: ("count", "_one")}, ranges=None if hot else 1)
    out = rows.filter("rank is not null")
    return out.select("seq", "rank", "item_id", (F.col("ci") - F.col("cu")).alias("n"), (F.col("ai") - F.col("au")).alias("n_all"), ((F.col("ci") - F.col("cu")) / (F.col("ai") - F.col("au") + 1)).alias("ctr"))


def poi_ctr(obs: DataFrame, ev: DataFrame, ac_label: str) -> DataFrame:
    """Clicks, impressions and ratio of the item under the label that the user had before the event (UNK without)."""
    label = F.coalesce(F.lag(ac_label).over(Window.partitionBy("user_id").orderBy("seq")), F.lit(UNKNOWN))
    at = ev.select("seq", label.alias("label"))
    train = F.col("is_test") == 0
    rows = obs.join(at, "seq").select("seq", "rank", "item_id", "label", F.when(train, F.col("was_clicked")).alias("clk"), F.when(train, 1).alias("imp"))
    out = before(rows, ["label", "item_id"], {"c": ("sum", "clk"), "i": ("sum", "imp")})
    c, i = _zero(F.col("c")), _zero(F.col("i"))
    return out.select("seq", "rank", "item_id", "label", c.alias("clicks"), i.alias("impressions"), (c / (i + 1)).alias("ctr"))


def pairwise_ctr(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Wins and draws of adjacent pairs. At place 0 the pair on the left wraps to the last item.

    A pair (a, b) of neighbours is won by the clicked one, drawn if neither was. left_*: the pair that ends in the item, from its
    side; right_*: the pair that starts with it.
    """
    after = F.lead("item_id").over(Window.partitionBy("seq").orderBy("rank"))
    pairs = obs.select("seq", "rank", "is_test", F.col("item_id").alias("a"), after.alias("b"), "reference").filter("b is not null")
    hit = lambda c: F.coalesce(F.col(c) == F.col("reference"), F.lit(False))
    updates = pairs.filter("is_test = 0").select("a", "b", "seq", hit("a").cast("int").alias("wa"), (~hit("a") & hit("b")).cast("int").alias("wb"), (~hit("a") & ~hit("b")).cast("int").alias("dr"))
    sums = {"fa": ("sum", "wa"), "fb": ("sum", "wb"), "fd": ("sum", "dr")}
    place = Window.partitionBy("seq").orderBy("rank")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = obs.select("seq", "rank", F.coalesce(F.lag("item_id").over(place), F.last("item_id").over(whole)).alias("a"), F.col("item_id").alias("b"))
    right = obs.select("seq", "rank", F.col("item_id").alias("a"), after.alias("b")).filter("b is not null")
    lt = as_of(updates, left, ["a", "b"], sums).select("seq", "rank", F.col("b").alias("item_id"), _zero(F.col("fb")).alias("left_wins"), _zero(F.col("fa")).alias("left_losses"), _zero(F.col("fd")).alias("left_draws"))
    rt = as_of(updates, right, ["a", "b"], sums).select("seq", "rank", _zero(F.col("fa")).alias("right_wins"), _zero(F.col("fb")).alias("right_losses"), _zero(F.col("fd")).alias("right_draws"))
    return lt.join(rt, ["seq", "rank"], "left").na.fill(0, ["right_wins", "right_losses", "right_draws"])


# ---------------------------------------------------------------- users and sessions


def list_repeats(ev: DataFrame) -> DataFrame:
    """Whether the user's list before was the same, and how much of the list that one held."""
    w = Window.partitionBy("user_id").orderBy("seq")
    was = F.lag("items").over(w)
    return ev.select("seq", F.coalesce(sorted_key(was) == sorted_key("items"), F.lit(False)).cast("int").alias("same"), F.coalesce(F.size(F.array_intersect(was, "items")), F.lit(0)).alias("overlap"))


def in_previous_list(ev: DataFrame, obs: DataFrame) -> DataFrame:
    was = ev.select("seq", F.lag("items").over(Window.partitionBy("user_id").orderBy("seq")).alias("was"))
    return obs.join(was, "seq").select("seq", "rank", "item_id", F.coalesce(F.array_contains("was", F.col("item_id")), F.lit(False)).cast("int").alias("in_previous"))


def last_index(ev: DataFrame, obs: DataFrame, *keys: str, strict: bool = True) -> DataFrame:
    """Last clicked place of the keys minus the rank, MISSING without one. strict: place 0 is passed over, as a missing one is not."""
    value = F.when(F.col("is_test") == 0, F.nullif(F.col("idx"), F.lit(0)) if strict else F.col("idx"))
    at = ev.select("seq", F.last(value, ignorenulls=True).over(prior(*keys)).alias("was"))
    return obs.select("seq", "rank", "item_id").join(at, "seq").select("seq", "rank", "item_id", F.coalesce(F.col("was") - F.col("rank"), F.lit(MISSING)).alias("last_index"))


def since_same_list(ev: DataFrame, key: str) -> DataFrame:
    """Seconds since the user's last train event with the same list, 0 without one."""
    was = F.max(F.when(F.col("is_test") == 0, F.col("ts"))).over(prior("user_id", key))
    return ev.select("seq", _zero(F.col("ts") - was).alias("since"))


def last_place_same_list(ev: DataFrame, obs: DataFrame, key: str) -> DataFrame:
    """The rank less the last place that the user clicked in the same list, whatever it was; MISSING counts where there is none."""
    at = ev.select("seq", F.last(F.when(F.col("is_test") == 0, F.col("idx")), ignorenulls=True).over(prior("user_id", key)).alias("was"))
    return obs.select("seq", "rank", "item_id").join(at, "seq").select("seq", "rank", "item_id", (F.col("rank") - F.coalesce("was", F.lit(MISSING))).alias("last_place"))


def shown_before(obs: DataFrame, *keys: str) -> DataFrame:
    """How often train events have shown the item under the keys."""
    rows = obs.select("seq", "rank", "item_id", *keys, F.when(F.col("is_test") == 0, 1).alias("_one"))
    return before(rows, [*keys, "item_id"], {"n": ("count", "_one")}).select("seq", "rank", "item_id", "n")


def references_before(ac: DataFrame, obs: DataFrame, actions: Sequence[str] | None = None) -> DataFrame:
    """How many events before refer to the item, whoever's: of the given *actions*, or of any whose reference starts with its number."""
    did = ac.filter("is_test = 0").filter(F.col("action_type").isin(*actions) if actions else F.lit(True))
    updates = did.select((F.col("item") if actions else leading_int("reference")).alias("item_id"), "seq").filter("item_id is not null")
    return counts_before(updates, obs.select("seq", "rank", "item_id"), ["item_id"], "n")


def item_actions(ac: DataFrame, obs: DataFrame, action: str) -> DataFrame:
    """For each list member, how often and how long ago the user did *action* on it: n, since (0 without), signed_since (now - last, uncapped, null without) and whether it was the user's last one of that type."""
    did = ac.filter((F.col("action_type") == action) & (F.col("is_test") == 0) & F.col("item").isNotNull()).select("user_id", F.col("item").alias("item_id"), "seq", F.col("ts").alias("at"))
    out = as_of(did, obs.select("seq", "rank", "user_id", "item_id", "ts"), ["user_id", "item_id"], {"n": ("count", "at"), "last_at": ("max", "at")})
    latest = ac.select("seq", F.last(F.when((F.col("action_type") == action) & (F.col("is_test") == 0), F.col("item")), ignorenulls=True).over(prior("user_id")).alias("last_item"))
    out = out.join(latest, "seq")
    gap = F.col("ts") - F.col("last_at")
    return out.select("seq", "rank", "item_id", "n", F.least(_zero(gap), F.lit(1_000_000)).alias("since"), gap.alias("signed_since"), F.coalesce(F.col("last_item") == F.col("item_id"), F.lit(False)).cast("int").alias("was_last"))


def last_values(ac: DataFrame, values: dict[str, Column], default: str = UNKNOWN) -> DataFrame:
    """For each action the last non-null of each value of the user before."""
    w = prior("user_id")
    return ac.select("seq", *[F.coalesce(F.last(v, ignorenulls=True).over(w), F.lit(default)).alias(n) for n, v in values.items()])


def action_string(ac: DataFrame) -> DataFrame:
    """q, the letters of all the user's actions before, x: texts that grow with the user's log, as the feature is defined; n-grams of it are what models see."""
    letters = F.array_join(F.collect_list(action_letter("action_type")).over(prior("user_id")), "")
    return ac.select("seq", "action_type", F.concat(F.lit("q"), letters, F.lit("x")).alias("actions"))


def since_actions(ac: DataFrame) -> DataFrame:
    """Seconds since the user's last action of each type, null without one, also as JSON of those there are."""
    w = prior("user_id")
    since = {f"since_{x}": F.col("ts") - F.max(F.when(F.col("action_type") == name, F.col("ts"))).over(w) for name, x in ACTION_LETTERS.items() if name in ("clickout item", "filter selection", "interaction item deals", "interaction item info", "search for poi")}
    out = ac.select("seq", *[c.alias(n) for n, c in since.items()])
    return out.withColumn("as_json", F.to_json(F.struct(*[F.col(n).alias(n[-1]) for n in since])))


def starts(ac: DataFrame) -> DataFrame:
    """Seconds since the session's and the user's first event (0 at it), sessions so far, and filter selections so far."""
    s, u = prior("user_id", "session_id"), prior("user_id")
    fresh = ac.withColumn("new", new_flag("user_id", "session_id"))
    return fresh.select("seq", _zero(F.col("ts") - F.min("ts").over(s)).alias("since_session"), _zero(F.col("ts") - F.min("ts").over(u)).alias("since_user"), _zero(F.sum("new").over(u)).alias("sessions"), F.count(F.when(F.col("action_type") == "filter selection", 1)).over(u).alias("filters_used"))


def interaction_lists(ac: DataFrame) -> DataFrame:
    """The sorted distinct item ids of the user's, and of the session's, item actions before; references that are no numbers are 0. The lists are the feature; each frame keeps one set."""
    item = F.when(F.col("action_type").isin(*ITEM_ACTIONS), F.coalesce(F.col("reference").try_cast("bigint"), F.lit(0)))
    sets = lambda w: list_key(F.array_sort(F.collect_set(item).over(w)))
    return ac.select("seq", sets(prior("user_id")).alias("by_user"), sets(prior("user_id", "session_id")).alias("by_session"))


def all_filters(ev: DataFrame) -> DataFrame:
    """All distinct filters of the user before, sorted and joined by bars."""
    sets = F.collect_set("filters").over(prior("user_id"))
    return ev.select("seq", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(sets, lambda x: F.split(x, r"\|"))))), "|").alias("filters"))


def interactions(ac: DataFrame, action: str) -> DataFrame:
    """For each click on an item: how often, and how long ago (seconds, at most a million, 0 for never), the user did *action* on it; whether it was the last one."""
    probes = ac.filter(F.col("action_type") == "clickout item").select("user_id", "reference", "seq", "ts")
    did = ac.filter(F.col("action_type") == action)
    out = as_of(did.select("user_id", "reference", "seq", F.col("ts").alias("at")), probes, ["user_id", "reference"], {"n": ("count", "at"), "last_at": ("max", "at")})
    last = as_of(did.filter("reference is not null").select("user_id", "seq", F.struct(F.col("seq").alias("s"), F.col("reference").alias("ref")).alias("latest")), out, ["user_id"], {"was": ("max", "latest")})
    return last.select("seq", "n", F.least(_zero(F.col("ts") - F.col("last_at")), F.lit(1_000_000)).alias("since"), F.coalesce(F.col("was.ref") == F.col("reference"), F.lit(False)).cast("int").alias("was_last"))


def interaction_ctr(ac: DataFrame) -> DataFrame:
    """For each click: clicks on the item before over item actions on it before (+1)."""
    item = ac.filter(F.col("action_type").isin(*ITEM_ACTIONS)).withColumns({"one": F.lit(1), "click": (F.col("action_type") == "clickout item").cast("int")})
    out = before(item, ["reference"], {"c": ("sum", "click"), "i": ("count", "one")})
    c, i = _zero(F.col("c")), F.col("i")
    return out.filter("click = 1").select("seq", c.alias("clicks"), i.alias("actions"), (c / (i + 1)).alias("ctr"))


def distinct_interactions(ac: DataFrame, *keys: str) -> DataFrame:
    """For clicks: distinct over all references (+1), and the chance that this one is new: (distinct + 1) / (all + 2), or one minus that if it was seen."""
    item = ac.filter(F.col("action_type").isin(*ITEM_ACTIONS)).withColumn("new", new_flag(*keys, "reference"))
    w = prior(*keys)
    u, n = _zero(F.sum("new").over(w)), F.count(F.lit(1)).over(w)
    p = (u + 1) / (n + 2)
    return item.select("seq", "action_type", (u / (n + 1)).alias("uniq"), F.when(F.col("new") == 1, p).otherwise(1 - p).alias("prob")).filter("action_type = 'clickout item'").drop("action_type")


def attention_span(ac: DataFrame) -> DataFrame:
    """Mean seconds between changes of the reference in the session, -1 without one; whether the last reference has had less than one, two spans."""
    s = Window.partitionBy("user_id", "session_id").orderBy("seq")
    changed = F.lag("reference").over(s) != F.col("reference")
    gaps = ac.withColumn("start", F.when(F.coalesce(changed, F.lit(True)), F.col("ts"))).withColumn("run", F.last("start", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = gaps.withColumn("gap", F.when(F.coalesce(changed, F.lit(False)), F.col("ts") - F.col("run")))
    p = prior("user_id", "session_id")
    out = gaps.select("seq", "ts", F.avg("gap").over(p).alias("span"), "run")
    here = F.col("ts") - F.col("run")
    return out.select("seq", F.coalesce("span", F.lit(-1.0)).alias("span"), F.coalesce(here <= F.col("span"), F.lit(False)).cast("int").alias("within_1"), F.coalesce(here <= 2 * F.col("span"), F.lit(False)).cast("int").alias("within_2"))


def global_last_click(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Seconds since anybody's last click on the item, whether it was the same user, and the seconds only if it was another."""
    updates = ev.filter("is_test = 0 and reference is not null").select(F.col("reference").alias("item_id"), "seq", F.struct(F.col("seq").alias("s"), F.col("ts").alias("t"), F.col("user_id").alias("u")).alias("last"))
    out = as_of(updates, obs.select("seq", "rank", "item_id", "user_id", "ts"), ["item_id"], {"was": ("max", "last")})
    dt, same = F.col("ts") - F.col("was.t"), F.coalesce(F.col("was.u") == F.col("user_id"), F.lit(False))
    return out.select("seq", "rank", "item_id", dt.alias("since"), same.cast("int").alias("same_user"), F.when(~same, dt).alias("since_other"), F.col("was.u").alias("last_user"))


# ---------------------------------------------------------------- sequences


def click_sequence(ev: DataFrame, obs: DataFrame, missing_too: bool = True) -> DataFrame:
    """Minimum, maximum, mean, deviation (0 for one) and length of the session's clicked places before, the extremes also minus the rank; MISSING if none."""
    value = F.when(F.col("is_test") == 0, F.col("idx")) if missing_too else F.when(F.col("idx") >= 0, F.col("idx"))
    w = prior("user_id", "session_id")
    at = ev.select("seq", F.min(value).over(w).alias("lo"), F.max(value).over(w).alias("hi"), F.avg(value).over(w).alias("mean"), F.stddev_samp(value).over(w).alias("sd"), F.count(value).over(w).alias("n"))
    m = lambda c: F.when(F.col("n") > 0, c).otherwise(F.lit(MISSING))
    return obs.select("seq", "rank", "item_id").join(at, "seq").select("seq", "rank", "item_id", m(F.col("lo")).alias("lo"), m(F.col("hi")).alias("hi"), m(F.col("lo") - F.col("rank")).alias("lo_rel"), m(F.col("hi") - F.col("rank")).alias("hi_rel"), m(F.col("mean")).alias("mean"), m(F.coalesce("sd", F.lit(0.0))).alias("sd"), m(F.col("n")).alias("length"))


def click_sequence_gzip(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Compressed length of the session's clicked places with the rank added, and its ratio to that without; MISSING if there are none."""
    import gzip

    past = F.collect_list(F.when(F.col("is_test") == 0, F.col("idx"))).over(prior("user_id", "session_id"))
    members = obs.groupBy("seq").agg((F.max("rank") + 1).alias("size"))
    events = ev.select("seq", F.array_join(F.transform(past, lambda x: x.cast("string")), ",").alias("past")).join(members, "seq")

    @F.pandas_udf("base double, sizes array<double>")
    def packed(past: pd.Series, size: pd.Series) -> pd.DataFrame:
        length = lambda s: float(len(gzip.compress(s.encode(), mtime=0)))
        return pd.DataFrame([(length(p), [length(f"{p},{r}") for r in range(n)]) if p else (None, None) for p, n in zip(past, size)], columns=["base", "sizes"])

    at = obs.select("seq", "rank", "item_id").join(events.select("seq", packed("past", "size").alias("x")), "seq")
    size, none = F.get("x.sizes", F.col("rank")), F.lit(float(MISSING))
    return at.select("seq", "rank", "item_id", F.coalesce(size, none).alias("size"), F.coalesce(size / F.col("x.base"), none).alias("ratio"))


def last_places(ev: DataFrame, obs: DataFrame, n: int = 5) -> DataFrame:
    """The last n clicked places of the user, newest first, each minus the rank, the seconds since, and the length of the trailing run of clicks on this rank."""
    value = F.when((F.col("is_test") == 0) & (F.col("idx") >= 0), F.col("idx"))
    user = Window.partitionBy("user_id").orderBy("seq")
    at = ev.select("user_id", "seq", "ts", "idx", "is_test", value.alias("v"))
    at = last_n(at, ["user_id"], {"last": F.when(F.col("v").isNotNull(), F.struct("v", "ts"))}, n)
    # Runs of equal places: a click's place in its run is what a rank equal to it continues.
    starts = F.col("v").isNotNull() & ~F.coalesce(F.col("v") == F.last("v", ignorenulls=True).over(prior("user_id")), F.lit(False))
    at = at.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(user))
    length = F.when(F.col("v").isNotNull(), F.count("v").over(Window.partitionBy("user_id", "run").orderBy("seq")))
    at = at.withColumn("length", length).select("seq", "ts", F.reverse("last").alias("last"), F.last("length", ignorenulls=True).over(prior("user_id")).alias("length"))
    rows = obs.select("seq", "rank", "item_id").join(at, "seq")
    newest = lambda i: F.get("last", F.lit(i))["v"]
    cells = [c for i in range(n) for c in (newest(i).alias(f"place_{i}"), (newest(i) - F.col("rank")).alias(f"place_{i}_rel"), (F.col("ts") - F.get("last", F.lit(i))["ts"]).alias(f"since_{i}"))]
    return rows.select("seq", "rank", "item_id", *cells, F.when(newest(0) == F.col("rank"), F.col("length")).otherwise(0).cast("int").alias("consecutive"))


def last_actions(ac: DataFrame, n: int = 9) -> DataFrame:
    """The letters of the user's last n item actions before, newest first; an empty text beyond the first."""
    letter = F.when(F.col("action_type").isin(*ITEM_ACTIONS), F.concat(action_letter("action_type"), F.coalesce("reference", F.lit(""))))
    rows = last_n(ac, ["user_id"], {"last": letter}, n).select("seq", F.reverse("last").alias("last"))
    return rows.select("seq", F.lit("").alias("action_0"), *[F.coalesce(F.get("last", F.lit(i)), F.lit("")).alias(f"action_{i + 1}") for i in range(n)])


def recent_events(ac: DataFrame, n: int = 10) -> DataFrame:
    """For each clickout the user's last *n* train events of each type before, newest first: seq, letter columns of structs (ago, place), the
    same of all item actions (interactions), and the price lists of the last two clickouts (prices).

    ago is log(1 + seconds), place the place (from 1) of the event's item in the list shown next, null without one.
    """
    names = {v: k for k, v in ACTION_LETTERS.items()}
    train = F.col("is_test") == 0
    place = F.when(F.col("action_type").isin(*ITEM_ACTIONS) & (F.col("fake_idx") >= 0), F.col("fake_idx") + 1)
    rows = ac.withColumn("what", F.when(train, F.struct("ts", place.alias("place"))))
    upto = Window.partitionBy("user_id", "action_type", "is_test").orderBy("seq").rowsBetween(1 - n, 0)
    rows = rows.withColumn("upto", F.when(train, F.collect_list("what").over(upto)))
    rows = last_n(rows, ["user_id"], {"interactions": F.when(F.col("action_type").isin(*ITEM_ACTIONS), F.col("what"))}, n)
    rows = last_n(rows, ["user_id"], {"prices": F.when(train, F.col("prices"))}, 2)
    lists = [F.last(F.when(F.col("action_type") == name, F.col("upto")), ignorenulls=True).over(prior("user_id")).alias(x) for x, name in sorted(names.items())]
    found = rows.select("seq", "ts", "action_type", "interactions", F.reverse("prices").alias("prices"), *lists).filter("action_type = 'clickout item'")
    newest = lambda x: F.transform(F.reverse(F.coalesce(x, F.array())), lambda e: F.struct(F.log1p(F.greatest(F.col("ts") - e["ts"], F.lit(0)).cast("double")).alias("ago"), e["place"].alias("place")))
    return found.select("seq", *[newest(F.col(x)).alias(x) for x in sorted(names)], newest(F.col("interactions")).alias("interactions"), F.transform("prices", lambda p: F.transform(p, lambda x: F.log1p(x.cast("double")))).alias("prices"))


def tracker_json(ac: DataFrame, obs: DataFrame, n: int = 10) -> DataFrame:
    """recent_events() of each list member as JSON; places come with their distance from the rank (rel)."""
    recent = recent_events(ac, n)
    letters = [*sorted(ACTION_LETTERS.values()), "interactions"]
    against = lambda c: F.transform(c, lambda e: F.struct(F.round(e["ago"], 4).alias("ago"), e["place"], (F.col("rank") + 1 - e["place"]).alias("rel"))).alias(c)
    prices = F.transform("prices", lambda p: F.transform(p, lambda x: F.round(x, 4))).alias("prices")
    return obs.select("seq", "rank", "item_id").join(recent, "seq").select("seq", "rank", "item_id", F.to_json(F.struct(*[against(x) for x in letters], prices)).alias("tracker"))


def last_action_places(ac: DataFrame, obs: DataFrame, n: int = 9) -> DataFrame:
    """The session's last n item actions before, newest first, each as its type and the place of its item, and as its type and the rank less that place; empty beyond the first."""
    what = F.when(F.col("action_type").isin(*ITEM_ACTIONS) & (F.col("is_test") == 0), F.struct("action_type", "fake_idx"))
    last = last_n(ac, ["user_id", "session_id"], {"last": what}, n).filter("action_type = 'clickout item'").select("seq", F.reverse("last").alias("last"))
    rows = obs.select("seq", "rank", "item_id").join(last, "seq")
    at = lambda i: F.get("last", F.lit(i))
    text = lambda i, place: F.coalesce(F.concat(at(i)["action_type"], place.cast("string")), F.lit(""))
    cells = [c for i in range(n) for c in (text(i, at(i)["fake_idx"]).alias(f"action_{i + 1}"), text(i, F.col("rank") - at(i)["fake_idx"]).alias(f"action_{i + 1}_norm"))]
    return rows.select("seq", "rank", "item_id", F.lit("").alias("action_0"), F.lit("").alias("action_0_norm"), *cells)


def trends(ev: DataFrame, obs: DataFrame, key: str = "user_id") -> DataFrame:
    """Where the clicks of the user (or another *key*) are heading: the line through the first and last click, and the regression line, at the time of the last event, minus the rank.

    -1 where there are no two clicks, or no spread in time or place.
    """
    y = F.when((F.col("is_test") == 0) & (F.col("idx") >= 0), F.col("idx").cast("double"))
    day = (F.col("ts") / 86400).cast("double")
    x = F.when(y.isNotNull(), day)
    w = prior(key)
    at = ev.select(
        "seq", day.alias("now"), F.count(y).over(w).alias("n"), F.first(y, ignorenulls=True).over(w).alias("y0"), F.last(y, ignorenulls=True).over(w).alias("y1"), F.first(x, ignorenulls=True).over(w).alias("x0"), F.last(x, ignorenulls=True).over(w).alias("x1"),
        F.regr_slope(y, x).over(w).alias("slope"), F.avg(y).over(w).alias("my"), F.avg(x).over(w).alias("mx"), F.var_pop(y).over(w).alias("vy"), F.var_pop(x).over(w).alias("vx"),
    )
    line = F.when((F.col("n") > 1) & (F.col("x1") != F.col("x0")), F.col("y1") + (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")) * (F.col("now") - F.col("x1")))
    fit = F.when((F.col("n") > 1) & (F.col("vy") > 1e-9) & (F.col("vx") > 1e-9), F.col("my") + F.col("slope") * (F.col("x1") - F.col("mx")))
    rows = obs.select("seq", "rank", "item_id").join(at.select("seq", line.alias("line"), fit.alias("fit")), "seq")
    return rows.select("seq", "rank", "item_id", F.coalesce(F.col("line") - F.col("rank"), F.lit(-1.0)).alias("minmax"), F.coalesce(F.col("fit") - F.col("rank"), F.lit(-1.0)).alias("regression"))


# ---------------------------------------------------------------- prices and similarity


def price_similarity(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean absolute difference to the user's distinct clicked prices before, and the last of those minus the price; 1000 without any."""
    price = F.when((F.col("is_test") == 0) & (F.col("idx") >= 0), F.get("prices", F.col("idx")))
    w = prior("user_id")
    at = ev.select("seq", "items", "prices", F.collect_set(price).over(w).alias("seen"), F.last(price, ignorenulls=True).over(w).alias("last"))
    # Reckoned in the event's row, so that no list member carries the prices.
    far = lambda p: F.aggregate("seen", F.lit(0).cast("bigint"), lambda a, q: a + F.abs(q - p)) / F.size("seen")
    cells = F.transform("prices", lambda p: F.struct(p.alias("price"), F.when(F.size("seen") > 0, far(p)).alias("far")))
    rows = at.select("seq", "last", F.posexplode(F.arrays_zip(F.col("items").alias("item_id"), cells.alias("x"))).alias("rank", "y"))
    return rows.select("seq", "rank", "y.item_id", F.coalesce("y.x.far", F.lit(1000.0)).alias("mean_diff"), F.coalesce(F.col("last") - F.col("y.x.price"), F.lit(1000)).alias("last_diff"))


def price_features(ev: DataFrame, obs: DataFrame) -> DataFrame:
    """Within the list: the highest price minus this one, this one over the mean, flags for sorted lists and how far they are sorted."""
    mean = F.aggregate("prices", F.lit(0).cast("bigint"), lambda a, p: a + p) / F.size("prices")
    steps = F.transform(F.slice("prices", 2, F.greatest(F.size("prices") - 1, F.lit(0))), lambda p, i: p < F.get("prices", i))
    until = F.array_position(steps, F.lit(True))
    per = ev.select(
        "seq", F.array_max("prices").alias("high"), mean.alias("mean"), (F.array_sort("prices") == F.col("prices")).cast("int").alias("ascending"), (F.sort_array("prices", asc=False) == F.col("prices")).cast("int").alias("descending"),
        F.when(until == 0, F.size("prices") - 1).otherwise((until - 1).cast("int")).alias("sorted_until"), F.contains(F.col("filters"), F.lit("URGENT")).alias("asked"),
    )
    rows = obs.select("seq", "rank", "item_id", "price").join(per, "seq")
    return rows.select("seq", "rank", "item_id", (F.col("high") - F.col("price")).alias("below_max"), F.try_divide(F.col("price"), F.col("mean")).alias("vs_mean"), (F.col("price") % 100).alias("cents"), "ascending", "descending", "sorted_until", (F.col("rank") < F.col("sorted_until")).cast("int").alias("in_sorted"), (F.col("asked") & (F.col("ascending") == 0)).cast("int").alias("wrong_sorting"))


#: Similarities are averaged as integers, so that no sum depends on its order.
_UNIT = 10**12


#: Sets from so many bytes of files are compared once for each pair of items; smaller ones go with the rows.
SETS_BYTES = 64 << 20
#: The similarities of all pairs of so many sets are a table that fits into each task.
MOST_KINDS = 256


def set_similarity(ev: DataFrame, obs: DataFrame, sets: DataFrame, *keys: str, acts: DataFrame | None = None, by_pairs: bool | None = None) -> DataFrame:
    """Similarity of the item's property set to that of the item the user clicked last, and its mean over the items met before under *keys* (the user); 0 without any.

    *sets* maps item_id to an array of properties. Met are the items clicked, or those of the actions *acts* (seq, keys, reference). With
    *by_pairs* (by default where the sets come from SETS_BYTES or more) each pair of items is compared once and rows carry no sets. Where such
    sets are no more than MOST_KINDS different ones, each pair of those is compared instead, and no pair of items becomes a row.
    """
    many = input_bytes(sets) >= SETS_BYTES
    if by_pairs is None and many:
        sets = written(sets)
        with cleaned(ev.sparkSession):
            kinds = sets.select("properties").filter("properties is not null").distinct().limit(MOST_KINDS + 1).collect()
        if len(kinds) <= MOST_KINDS:
            return _similarity_by_kinds(ev, obs, sets, sorted((r["properties"] for r in kinds), key=str), keys or ("user_id",), acts)
    keys = keys or ("user_id",)
    click = F.when(F.col("is_test") == 0, F.col("reference"))
    last = ev.select("seq", F.last(click, ignorenulls=True).over(prior("user_id")).alias("last"))
    met = ev.filter("is_test = 0") if acts is None else acts
    seen = first_seen(met.filter("reference is not null"), *keys, "reference").withColumnRenamed("reference", "other")
    rows = obs.select("seq", "rank", "item_id", *keys).join(last, "seq")
    side = lambda item, p: sets.select(F.col("item_id").alias(item), F.col("properties").alias(p))
    similar = F.when(F.col("p").isNotNull(), F.round(jaccard("p", "q") * _UNIT).cast("bigint"))

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """Adds *name*: how similar item_id, whose set is p, and other are; null without other or p."""
        return pairs.join(side("other", "q"), "other", "left").withColumn(name, F.when(F.col("other").isNotNull(), similar)).drop("q")

    def with_met(rows: DataFrame) -> DataFrame:
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        return rows.alias("a").join(seen.alias("b"), [*same, F.col("b.first_seq") < F.col("a.seq")], "left").select("a.*", "b.other").drop(*keys)

    if many if by_pairs is None else by_pairs:
        each, lasts = with_met(rows), rows.select("seq", "rank", "item_id", F.col("last").alias("other"))
        pairs = each.select("item_id", "other").union(lasts.select("item_id", "other")).filter("other is not null").distinct()
        known = compared(pairs.join(side("item_id", "p"), "item_id", "left"), "s").drop("p")
        lasts = lasts.join(known, ["item_id", "other"], "left").select("seq", "rank", F.col("s").alias("s_last"))
        each = each.join(known, ["item_id", "other"], "left").join(lasts, ["seq", "rank"])
    else:
        to_last = compared(rows.join(side("item_id", "p"), "item_id", "left").withColumn("other", F.col("last")), "s_last").drop("other")
        each = compared(with_met(to_last.drop("p")).join(side("item_id", "p"), "item_id", "left"), "s")  # no set is shuffled
    sums = each.groupBy("seq", "rank", "item_id").agg(F.max("s_last").alias("l"), F.sum("s").alias("s"), F.count("s").alias("n"))
    mean = F.col("s") / (F.col("n") * F.lit(_UNIT))
    return sums.select("seq", "rank", "item_id", F.coalesce(F.col("l") / _UNIT, F.lit(0.0)).alias("to_last"), F.coalesce(F.when(F.col("n") > 0, mean), F.lit(0.0)).alias("to_seen"))


def _similarity_by_kinds(ev: DataFrame, obs: DataFrame, sets: DataFrame, kinds: list, keys: Sequence[str], acts: DataFrame | None) -> DataFrame:
    """set_similarity() where all sets are among *kinds*: what was met is an array for each of *keys*, of times and kinds, and a row adds up a table's numbers over it."""
    spark = ev.sparkSession
    table = spark.createDataFrame(list(enumerate(kinds, 1)), f"kind int, properties {dict(sets.dtypes)['properties']}")
    others = spark.createDataFrame([(0, None), *enumerate(kinds, 1)], f"other int, q {dict(sets.dtypes)['properties']}")  # 0: an item without a set
    scored = table.crossJoin(others).select("kind", F.struct("other", F.round(jaccard("properties", "q") * _UNIT).cast("bigint").alias("s")).alias("x"))
    sims = scored.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("sims"))
    coded = sets.join(F.broadcast(table), "properties").select("item_id", "kind")
    of = lambda rows, item: rows.join(coded.withColumnRenamed("item_id", item), item, "left")
    at = lambda when: F.collect_list(F.struct(F.col(when).alias("at"), _zero(F.col("kind")).alias("kind")))
    click = ev.filter("is_test = 0 and reference is not null")
    clicked = of(click.select("user_id", "seq", "reference"), "reference").groupBy("user_id").agg(at("seq").alias("clicked"))
    met = (ev.filter("is_test = 0") if acts is None else acts).filter("reference is not null")
    seen = of(first_seen(met, *keys, "reference"), "reference").groupBy(*keys).agg(at("first_seq").alias("met"))
    rows = of(obs.select("seq", "rank", "item_id", *dict.fromkeys(("user_id", *keys))), "item_id")
    rows = rows.join(written(seen), list(keys), "left").join(written(clicked), "user_id", "left").join(F.broadcast(sims), "kind", "left")
    earlier = lambda c: F.filter(c, lambda x: x["at"] < F.col("seq"))
    rows = rows.select("seq", "rank", "item_id", "sims", earlier("met").alias("met"), F.array_max(earlier("clicked"))["kind"].alias("last"))
    known = F.col("sims").isNotNull() & (F.size("met") > 0)
    mean = F.aggregate("met", F.lit(0).cast("bigint"), lambda total, x: total + F.get("sims", x["kind"])) / (F.size("met").cast("bigint") * F.lit(_UNIT))
    return rows.select("seq", "rank", "item_id", F.coalesce(F.get("sims", F.col("last")) / _UNIT, F.lit(0.0)).alias("to_last"), F.when(known, mean).otherwise(0.0).alias("to_seen"))


def price_item_similarity(ev: DataFrame, obs: DataFrame, prices: DataFrame, *keys: str, acts: DataFrame | None = None) -> DataFrame:
    """Mean absolute difference of the item's mean price to those of items met before under *keys* (the user) that have one; 1000 without any."""
    keys = keys or ("user_id",)
    met = ev.filter("is_test = 0") if acts is None else acts
    seen = first_seen(met.filter("reference is not null"), *keys, "reference").join(prices.select(F.col("item_id").alias("reference"), F.col("mean_price").alias("q")), "reference")
    probes = obs.select("seq", "rank", "item_id", *keys).join(prices, "item_id", "left")
    each = probes.join(seen, list(keys)).filter("first_seq < seq").groupBy("seq", "rank").agg(F.avg(F.abs(F.col("mean_price") - F.col("q"))).alias("price_diff"))
    return obs.select("seq", "rank", "item_id").join(each, ["seq", "rank"], "left").select("seq", "rank", "item_id", F.coalesce("price_diff", F.lit(1000.0)).alias("price_diff"))


def click_probability(ev: DataFrame, obs: DataFrame, probs: DataFrame, key: str) -> DataFrame:
    """P(rank - last place | time bucket) if the user's list before had the same *key*: at the bucket, else at the last bucket, else a default by rank.

    *probs* has bucket, offset, prob.
    """
    w = prior("user_id")
    click = (F.col("is_test") == 0) & (F.col("idx") >= 0)
    at = ev.select("seq", F.last(F.when(click, F.col(key)), ignorenulls=True).over(w).alias("lk"), F.col(key).alias("k"), F.last(F.when(click, F.col("idx")), ignorenulls=True).over(w).alias("li"), F.last(F.when(click, F.col("ts")), ignorenulls=True).over(w).alias("lt"), F.col("ts").alias("t"))
    same = F.coalesce(F.col("lk") == F.col("k"), F.lit(False))
    rows = obs.select("seq", "rank", "item_id").join(at, "seq").withColumns({"offset": F.when(same, F.col("rank") - F.col("li")), "bucket": F.when(same, time_bucket(F.col("t") - F.col("lt")).cast("int"))})
    first = probs.select("bucket", "offset", F.col("prob").alias("p1"))
    second = probs.filter("bucket = 120").select("offset", F.col("prob").alias("p2"))
    looked = rows.join(first, ["bucket", "offset"], "left").join(second, "offset", "left")
    # The chances of the first places, and of all others.
    plain = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in (0.3, 0.2, 0.1, 0.07, 0.05)]), F.col("rank") + 1), F.lit(0.03))
    return looked.select("seq", "rank", "item_id", F.coalesce("p1", F.when(F.col("offset").isNotNull(), F.col("p2")), plain).alias("click_prob"))


# ---------------------------------------------------------------- the user-item graph


def edges(ev: DataFrame) -> DataFrame:
    """user_id, item_id, first_seq of train clicks."""
    return first_seen(ev.filter("is_test = 0 and reference is not null").select("user_id", F.col("reference").alias("item_id"), "seq"), "user_id", "item_id")


#: Rows of one item beyond which no task takes them all; they are counted where the input has COUNT_BYTES.
HOT_ITEM = 20_000_000
#: Bytes of the table of probes for each part that is counted on its own.
PART_BYTES = 128 << 20


def similar_users(ev: DataFrame, obs: DataFrame, parts: int | None = None) -> DataFrame:
    """Paths item - other user - item that the user clicked, all edges before the event.

    Counted without listing paths: users of both items come from the pairs of items of each user, whose number doesn't depend on how
    many users an item has, and a probe adds up those of the user's items, less the user's own. The items that a user clicked travel as one
    array with each probe until all rows of the probed item are together; where an item has more than HOT_ITEM rows, pairs travel one by one.
    Large inputs are counted in *parts* by item, one after the other, and of each only the probes with paths are kept.
    """
    e = edges(ev).groupBy("user_id").agg(F.collect_list(F.struct("item_id", F.col("first_seq").alias("f"))).alias("e"))
    clicked = written(e)
    known = F.transform(F.filter("e", lambda x: x["f"] < F.col("seq")), lambda x: x["item_id"])
    kind = dict(obs.dtypes)["item_id"]
    shown = obs.select("seq", "rank", "user_id", "item_id").join(clicked, "user_id", "left")
    shown = written(shown.select("seq", "rank", "item_id", F.coalesce(known, F.array().cast(f"array<{kind}>")).alias("mine")))
    n = parts or max(1, -(-input_bytes(shown) // PART_BYTES))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = clicked.select("e", F.inline("e").alias("item_id", "f"))
    both = both.select("item_id", none("seq", "bigint"), none("rank", "int"), none("own", "int"), F.transform("e", lambda x: F.struct(x["item_id"].alias("a"), F.greatest(x["f"], F.col("f")).alias("at"))).alias("m"))
    own = F.array_contains("mine", F.col("item_id")).cast("int").alias("own")
    probes = shown.filter(F.size("mine") > 0).select("item_id", "seq", "rank", own, F.transform("mine", lambda x: F.struct(x.alias("a"), F.col("seq").alias("at"))).alias("m"))
    lists = both.unionByName(probes)
    with cleaned(ev.sparkSession):
        hot = input_bytes(lists) >= COUNT_BYTES and (lists.groupBy("item_id").agg(F.sum(F.size("m")).alias("rows")).agg(F.max("rows")).first()[0] or 0) > HOT_ITEM
    found = []
    for k in range(n):
        part = lists.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else lists
        rows = (part if hot else part.repartition("item_id")).select("item_id", "rank", "own", F.col("seq").alias("event"), F.inline("m").alias("a", "seq"))
        rows = rows.withColumn("_one", F.when(F.col("rank").isNull(), 1))
        met = before(rows, ["item_id", "a"], {"users": ("count", "_one")}, ranges=None if hot else 1).filter("rank is not null and users > own")
        some = met.groupBy(F.col("event").alias("seq"), "rank").agg(F.sum(F.col("users") - F.col("own")).alias("paths"))
        found.append(written(some, 0) if n > 1 else some)
    paths = reduce(DataFrame.unionByName, found)
    return shown.select("seq", "rank", "item_id").join(paths, ["seq", "rank"], "left").withColumn("paths", _zero(F.col("paths")))


def neighbours(ev: DataFrame, k: int = 1, score: str = "intersection") -> DataFrame:
    """For each event the k users most like its user before it (score, then least id), and the items of theirs: seq, v, place, score.

    score: the size of the "intersection" or of the "union" of the items clicked.
    """
    e = edges(ev)
    probes = ev.select("seq", "user_id")
    mine = probes.join(e, "user_id").filter("first_seq < seq").select("seq", "user_id", "item_id")
    sizes = mine.groupBy("seq").agg(F.count(F.lit(1)).alias("mine"))
    common = mine.join(e.select(F.col("user_id").alias("v"), "item_id", "first_seq"), "item_id").filter("first_seq < seq and v <> user_id").groupBy("seq", "v").agg(F.count(F.lit(1)).alias("common"))
    if score == "union":
        theirs = common.join(e.select(F.col("user_id").alias("v"), "first_seq"), "v").filter("first_seq < seq").groupBy("seq", "v").agg(F.count(F.lit(1)).alias("theirs"))
        common = common.join(theirs, ["seq", "v"]).join(sizes, "seq").withColumn("score", F.col("mine") + F.col("theirs") - F.col("common"))
    else:
        common = common.withColumn("score", F.col("common"))
    place = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("score"), "v"))
    return common.select("seq", "v", "score", place.alias("place")).filter(F.col("place") <= k)


def neighbour_items(ev: DataFrame, obs: DataFrame, k: int = 1, score: str = "union") -> DataFrame:
    """How many of the k best neighbours clicked the item before."""
    best = neighbours(ev, k, score)
    items = best.join(edges(ev).select(F.col("user_id").alias("v"), "item_id", "first_seq"), "v").filter("first_seq < seq").groupBy("seq", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return obs.select("seq", "rank", "item_id").join(items, ["seq", "item_id"], "left").withColumn("n", _zero(F.col("n")))
