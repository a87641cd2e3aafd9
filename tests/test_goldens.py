"""Cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import features as feat
from asofkit.operators import groupwise as gw
from asofkit.operators import listcompare as lc
from asofkit.operators import metrics as mt
from asofkit.operators import vectorize as vz
from asofkit.operators.prequential import as_of, last_n
from asofkit.sources.feeds import observations

A, B, C = 1, 2, 3


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "U1", [A, B, C], B, 0), (2, "U2", [A, B, C], A, 0), (3, "U1", [B, A], A, 0), (4, "U3", [A, C], None, 1), (5, "U2", [C, A, B], C, 0)]
    ev = spark.createDataFrame([(s, u, i, [10] * len(i), r, t, len(i), 10 * s, u) for s, u, i, r, t in rows], "seq bigint, user_id string, items array<bigint>, prices array<bigint>, reference bigint, is_test int, n int, ts bigint, session_id string")
    return ev.withColumn("idx", F.coalesce(S.index_of("items", F.col("reference")), F.lit(S.MISSING))).withColumn("step", F.lit(1)).cache()


def by_item(df, *columns):
    return {(r["seq"], r["item_id"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_click_through(log):
    got = by_item(feat.item_ctr(log, observations(log)), "clicks", "impressions", "corrected")
    assert all(got[1, i] == (0, 0, 0) for i in (A, B, C))
    assert (got[2, A], got[2, B], got[2, C]) == ((0, 1, 1), (1, 1, 1), (0, 1, 0))
    assert (got[3, B], got[3, A]) == ((1, 2, 1), (1, 2, 2))
    assert (got[4, A], got[4, C]) == ((2, 3, 3), (0, 2, 0))
    assert (got[5, C], got[5, A], got[5, B]) == ((0, 2, 0), (2, 3, 3), (1, 3, 2))


def test_last_index_passes_over_place_0(log):
    got = by_item(feat.last_index(log, observations(log), "user_id"), "last_index")
    assert got[3, B] == (1,) and got[3, A] == (0,)
    assert all(got[5, i] == (-1000,) for i in (A, B, C))


def test_pairs_wrap_to_the_last_item(log):
    got = by_item(feat.pairwise_ctr(log, observations(log)), "left_wins", "left_losses", "left_draws", "right_wins", "right_losses", "right_draws")
    assert got[5, C][:3] == (0, 1, 1)
    assert got[5, A][:3] == (0, 0, 0)
    assert got[5, A][3:] == (1, 1, 0)


def test_paths_of_similar_users(log):
    got = by_item(feat.similar_users(log, observations(log)), "paths")
    assert all(got[3, i] == (0,) for i in (A, B))
    assert (got[5, A], got[5, B], got[5, C]) == ((1,), (1,), (0,))


@pytest.mark.parametrize("hot", [False, True])
def test_paths_in_parts(spark, sf, monkeypatch, hot):
    """The same paths in parts and for hot items; before they are exploded, a probe is one row whatever its user clicked."""
    from asofkit.plans.prep import _o

    ev = _o(spark, sf)
    plain = sorted(map(str, feat.similar_users(ev, observations(ev)).collect()))
    monkeypatch.setattr("asofkit.sources.work.LEAST_BYTES", 0)
    monkeypatch.setattr(feat, "COUNT_BYTES", 0)
    monkeypatch.setattr(feat, "HOT_ITEM", 0 if hot else 10**9)
    got = feat.similar_users(ev, observations(ev), parts=3)
    assert sorted(map(str, got.collect())) == plain and any(not x.endswith("paths=0)") for x in plain)


G2 = {
    0: "100,12666,126,80,80,200,200,1,33,10000,100,100,100,100,100,12666,126,80,80,200,200,0,0,1,33,80,200,126,100,100,100,125,50,100,100,100",
    1: "80,12666,158,80,100,200,250,0,0,9000,112,80,100,100,125,14000,175,80,100,200,250,0,0,0,0,100,250,158,80,80,80,40,40,100,125,112",
    2: "200,12666,63,80,40,200,100,2,66,12666,63,80,40,200,100,20000,100,200,100,200,100,2,66,0,0,40,100,63,200,200,250,100,100,40,100,63",
}
ZERO = "0,520,10000,0,10000,9,10000,0,0,0,10000,0,10000,0,10000,520,10000,0,10000,9,10000,0,0,0,0,10000,10000,10000,10000,10000,10000,0,0,10000,10000,10000"
ORDER = (
    ["pure", "mean", "mean_vs_item", "min", "min_vs_item", "max", "max_vs_item", "value_rank", "value_rank_norm"]
    + [f"{s}_{w}" for w in ("before", "after") for s in ("mean", "mean_vs_item", "min", "min_vs_item", "max", "max_vs_item")]
    + ["value_rank_before", "value_rank_norm_before", "value_rank_after", "value_rank_norm_after", "first3_min_vs_item", "first3_max_vs_item", "first3_mean_vs_item"]
    + ["vs_place_m3", "vs_place_m2", "vs_place_m1", "vs_place_p1", "vs_place_p2", "recent3_min_vs_item", "recent3_max_vs_item", "recent3_mean_vs_item"]
)


def test_list_comparison(spark):
    lists = {1: [100, 80, 200], 2: [0, 7, 7, 3, 9]}
    obs = spark.createDataFrame([(s, r, r, v) for s, vs in lists.items() for r, v in enumerate(vs)], "seq bigint, rank int, item_id bigint, v bigint")
    got = {(r["seq"], r["rank"]): ",".join(str(r[c]) for c in ORDER) for r in lc.list_comparison(obs, "v").collect()}
    assert {i: got[1, i] for i in G2} == G2
    assert got[2, 0] == ZERO


def test_ranks(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([100, 80, 200, 150, 50])] + [(2, i, p) for i, p in enumerate([5, 5, 7])] + [(3, 0, None)], "g int, i int, p int")
    rows = sorted(gw.rank_features(df, "g", ["p"]).collect())
    assert [r["p_rank_asc"] for r in rows] == [2, 1, 4, 3, 0, 1, 1, 2, None]
    assert [r["p_rank_desc"] for r in rows] == [2, 3, 0, 1, 4, 2, 2, 0, None]


def test_reciprocal_ranks(spark):
    df = spark.createDataFrame([(1, i, s, c) for i, (s, c) in enumerate([(0.9, 0), (0.5, 1), (0.1, 0)])] + [(2, i, s, 0) for i, s in enumerate([0.4, 0.3, 0.2, 0.1])], "g int, item_id int, s double, c int")
    mean = lambda how: mt.reciprocal_ranks(df, "g", "s", "c", no_click=how).agg(F.avg("rr")).first()[0]
    assert mean("drop") == 0.5
    assert mean("size") == 0.375


def test_scalars(spark):
    row = spark.range(1).select(
        *[S.time_bucket(F.lit(t)).alias(f"t{t}") for t in (0, 12, 13, 15, 16, 119, 120)],
        S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"),
        S.jaccard(F.array().cast("array<int>"), F.lit(None).cast("array<int>")).alias("j0"),
        S.leading_int(F.lit(" 5 Star")).alias("five"),
        S.leading_int(F.lit("Star 5")).alias("none"),
        S.sha1_bucket(F.lit("abc")).alias("sha"),
    ).first()
    assert [row[f"t{t}"] for t in (0, 12, 13, 15, 16, 119, 120)] == [0, 12, 12, 12, 16, 116, 120]
    assert (row["j"], row["j0"], row["five"], row["none"]) == (0.25, 0, 5, None)
    import hashlib

    assert row["sha"] == int(hashlib.sha1(b"abc").hexdigest(), 16) % 10**8


@pytest.mark.parametrize("ranges", [None, 2, 17, 1000])
def test_as_of_against_a_fold(spark, ranges):
    """Plain and in ranges, null keys and null values too."""
    r = random.Random(3)
    ups = [(r.choice(["a", "b", None]) if r.random() < 0.3 else "hot", r.randrange(400), r.choice([None, *range(10)])) for _ in range(300)]
    probes = [(r.choice(["a", "b", None, "hot", "new"]), r.randrange(420), i) for i in range(300)]
    u, p = spark.createDataFrame(ups, "k string, seq bigint, v int"), spark.createDataFrame(probes, "k string, seq bigint, id int")
    u = u.withColumn("at", F.when(F.col("v").isNotNull(), F.struct("seq", "v")))
    got = {x["id"]: (x["s"], x["n"], x["m"]) for x in as_of(u, p, ["k"], {"s": ("sum", "v"), "n": ("count", "v"), "m": ("max", "at")}, ranges=ranges).collect()}
    for k, s, i in probes:
        seen = [(s2, v) for k2, s2, v in ups if k2 == k and s2 < s and v is not None]
        assert got[i] == (sum(v for _, v in seen) if seen else None, len(seen), max(seen, default=None))
    assert as_of(u.limit(0), p.limit(0), ["k"], {"s": ("sum", "v")}, ranges=ranges).count() == 0


def test_last_n_against_slices(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), s, r.choice([None, *range(5)])) for s in range(120)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    for x in last_n(df, ["k"], {"last": F.col("v")}, 3).collect():
        assert x["last"] == [v for k, s, v in rows if k == x["k"] and s < x["seq"] and v is not None][-3:]


def test_clicks_outside_lists_count(spark, log):
    """A click on an item that its list doesn't hold counts for later events."""
    more = log.unionByName(log.filter("seq = 5").withColumns({"seq": F.lit(6).cast("bigint"), "reference": F.lit(9).cast("bigint"), "idx": F.lit(S.MISSING)}))
    more = more.unionByName(log.filter("seq = 5").withColumns({"seq": F.lit(7).cast("bigint"), "items": F.array(F.lit(9).cast("bigint")), "prices": F.array(F.lit(1).cast("bigint"))}))
    assert by_item(feat.item_ctr(more, observations(more)), "clicks", "impressions", "corrected")[7, 9] == (1, 0, 0)


def test_no_event_sees_later_ones(spark, sf):
    """Without the later half of the log, features of the earlier half stay as they are."""
    from asofkit.sources.feeds import order_events

    ev = order_events(spark, sf).cache()
    cut = ev.agg(F.percentile_approx("seq", 0.5)).first()[0]
    early = ev.filter(F.col("seq") < cut)
    for f in (feat.item_ctr, feat.pairwise_ctr, feat.price_similarity, feat.click_sequence, feat.similar_users):
        whole = f(ev, observations(ev)).filter(F.col("seq") < cut)
        part = f(early, observations(early))
        assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, part.collect()), key=str)


def test_row_order_does_not_matter(spark, sf):
    from asofkit.sources.feeds import order_events

    ev = order_events(spark, sf)
    mixed = ev.orderBy(F.rand(5)).repartition(7)
    f = lambda e: sorted(map(tuple, feat.item_ctr(e, observations(e)).collect()))
    assert f(ev) == f(mixed)


def test_nelder_mead_until_the_simplex_is_small():
    import numpy as np

    for loss, want in ((lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, [1, -2]), (lambda x: 0.0, [0, 0])):
        assert np.allclose(mt.nelder_mead(loss, np.zeros(2), rounds=None), want, atol=0.05)


def test_nelder_mead():
    import numpy as np

    best = mt.nelder_mead(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, np.zeros(2), rounds=200)
    assert abs(best - np.array([1, -2])).max() < 1e-3


def test_downcast_and_duplicates(spark):
    df = spark.createDataFrame([(1, 300, 1, 0.5), (2, 70_000, 2, 0.1)], "a bigint, b bigint, c bigint, d double")
    assert dict(vz.downcast(df).dtypes) == {"a": "tinyint", "b": "int", "c": "tinyint", "d": "double"}
    assert vz.duplicate_columns(df) == ["c"]
    assert vz.sparse_columns(df, ["a", "b"], 3) == []


def test_compressed_sequences(spark, log):
    """Sizes of compressed places against the library's own, from the places of earlier events in the session."""
    import gzip

    rows = [(1, "U", "S", [A, B, C], B), (2, "U", "S", [C, A], C), (3, "U", "T", [A, B], A), (4, "U", "S", [A, B, C], None)]
    ev = spark.createDataFrame([(s, u, x, i, [1] * len(i), r, int(r is None), 10 * s) for s, u, x, i, r in rows], "seq bigint, user_id string, session_id string, items array<bigint>, prices array<bigint>, reference bigint, is_test int, ts bigint")
    ev = ev.withColumn("idx", F.coalesce(S.index_of("items", F.col("reference")), F.lit(S.MISSING)))
    got = {(r["seq"], r["rank"]): (r["size"], r["ratio"]) for r in feat.click_sequence_gzip(ev, observations(ev)).collect()}
    size = lambda t: float(len(gzip.compress(t.encode(), mtime=0)))
    past = {2: "1", 4: "1,0"}
    for (seq, rank), cell in got.items():
        want = (size(f"{past[seq]},{rank}"), size(f"{past[seq]},{rank}") / size(past[seq])) if seq in past else (-1000.0, -1000.0)
        assert cell == want
    assert len(got) == 10


def test_similarity_by_pairs_or_by_rows(spark, sf):
    from asofkit.plans import mixed, prep

    acts, clicks, obs = mixed._all(spark, sf)
    sets = prep._properties(spark, sf).filter("item_id % 9 <> 0")
    rows = [sorted(map(str, feat.set_similarity(clicks, obs, sets, "user_id", acts=acts.filter("is_test = 0"), by_pairs=x).collect())) for x in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) == 6000


@pytest.mark.parametrize("keys", [("user_id",), ("user_id", "session_id")])
def test_similarity_of_few_kinds_makes_no_pairs(spark, sf, monkeypatch, keys):
    """Sets of few kinds, some null, empty or missing: the same numbers, and no join that makes a row of each pair of items."""
    from asofkit.plans import mixed, prep

    ev = prep._o(spark, sf)
    acts, clicks, obs = mixed._all(spark, sf)
    sets = mixed._pois(ev).filter("item_id % 9 <> 0").withColumn("properties", F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("item_id") % 7 > 0, F.col("properties")))
    one = lambda: feat.set_similarity(clicks, obs, sets, *keys, acts=acts.filter("is_test = 0"))
    plain = sorted(map(str, one().collect()))
    monkeypatch.setattr(feat, "SETS_BYTES", 0)
    got = one()
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # nothing is added up over rows
    assert sorted(map(str, got.collect())) == plain and len(plain) == 6000
    monkeypatch.setattr(feat, "MOST_KINDS", 3)
    assert sorted(map(str, one().collect())) == plain


@pytest.mark.parametrize("hot", [False, True])
def test_clicks_of_others_share_a_shuffle(spark, sf, monkeypatch, hot):
    from asofkit.plans.prep import _o

    ev = _o(spark, sf).withColumn("lk", S.list_key(F.slice("items", 1, 1)))
    plain = sorted(map(str, feat.list_clicks_of_others(ev, observations(ev), "lk").collect()))
    monkeypatch.setattr("asofkit.sources.work.LEAST_BYTES", 0)
    monkeypatch.setattr(feat, "COUNT_BYTES", 0)
    monkeypatch.setattr(feat, "HOT_LIST", 0 if hot else 10**9)
    got = feat.list_clicks_of_others(ev, observations(ev), "lk")
    assert sorted(map(str, got.collect())) == plain
    plan = got._jdf.queryExecution().sparkPlan().toString() if hot else got._jdf.queryExecution().executedPlan().toString()
    assert hot or plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
