"""Learners and searches against plain versions."""

import inspect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.operators import matrix as mx
from asofkit.operators import metrics as mt
from asofkit.operators import ranking as rk
from asofkit.operators import vectorize as vz
from asofkit.sources import feeds, sinks


@pytest.fixture(scope="module")
def lists(spark):
    """Lists whose clicked member is mostly the one of greatest x less y."""
    r = random.Random(2)
    rows = []
    for seq in range(300):
        members = [(r.random(), r.random()) for _ in range(r.randint(2, 8))]
        best = max(range(len(members)), key=lambda i: members[i][0] - members[i][1] + r.gauss(0, 0.1))
        rows += [(seq, i, x, y, int(i == best and seq % 11 > 0)) for i, (x, y) in enumerate(members)]
    return spark.createDataFrame(rows, "seq bigint, rank int, x double, y double, hit int").cache()


def mrr(df, score):
    return mt.reciprocal_ranks(df, "seq", score, "hit", tie="rank").agg(F.avg("rr")).first()[0]


def test_grouped_ranker_learns_lists(lists):
    model = rk.GroupedRanker(["x", "y"], "seq", rounds=6, rate=0.5, maxDepth=3).fit(lists, "hit")
    assert all(a > b for a, b in zip(model.losses, model.losses[1:]))
    scored = lists.join(model.score(lists, ["seq", "rank"]), ["seq", "rank"])
    assert mrr(scored, "score") > mrr(lists, "x") + 0.05


def test_gradient_of_pairs(lists):
    """Gradients and losses of the first tree against pairs listed one by one."""
    ready = lists.withColumns({"label": F.col("hit").cast("double"), "s": F.col("x")})
    pull, loss = rk._pulls(F.col("s"), "seq")
    rows = ready.withColumns({"pull": pull, "loss": loss}).toPandas()
    for _, g in rows.groupby("seq"):
        clicked = g[g["hit"] == 1]
        if len(clicked):
            c = clicked["s"].iloc[0]
            others = g[g["hit"] == 0]
            want = 1 / (1 + np.exp(c - others["s"]))
            assert np.allclose(others["pull"], -want) and np.allclose(clicked["pull"], want.sum()) and np.allclose(others["loss"], np.log1p(np.exp(others["s"] - c)))


def test_pulls_of_lists_as_rows(lists):
    """Lists as one row each give the gradients and losses that windows give; a fitted tree as a column gives its predictions."""
    odd = lists.withColumn("label", F.when(F.col("seq") % 7 == 3, F.when(F.col("rank") > 0, 1.0).otherwise(0.0)).otherwise(F.col("hit").cast("double"))).filter("seq % 11 > 0")
    pull, loss = rk._pulls(F.col("x"), "seq")
    key = lambda rows: sorted((r["x"], round(r["pull"], 12), -1 if r["loss"] is None else round(r["loss"], 12)) for r in rows)
    want = key(odd.select("x", pull.alias("pull"), loss.alias("loss")).collect())
    gathered = odd.groupBy("seq").agg(F.collect_list(F.struct("label", "x")).alias("m"))
    got = gathered.select(F.inline(rk._list_pulls(lambda m: m["x"]))).select("x.x", "pull", "loss")
    assert key(got.collect()) == want
    model = rk.GroupedRanker(["x", "y"], "seq", rounds=3).fit(lists, "hit")
    rows = lists.withColumn("s", model._member_score(F.struct(F.col("x").alias("f0"), F.col("y").alias("f1"))))
    assert rows.join(model.score(lists, ["seq", "rank"]), ["seq", "rank"]).filter("s <> score").count() == 0


def test_written_rounds_learn_the_same(lists, monkeypatch):
    fit = lambda: rk.GroupedRanker(["x", "y"], "seq", rounds=2).fit(lists, "hit").losses
    plain = fit()
    monkeypatch.setattr("asofkit.sources.work.LEAST_BYTES", 0)
    monkeypatch.setattr(rk, "ROUND_BYTES", 0)
    assert fit() == pytest.approx(plain, rel=1e-3)


def test_models_are_fitted_once(lists, monkeypatch):
    fits = []
    monkeypatch.setattr(rk.GroupedRanker, "fit", lambda self, df, label, f=rk.GroupedRanker.fit: fits.append(1) or f(self, df, label))
    rows = lists.withColumns({"item_id": F.col("rank") + 10, "user_id": F.col("seq")})
    train, val, test = (rows.filter(f"seq % 3 = {k}") for k in range(3))
    rk.train_and_submit(train, val, test, [{"name": "g", "model_class": "grouped", "params": {"rounds": 1}}], ["x", "y"], "hit", ["seq", "rank"], ["user_id"], rounds=1)
    assert len(fits) == 1


@pytest.mark.parametrize("method", ["simplex", "lines"])
def test_blend_weights_are_better_than_each_score(lists, method):
    scores = lists.withColumns({"a": F.col("x"), "b": -F.col("y")}).select("seq", "rank", "hit", "a", "b").cache()
    w = mt.fit_blend(scores, ["a", "b"], "seq", "hit", 8, tie="rank", method=method)
    assert mrr(mt.blend(scores, w), "blend") >= max(mrr(scores, "a"), mrr(scores, "b"), mrr(mt.blend(scores, {"a": 0.5, "b": 0.5}), "blend"))


def test_searches_find_a_minimum():
    f = lambda p: float((p[0] - 1) ** 2 + 2 * (p[1] + 0.5) ** 2 + p[0] * p[1])
    best = np.linalg.solve([[2, 1], [1, 4]], [2, -2])
    for found in (mt.powell(f, np.zeros(2), 40), mt.nelder_mead(f, np.zeros(2), None)):
        assert f(found) < f(best) + 1e-3


def test_training_ends_in_a_submission(spark, lists):
    rows = lists.withColumns({"item_id": F.col("rank") + 10, "user_id": F.col("seq")})
    configs = [{"name": "g", "model_class": "grouped", "params": {"rounds": 2}}, {"name": "l", "model_class": "logistic"}]
    train, val, test = (rows.filter(f"seq % 3 = {k}") for k in range(3))
    weights, out = rk.train_and_submit(train, val, test, configs, ["x", "y"], "hit", ["seq", "rank"], ["user_id"], rounds=2)
    assert set(weights) == {"g", "l"} and out.count() == 100
    got = {r["user_id"]: r["item_recommendations"].split(" ") for r in out.collect()}
    sizes = {r["seq"]: r["count"] for r in test.groupBy("seq").count().collect()}
    assert {u: len(set(items)) for u, items in got.items()} == sizes


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_vectors_hold_the_cells(spark, monkeypatch, most):
    """Vectors against cells, with nulls, repeated terms, unseen values and a row without cells; no cell is a row unless there are very many features."""
    rows = spark.createDataFrame(
        [(1, 0, 5.0, "a", ["x", "x", "y"], {"k": 2.0}), (1, 1, None, "b", None, None), (2, 0, 3.0, None, ["y", None, "z"], {"k": float("nan"), "j": 1.0}), (2, 1, 0.0, "q", [], {"k": None}), (3, 0, 0.0, "q", ["w"], {})],
        "seq bigint, rank int, price double, kind string, bag array<string>, facts map<string,double>",
    )
    spec = mx.Branches(numeric=["price"], lagged=["price"], ranked=["price"], categorical={"kind": 1}, bags={"bag": 1}, ngrams={"kind": (1, 1)}, maps=["facts"], at_rank_0=["price"])
    fitted = mx.FeatureMatrix(spec, impute=0.0).fit(rows.filter("kind is null or kind <> 'q'"))
    want = {}
    for r in fitted.transform(rows).collect():
        want.setdefault((r["seq"], r["rank"]), {})[r["feature"]] = r["value"]
    monkeypatch.setattr(mx, "MOST_FEATURES", most)
    out = fitted.vectors(rows)
    assert most == 0 or "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    dense = [c for cs in fitted._dense(rows)[1].values() for c in cs]
    names = sorted({*dense, *(r["feature"] for r in fitted.kept.collect() if r["feature"])})
    got = {(r["seq"], r["rank"]): {names[i]: v for i, v in enumerate(r["features"].toArray()) if v} for r in out.collect()}
    assert got == want and len(want) >= 3


def test_ftrl_against_a_plain_learner(spark, sf):
    """The hashed learner without collisions is the textbook's with a dictionary."""
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.choice("xyz"), r.choice([0.0, 1.0, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, a string, b string, y double")
    got = {x["i"]: x["p"] for x in vz.ftrl_predictions(df, ["i"], ["i"], ["a", "b"], "y", bits=22).collect()}
    z, n, alpha, beta, l2 = {}, {}, 0.1, 1.0, 1.0
    for i, a, b, y in rows:
        at = ["bias", ("a", a), ("b", b), ("ab", a, b)]
        w = {k: -z.get(k, 0.0) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2) for k in at}
        p = 1 / (1 + math.exp(-sum(w.values())))
        assert abs(got[i] - p) < 1e-9
        if y is not None:
            for k in at:
                g, before = p - y, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[k]
                n[k] = before + g * g


@pytest.mark.parametrize("few", [10, 10_000])
def test_exact_quantile(spark, few):
    r = np.random.default_rng(4)
    for values in (r.integers(-(10**12), 10**12, 500), r.integers(0, 3, 400), np.array([7])):
        df = spark.createDataFrame(pd.DataFrame({"v": values.astype(np.int64)}))
        for q in (0.0, 0.37, 0.9, 1.0):
            assert mt.exact_quantile(df, "v", q, few) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert mt.exact_quantile(spark.createDataFrame([], "v bigint"), "v", 0.5) is None


def test_strict_lookup_fails_on_a_miss(spark):
    df, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.5)], "k int, v double")
    assert mx.strict_lookup(df.filter("k = 1"), table, ["k"], "v").first()["v"] == 0.5
    with pytest.raises(Exception, match="no v for"):
        mx.strict_lookup(df, table, ["k"], "v").collect()


def test_stored_matrices(spark, tmp_path):
    """NPZ files in, vectors appended, a slice of rows out; item maps; models and metric logs."""
    data = np.array([[0, 2.5, 0], [1, 0, 0], [0, 0, 0], [0, 3, 4]])
    at = [np.flatnonzero(row) for row in data]
    np.savez(tmp_path / "m.npz", indptr=np.cumsum([0] + [len(a) for a in at]), indices=np.concatenate(at), data=data[data != 0], shape=data.shape)
    rows = feeds.read_npz(spark, str(tmp_path / "m.npz")).orderBy("row").collect()
    assert [(r["row"], r["indices"], r["values"]) for r in rows] == [(i, a.tolist(), data[i, a].tolist()) for i, a in enumerate(at)]
    cells = spark.createDataFrame([(i, 0, "n", f"f{j}", float(data[i, j])) for i in range(4) for j in range(3) if data[i, j]], "seq int, rank int, branch string, feature string, value double")
    vectors = mx.to_vectors(cells, spark.createDataFrame([(f"f{j}",) for j in range(3)], "feature string"))
    for _ in range(2):
        sinks.append_matrix(vectors, str(tmp_path / "matrix"))
    stored = spark.read.parquet(str(tmp_path / "matrix"))
    assert stored.count() == 6
    part = {r["seq"]: (r["size"], r["indices"], r["values"]) for r in mx.row_range(stored, "seq", 1, 3).collect()}
    assert part == {1: (3, [0], [1.0]), 3: (3, [1, 2], [3.0, 4.0])}
    (tmp_path / "map.json").write_text('{"5": ["b", "a", "a"], "7": []}')
    assert {r["item_id"]: r["properties"] for r in feeds.read_item_map(spark, str(tmp_path / "map.json")).collect()} == {5: ["a", "b"], 7: []}
    model = rk.fit_ranker(spark.createDataFrame([(1.0, 1), (0.0, 0)] * 5, "x double, hit int"), ["x"], "hit", "logistic")
    sinks.write_model(model, str(tmp_path / "model"))
    sinks.write_model(model, str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    assert len(PipelineModel.load(str(tmp_path / "model")).stages) == 2
    for k in (1, 2):
        sinks.append_metrics(spark.createDataFrame([("run", 0.5 * k)], "name string, mrr double"), str(tmp_path / "log"))
    assert sorted(r["mrr"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [0.5, 1.0]


def test_blend_tries_pass_over_gathered_lists(spark):
    rows = [(g, i, (g * 7 + i * 3) % 5 / 4.0, None if (g + i) % 11 == 0 else (g + i) % 3 / 2.0, int((g * i) % 4 == 1)) for g in range(40) for i in range(g % 6 + 1)]
    df = spark.createDataFrame(rows, "seq int, rank int, a double, b double, hit int")
    blocks = mt._blocks(df, ["a", "b"], "seq", "hit", "rank")
    for w in ([0.5, 0.5], [1.0, 0.0], [-0.3, 0.7]):
        want = sorted(round(1 / r["rr"]) for r in mt.reciprocal_ranks(mt.blend(df, dict(zip("ab", w))), "seq", "blend", "hit", "rank").collect())
        got = blocks.mapInPandas(mt._places_of(w), "p int, n bigint").collect()
        assert sorted(p for r in got for p in [r["p"]] * r["n"]) == want


def test_submission_searches_weights_to_the_end(spark, monkeypatch):
    """The query sets no number of rounds, and neither search has one of its own."""
    from asofkit.plans import ranking as plans

    seen, old = [], mt.fit_blend
    monkeypatch.setattr(mt, "fit_blend", lambda *args, **kwargs: seen.append(inspect.signature(old).bind(*args, **kwargs)) or old(*args, **kwargs))
    assert plans.trained_submission(spark, "/root/testdata/sf0.001").count() > 0
    for call in seen:
        call.apply_defaults()
    assert [call.arguments["rounds"] for call in seen] == [None]


@pytest.mark.parametrize("search", [mt.powell, mt.nelder_mead])
def test_searches_go_on_until_they_are_close(search):
    """A long curved valley, for which a dozen rounds are too few."""
    f = lambda p: float(100 * (p[1] - p[0] ** 2) ** 2 + (1 - p[0]) ** 2)
    start = np.array([-1.2, 1.0])
    assert f(search(f, start, None)) < f(search(f, start, 12))
