"""Mixing, language, fingerprints, neighbours."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import ann, fingerprints, langid, mixing, queries
from tests.compare import check, connect


def test_mix_equals_sql(spark, sf):
    check(spark, connect(sf), queries.op1_poisson_mix, queries.OP1_SQL, sf)


def test_mix_hits_its_targets(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(6000)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("copy", F.lit("mine"))
    out = mixing.mix_to_weights(df, {"a": 1.0, "b": 3.0}, default_weight=0.0, seed=5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["b"] / n["a"] - 3) < 0.3 and abs(sum(n.values()) - 6001) < 300
    again = mixing.mix_to_weights(df.repartition(7), {"a": 1.0, "b": 3.0}, default_weight=0.0, seed=5)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_poisson_draws(spark):
    u = spark.range(20_000).select(mixing.unit(F.lit(3), F.col("id")).alias("u"))
    for mean in (0.3, 5.0):
        k = np.array([r[0] for r in u.select(mixing.inverse_poisson(F.col("u"), F.lit(mean))).collect()])
        assert abs(k.mean() - mean) < 0.05 and abs(k.var() - mean) < 0.05 * max(mean, 4)
    large = mixing.mix_to_weights(spark.createDataFrame([(1, "a")], "doc_id bigint, source string"), total=900.0)
    assert abs(large.count() - 900) < 150


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix_to_weights(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_to_weights(spark.createDataFrame([(1, "a")], "doc_id bigint, source string"), {"a": 0.0})


def test_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{Path(sf).parent}/sf0.01/documents.parquet")
    got = langid.identify(df.withColumn("score", F.lit("mine")))
    test = got.filter("held_out and lang is not null")
    assert test.count() > 150
    assert test.filter("lang = lang_pred").count() / test.count() > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def naive_bayes(train, texts):
    """Posteriors by plain counting: (languages, one row of probabilities for each text)."""
    from math import exp, log

    def buckets(text):
        points = [ord(c) if ord(c) >= 0x3000 else ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text + "   "]
        out = []
        for at in range(len(text) + 1):
            value = 0
            for n in (1, 2, 3):
                value = (value * 0x9E3779B1 + points[at + n - 1] + n) % 2**32
                out.append(((value ^ value >> 15) * 0x85EBCA6B % 2**32) >> (32 - langid.BUCKET_BITS))
        return out

    langs = sorted({x for _, x in train})
    counts = {x: {} for x in langs}
    for t, x in train:
        for b in buckets(t):
            counts[x][b] = counts[x].get(b, 0) + 1
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * 2**langid.BUCKET_BITS for x in langs}
    out = []
    for t in texts:
        logs = [log(sum(y == x for _, y in train) / len(train)) + sum(log((counts[x].get(b, 0) + langid.SMOOTHING) / total[x]) for b in buckets(t)) for x in langs]
        top = [exp(v - max(logs)) for v in logs]
        out.append([v / sum(top) for v in top])
    return langs, out


def test_language_against_plain_counts(spark, monkeypatch):
    r = random.Random(6)
    alphabets = {"x": "abcde é", "y": "cdefg ü", "z": "日本語 ab"}
    train = [("".join(r.choice(alphabets[x]) for _ in range(r.randint(1, 80))) + "a", x) for x in r.choices("xyz", [5, 3, 2], k=90)]
    texts = ["".join(r.choice("abcdefg éü日本.1İ") for _ in range(r.randint(0, 12))) + "a" for _ in range(60)] + ["cde" * 40]
    langs, want = naive_bayes(train, texts)
    docs = spark.createDataFrame([(f"t{i}", t, x) for i, (t, x) in enumerate(train)], "doc_id string, text string, lang string")
    for chunk in (400_000, 7):  # texts whole, and in pieces
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        model = langid.fit(docs)
        assert model.langs == langs
        assert np.allclose(model.scores(texts), want, atol=1e-9)
        assert np.allclose(model.scores(texts[3:9]), want[3:9], atol=1e-9)


def test_language_of_odd_texts(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    odd = [(100, None, "en"), (101, "123 ...", "en"), (102, "", None), (None, "the dog", None), (103, "the " * 200_000, None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == got[103]["lang_pred"] == "en" and not got[None]["held_out"]
    none = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(none).first()["lang_pred"] == "und"
    assert langid.identify(none.limit(0)).count() == 0


def naive(points, i, j, base, prime):
    return sum((c + 1) * pow(base, k, prime) for k, c in enumerate(points[i:j])) % prime


def test_span_hashes_and_extensions():
    r = random.Random(1)
    a, b = ("".join(r.choice("aéz\U0001f600") for _ in range(60)) for _ in range(2))
    b = b[:20] + a[10:40] + b[20:]
    x, y = fingerprints.PrefixHash.of(a), fingerprints.PrefixHash.of(b)
    points = list(map(ord, a))
    for i, j in ((0, 60), (3, 9), (17, 17), (59, 60)):
        assert x.span(i, j) == tuple(naive(points, i, j, q, p) for q, p in zip(fingerprints.BASES, fingerprints.PRIMES))
    assert x.spans(5)[7] == x.span(7, 12)[0] << 31 | x.span(7, 12)[1]
    for _ in range(200):
        i, j = r.randrange(61), r.randrange(len(b) + 1)
        want = next((k for k, (p, q) in enumerate(zip(a[i:], b[j:])) if p != q), min(len(a) - i, len(b) - j))
        assert x.extension(i, y, j) == want
    spliced = x.spliced(30, y.points[:7])
    assert spliced.span(0, 37) == fingerprints.PrefixHash.of(a[:30] + b[:7]).span(0, 37)


def test_fingerprints_against_a_loop(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", None, "é", texts_long := "xyz " * 60_000]
    docs = [(r.randrange(10**6), t) for t in texts] + [(None, "null key"), (5, "twin"), (5, "twin")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    want = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        f, g, h = (fingerprints.fingerprint(fingerprints.PrefixHash.of(z))[0] for z in (t, edited, after))
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(texts_long) == 240_000
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_neighbours_against_all_pairs(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 24))
    x = centres[r.integers(0, 20, 900)] + 0.4 * r.standard_normal((900, 24))
    x[500:560] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 24), (1200, [float("nan")] + [1.0] * 23), (1300, [1.0, None] + [1.0] * 22), (None, [1.0] * 24), (1400, [1.0] * 3), (1500, [float("inf")] * 24)]
    got = ann.nearest(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>"), k=10, every=50).collect()
    hits = 0
    for q in range(0, 900, 50):
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(900), d))[:10]
        hits += len({m[1] for m in mine} & set(true.tolist()))
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == d[m[1]] for m in mine)
    assert hits >= 0.9 * 10 * 18 and {g["query_id"] for g in got} == set(range(0, 900, 50))
    few = ann.nearest(spark.createDataFrame(rows[:4], "vec_id bigint, embedding array<double>"), every=2).collect()
    assert len(few) == 2 * 3
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def nearest_of(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return set(np.lexsort((np.arange(len(x)), d))[:k].tolist())


@pytest.mark.parametrize("bits", range(ann.MOST_BITS + 1))
def test_probes_meet_every_code_within_the_bound(spark, monkeypatch, bits):
    """What queries meet with up to *bits* differing bits holds every row within Hamming distance m * (bits + 1) - 1."""
    r = np.random.default_rng(5)
    codes = r.integers(0, 1 << 16, (400, 4), dtype=np.uint16)
    for i in range(0, 300):  # neighbours of the first code at all distances
        codes[i + 1] = codes[0]
        for b in r.permutation(64)[: i % 24]:
            codes[i + 1, b // 16] ^= 1 << (b % 16)
    rows = [(i, i, [float(i)], c.tolist(), c.view(np.int64).tolist()) for i, c in enumerate(codes)]
    coded = spark.createDataFrame(rows, "id bigint, k bigint, v array<double>, code array<int>, wide array<bigint>")
    for rows_of_a_part in (1 << 16, 16):  # in one part for each substring, and in many
        monkeypatch.setattr(ann, "PART_ROWS", rows_of_a_part)
        sizes = ann._part_sizes(coded, 400).cache()
        table = ann._postings(coded, sizes)
        live = spark.createDataFrame([(0, [0.0], codes[0].tolist(), codes[0].view(np.int64).tolist(), 64)], "q bigint, qv array<double>, qcode array<int>, qwide array<bigint>, radius int")
        met = {x["id"] for b in range(bits + 1) for x in ann._probed(live, spark.table(table), sizes, b, 400).collect()}
        spark.sql(f"DROP TABLE {table}")
        far = ann.hamming(codes[:1], codes)[0]
        assert {i for i in range(1, 400) if far[i] <= 4 * (bits + 1) - 1} <= met
        assert met == {i for i in range(1, 400) if min(bin(int(a ^ b)).count("1") for a, b in zip(codes[0], codes[i])) <= bits}


def test_few_rows_are_met_in_clusters(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((500, 64))
    x = centres[r.integers(0, 500, 50_000)] + 0.25 * r.standard_normal((50_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, every=1000, report=(report := {})).collect()
    hits = sum(len({g["vec_id"] for g in got if g["query_id"] == q} & nearest_of(x, q)) for q in range(0, 50_000, 1000))
    assert hits >= 0.95 * 500 and report["queries"] == 50
    assert report["met"] + report["scanned"] < 0.1 * 50 * 50_000, report


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf, size):
    rows = spark.read.parquet(f"{Path(sf).parent}/{size}/embeddings.parquet").orderBy("vec_id")
    data = rows.collect()
    x, ids = np.array([d["embedding"] for d in data], float), np.array([d["vec_id"] for d in data])
    got = ann.nearest(rows).collect()
    queries = np.flatnonzero(ids % 100 == 0)
    hits = sum(len({g["vec_id"] for g in got if g["query_id"] == ids[q]} & {int(ids[i]) for i in nearest_of(x, q)}) for q in queries)
    assert hits >= 0.95 * 10 * len(queries)
