import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import ngramjoin
from asofkit.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, percent):
    sets, above = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                above[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in g]
    return sorted(out, key=str)


def made_up(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ü", "ü", "a b"]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(12)]
    common, rows = [r.choice(words) for _ in range(25)], []
    for d in range(240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        w += common if r.random() < 0.3 else []
        rows.append((r.choice([d, d, None, 5]) if d % 9 == 0 else d, " ".join(w) if d % 17 else r.choice(["", " ", None, "A b", "a B"])))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "percent"), [(1, 4, 75), (2, 256, 75), (3, 4, 30), (4, 256, 50), (5, 8, 90)])
def test_against_all_pairs(spark, monkeypatch, seed, frequent, percent):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    monkeypatch.setattr(ngramjoin, "COUNT_BYTES", 5_000)
    monkeypatch.setattr(ngramjoin, "GATHER_ENTRIES", 300)
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    assert sorted(map(tuple, ngramjoin.similar_components(df, percent=percent).collect()), key=str) == brute(rows, percent)


@pytest.mark.parametrize("frequent", [2, 256])
@pytest.mark.parametrize("percent", [50, 60, 100])
def test_contained_sets_at_other_percents(spark, monkeypatch, percent, frequent):
    """Sets inside larger ones, of sizes as far apart as links at *percent* allow."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    rows = []
    for g, n in enumerate([1, 2, 4, 8, 64, 133, 150, 200]):
        words = [f"g{g}w{i}" for i in range(500)]
        rows += [(10 * g + k, " ".join(words[: m + 4])) for k, m in enumerate([n, 100 * n // percent, 100 * n // percent + 1])]
    got = ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_one_group_of_near_copies(spark):
    """Copies with growing numbers of edits, many of them linked with nothing."""
    r = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 75)


def test_empty_table(spark):
    assert ngramjoin.similar_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert ngramjoin.keep_one_of_each(spark.createDataFrame([(None, "a")], "doc_id bigint, text string")).count() == 1


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, repeated keys of other texts, and null keys."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (None, a, "x"), (2, a + " more", "x"), (None, b, "x"), (None, b, "x"), (1, c, "x"), (0, c, "x"), (1, d, "x"), (7, "", "x"), (7, "", "x"), (None, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string")
    got = ngramjoin.keep_one_of_each(df)
    assert got.columns == df.columns
    want = [(1, a), (None, b), (0, c), (1, d), (7, ""), (7, ""), (None, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert got == least


def test_saved_tables_leave_no_shuffle_files(spark):
    from asofkit.llm.common import saved

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(b) for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = files()
    table = saved(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    time.sleep(1)
    assert not files() - before
    assert table.count() == 100


def test_texts_are_told_by_their_ids_where_they_are_many(spark, monkeypatch):
    docs = spark.createDataFrame([(d, f"t{d}") for d in [*range(3000), None]], "id bigint, t string")
    wanted = [0, 7, 2999, None]
    got = {r["id"] for r in ngramjoin._among(docs, spark.createDataFrame([(d,) for d in wanted], "rep bigint")).collect()}
    assert set(wanted) <= got and len(got) < 20
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    rows = made_up(1)
    found = ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, 75)


@pytest.mark.parametrize(("short", "frequent", "percent"), [(0, 4, 75), (0, 256, 50), (3, 256, 75), (3, 6, 30), (32, 256, 90)])
def test_short_and_long_lists_against_all_pairs(spark, monkeypatch, short, frequent, percent):
    monkeypatch.setattr(ngramjoin, "SHORT_LIST", short)
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rows = made_up(percent + short)
    got = ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_bitmaps_never_fall_short_of_what_sets_share():
    r = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 1 << 63, r.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.append(y[: r.integers(0, len(y) + 1)], x[: r.integers(1, len(x) + 1)]))
        most = ngramjoin.most_common(len(x), ngramjoin._bitmap(x), len(y), ngramjoin._bitmap(y))
        assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))


def test_texts_that_share_a_passage_by_chance_are_not_compared(spark, monkeypatch):
    """Any two of these texts share a rare passage of their own, and a few a passage of three texts; one pair is similar."""
    r, compared, old = random.Random(3), [], ngramjoin.saved

    def saved(df, name):
        out = old(df, name)
        if name == "compared":
            compared.append(out.count())
        return out

    monkeypatch.setattr(ngramjoin, "saved", saved)
    made = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = [made(60) for _ in range(40)]
    for i in range(0, 39):
        passage = made(6)
        for w in texts[i : i + 2 + i % 2]:
            w += passage
    texts.append(texts[0] + ["more"])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = ngramjoin.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 75)
    assert sum(compared) == 1
