import random

import pytest
from pyspark.sql import functions as F

from asofkit.llm import linededup


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = r.randrange(len(s) + 1), r.randrange(3)
        if kind == 0 or at == len(s):
            s.insert(at, r.choice("abcdefé ghi"))
        elif kind == 1:
            del s[at]
        else:
            s[at] = r.choice("abcdefé ghi")
    return "".join(s)


WHITE = " \t\x0b\x0c\r"


def brute(docs, hashes, edits, least, unit="char"):
    rows = sorted({(k is not None, k or 0, hashes[t], t) for k, t, *_ in docs if t is not None}, key=lambda x: x[:3])
    first = {}
    for *at, text in rows:
        for n, line in enumerate(text.split("\n")):
            if line.strip(WHITE):
                first.setdefault(line, (tuple(at), n))
    of = {x: x.split(" ") if unit == "word" else x for x in first}
    gone = {b for b in first for a in first if first[a] < first[b] and min(len(of[a]), len(of[b])) >= least and abs(len(of[a]) - len(of[b])) <= edits and distance(of[a], of[b]) <= edits}
    kept = {v for line, v in first.items() if line not in gone}
    out = []
    for k, t, *_ in docs:
        if t is None:
            out.append((k, None, 0))
            continue
        lines = t.split("\n")
        left = [x for n, x in enumerate(lines) if not x.strip(WHITE) or ((k is not None, k or 0, hashes[t]), n) in kept]
        out.append((k, "\n".join(left), len(lines) - len(left)))
    return sorted(out, key=str)


def held(spark, docs, schema="doc_id bigint, text string", **settings):
    """dedup_lines of *docs* against brute()."""
    df = spark.createDataFrame(docs, schema)
    hashes = {x[0]: x[1] for x in df.select("text", F.xxhash64("text")).collect()}
    got = linededup.dedup_lines(df, **settings).select("doc_id", "text", "lines_removed").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, hashes, settings["max_edits"], settings["min_size"], settings["unit"])
    return got


@pytest.mark.parametrize(("edits", "hot", "unit"), [(1, 256, "char"), (1, 1, "char"), (2, 256, "char"), (2, 1, "char"), (3, 2, "char"), (1, 256, "word"), (1, 1, "word"), (2, 1, "word")])
def test_against_all_pairs(spark, monkeypatch, edits, hot, unit):
    monkeypatch.setattr(linededup, "HOT_KEY", hot)
    r = random.Random(5)
    base = ["".join(r.choice("abcdef ghi   " if unit == "word" else "abcdef ghi") for _ in range(r.randint(3, 40))).strip() + "x" for _ in range(30)]
    docs = []
    for d in range(50):
        lines = [x if r.random() < 0.3 else mutated(r, x, r.randint(1, 3)) if r.random() < 0.8 else r.choice(["", " \t"]) for x in r.choices(base, k=r.randint(0, 6))]
        docs.append((d if d != 7 else 6, "\n".join(lines) if d != 9 else None, "e"))
    docs += [docs[3], (None, f"abc\n{base[0]}", "z"), (99, "", "z")]
    held(spark, docs, "doc_id bigint, text string, lines_removed string", max_edits=edits, min_size=5 if unit == "char" else 3, unit=unit)


@pytest.mark.parametrize(
    ("group", "hot", "edits", "unit"),
    [(3, 1, 1, "char"), (20, 1, 1, "char"), (400, 256, 1, "char"), (3, 1, 1, "word"), (20, 256, 1, "word"), (400, 1, 1, "word"), (400, 256, 1, "word"), (3, 1, 2, "word"), (20, 1, 2, "char"), (400, 1, 2, "word"), (400, 256, 2, "word")],
)
def test_groups_of_near_equal_lines(spark, monkeypatch, group, hot, edits, unit):
    """Lines that differ at one place: the earliest stays, not the one of least hash, whatever the number of lines that share a key."""
    monkeypatch.setattr(linededup, "HOT_KEY", hot)
    r = random.Random(group)
    symbols = [chr(0x4E00 + i) for i in range(group)]
    r.shuffle(symbols)
    gap = " " if unit == "word" else ""
    lines = [gap.join(["a", "b", "c", x, "d", "e", "f", "g"]) for x in symbols]
    if edits == 2:
        lines += [gap.join(["a", y, "c", x, "d", "e", "f", "g"]) for x, y in zip(symbols, reversed(symbols))]
    docs = [(d, "\n".join(lines[d::4])) for d in range(4)]
    got = held(spark, docs, max_edits=edits, min_size=6, unit=unit)
    assert sum(x["text"] != "" for x in got) == 1


def test_numbered_template_beyond_hot_key(spark):
    """Many lines in one substitution group, others two edits apart."""
    r = random.Random(3)
    numbers = [f"{i:02d}{i:02d}{x}" for i in range(70) for x in "abcdef"]  # lines of other i are two edits apart at least
    r.shuffle(numbers)
    assert len(numbers) > linededup.HOT_KEY
    docs = [(d, "\n".join(f"see the long table, entry number {x}" for x in numbers[d::9])) for d in range(9)]
    docs += [(None, f"see the long table, entry number {numbers[-1]}"), (20, f"see the long table, entry number {numbers[0]}1")]
    held(spark, docs, max_edits=1, min_size=20, unit="char")


def test_clashing_names(spark):
    names = ["doc_id", "text", "lines_removed", "_kept", "_text_hash", "_text_hash_", "_kept_hash", "_kept_key", "_k", "k", "t", "n", "h", "g", "line", "first", "key", "probe"]
    df = spark.createDataFrame([(1, "same line\nown", *range(16)), (2, "same line\n\nother", *range(16))], ", ".join(f"`{x}` {'string' if x == 'text' else 'bigint'}" for x in names))
    got = linededup.dedup_lines(df, max_edits=1, min_size=8, unit="word").orderBy("doc_id").collect()
    assert got[0].asDict() == dict(zip(names, (1, "same line\nown", 0, *range(1, 16)))) and (got[1]["text"], got[1]["lines_removed"], got[1]["_text_hash_"]) == ("\nother", 1, 3)


@pytest.mark.parametrize("edits", [1, 2, 5])
def test_distance(spark, edits):
    r = random.Random(2)
    pairs = []
    for _ in range(150):
        a = "".join(r.choice("abcé ") for _ in range(r.randint(0, 30)))
        pairs.append((a, mutated(r, a, r.randint(0, 6))))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"d": linededup.banded_distance("a", "b", edits), "e": linededup.banded_distance("a", "b", edits, words=True)})
    for x in df.collect():
        assert min(x["d"], edits + 1) == min(distance(x["a"], x["b"]), edits + 1)
        a, b = x["a"].split(" "), x["b"].split(" ")
        assert min(len(a), len(b)) <= edits or min(x["e"], edits + 1) == min(distance(a, b), edits + 1)


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"line number {i} of a very long text" for i in range(20_000))
    row = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string"), max_edits=0).orderBy("doc_id").collect()
    assert row[0]["text"] == text and row[1]["text"] == "" and row[1]["lines_removed"] == 20_000
