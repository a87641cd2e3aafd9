"""The pipeline's stages against brute force, each on its own input."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from asofkit.llm import queries
from asofkit.llm.common import saved
from tests.llm import test_documents as documents
from tests.llm import test_linededup as lines
from tests.llm import test_ngramjoin as ngrams


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = saved(stage(spark, docs, sf), name)
        out.append((docs, after))
        docs = after
    return out


def test_stages(steps):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "packing"]
    for before, after in steps[:-1]:
        assert before.columns == after.columns


def test_language(steps):
    before, after = steps[0]
    rows = [r for r in before.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    train = [(r["text"], r["lang"]) for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    langs, scores = documents.naive_bayes(train, [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == {r["doc_id"] for r, p in zip(rows, scores) if max(p) >= pipeline.LEAST_SCORE}
    for r, p in zip(rows, scores):
        if r["doc_id"] in got:
            assert got[r["doc_id"]]["lang"] == (r["lang"] or langs[p.index(max(p))])


def test_lines(steps):
    before, after = steps[1]
    rows = [(r["doc_id"], r["text"], None) for r in before.collect()]
    hashes = {r[0]: r[1] for r in before.select("text", F.xxhash64("text")).collect()}
    want = {k: t for k, t, gone in lines.brute(rows, hashes, 1, 8, "word") if not gone or re.search(r"\S", t)}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicates(steps):
    before, after = steps[2]
    want = {c for _, _, c in ngrams.brute([(r["doc_id"], r["text"]) for r in before.collect()], 75)}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_mixing(steps):
    """Against the SQL of the query, on this stage's input."""
    before, after = steps[3]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = con.sql(f"SELECT {', '.join(before.columns)} FROM ({queries.OP1_SQL})").fetchall()
    assert sorted(map(str, map(tuple, after.collect()))) == sorted(map(str, want))


def test_packing(steps):
    before, after = steps[4]
    first = after.filter("piece = 0").groupBy("doc_id").count()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, before.groupBy("doc_id").count().collect()))
    per = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.filter("n > 2048 or n <> end").count() == 0
