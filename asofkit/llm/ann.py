"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the signs of vectors under rotations learned by iterative quantization on a bounded sample. Each code is
split into m substrings of 16 bits, and a row's substrings are its postings, dealt once by (substring, value) into parts of about PART_ROWS. Two
codes within Hamming radius m * (b + 1) - 1 differ by at most b bits in some substring (pigeonhole), so a query that probes all values within b
bits of its own meets every code within that radius. Queries go on from b = 0, to the parts that hold such values; what they meet there is
reranked by exact distances, and each part gives the k best.

A query is done once its radius is wide enough for the distance of its k-th best: the sample tells within which Hamming distance the
rows lie that are as near as that (a share TARGET_RECALL of them). On vectors that form clusters most queries are done after few probes. On
vectors without any structure near rows have codes half as far as any others, and no substring probing can keep rows out; queries
that aren't done at b = MOST_BITS differing bits, where probes meet a tenth of all rows, are compared with all codes, in blocks, and rerank
what lies within their radius.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, partitions_for, releasing, saved, small, tidy, work_path

#: Vectors that rotations and radii are learned from.
SAMPLE = 4_096
SAMPLE_QUERIES = 256
BITS = 128
TARGET_RECALL = 0.985
#: The most differing bits of a substring that are probed: 697 values of 65,536.
MOST_BITS = 3
BROADCAST_ROWS = 200_000
#: Queries that are compared with all codes at a time: their vectors and codes are what is broadcast.
QUERY_BLOCK = 16_384
#: Postings of a part.
PART_ROWS = 65_536
#: Rows that are compared with them at a time.
INDEX_BLOCK = 65_536


@dataclass
class Codebook:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    radius: int
    #: Rows nearer than edges[i] lie within Hamming distance within[i]; others within radius.
    edges: list[float] = field(default_factory=list)
    within: list[int] = field(default_factory=list)

    @property
    def words(self) -> int:
        return self.rotations.shape[1] // 16

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of 16-bit substrings."""
        bits = (vectors - self.mean) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def needed(self, distance: Column) -> Column:
        """The Hamming radius that rows as near as *distance* need."""
        out = F.lit(self.radius)
        for edge, h in reversed(list(zip(self.edges, self.within))):
            out = F.when(distance <= edge, h).otherwise(out)
        return out


def _rotations(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    """Iterative quantization: alternately sets codes to signs and turns the axes onto the codes; one rotation for each *dimensions* bits."""
    d, parts = x.shape[1], []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        parts.append(r)
    return np.concatenate(parts, axis=1)[:, :bits]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of *a* and of *b*."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def learn(sample: np.ndarray, k: int, bits: int = BITS, target: float = TARGET_RECALL, seed: int = 1) -> Codebook:
    """Rotations, and how far codes of near rows lie apart.

    radius is the least that holds *target* of the sample queries' true k nearest in the sample. Nearest neighbours in all data are nearer than
    those in a sample, so it errs on the wide side; within[i] holds *target* of the sample's pairs at most edges[i] apart, for distances that have enough pairs.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    scale = np.linalg.norm(sample - mean, axis=1).mean() or 1.0
    book = Codebook(mean, _rotations((sample - mean) / scale, bits, rng), bits)
    asks = sample[rng.permutation(len(sample))[:SAMPLE_QUERIES]]
    d = (asks**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * asks @ sample.T
    near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]  # the query itself is among them
    far = hamming(book.codes(asks), book.codes(sample))
    held = np.take_along_axis(far, near, axis=1)[:, 1:].ravel()
    if not len(held):
        return book
    apart = np.sqrt(np.maximum(np.take_along_axis(d, near, axis=1)[:, 1:], 0)).ravel()
    quantile = lambda x: int(np.sort(x)[min(len(x) - 1, int(np.ceil(target * len(x))))])
    book.radius = quantile(held)
    order = np.argsort(apart, kind="stable")
    steps = np.array_split(order, max(1, min(32, len(order) // 60)))
    book.edges = [float(apart[s[-1]]) for s in steps]
    book.within = np.maximum.accumulate([min(book.radius, quantile(held[s])) for s in steps]).tolist()
    return book


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """k, v: rows with a key whose vectors have finite components and aren't all zeros."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("k").isNotNull() & v.isNotNull())
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(~F.exists(v, odd) & F.exists(v, lambda x: x != 0))


def _masks(bits: int) -> list[int]:
    """All 16-bit words with so many bits set."""
    return [sum(1 << i for i in c) for c in combinations(range(16), bits)]


@tidy
def nearest(embeddings: DataFrame, *, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", bits: int = BITS, report: dict | None = None) -> DataFrame:
    """The *k* nearest of each query found: query_id, rank (from 1), vec_id, score (Euclidean distance), ties to the smaller vec_id.

    Queries are the rows whose key *every* divides; candidates are all rows with another key. Vectors that are
    null, all zero, or hold a null or a component that isn't finite take no part; neither do rows without a key, nor vectors
    whose length differs from the most frequent one. Rows that repeat a key count once each as candidates and once as a query
    (with the least of their vectors). A query that finds fewer than k is compared with all rows. An empty table gives none.
    A *report* gets the numbers of rows, queries, pairs met by probing, queries left to blocks, and pairs compared there.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = _usable(embeddings, key, vector)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]["n"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == dims)
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total)))
    sample = np.array([r["v"] for r in rows.filter(drawn).orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()] or [r["v"] for r in rows.limit(1).collect()])
    book = learn(sample, k, bits)
    # Each row by a number of its own, for keys may repeat.
    coded = saved(_coded(rows, book).withColumn("id", F.monotonically_increasing_id()), "codes")
    asked = coded.filter(F.pmod("k", F.lit(every)) == 0).groupBy("k").agg(F.min(F.struct("v", "code", "wide")).alias("x"))
    live = saved(asked.select(F.col("k").alias("q"), F.col("x.v").alias("qv"), F.col("x.code").alias("qcode"), F.col("x.wide").alias("qwide"), F.lit(book.radius).alias("radius")), "queries")
    if report is not None:
        report.update(rows=total, queries=live.count(), met=0, scanned=0, left=0)
    best = spark.createDataFrame([], "q bigint, id bigint, k bigint, score double")
    coded = _first_copies(coded, k + 1)
    sizes = saved(_part_sizes(coded, total), "part_sizes")
    table = _postings(coded, sizes)
    met = spark.sparkContext.accumulator(0)
    try:
        for b in range(MOST_BITS + 1):
            best = saved(_top(best.unionByName(_probed(live, spark.table(table), sizes, b, k, met)), k), "best")
            if report is not None:
                report["met"] = met.value
            worst = best.groupBy("q").agg(F.max("score").alias("d"), F.count(F.lit(1)).alias("n"))
            needs = F.when(F.col("n") >= k, book.needed(F.col("d"))).otherwise(book.radius)
            live = live.drop("radius").join(worst, "q", "left").withColumn("radius", needs).drop("d", "n")
            live = saved(live.filter(F.col("radius") > book.words * (b + 1) - 1), "queries")
            if live.isEmpty():
                break
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if not live.isEmpty():
        best = _top(best.unionByName(_in_blocks(live, best, coded, book, k, report)), k)
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "k", "id"))
    return saved(best.select(F.col("q").alias("query_id"), place.alias("rank"), F.col("k").alias("vec_id"), "score"), "nearest")


def _coded(rows: DataFrame, book: Codebook) -> DataFrame:
    """Adds code, the substrings as numbers from 0, and wide, the same four to a word."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                code = np.ascontiguousarray(shared.value.codes(np.stack(batch["v"].to_numpy())))
                yield batch.assign(code=list(code.astype(np.int32)), wide=list(code.view(np.int64)))

    return rows.mapInPandas(releasing(run), "k bigint, v array<double>, code array<int>, wide array<bigint>")


def _first_copies(coded: DataFrame, keep: int) -> DataFrame:
    """Without the rows that have *keep* others of the same vector and smaller keys: they are among nobody's nearest, and a large group of copies would meet itself."""
    marks = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v")}
    marked = coded.select("id", "k", *[c.alias(n) for n, c in marks.items()])
    crowds = saved(marked.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep).select("h", "g"), "crowds")
    if crowds.isEmpty():
        return coded
    hint = F.broadcast(crowds) if small(crowds, BROADCAST_ROWS) else crowds
    inside = marked.join(hint, ["h", "g"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    for by in (["h", "g", "salt"], ["h", "g"]):  # the first of each part, then of the whole
        inside = inside.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("k", "id"))).filter(F.col("place") <= keep).drop("place")
    first = saved(inside.select("id"), "first_copies")
    others = coded.withColumns(marks).join(hint, ["h", "g"], "left_anti").drop("h", "g")
    return saved(others.unionByName(coded.join(F.broadcast(first) if small(first, BROADCAST_ROWS) else first, "id", "left_semi").select(*others.columns)), "candidates")


def _prefix_bits(sizes: int) -> int:
    """Leading bits of a value by which parts are told, for so many rows."""
    return min(16, max(0, int(np.ceil(np.log2(max(1, sizes / PART_ROWS))))))


def _part_sizes(coded: DataFrame, total: int) -> DataFrame:
    """w, prefix, salts: how many parts the postings of each range of values take; a range that very many rows share takes several."""
    shift = 16 - _prefix_bits(total)
    rows = coded.select(F.posexplode("code").alias("w", "value")).groupBy("w", F.shiftright("value", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("w", "prefix", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("salts"), F.lit(shift).alias("shift"))


def _postings(coded: DataFrame, sizes: DataFrame) -> str:
    """The name of a table of postings (part, value, id, k, wide, v), bucketed by part: it is dealt once, and no round shuffles it again."""
    spark, name = coded.sparkSession, f"asofkit_postings_{uuid.uuid4().hex}"
    n = partitions_for(spark)
    shift = sizes.first()["shift"]
    rows = coded.select("id", "k", "wide", "v", F.posexplode("code").alias("w", "value")).withColumn("prefix", F.shiftright("value", shift))
    placed = rows.join(F.broadcast(sizes) if small(sizes, BROADCAST_ROWS) else sizes, ["w", "prefix"])
    part = F.xxhash64("w", "prefix", F.pmod(F.xxhash64("id"), F.col("salts")))
    dealt = placed.select(part.alias("part"), "value", "id", "k", "wide", "v").repartition(n, "part")
    dealt.write.option("path", work_path(spark, "postings")).option("compression", "zstd").bucketBy(n, "part").saveAsTable(name)
    return name


def _probed(live: DataFrame, postings: DataFrame, sizes: DataFrame, bits: int, k: int, met=None) -> DataFrame:
    """q, id, k, score: of the rows that a query meets in each part, at a substring exactly *bits* bits away and within its radius, the k nearest.

    A query goes once to each part that holds values to probe; *met*, an accumulator, gets the number of rows met.
    """
    shift = sizes.first()["shift"]
    masks = np.array(_masks(bits), np.int32)
    heads = F.array(*[F.lit(int(m)) for m in sorted({int(m) >> shift for m in masks})])
    asked = live.select("q", "qv", "qwide", "radius", F.posexplode("qcode").alias("w", "own"))
    asked = asked.withColumn("prefix", F.explode(F.transform(heads, lambda m: F.shiftright("own", shift).bitwiseXOR(m))))
    asked = asked.join(F.broadcast(sizes) if small(sizes, BROADCAST_ROWS) else sizes, ["w", "prefix"])
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("part", F.xxhash64("w", "prefix", F.col("salt").cast("bigint")))

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.empty(0, np.int64), "id": np.empty(0, np.int64), "k": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(rows) and len(queries):
            rows = rows.sort_values("value", kind="stable")
            values, own, keys = (rows[c].to_numpy() for c in ("value", "id", "k"))
            codes, data = np.stack(rows["wide"].to_numpy()).astype(np.int64).view(np.uint64), np.stack(rows["v"].to_numpy())
            for q, v, code, radius, value in zip(queries["q"], queries["qv"], queries["qwide"], queries["radius"], queries["own"]):
                probes = value ^ masks
                first, size = np.searchsorted(values, probes), 0
                size = np.searchsorted(values, probes, "right") - first
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                far = np.bitwise_count(codes[at] ^ np.asarray(code, np.int64).view(np.uint64)).sum(axis=1)
                at = at[(far <= radius) & (keys[at] != q)]
                if met is not None:
                    met.add(len(at))
                at, score = _nearest_of(at, own, keys, data, v, k)
                out.append(pd.DataFrame({"q": q, "id": own[at], "k": keys[at], "score": score}))
        return pd.concat(out, ignore_index=True)

    queries = asked.select("part", "q", "qv", "qwide", "radius", "own").groupBy("part")
    return postings.groupBy("part").cogroup(queries).applyInPandas(meet, "q bigint, id bigint, k bigint, score double")


def _nearest_of(at: np.ndarray, own: np.ndarray, keys: np.ndarray, data: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest to *v* of the rows *at*, ties to the smaller key, and their distances."""
    score = _apart(data[at], v)
    if len(at) > k:
        keep = score <= np.partition(score, k - 1)[k - 1]
        at, score = at[keep], score[keep]
    order = np.lexsort((own[at], keys[at], score))[:k]
    return at[order], score[order]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of *a* to *b*: the same sums whatever rows come together."""
    return np.sqrt((np.ascontiguousarray(a - b) ** 2).sum(axis=1))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each row once."""
    once = found.dropDuplicates(["q", "id"])
    return once.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "k", "id"))).filter(F.col("place") <= k).drop("place")


def _in_blocks(live: DataFrame, best: DataFrame, coded: DataFrame, book: Codebook, k: int, report: dict | None) -> DataFrame:
    """q, id, k, score: the k nearest of each query within its radius in each block of rows; of one that finds fewer than k, without a radius.

    Queries come to the driver QUERY_BLOCK at a time.
    """
    rest = saved(live.withColumn("block", F.xxhash64("q")), "left_queries")
    n = rest.count()
    if report is not None:
        report["left"] = n
    blocks, out = -(-n // QUERY_BLOCK), None
    for b in range(blocks):
        part = rest if blocks == 1 else rest.filter(F.pmod("block", F.lit(blocks)) == b)
        found = saved(_scan(coded, part.collect(), k), "scanned")
        if report is not None:
            report["scanned"] += part.count() * report["rows"]
        both = found.select("q", "id").union(best.join(part.select("q"), "q", "left_semi").select("q", "id")).distinct()
        few = part.join(both.groupBy("q").count().filter(F.col("count") >= k), "q", "left_anti").withColumn("radius", F.lit(16 * book.words))
        if short := few.collect():  # these look at everything
            found = found.unionByName(saved(_scan(coded, short, k), "scanned"))
        out = found if out is None else out.unionByName(found)
    return out


def _scan(coded: DataFrame, queries: list, k: int) -> DataFrame:
    """The k nearest of each of some queries within its radius in each block of rows, by comparing all codes."""
    ids, radius = (np.array([r[c] for r in queries], np.int64) for c in ("q", "radius"))
    vectors, codes = np.array([r["qv"] for r in queries], float), np.array([r["qwide"] for r in queries], np.int64).view(np.uint64)
    shared = coded.sparkSession.sparkContext.broadcast((ids, vectors, codes, radius))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, codes, radius = shared.value
        for own, keys, data, of in _blocks(batches):
            of, out = of.astype(np.int64).view(np.uint64), []
            for q, v, code, r in zip(ids, vectors, codes, radius):
                at = np.flatnonzero((np.bitwise_count(of ^ code).sum(axis=1) <= r) & (keys != q))
                at, score = _nearest_of(at, own, keys, data, v, k)
                out.append(pd.DataFrame({"q": q, "id": own[at], "k": keys[at], "score": score}))
            yield pd.concat(out, ignore_index=True)

    return coded.select("id", "k", "v", "wide").mapInPandas(releasing(scan), "q bigint, id bigint, k bigint, score double")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, keys, vectors and codes of INDEX_BLOCK rows or so."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append((batch["id"].to_numpy(np.int64), batch["k"].to_numpy(np.int64), np.stack(batch["v"].to_numpy()), np.stack(batch["wide"].to_numpy())))
            size += len(batch)
        if size >= INDEX_BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))
