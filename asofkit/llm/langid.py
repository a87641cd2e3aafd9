"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a sample whose expected size is bounded (MAX_DOCS_PER_LANG documents of each language,
picked by a hash of the key); the matrix of log probabilities, buckets x languages, is broadcast; each batch
of texts is scored as a sparse product, a gather of matrix rows and a segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, release, releasing, without

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Bound of the training sample for each language (the expected number of documents).
MAX_DOCS_PER_LANG = 2_000
SMOOTHING = 0.5
#: Log-probability matrices have 2**BUCKET_BITS rows of this many columns at most.
MAX_LANGS = 200
UNKNOWN = "und"
#: Characters scored at a time, and matrix cells gathered for them: a long text goes by pieces.
_CHUNK = 400_000
_CELLS = 3_000_000
_GAP = " " * max(ORDERS)
_LOW = 0x3000


def _folded() -> np.ndarray:
    """What counts for each low code point: letters in lower case, a space for all else."""
    return np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i if c.isalpha() else 32 for i in range(_LOW)], np.uint32)


_fold = _folded()


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams, a row for each order, and where each text begins."""
    points = np.frombuffer((_GAP.join(texts) + _GAP).encode("utf-32-le"), "<u4")
    points = np.where(points < _LOW, _fold[np.minimum(points, _LOW - 1)], points).astype(np.uint32)
    starts = np.zeros(len(texts), np.int64)
    starts[1:] = np.cumsum([len(t) + len(_GAP) for t in texts[:-1]])
    size = len(points) - max(ORDERS) + 1
    out, value = np.empty((len(ORDERS), size), np.uint16), np.zeros(size, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        value = value * np.uint32(0x9E3779B1) + points[n - 1 : n - 1 + size] + np.uint32(n)
        if n in ORDERS:
            mixed = (value ^ value >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            out[ORDERS.index(n)] = mixed >> np.uint32(32 - BUCKET_BITS)
    return out, starts


def _runs(texts: list[str], chunk: int) -> Iterator[list[tuple[int, str, int]]]:
    """Pieces of texts, about *chunk* characters together: (text, piece, n-grams that start in it).

    A piece that goes on is followed by the characters that its last n-grams reach into; they don't start any. A text's last piece has one n-gram
    more, at its end.
    """
    run, size, over = [], 0, max(ORDERS) - 1
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), chunk):
            b = min(len(t), a + chunk)
            run.append((i, t[a:] if b == len(t) else t[a : b + over], b - a + (b == len(t))))
            size += b - a
            if size >= chunk:
                yield run
                run, size = [], 0
    if run:
        yield run


@dataclass
class Model:
    langs: list[str]
    log_probs: np.ndarray
    priors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior probabilities, texts x languages."""
        logs = np.tile(self.priors, (len(texts), 1))
        for run in _runs(texts, min(_CHUNK, _CELLS // len(self.langs))):
            grams, starts = gram_buckets([t for _, t, _ in run])
            # Sums from each start to its end: every other one of these.
            stops = np.minimum(starts + [n for _, _, n in run], grams.shape[1])
            edges = np.stack([starts, stops], axis=1).ravel()
            owners = [i for i, _, _ in run]
            for row in grams:
                cells = np.concatenate([self.log_probs[row], np.zeros((1, len(self.langs)))])
                np.add.at(logs, owners, np.add.reduceat(cells, edges, axis=0)[::2])
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        return weights / weights.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, max_docs: int = MAX_DOCS_PER_LANG) -> Model | None:
    """Learns from labelled *rows*; those without a label or a letter are skipped. None if none is left.

    The sample takes each language's documents by a hash of *key* with probability max_docs / their number.
    """
    rows = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGS + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, max_docs / r["n"]))])
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("null"))), F.lit(1 << 30)) / float(1 << 30)
    langs = sorted(r["l"] for r in sizes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(langs), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for name, group in batch.groupby("l"):
                for run in _runs(group["t"].tolist(), _CHUNK):
                    grams, starts = gram_buckets([t for _, t, _ in run])
                    for a, (_, _, n) in zip(starts, run):
                        table[langs.index(name)] += np.bincount(grams[:, a : a + n].ravel(), minlength=1 << BUCKET_BITS)
        at, bucket = np.nonzero(table)
        yield pd.DataFrame({"at": at, "bucket": bucket, "n": table[at, bucket]})

    counted = rows.filter(drawn < F.element_at(shares, F.col("l"))).select("t", "l").mapInPandas(releasing(count), "at bigint, bucket bigint, n bigint")

    def row(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(1 << BUCKET_BITS)
        cells[group["bucket"]] = group["n"]
        return pd.DataFrame({"at": [int(group["at"].iloc[0])], "cells": [cells.tobytes()]})

    cells = counted.groupBy("at", "bucket").agg(F.sum("n").alias("n")).groupBy("at").applyInPandas(row, "at bigint, cells binary")
    table = np.full((len(langs), 1 << BUCKET_BITS), SMOOTHING)
    for r in cells.toLocalIterator():  # a row of half a megabyte for each language
        table[r["at"]] += np.frombuffer(r["cells"])
    number = {r["l"]: r["n"] for r in sizes}
    priors = np.log(np.array([number[x] for x in langs], float) / sum(number.values()))
    return Model(langs, np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T), priors)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """*docs* with lang_pred and score (input columns of these names are replaced).

    A null text, or one without any letter, is ``und`` with score 0, and so is every text if there is no
    model. Whole texts are scored; score is the posterior probability of lang_pred, ties going to the first name.
    """
    docs = without(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                scores = shared.value.scores(texts.fillna("").tolist())
                at = scores.argmax(axis=1)
                yield pd.DataFrame({"lang": np.array(shared.value.langs, object)[at], "score": scores[np.arange(len(at)), at]})
        finally:
            release()

    best = best.asNondeterministic()  # or a filter on the score would have it computed twice

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("lang_pred", best(F.col(text)))
    return found.withColumns({"score": F.when(lettered, F.col("lang_pred.score")).otherwise(0.0), "lang_pred": F.when(lettered, F.col("lang_pred.lang")).otherwise(UNKNOWN)})


def held_out(key: Column) -> Column:
    """Whether the fold of a document, crc32 of its key as text modulo 4, is 2; a null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fits on the labelled documents that aren't held out and predicts for all; adds held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col(key))), text, lang, key)
    return predict(without(docs, "held_out").withColumn("held_out", held_out(F.col(key))), model, text)
