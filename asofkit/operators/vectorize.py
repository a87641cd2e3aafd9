"""Feature matrices: encodings with minimal support, bags of words, shifts that make matrices sparse, narrower types."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMPUTE = -9999.0


def minimize_nnz(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shifts each column so that its most frequent value (the least of those) is 0, if it is the minimum or the maximum."""
    stats = df.agg(*[x for c in columns for x in (F.mode(c, deterministic=True).alias(f"{c}_mode"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]).first()
    shift = {c: stats[f"{c}_mode"] if stats[f"{c}_mode"] in (stats[f"{c}_min"], stats[f"{c}_max"]) and stats[f"{c}_mode"] is not None else 0 for c in columns}
    return df.withColumns({c: F.col(c) - F.lit(shift[c]) for c in columns})


def support(df: DataFrame, terms: str) -> DataFrame:
    """term, rows: how many rows hold each distinct term of an array column."""
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))


def one_hot(df: DataFrame, key: Sequence[str], column: str, min_rows: int) -> DataFrame:
    """key, term, value 1: a sparse one-hot encoding of values with at least *min_rows* rows."""
    kept = support(df.select(F.array(F.col(column).cast("string")).alias("t")), "t").filter(F.col("rows") >= min_rows)
    return df.select(*key, F.col(column).cast("string").alias("term")).join(kept.select("term"), "term").select(*key, "term", F.lit(1).alias("value"))


def bag_of_words(df: DataFrame, key: Sequence[str], terms: str, min_rows: int) -> DataFrame:
    """key, term, count of terms in at least *min_rows* rows."""
    kept = support(df, terms).filter(F.col("rows") >= min_rows)
    counts = df.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("value"))
    return counts.join(kept.select("term"), "term").select(*key, "term", "value")


def char_ngrams(text: str, n: int):
    """The n-grams of a text column, as an array."""
    size = F.length(text)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def sparse_columns(df: DataFrame, columns: Sequence[str], min_nnz: int) -> list[str]:
    """Columns with at least *min_nnz* values other than 0."""
    row = df.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(0)) != 0).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] >= min_nnz]


def duplicate_columns(df: DataFrame) -> list[str]:
    """Columns whose contents equal those of an earlier one of the same type, by order-free digests of (row, value) pairs."""
    row_hash = F.xxhash64(*df.columns)
    digests = df.agg(*[F.bit_xor(F.xxhash64(row_hash, F.col(c).cast("string"))).alias(c) for c in df.columns], *[F.sum(F.xxhash64(row_hash, F.col(c).cast("string")) % 1_000_003).alias(f"{c}__s") for c in df.columns]).first()
    seen, out = set(), []
    for c, kind in df.dtypes:
        mark = (kind, digests[c], digests[f"{c}__s"])
        out += [c] if mark in seen else []
        seen.add(mark)
    return out


def downcast(df: DataFrame) -> DataFrame:
    """Integer columns in the narrowest type that holds their minimum and maximum, doubles as floats where nothing is lost."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    row = df.agg(*[F.min(c).alias(f"{c}_a") for c in ints], *[F.max(c).alias(f"{c}_b") for c in ints], *[F.count_if(F.col(c).cast("float").cast("double") != F.col(c)).alias(f"{c}_l") for c in doubles], F.count(F.lit(1)).alias("_n")).first()
    out = {}
    for c in ints:
        a, b = row[f"{c}_a"] or 0, row[f"{c}_b"] or 0
        out[c] = F.col(c).cast(next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= a and b < 1 << bits))
    out |= {c: F.col(c).cast("float") for c in doubles if not row[f"{c}_l"]}
    return df.withColumns(out)


def fit_vectorizer(df: DataFrame, numeric: Sequence[str], bags: dict[str, int]) -> PipelineModel:
    """A pipeline that puts imputed numbers and bags of words (array column -> minimal number of rows) into one vector "features"."""
    stages = [CountVectorizer(inputCol=c, outputCol=f"{c}_bag", minDF=float(n)) for c, n in bags.items()]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*[f"{c}_imputed" for c in numeric], *[f"{c}_bag" for c in bags]], outputCol="features")]).fit(imputed(df, numeric))


def imputed(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_imputed": F.coalesce(F.col(c).cast("double"), F.lit(IMPUTE)) for c in numeric})


def ftrl_predictions(df: DataFrame, key: Sequence[str], order: Sequence[str], features: Sequence[str], label: str, *, bits: int = 18, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0, shard: str | None = None) -> DataFrame:
    """Predict-then-update logistic regression (FTRL-proximal over hashed features and their pairs): key columns and p.

    The sequence is inherently serial: rows of one *shard* value go in order through one learner, and shards learn on their own. Without a shard
    there is one learner for all.
    """
    names = list(features)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, n, now = np.zeros(1 << bits), np.zeros(1 << bits), None
        mask = (1 << bits) - 1
        for batch in batches:
            out = []
            hashed = [pd.util.hash_pandas_object(c + "=" + batch[c].astype(str), index=False).to_numpy(np.uint64) for c in names]
            crossed = [hashed[i] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[j] for i in range(len(names)) for j in range(i)]
            at = (np.stack([np.full(len(batch), 1, np.uint64), *hashed, *crossed], axis=1) & np.uint64(mask)).astype(np.int64)
            for i, y, s in zip(at, batch["_y"].to_numpy(float), batch["_s"]):
                if s != now:
                    z[:], n[:], now = 0, 0, s
                i = np.unique(i)
                zi, ni = z[i], n[i]
                w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                out.append(p)
                if not np.isnan(y):
                    g = p - y
                    z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                    n[i] += g * g
            yield batch[list(key)].assign(p=out)

    rows = df.select(*key, *[c for c in (*order, *names) if c not in key], F.col(label).cast("double").alias("_y"), (F.col(shard).cast("string") if shard else F.lit("")).alias("_s"))
    dealt = rows.repartition(F.col("_s")) if shard else rows.coalesce(1)
    kinds = dict(df.dtypes)
    return dealt.sortWithinPartitions("_s", *order).mapInPandas(learn, ", ".join(f"{c} {kinds[c]}" for c in key) + ", p double")
