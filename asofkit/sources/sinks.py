"""Writers: features only, routed parts, lists joined by bars, submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of train, validation and test rows.
PARTS = {"train": 25, "val": 2, "test": 4}


def part_of(key: str) -> Column:
    name = lambda kind: F.concat_ws("_", F.lit(kind), F.pmod(F.col(key), F.lit(PARTS[kind])).cast("string"))
    return F.when(F.col("is_test") == 1, name("test")).when(F.col("is_val") == 1, name("val")).otherwise(name("train"))


def route(df: DataFrame, key: str) -> DataFrame:
    """Adds the part that a row belongs to by is_test, is_val and its key."""
    return df.withColumn("part", part_of(key))


def write_routed(df: DataFrame, path: str, key: str, fmt: str = "parquet", mode: str = "error") -> None:
    """One folder per part. Parts have hot and cold sizes, so rows are dealt by (part, key) and not by part."""
    routed = route(df, key)
    routed.repartition("part", F.pmod(F.xxhash64(key), F.lit(16))).write.mode(mode).partitionBy("part").format(fmt).save(path)


def write_features(df: DataFrame, path: str, keys: Sequence[str], only_features: bool = False) -> None:
    """CSV with a header; keys are left out with *only_features*. Arrays are joined by bars."""
    flat = df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema if not (only_features and f.name in keys)])
    flat.write.option("header", True).csv(path)


def write_missing_parts(df: DataFrame, path: str, parts: Sequence[str]) -> list[str]:
    """Writes the parts that aren't there yet and says which; a part counts as there once its _SUCCESS is."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    done = []
    for part in parts:
        marker = fs_path(f"{path}/part={part}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            df.filter(F.col("part") == part).drop("part").write.mode("overwrite").parquet(f"{path}/part={part}")
            done.append(part)
    return done


def write_submission(df: DataFrame, path: str) -> None:
    df.select("user_id", "session_id", F.col("ts").alias("timestamp"), "step", "item_recommendations").write.option("header", True).csv(path)


def append_matrix(vectors: DataFrame, path: str) -> None:
    """Adds rows with sparse vectors to a stored matrix: indices and values are plain columns, so that ranges of rows can be read without the rest."""
    from pyspark.ml.functions import vector_to_array

    dense = vector_to_array("features")
    cells = F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: c["v"] != 0)
    rest = [c for c in vectors.columns if c != "features"]
    vectors.select(*rest, F.size(dense).alias("size"), cells.alias("c")).select(*rest, "size", F.col("c.i").alias("indices"), F.col("c.v").alias("values")).write.mode("append").parquet(path)


def write_model(model, path: str) -> None:
    """A fitted model, in place of an older one."""
    model.write().overwrite().save(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds lines to a metric log: JSON objects."""
    rows.coalesce(1).write.mode("append").json(path)
