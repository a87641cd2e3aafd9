"""Queries that go through files: each writes what it needs into a folder of its own, reads it back with the engine's readers, and removes it at exit."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import matrix as mx
from asofkit.operators import metrics as mt
from asofkit.operators import vectorize as vz
from asofkit.plans.mixed import _log
from asofkit.plans.prep import _e, _o, _ob
from asofkit.plans.ranking import _SC, _scored
from asofkit.plans.registry import query
from asofkit.sources import feeds, sinks
from asofkit.streaming.online import prior_counts_stream

_folders: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _folders:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; sessions within one process may take the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    if not _folders:
        atexit.register(_sweep)
    _folders.append((spark, path := f"{base.rstrip('/')}/asofkit/{uuid.uuid4().hex}"))
    return path


def _text(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


@query(
    " SELECT user_id::VARCHAR AS user_id, session_id, ts AS timestamp, action_type, reference, platform, n::BIGINT AS impressions, CASE WHEN prices IS NULL THEN NULL ELSE list_sum(prices)::BIGINT END AS price_sum FROM lg", "m"
)
def csv_log_scan(spark, sf):
    """The raw log from CSV files under a glob: quoted texts, lists joined by bars, numbers parsed."""
    path, lg = _folder(spark), _log(spark, sf)
    raw = lg.select(
        F.col("user_id").cast("string").alias("user_id"), "session_id", F.col("ts").alias("timestamp"), F.lit(1).alias("step"), "action_type", "reference", "platform", F.concat_ws(", ", F.lit("x"), "platform").alias("city"), "device", F.lit(None).cast("string").alias("current_filters"), F.col("items").alias("impressions"), "prices",
    )
    sinks.write_features(raw, path, [])
    log = feeds.read_log(spark, f"{path}/*.csv")
    total = F.aggregate("prices", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return log.select("user_id", "session_id", "timestamp", "action_type", "reference", "platform", F.when(F.col("impressions").isNotNull(), F.size("impressions").cast("bigint")).alias("impressions"), total.alias("price_sum"))


@query(" SELECT price::BIGINT AS price, rank, n, count(*) AS rows FROM ob GROUP BY ALL", "o")
def csv_features_only(spark, sf):
    """The features without their keys, as CSV with a header."""
    path = _folder(spark)
    sinks.write_features(_ob(spark, sf).select("seq", "item_id", "price", "rank", "n"), path, ["seq", "item_id"], only_features=True)
    back = spark.read.csv(path, header=True, schema="price bigint, rank int, n int", enforceSchema=False)
    return back.groupBy("price", "rank", "n").agg(F.count(F.lit(1)).alias("rows"))


@query(" SELECT CASE WHEN is_test = 1 THEN 'test_' || (event_id % 4)::VARCHAR WHEN step > 1 AND event_id % 7 = 0 THEN 'val_' || (event_id % 2)::VARCHAR ELSE 'train_' || (event_id % 25)::VARCHAR END AS part, event_id, seq FROM ev", "o")
def routed_files(spark, sf):
    """One folder for each part, read back with its name."""
    path, ev = _folder(spark), _o(spark, sf)
    rows = ev.select("event_id", "seq", "is_test", ((F.col("step") > 1) & (F.col("event_id") % 7 == 0)).cast("int").alias("is_val"))
    sinks.write_routed(rows, path, "event_id")
    return spark.read.parquet(path).select("part", "event_id", "seq")


@query(" SELECT 'part' || (event_id % 3)::VARCHAR AS part, count(*) AS rows, sum(seq)::BIGINT AS total FROM ev GROUP BY 1", "o")
def resumed_parts(spark, sf):
    """Parts that are there already aren't written again."""
    path = _folder(spark)
    rows = _o(spark, sf).select("event_id", "seq").withColumn("part", F.concat(F.lit("part"), F.col("event_id") % 3))
    first = sinks.write_missing_parts(rows, path, ["part0", "part2"])
    rest = sinks.write_missing_parts(rows.withColumn("seq", F.when(F.col("part") == "part1", F.col("seq")).otherwise(F.lit(0))), path, ["part0", "part1", "part2"])
    if (first, rest) != (["part0", "part2"], ["part1"]):
        raise AssertionError((first, rest))
    return spark.read.option("basePath", path).parquet(f"{path}/part=*").groupBy(F.col("part").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("total"))


@query(_SC + " SELECT user_id, session_id, ts AS timestamp, step, string_agg(item_id::VARCHAR, ' ' ORDER BY s1 DESC, item_id) AS item_recommendations FROM s GROUP BY ALL", "o")
def submission_file(spark, sf):
    path = _folder(spark)
    sinks.write_submission(mt.recommendations(_scored(spark, sf), ["user_id", "session_id", "ts", "step"], "item_id", "s1"), path)
    return spark.read.csv(path, header=True, schema="user_id bigint, session_id string, timestamp bigint, step int, item_recommendations string", enforceSchema=False)


@query(" SELECT seq, rank, price::DOUBLE AS total FROM ob WHERE price <> 0 AND event_id BETWEEN 100 AND 499", "o")
def matrix_file(spark, sf):
    """Sparse vectors appended by chunks, a range of rows read back."""
    path = _folder(spark)
    cells = _ob(spark, sf).select("event_id", "seq", "rank", F.lit("numeric").alias("branch"), F.concat(F.lit("price_"), F.col("rank")).alias("feature"), F.col("price").cast("double").alias("value")).filter("value <> 0")
    names = cells.select("feature").distinct()
    for k in range(2):
        sinks.append_matrix(mx.to_vectors(cells.filter(F.col("event_id") % 2 == k), names, ["event_id", "seq", "rank"]), path)
    part = mx.row_range(spark.read.parquet(path), "event_id", 100, 499)
    return part.select("seq", "rank", F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("SELECT * FROM (VALUES ('run_1', 0.5::DOUBLE), ('run_2', 0.75::DOUBLE), ('run_1', 0.625::DOUBLE)) v(run, auc)")
def metric_log(spark, sf):
    """Numbers on the lines after others, from logs of runs."""
    path = _folder(spark)
    for run, values in (("run_1", (0.5, 0.625)), ("run_2", (0.75,))):
        lines = [x for v in values for x in ("start", f"round of {run}", f"auc {v}", "auc 0.1")]
        _text(spark, f"{path}/{run}", lines)
    found = feeds.read_metric_log(spark, f"{path}/run_*/*.txt", "round of", "auc")
    return found.select(F.regexp_extract("file", r"(run_\d+)/", 1).alias("run"), F.col("value").alias("auc"))


@query("SELECT * FROM (VALUES ('boosted', 'm1', '64'), ('logistic', 'm2', NULL)) v(model_class, matrix, leaves)")
def run_configs(spark, sf):
    path = _folder(spark)
    for name, config in (("a", {"dataset_path_matrix": "m1", "model_class": "boosted", "model_params": {"leaves": 64}}), ("b", {"dataset_path_matrix": "m2", "model_class": "logistic", "model_params": {}})):
        _text(spark, f"{path}/{name}", json.dumps(config, indent=1).split("\n"))
    return feeds.read_run_configs(spark, f"{path}/*/*.txt").select("model_class", F.col("dataset_path_matrix").alias("matrix"), F.try_element_at("model_params", F.lit("leaves")).alias("leaves"))


@query("SELECT p_partkey AS item_id, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS properties FROM part")
def item_map_file(spark, sf):
    """Sets of items' properties, stored as JSON objects."""
    path = _folder(spark)
    part = spark.read.parquet(f"{sf}/part.parquet")
    part.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.split("p_name", " "))).alias("value")).write.text(path)
    return feeds.read_item_map(spark, path).select("item_id", S.list_key("properties").alias("properties"))


@query(
    """ SELECT seq, reference, count(CASE WHEN action_type = 'clickout item' AND seq % 5 <> 0 THEN 1 END) OVER w AS clicks, count(CASE WHEN seq % 5 <> 0 THEN 1 END) OVER w AS impressions
    FROM ac WINDOW w AS (PARTITION BY reference ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "e",
)
def online_counts(spark, sf):
    """Prior counts kept over a stream of files; every fifth event looks but doesn't count."""
    path = _folder(spark)
    events = _e(spark, sf).select("seq", "reference", (F.col("action_type") == "clickout item").cast("int").alias("clicked"), (F.col("seq") % 5 != 0).cast("int").alias("update"), F.timestamp_seconds("ts").alias("time"))
    events.repartition(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    out = prior_counts_stream(stream, "reference").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("seq bigint, reference string, clicks bigint, impressions bigint").parquet(f"{path}/out")


# ---------------------------------------------------------------- choices of columns


@query(" SELECT unnest(['seq', 'event_id', 'user_id', 'ts', 'is_test', 'n', 'idx', 'step', 'item_id', 'price', 'rank', 'was_clicked', 'reference']) AS name")
def numeric_columns(spark, sf):
    obs: DataFrame = _ob(spark, sf)
    return spark.createDataFrame([(c,) for c in S.numeric_columns(obs)], "name string")


@query(", x AS (SELECT count(*) FILTER (WHERE price <> 0) AS price, count(*) FILTER (WHERE was_clicked <> 0) AS was_clicked, count(*) FILTER (WHERE rank > 8) AS late FROM ob), y AS (UNPIVOT x ON price, was_clicked, late INTO NAME name VALUE n) SELECT name FROM y WHERE n >= 1000", "o")
def sparsity_filter(spark, sf):
    """Columns with enough values other than 0."""
    obs = _ob(spark, sf).withColumn("late", (F.col("rank") > 8).cast("int"))
    return spark.createDataFrame([(c,) for c in vz.sparse_columns(obs, ["price", "was_clicked", "late"], 1000)], "name string")
