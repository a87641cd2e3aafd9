"""Readers, writers and the online mode."""

import json

from pyspark.sql import functions as F

from asofkit.sources import feeds, sinks
from asofkit.streaming.online import prior_counts_stream

RAW = """user_id,session_id,timestamp,step,action_type,reference,platform,city,device,current_filters,impressions,prices
u1,s1,100,1,clickout item,5,AU,"Sydney, Australia",mobile,A|B,5|6|x,10|20|30
u1,s1,101,2,search for poi,"Opera, House",AU,"Sydney, Australia",mobile,,,
"""


def test_raw_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text(RAW)
    a, b = feeds.read_log(spark, str(tmp_path / "*.csv")).orderBy("step").collect()
    assert (a["impressions"], a["prices"], a["current_filters"], a["city"]) == ([5, 6, None], [10, 20, 30], ["A", "B"], "Sydney, Australia")
    assert (b["impressions"], b["reference"], b["current_filters"]) == (None, "Opera, House", None)


def test_configs_and_metric_log(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps({"dataset_path_matrix": "m", "dataset_path_meta": "t", "model_class": "boosted", "model_params": {"leaves": 64}}, indent=1))
    row = feeds.read_run_configs(spark, str(tmp_path / "*.json")).first()
    assert row["model_class"] == "boosted" and row["model_params"] == {"leaves": "64"}
    (tmp_path / "run.log").write_text("start\nround 10\nauc 0.5\nauc 0.9\nround 20\nauc 0.75\n")
    got = feeds.read_metric_log(spark, str(tmp_path / "run.log"), "round", "auc").orderBy("line").collect()
    assert [r["value"] for r in got] == [0.5, 0.75]


def test_writers(spark, sf, tmp_path):
    ev = feeds.order_events(spark, sf).withColumn("is_val", F.lit(0))
    sinks.write_routed(ev, str(tmp_path / "routed"), "event_id")
    back = spark.read.parquet(str(tmp_path / "routed"))
    assert back.count() == ev.count() and back.select("part").distinct().count() <= 29
    sinks.write_features(ev.select("seq", "items"), str(tmp_path / "csv"), ["seq"], only_features=True)
    lines = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert lines.columns == ["items"] and lines.count() == ev.count()
    parts = sinks.route(ev, "event_id")
    first = sinks.write_missing_parts(parts, str(tmp_path / "parts"), ["test_0", "test_1"])
    again = sinks.write_missing_parts(parts, str(tmp_path / "parts"), ["test_0", "test_1", "test_2"])
    assert (first, again) == (["test_0", "test_1"], ["test_2"])


def test_stream_counts_what_came_before(spark, tmp_path):
    schema = "seq bigint, item string, clicked int, update int, time timestamp"
    batches = [[(1, "a", 1, 1), (2, "a", 0, 1), (3, "b", 0, 0)], [(4, "a", 1, 0), (5, "a", 0, 1), (6, "b", 1, 1), (7, "b", 0, 1)]]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("time", F.timestamp_seconds(F.col("seq")))
        df.coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    q = prior_counts_stream(stream, "item").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: (r["clicks"], r["impressions"]) for r in spark.sql("SELECT * FROM counts").collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (1, 2), 5: (1, 2), 6: (0, 0), 7: (1, 1)}
