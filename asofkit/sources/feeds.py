"""Adapters from relational tables to canonical event logs, and readers of the raw log format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.functions.scalars import MISSING, index_of

#: The raw log as files have it: lists are joined by bars.
RAW_LOG = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("user_id", T.StringType()), ("session_id", T.StringType()), ("timestamp", T.LongType()), ("step", T.IntegerType()), ("action_type", T.StringType()),
            ("reference", T.StringType()), ("platform", T.StringType()), ("city", T.StringType()), ("device", T.StringType()), ("current_filters", T.StringType()),
            ("impressions", T.StringType()), ("prices", T.StringType()),
        )
    ]
)

ACTIONS = {"click": "clickout item", "view": "interaction item info", "purchase": "interaction item deals", "signup": "filter selection", "error": "search for poi"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The raw log from CSV files (a path or a glob) with a fixed schema; lists become arrays, prices that aren't numbers null."""
    raw = spark.read.csv(path, header=True, schema=RAW_LOG, quote='"', escape='"')
    return raw.withColumns({"impressions": bar_list("impressions", "bigint"), "prices": bar_list("prices", "int"), "current_filters": bar_list("current_filters", "string")})


def bar_list(name: str, kind: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.transform(F.split(name, r"\|"), lambda x: x.try_cast(kind)))


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """Model configurations, one JSON object per file: dataset paths, class and a map of parameters."""
    return spark.read.schema("dataset_path_matrix string, dataset_path_meta string, model_class string, model_params map<string,string>").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def read_metric_log(spark: SparkSession, path: str, before: str, after: str) -> DataFrame:
    """Numbers at the end of log lines that hold *after* and directly follow one that holds *before*, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    prior = F.lag("value").over(Window.partitionBy("file").orderBy("line"))
    found = lines.withColumn("prior", prior).filter(F.contains(F.col("prior"), F.lit(before)) & F.contains(F.col("value"), F.lit(after)))
    return found.select("file", "line", F.regexp_extract("value", r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*$", 1).try_cast("double").alias("value"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed O: an order is a clickout on the list of its lines; orders without lines have no list and drop out.

    seq is a total order. Every tenth event is a test event: its reference is hidden.
    """
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lists = table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    people = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    joined = table("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(lists, F.col("o_orderkey") == F.col("l_orderkey"))  # lists are shuffled once
    test = (F.col("o_orderkey") % 10 == 0).cast("int")
    flat = joined.select(
        (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint") * 10_000_000 + F.col("o_orderkey")).alias("seq"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("user_id"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        F.concat_ws("-", F.col("o_custkey"), F.year("o_orderdate")).alias("session_id"),
        F.col("n_name").alias("platform"),
        F.concat_ws(", ", "c_mktsegment", "n_name").alias("city"),
        F.col("o_orderpriority").alias("device"),
        F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("filters"),
        test.alias("is_test"),
        F.size("lines").alias("n"),
        F.col("lines.l_partkey").alias("items"),
        F.transform("lines.l_extendedprice", lambda p: F.floor(p).cast("bigint")).alias("prices"),
    )
    shown = flat.withColumn("reference", F.when(F.col("is_test") == 0, F.get("items", (F.col("event_id") % F.col("n")).cast("int"))))
    indexed = shown.withColumn("idx", F.coalesce(index_of("items", F.col("reference")), F.lit(MISSING)))
    return indexed.withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))


def observations(events: DataFrame) -> DataFrame:
    """One row per event and list member: rank (from 0), item_id, price, was_clicked, and the event's other columns."""
    rest = [c for c in events.columns if c not in ("items", "prices")]
    rows = events.select(*rest, F.posexplode(F.arrays_zip(F.col("items").alias("item_id"), F.col("prices").alias("price"))).alias("rank", "x"))
    return rows.select(*rest, "x.item_id", "x.price", "rank", F.coalesce(F.col("x.item_id") == F.col("reference"), F.lit(False)).cast("int").alias("was_clicked"))


def action_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed E: a log of actions with references; event ids are a total order."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return raw.select(
        F.col("event_id").alias("seq"),
        "user_id",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.element_at(names, F.col("event_type")).alias("action_type"),
        F.get_json_object("props", "$.k").alias("reference"),
        F.floor("value").cast("bigint").alias("price"),
    )


def mixed_events(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """Feed M: the clickouts of feed O, each with actions on items of its list in the ten minutes before, of the types that feed E lacks.

    References are texts: mostly items of the list to come, some items that it doesn't hold, some free text. item is the reference as an item, null for
    text; idx is its place in the clickout's own list, null for other actions. *ev* is feed O, where it is made already.
    """
    ev = order_events(spark, sf_dir) if ev is None else ev
    kind = F.pmod(F.col("event_id") + F.col("rank"), F.lit(6))
    names = F.array(*[F.lit(x) for x in ("interaction item image", "interaction item rating", "interaction item info", "search for item", "interaction item deals", "change of sort order")])
    orders = F.array(F.lit("price only"), F.lit("distance"), F.lit("rating"))
    shown = ev.select("seq", "event_id", "user_id", "session_id", "ts", "platform", "device", F.posexplode("items").alias("rank", "item"))
    text = F.when(kind == 5, F.get(orders, F.col("rank") % 3)).when(F.col("item") % 7 == 0, (F.col("item") + 1).cast("string")).when(F.col("item") % 11 == 0, "5 Star").otherwise(F.col("item").cast("string"))
    none = F.lit(None)
    acts = shown.select(
        (F.col("seq") * 100 + F.col("rank")).alias("seq"), "user_id", "session_id", (F.col("ts") - 600 + 40 * F.col("rank")).alias("ts"), F.get(names, kind.cast("int")).alias("action_type"), text.alias("reference"),
        F.lit(0).alias("is_test"), "platform", "device", none.cast("array<bigint>").alias("items"), none.cast("array<bigint>").alias("prices"), none.cast("int").alias("n"), none.cast("int").alias("idx"),
    )
    clicks = ev.select((F.col("seq") * 100 + 99).alias("seq"), "user_id", "session_id", "ts", F.lit("clickout item").alias("action_type"), F.col("reference").cast("string").alias("reference"), "is_test", "platform", "device", "items", "prices", "n", "idx")
    return acts.unionByName(clicks).withColumn("item", F.col("reference").try_cast("bigint"))


def with_next_lists(events: DataFrame) -> DataFrame:
    """Adds fake_items and fake_prices, the list of the session's next event that has one (its own, if it does), and fake_idx, the place of item in it, MISSING without."""
    onward = Window.partitionBy("user_id", "session_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({"fake_items": F.last("items", ignorenulls=True).over(onward), "fake_prices": F.last("prices", ignorenulls=True).over(onward)})
    return out.withColumn("fake_idx", F.coalesce(index_of("fake_items", F.col("item")), F.lit(MISSING)))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """file, row, indices, values: the rows of compressed-row matrices in NPZ files (indptr, indices, data), one task for each file."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                m = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                ptr, at, values = m["indptr"], m["indices"].astype(np.int32), m["data"].astype(np.float64)
                for a in range(0, len(ptr) - 1, 10_000):
                    rows = range(a, min(a + 10_000, len(ptr) - 1))
                    yield pd.DataFrame({"file": name, "row": list(rows), "indices": [at[ptr[r] : ptr[r + 1]] for r in rows], "values": [values[ptr[r] : ptr[r + 1]] for r in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row bigint, indices array<int>, values array<double>")


def read_item_map(spark: SparkSession, path: str) -> DataFrame:
    """item_id, properties: maps from items to sets, stored as JSON objects of lists, one per file or line."""
    pairs = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("item_id", "properties"))
    return pairs.select(F.col("item_id").cast("bigint").alias("item_id"), F.array_sort(F.array_distinct("properties")).alias("properties"))
