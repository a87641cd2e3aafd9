"""Queries over scans, filters, preparation and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import side_tables as side
from asofkit.plans.registry import query
from asofkit.sources import feeds


def _o(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.order_events(spark, sf)


def _ob(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.observations(_o(spark, sf))


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.action_events(spark, sf)


@query(" SELECT seq, user_id, action_type, reference FROM ac ORDER BY seq LIMIT 102", "e")
def scan_limit(spark, sf):
    """A scan that stops after limit + 2 rows (limit 100), in log order."""
    return _e(spark, sf).orderBy("seq").limit(102).select("seq", "user_id", "action_type", "reference")


@query(" SELECT seq, user_id, reference FROM ac WHERE action_type IN ('clickout item', 'interaction item deals', 'interaction item image', 'interaction item info', 'interaction item rating', 'search for item') AND reference IS NOT NULL", "e")
def filter_isin(spark, sf):
    return _e(spark, sf).filter(F.col("action_type").isin(*S.ITEM_ACTIONS) & F.col("reference").isNotNull()).select("seq", "user_id", "reference")


@query(" SELECT 'train' AS src, 0 AS is_test, seq, user_id FROM ev WHERE is_test = 0 UNION ALL SELECT 'test', 1, seq, user_id FROM ev WHERE is_test = 1", "o")
def union_train_test(spark, sf):
    ev = _o(spark, sf).select("is_test", "seq", "user_id")
    train = ev.filter("is_test = 0").select(F.lit("train").alias("src"), F.lit(0).alias("is_test"), "seq", "user_id")
    return train.unionByName(ev.filter("is_test = 1").select(F.lit("test").alias("src"), F.lit(1).alias("is_test"), "seq", "user_id"))


@query(" SELECT seq, user_id, (reference IS NULL)::INTEGER AS hidden, contains(filters, 'URGENT')::INTEGER AS has_urgent FROM ev", "o")
def is_test_flag(spark, sf):
    return _o(spark, sf).select("seq", "user_id", F.col("reference").isNull().cast("int").alias("hidden"), F.contains(F.col("filters"), F.lit("URGENT")).cast("int").alias("has_urgent"))


@query(" SELECT seq, session_id, first_value(reference IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM ev", "o")
def bfill_session(spark, sf):
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    return _o(spark, sf).select("seq", "session_id", F.first("reference", ignorenulls=True).over(w).alias("filled"))


@query(
    """, r AS (SELECT seq, session_id, action_type, (row_number() OVER (PARTITION BY session_id ORDER BY seq))::INTEGER AS step FROM ac),
    q AS (SELECT *, count(*) OVER (PARTITION BY session_id, action_type ORDER BY step) AS clickout_step, count(*) OVER (PARTITION BY session_id, action_type ORDER BY step DESC) AS clickout_step_rev FROM r)
    SELECT seq, step, clickout_step, clickout_step_rev, clickout_step + clickout_step_rev - 1 AS clickout_max_step FROM q""",
    "e",
)
def step_rank_max(spark, sf):
    stepped = _e(spark, sf).withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    keys = ("session_id", "action_type")
    up, down = side.rank_max(F.col("step").asc(), *keys), side.rank_max(F.col("step").desc(), *keys)
    return stepped.select("seq", "step", up.alias("clickout_step"), down.alias("clickout_step_rev"), (up + down - 1).alias("clickout_max_step"))


@query(
    """, c AS (SELECT *, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS dt FROM ac WHERE action_type = 'clickout item'), d AS (SELECT * FROM c WHERE dt = (SELECT max(dt) FROM c)),
    r AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM d) SELECT a.seq, a.user_id, coalesce(r.k = 1, FALSE)::INTEGER AS is_val FROM ac a LEFT JOIN r ON a.seq = r.seq""",
    "e",
)
def val_last_click(spark, sf):
    """Flags each user's last click of the last day; if two share the last second, none is flagged."""
    ac = _e(spark, sf).withColumn("dt", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    clicks = ac.filter(F.col("action_type") == "clickout item")
    last = clicks.agg(F.max("dt").alias("dt"))
    day = clicks.join(F.broadcast(last), "dt")
    flagged = day.withColumn("k", side.rank_max(F.col("ts").desc(), "user_id")).filter("k = 1").select(F.col("seq"), F.lit(1).alias("is_val"))
    return ac.join(flagged, "seq", "left").select("seq", "user_id", F.coalesce("is_val", F.lit(0)).alias("is_val"))


@query(" SELECT seq, rank, item_id, price, was_clicked, is_test FROM ob", "o")
def explode_impressions(spark, sf):
    return _ob(spark, sf).select("seq", "rank", "item_id", "price", "was_clicked", "is_test")


@query(" SELECT seq, idx AS index_clicked, CASE WHEN idx >= 0 THEN prices[(idx + 1)::BIGINT] END AS price_clicked FROM ev", "o")
def index_clicked(spark, sf):
    return _o(spark, sf).select("seq", F.col("idx").alias("index_clicked"), F.when(F.col("idx") >= 0, F.get("prices", F.col("idx"))).alias("price_clicked"))


@query(" SELECT seq, array_to_string(items, '|') AS impressions_raw, array_to_string(list_sort(items), '|') AS impressions_hash FROM ev", "o")
def impressions_hash(spark, sf):
    return _o(spark, sf).select("seq", S.list_key("items").alias("impressions_raw"), S.sorted_key("items").alias("impressions_hash"))


@query(" SELECT seq, ts - seq % 7 AS session_start, row_number() OVER (PARTITION BY session_id ORDER BY seq)::INTEGER AS impression_no, coalesce(list_position(items, reference) - 1, -1)::INTEGER AS index, n AS impression_num FROM ev", "o")
def event_projection(spark, sf):
    """Item events as (place in the list, length of the list)."""
    ev = _o(spark, sf)
    return ev.select("seq", (F.col("ts") - F.col("seq") % 7).alias("session_start"), F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).alias("impression_no"), F.coalesce(S.index_of("items", F.col("reference")), F.lit(-1)).alias("index"), F.col("n").alias("impression_num"))


@query(
    """ SELECT seq, CASE WHEN price <= 12 THEN price ELSE floor(price / 4.0)::BIGINT * 4 END AS bucket, regexp_matches(reference, '^[0-9]+$')::INTEGER AS numeric, coalesce(try_cast(reference AS BIGINT), 0) AS tried,
    round(ln(1 + abs(price)), 6) AS log1p, split_part(session_id, '-', 1) AS first_part, sha1(reference) AS digest, lower(replace(action_type, ' ', '_')) AS snake, hour(make_timestamp(ts * 1000000))::INTEGER AS h, minute(make_timestamp(ts * 1000000))::INTEGER AS m,
    round(greatest(least(1.0 / (1.0 + exp(-greatest(least(price / 10.0, 35.0), -35.0))), 1.0 - 1e-15), 1e-15), 6) AS sigmoid FROM ac""",
    "e",
)
def scalar_functions(spark, sf):
    p = F.col("price")
    bounded = F.greatest(F.least(p / 10.0, F.lit(35.0)), F.lit(-35.0))
    return _e(spark, sf).select(
        "seq", S.time_bucket(p).alias("bucket"), S.is_numeric("reference").cast("int").alias("numeric"), F.coalesce(F.col("reference").try_cast("bigint"), F.lit(0)).alias("tried"), F.round(F.log1p(F.abs(p)), 6).alias("log1p"),
        F.get(F.split("session_id", "-"), F.lit(0)).alias("first_part"), F.sha1("reference").alias("digest"), F.lower(F.translate("action_type", " ", "_")).alias("snake"),
        F.hour(F.timestamp_seconds("ts")).alias("h"), F.minute(F.timestamp_seconds("ts")).alias("m"),
        F.round(F.greatest(F.least(1 / (1 + F.exp(-bounded)), F.lit(1 - 1e-15)), F.lit(1e-15)), 6).alias("sigmoid"),
    )


@query(" SELECT count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, count(*) AS n, min(price) AS min_price, max(price) AS max_price, count(*) FILTER (WHERE price <> 0) AS nnz, mode(rank) AS top_rank FROM ob", "o")
def column_statistics(spark, sf):
    return _ob(spark, sf).agg(F.countDistinct("item_id").alias("items"), F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count_if(F.col("price") != 0).alias("nnz"), F.mode("rank").alias("top_rank"))


# ---------------------------------------------------------------- side tables


@query(" SELECT item_id, round(avg(price), 6) AS mean_price FROM ob GROUP BY item_id", "o")
def item_price_mean(spark, sf):
    return side.mean_prices(_ob(spark, sf)).withColumn("mean_price", F.round("mean_price", 6))


@query(
    """, d AS (SELECT DISTINCT item_id, price FROM ob), w AS (SELECT *, count(*) OVER (PARTITION BY item_id ORDER BY price) AS price_rank_asc, count(*) OVER (PARTITION BY item_id ORDER BY price DESC) AS price_rank_desc,
    min(price) OVER (PARTITION BY item_id) AS min_price, max(price) OVER (PARTITION BY item_id) AS max_price, count(*) OVER (PARTITION BY item_id) AS count_price FROM d)
    SELECT item_id, price, price_rank_asc, price_rank_desc, round(price_rank_asc / count_price::DOUBLE, 6) AS price_rank_asc_pct, min_price, max_price, count_price, round(price / min_price::DOUBLE, 6) AS price_relative_to_min, max_price - min_price AS price_range, round(max_price / min_price::DOUBLE, 6) AS price_range_div FROM w""",
    "o",
)
def item_price_rank(spark, sf):
    r = side.price_ranks(_ob(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("price_rank_asc_pct", "price_relative_to_min", "price_range_div")})


_PCT = """, d AS (SELECT DISTINCT city, platform, item_id, price FROM ob), r AS (SELECT {k}, price, rank() OVER (PARTITION BY {k} ORDER BY price) AS lo, count(*) OVER (PARTITION BY {k} ORDER BY price) AS hi, count(*) OVER (PARTITION BY {k}) AS n FROM d)
    SELECT DISTINCT {k}, price, round((lo + hi) / 2.0 / n, 6) AS pct FROM r"""


@query(_PCT.format(k="city"), "o")
def price_pct_by_city(spark, sf):
    return side.price_percentiles(_ob(spark, sf), "city").withColumn("pct", F.round("pct", 6))


@query(_PCT.format(k="platform"), "o")
def price_pct_by_platform(spark, sf):
    return side.price_percentiles(_ob(spark, sf), "platform").withColumn("pct", F.round("pct", 6))


@query(
    """, p AS (SELECT DISTINCT a.item_id AS above, b.item_id AS below FROM ob a JOIN ob b ON a.seq = b.seq AND a.rank < b.rank WHERE contains(a.filters, 'URGENT')), s AS (SELECT above AS item_id, 1 AS win FROM p UNION ALL SELECT below, 0 FROM p)
    SELECT item_id, round(sum(win) / count(*)::DOUBLE, 6) AS rating FROM s GROUP BY item_id""",
    "o",
)
def dominance_rating(spark, sf):
    return side.dominance_ratings(_o(spark, sf), F.contains(F.col("filters"), F.lit("URGENT"))).withColumn("rating", F.round("rating", 6))


#: Lists of feed O hardly recur, so transitions go by (user, platform) as the list and by days.
_CLICKS = """, k AS (SELECT user_id, seq, platform, device, idx, (ts // 86400) % 97 + 100 * row_number() OVER (PARTITION BY user_id ORDER BY seq) AS t0, device AS list_key FROM ev WHERE idx >= 0),
    s AS (SELECT device, idx, lag(list_key) OVER w = list_key AS same, lag(idx) OVER w AS before, abs(t0 - lag(t0) OVER w) AS dt FROM k WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    f AS (SELECT *, (CASE WHEN dt <= 12 THEN dt ELSE floor(dt / 4.0) * 4 END)::INTEGER AS bucket FROM s WHERE same AND dt <= 120),"""


def _click_log(spark, sf):
    """Clicks with a synthetic clock that never runs backwards much, and the device as the list."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return _o(spark, sf).filter("idx >= 0").select("user_id", "seq", "platform", "device", "idx", (F.floor(F.col("ts") / 86400) % 97 + 100 * n).alias("ts"), F.col("device").alias("list_key"))


_FILL = """ c AS (SELECT {k}, {o} AS "offset", count(*) AS c FROM f GROUP BY ALL), g AS (SELECT d.*, r."offset"::INTEGER AS "offset" FROM (SELECT DISTINCT {k} FROM c) d, generate_series({a}, {b}) AS r("offset")),
    h AS (SELECT g.*, coalesce(c.c, 1) AS n FROM g LEFT JOIN c USING ({k}, "offset")) SELECT {k}, "offset", round(n / (sum(n) OVER (PARTITION BY {k}))::DOUBLE, 6) AS prob FROM h"""


@query(_CLICKS.replace("abs(t0 - lag(t0) OVER w)", "t0 - lag(t0) OVER w") + _FILL.format(k="bucket", o="idx - before", a=-10, b=10), "o")
def transition_prob(spark, sf):
    return side.transition_probabilities(_click_log(spark, sf)).withColumn("prob", F.round("prob", 6))


@query(_CLICKS.replace("abs(t0 - lag(t0) OVER w)", "t0 - lag(t0) OVER w") + _FILL.format(k="device, bucket", o="idx - before", a=-10, b=10), "o")
def transition_prob_by_device(spark, sf):
    return side.transition_probabilities(_click_log(spark, sf), "device").withColumn("prob", F.round("prob", 6))


@query(_CLICKS.replace("abs(t0 - lag(t0) OVER w)", "t0 - lag(t0) OVER w").replace("lag(idx) OVER w AS before", "lag(idx) OVER w AS place") + _FILL.format(k="bucket, place", o="idx", a=0, b=10), "o")
def transition_prob_abs(spark, sf):
    return side.transition_probabilities(_click_log(spark, sf), offsets=(0, 10), absolute=True).withColumn("prob", F.round("prob", 6))


@query(" SELECT item_id, array_to_string(list_sort(list(DISTINCT device)), ' ') AS labels FROM ob GROUP BY item_id", "o")
def poi_sets(spark, sf):
    return side.item_sets(_o(spark, sf).withColumn("label", F.col("device"))).select("item_id", F.array_join("labels", " ").alias("labels"))


@query(" SELECT item_id, array_to_string(list_sort(list(DISTINCT device)), ' ') AS labels FROM ob WHERE rank < 2 GROUP BY item_id", "o")
def poi_sets_topk(spark, sf):
    return side.item_sets(_o(spark, sf).withColumn("label", F.col("device")), top=2).select("item_id", F.array_join("labels", " ").alias("labels"))


def _properties(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = F.array_distinct(F.concat(F.array("p_brand", "p_type", F.concat(F.lit("size"), "p_size")), F.split("p_name", " ")))
    return part.select(F.col("p_partkey").alias("item_id"), names.alias("properties"))


_PROPS = "WITH pr AS (SELECT p_partkey AS item_id, list_distinct(list_concat([p_brand, p_type, 'size' || p_size::VARCHAR], string_split(p_name, ' '))) AS properties FROM part)"


@query(_PROPS + " SELECT property, (row_number() OVER (ORDER BY property) - 1)::INTEGER AS code FROM (SELECT DISTINCT unnest(properties) AS property FROM pr)")
def property_codes(spark, sf):
    return side.property_codes(_properties(spark, sf))


@query(
    _PROPS
    + """ SELECT item_id, len(properties)::INTEGER AS n_properties, CASE WHEN list_contains(properties, 'size3') THEN 3 WHEN list_contains(properties, 'size2') THEN 2 WHEN list_contains(properties, 'size1') THEN 1 END AS stars,
    list_contains(properties, 'size4')::INTEGER AS has_size4 FROM pr"""
)
def metadata_dense(spark, sf):
    return side.dense_properties(_properties(spark, sf), {"stars": {"size1": 1, "size2": 2, "size3": 3}}, {"has_size4": "size4"}).drop("properties")


@query(
    """, s AS (SELECT *, coalesce(lag(reference) OVER (PARTITION BY user_id ORDER BY session_id, seq) <> reference, TRUE) AS new FROM ac), t AS (SELECT reference, lead(ts) OVER (PARTITION BY user_id, session_id ORDER BY seq) - ts AS dwell FROM s WHERE new)
    SELECT reference, min(dwell) AS dwell_min, max(dwell) AS dwell_max, round(avg(dwell), 6) AS dwell_mean, round(median(dwell), 6) AS dwell_median FROM t WHERE dwell IS NOT NULL AND regexp_matches(reference, '^[0-9]+$') GROUP BY reference""",
    "e",
)
def dwell_time(spark, sf):
    return side.dwell_times(_e(spark, sf)).withColumns({c: F.round(c, 6) for c in ("dwell_mean", "dwell_median")})


_LOO = """, u AS (SELECT item_id, platform, user_id, 'impressions' AS stat FROM ob UNION ALL SELECT item_id, platform, user_id, 'clickout item' FROM ob WHERE was_clicked = 1),
    m AS (SELECT DISTINCT {k}, stat, user_id FROM u) SELECT {k}, stat, user_id, (count(*) OVER (PARTITION BY {k}, stat) - 1) AS others FROM m"""


def _loo(spark, sf, *keys):
    ob = _ob(spark, sf)
    rows = ob.select("item_id", "platform", "user_id", F.explode(F.when(F.col("was_clicked") == 1, F.array(F.lit("impressions"), F.lit("clickout item"))).otherwise(F.array(F.lit("impressions")))).alias("stat"))
    return side.loo_counts(rows, *keys)


@query(_LOO.format(k="item_id"), "o")
def loo_users(spark, sf):
    return _loo(spark, sf, "item_id")


@query(_LOO.format(k="item_id, platform"), "o")
def loo_users_by_platform(spark, sf):
    return _loo(spark, sf, "item_id", "platform")


@query(
    """ SELECT seq, trim(split_part(city, ',', -1)) AS country, (trim(split_part(city, ',', -1)) = platform AND platform IN ('NATION_1', 'NATION_2'))::INTEGER AS country_eq_platform, substr(user_id::VARCHAR, 1, 1) AS user_first,
    hour(make_timestamp((ts + CASE WHEN platform = 'NATION_1' THEN 18000 ELSE 0 END) * 1000000))::INTEGER AS local_hour, 'BEG ' || CASE WHEN idx > 0 THEN idx::VARCHAR || ' , ' || n::VARCHAR ELSE n::VARCHAR END || ' END' AS places FROM ev""",
    "o",
)
def event_projections(spark, sf):
    """Country of the city, whether it is the platform's, the user's first letter, local hours, places as words."""
    ev = _o(spark, sf)
    return ev.select(
        "seq", S.country_of("city").alias("country"), S.country_is_platform("city", "platform", {"NATION_1": "NATION_1", "NATION_2": "NATION_2"}).alias("country_eq_platform"), F.substring(F.col("user_id").cast("string"), 1, 1).alias("user_first"),
        F.hour(S.local_time(F.col("ts"), "platform", {"NATION_1": "UTC+5"})).alias("local_hour"), S.sequence_text(F.array(F.array(F.greatest("idx", F.lit(0))), F.array("n"))).alias("places"),
    )
