"""Queries over a log of clickouts and item actions (feed M): lists that come next, places in them, interactions of all types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import features as feat
from asofkit.operators import side_tables as side
from asofkit.plans.prep import _o, _properties
from asofkit.plans.registry import query
from asofkit.plans.state import rounded
from asofkit.sources import feeds
from asofkit.sources.work import written

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_IA = ", ia AS (SELECT * FROM lg WHERE on_item AND is_test = 0), cl AS (SELECT * FROM lg WHERE action_type = 'clickout item')"
_KEY = "seq, rank, item_id"


def _log(spark: SparkSession, sf: str, ev: DataFrame | None = None) -> DataFrame:
    return feeds.with_next_lists(feeds.mixed_events(spark, sf, ev)).withColumns({"fk": S.list_key("fake_items"), "lk": S.list_key("items"), "lh": S.sorted_key("items"), "top": S.list_key(F.slice("fake_items", 1, 1))})


def _clickouts(lg: DataFrame) -> DataFrame:
    return lg.filter("action_type = 'clickout item'").withColumn("reference", F.col("item"))


def _placed(lg: DataFrame) -> DataFrame:
    """Item actions as clicks on the list that comes next; other actions have no place."""
    on_item = F.col("action_type").isin(*S.ITEM_ACTIONS)
    return lg.withColumns({"reference": F.when(on_item, F.col("item")), "idx": F.when(on_item, F.col("fake_idx"))})


def _all(spark: SparkSession, sf: str, ev: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Item actions by their places in the next lists, clickouts, list members."""
    lg = _log(spark, sf, ev)
    clicks = _clickouts(lg)
    return _placed(lg), clicks, feeds.observations(clicks)


def _last_sql(keys: str, value: str, source: str) -> str:
    return f", w AS (SELECT seq, last_value(CASE WHEN is_test = 0 THEN {value} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY seq {_BEFORE}) AS was FROM {source})"


_FAKE = "CASE WHEN on_item THEN nullif(fake_idx, 0) END"


@query(", q AS (SELECT seq, action_type, reference, fake_idx, fk FROM lg) SELECT * FROM q", "m")
def next_lists(spark, sf):
    """The list that comes next in the session, and the place of the reference in it."""
    return _log(spark, sf).select("seq", "action_type", "reference", "fake_idx", "fk")


@query(_last_sql("user_id", _FAKE, "lg") + " SELECT seq, rank, item_id, coalesce(was - rank, -1000)::INTEGER AS last_index FROM mb JOIN w USING (seq)", "m")
def last_item_fake_index(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.last_index(acts, obs, "user_id")


@query(_last_sql("user_id, fk", _FAKE, "lg") + " SELECT seq, rank, item_id, coalesce(was - rank, -1000)::INTEGER AS last_index FROM mb JOIN w USING (seq)", "m")
def last_index_same_fake_list(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.last_index(acts, obs, "user_id", "fk")


@query(_IA + _last_sql("user_id, fk", "nullif(idx, 0)", "cl") + " SELECT seq, rank, item_id, coalesce(was - rank, -1000)::INTEGER AS last_index FROM mb JOIN w USING (seq)", "m")
def last_index_same_list(spark, sf):
    _, clicks, obs = _all(spark, sf)
    return feat.last_index(clicks, obs, "user_id", "lk")


@query(_IA + _last_sql("user_id, fk", "idx", "cl") + " SELECT seq, rank, item_id, (rank - coalesce(was, -1000))::INTEGER AS last_place FROM mb JOIN w USING (seq)", "m")
def last_place_same_list(spark, sf):
    _, clicks, obs = _all(spark, sf)
    return feat.last_place_same_list(clicks, obs, "lk")


@query(_IA + " SELECT p.seq, p.rank, p.item_id, p.user_id, count(u.seq) AS n FROM mb p LEFT JOIN ia u ON u.user_id = p.user_id AND u.fake_idx = p.rank AND u.seq < p.seq GROUP BY ALL", "m")
def user_fake_rank_pref(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.place_counts(acts, obs, "user_id")


@query(
    _IA + ", h AS (SELECT seq, array_to_string(list_sort(items), '|') AS lh FROM cl) SELECT p.seq, p.rank, p.item_id, p.user_id, a.lh, count(u.seq) AS n FROM mb p JOIN h a ON a.seq = p.seq LEFT JOIN (cl u JOIN h b ON b.seq = u.seq) ON u.user_id = p.user_id AND b.lh = a.lh AND u.is_test = 0 AND u.idx = p.rank AND u.seq < p.seq GROUP BY ALL",
    "m",
)
def user_list_rank_pref(spark, sf):
    _, clicks, obs = _all(spark, sf)
    return feat.place_counts(clicks, obs, "user_id", "lh")


@query(f" SELECT {_KEY}, count(CASE WHEN is_test = 0 THEN 1 END) OVER (PARTITION BY user_id, item_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM mb", "m")
def user_item_impressions(spark, sf):
    return feat.shown_before(_all(spark, sf)[2], "user_id")


@query(_IA + f" SELECT seq, coalesce(ts - max(CASE WHEN is_test = 0 THEN ts END) OVER (PARTITION BY user_id, fk ORDER BY seq {_BEFORE}), 0) AS since FROM cl", "m")
def since_same_list(spark, sf):
    return feat.since_same_list(_all(spark, sf)[1], "lk")


@query(
    f""", w AS (SELECT seq, min(v) OVER s AS lo, max(v) OVER s AS hi, avg(v) OVER s AS mean, stddev_samp(v) OVER s AS sd, count(v) OVER s AS m FROM (SELECT *, CASE WHEN is_test = 0 AND on_item THEN fake_idx END AS v FROM lg) WINDOW s AS (PARTITION BY user_id, session_id ORDER BY seq {_BEFORE}))
    SELECT seq, rank, item_id, coalesce(lo, -1000) AS lo, coalesce(hi, -1000) AS hi, coalesce(lo - rank, -1000) AS lo_rel, coalesce(hi - rank, -1000) AS hi_rel, round(coalesce(mean, -1000), 6) AS mean, round(CASE WHEN m > 0 THEN CASE WHEN m = 1 THEN 0 ELSE sd END ELSE -1000 END, 4)::DOUBLE AS sd, CASE WHEN m > 0 THEN m ELSE -1000 END AS length FROM mb JOIN w USING (seq)""",
    "m",
)
def fake_click_sequence_stats(spark, sf):
    """As click_sequence_stats, over places in the lists that come next, missing ones too."""
    acts, _, obs = _all(spark, sf)
    return rounded(feat.click_sequence(acts, obs), "mean").withColumn("sd", F.round("sd", 4))


@query()
def fake_click_sequence_gzip(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.click_sequence_gzip(acts, obs)


def _others(key: str) -> str:
    return (
        _IA
        + f""", k AS (SELECT seq, fk, array_to_string(fake_items[1:1], '|') AS top FROM lg), q AS (SELECT p.*, k.{key} AS lk FROM mb p JOIN k USING (seq)), v AS (SELECT u.seq, u.user_id, u.item, k.{key} AS lk FROM ia u JOIN k USING (seq) WHERE u.item IS NOT NULL)
    SELECT q.seq, q.rank, q.item_id, count(v.seq) FILTER (WHERE v.item = q.item_id) AS n, count(v.seq) AS n_all, round(count(v.seq) FILTER (WHERE v.item = q.item_id) / (count(v.seq) + 1)::DOUBLE, 6) AS ctr FROM q LEFT JOIN v ON v.lk = q.lk AND v.user_id <> q.user_id AND v.seq < q.seq GROUP BY q.seq, q.rank, q.item_id"""
    )


@query(_others("fk"), "m")
def same_fake_list_other_user(spark, sf):
    """Item actions of others before the same list as this one."""
    acts, _, obs = _all(spark, sf)
    return rounded(feat.list_clicks_of_others(acts, obs, "lk", "fk"), "ctr")


@query(_others("top"), "m")
def same_fake_top_other_user(spark, sf):
    """The same with lists told by their first item."""
    acts, _, obs = _all(spark, sf)
    return rounded(feat.list_clicks_of_others(acts, obs, "top"), "ctr")


@query(
    _IA
    + """, i AS (SELECT user_id, session_id, seq, action_type AS a, fake_idx AS f, row_number() OVER (PARTITION BY user_id, session_id ORDER BY seq) AS k FROM ia),
    m AS (SELECT c.seq, c.user_id, c.session_id, coalesce(max(i.k), 0) AS k FROM cl c LEFT JOIN i ON i.user_id = c.user_id AND i.session_id = c.session_id AND i.seq < c.seq GROUP BY ALL)
    SELECT p.seq, p.rank, p.item_id, '' AS action_0, '' AS action_0_norm, """
    + ", ".join(f"coalesce(i{n}.a || i{n}.f::VARCHAR, '') AS action_{n + 1}, coalesce(i{n}.a || (p.rank - i{n}.f)::VARCHAR, '') AS action_{n + 1}_norm" for n in range(9))
    + " FROM mb p JOIN m USING (seq) "
    + " ".join(f"LEFT JOIN i i{n} ON i{n}.user_id = m.user_id AND i{n}.session_id = m.session_id AND i{n}.k = m.k - {n}" for n in range(9)),
    "m",
)
def last10_action_places(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.last_action_places(acts.withColumn("reference", F.col("item").cast("string")), obs)


@query(
    _IA
    + """, c AS (SELECT user_id, seq, fake_idx AS idx, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k, ts FROM ia WHERE fake_idx >= 0), m AS (SELECT e.seq, coalesce(max(c.k), 0) AS k FROM cl e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq),
    z AS (SELECT p.seq, p.rank, p.item_id, m.k, coalesce(max(c.k), 0) AS other FROM mb p JOIN m USING (seq) LEFT JOIN c ON c.user_id = p.user_id AND c.k <= m.k AND c.idx <> p.rank GROUP BY ALL)
    SELECT z.seq, z.rank, z.item_id, """
    + ", ".join(f"c{i}.idx AS place_{i}, c{i}.idx - z.rank AS place_{i}_rel, e.ts - c{i}.ts AS since_{i}" for i in range(5))
    + ", (z.k - z.other)::INTEGER AS consecutive FROM z JOIN cl e USING (seq) "
    + " ".join(f"LEFT JOIN c c{i} ON c{i}.user_id = e.user_id AND c{i}.k = z.k - {i}" for i in range(5)),
    "m",
)
def fake_indices_last5(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.last_places(acts, obs)


def _trend_sql(key: str) -> str:
    return (
        _IA
        + f""", c AS (SELECT {key}, seq, fake_idx::DOUBLE AS y, ts / 86400.0::DOUBLE AS x FROM ia WHERE fake_idx >= 0),
    m AS (SELECT e.seq, e.ts / 86400.0::DOUBLE AS now, count(c.seq) AS n, min_by(c.y, c.seq) AS y0, max_by(c.y, c.seq) AS y1, min_by(c.x, c.seq) AS x0, max_by(c.x, c.seq) AS x1 FROM cl e LEFT JOIN c ON c.{key} = e.{key} AND c.seq < e.seq GROUP BY e.seq, e.ts)
    SELECT seq, rank, item_id, round(coalesce(CASE WHEN m.n > 1 AND x1 <> x0 THEN y1 + (y1 - y0) / (x1 - x0) * (now - x1) END - rank, -1), 4) AS minmax FROM mb JOIN m USING (seq)"""
    )


@query(_trend_sql("session_id"), "m")
def fake_trend_by_session(spark, sf):
    """The line through the session's first and last place."""
    acts, _, obs = _all(spark, sf)
    return feat.trends(acts, obs, "session_id").select("seq", "rank", "item_id", F.round("minmax", 4).alias("minmax"))


@query(_trend_sql("user_id"), "m")
def fake_trend_by_user(spark, sf):
    acts, _, obs = _all(spark, sf)
    return feat.trends(acts, obs, "user_id").select("seq", "rank", "item_id", F.round("minmax", 4).alias("minmax"))


@query(
    """, c AS (SELECT session_id, seq, idx::DOUBLE AS y, ts / 86400.0::DOUBLE AS x FROM ev WHERE is_test = 0 AND idx >= 0),
    m AS (SELECT e.seq, e.ts / 86400.0::DOUBLE AS now, count(c.seq) AS n, min_by(c.y, c.seq) AS y0, max_by(c.y, c.seq) AS y1, min_by(c.x, c.seq) AS x0, max_by(c.x, c.seq) AS x1, avg(c.y) AS my, avg(c.x) AS mx, covar_pop(c.y, c.x) AS cov, var_pop(c.x) AS vx, var_pop(c.y) AS vy FROM ev e LEFT JOIN c ON c.session_id = e.session_id AND c.seq < e.seq GROUP BY e.seq, e.ts)
    SELECT seq, rank, item_id, round(coalesce(CASE WHEN m.n > 1 AND x1 <> x0 THEN y1 + (y1 - y0) / (x1 - x0) * (now - x1) END - rank, -1), 6) AS minmax, round(coalesce(CASE WHEN m.n > 1 AND vy > 1e-9 AND vx > 1e-9 THEN my + cov / vx * (x1 - mx) END - rank, -1), 6) AS regression FROM ob JOIN m USING (seq)""",
    "o",
)
def trend_by_session(spark, sf):
    ev = _o(spark, sf)
    return rounded(feat.trends(ev, feeds.observations(ev), "session_id"), "minmax", "regression")


# ---------------------------------------------------------------- chances of the next click


def _chance_sql(source: str) -> str:
    return (
        _IA
        + f""", k AS (SELECT user_id, seq, ts, fk, {source} AS i FROM {'ia' if source == 'fake_idx' else 'cl'} WHERE {source} >= 0),
    s AS (SELECT i - lag(i) OVER w AS "offset", ts - lag(ts) OVER w AS dt, lag(fk) OVER w = fk AS same FROM k WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
    f AS (SELECT "offset", (CASE WHEN dt <= 12 THEN dt ELSE floor(dt / 4.0) * 4 END)::INTEGER AS bucket FROM s WHERE same AND dt <= 120),
    c AS (SELECT bucket, "offset", count(*) AS c FROM f GROUP BY ALL), g AS (SELECT d.bucket, r."offset"::INTEGER AS "offset" FROM (SELECT DISTINCT bucket FROM c) d, generate_series(-10, 10) AS r("offset")),
    h AS (SELECT g.*, coalesce(c.c, 1) AS n FROM g LEFT JOIN c USING (bucket, "offset")), t AS (SELECT bucket, "offset", n / (sum(n) OVER (PARTITION BY bucket))::DOUBLE AS prob FROM h),
    l AS (SELECT e.seq, e.ts, e.fk, max_by(u.i, u.seq) AS li, max_by(u.ts, u.seq) AS lt, max_by(u.fk, u.seq) AS lf FROM cl e LEFT JOIN k u ON u.user_id = e.user_id AND u.seq < e.seq GROUP BY e.seq, e.ts, e.fk),
    r AS (SELECT mb.seq, mb.rank, mb.item_id, CASE WHEN l.lf = l.fk THEN mb.rank - l.li END AS "offset", (CASE WHEN l.ts - l.lt <= 12 THEN l.ts - l.lt ELSE floor((l.ts - l.lt) / 4.0) * 4 END)::BIGINT AS bucket FROM mb JOIN l USING (seq))
    SELECT r.seq, r.rank, r.item_id, round(coalesce(a.prob, b.prob, CASE r.rank WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 WHEN 3 THEN 0.07 WHEN 4 THEN 0.05 ELSE 0.03 END)::DOUBLE, 6) AS click_prob
    FROM r LEFT JOIN t a ON a.bucket = r.bucket AND a."offset" = r."offset" LEFT JOIN t b ON b.bucket = 120 AND b."offset" = r."offset\""""
    )


def _chances(acts: DataFrame, obs: DataFrame) -> DataFrame:
    """Transitions counted from the same log, and looked up."""
    probs = side.transition_probabilities(acts.filter("idx >= 0").withColumn("list_key", F.col("fk")))
    return rounded(feat.click_probability(acts, obs, probs, "fk"), "click_prob")


@query(_chance_sql("fake_idx"), "m")
def click_prob_fake_lists(spark, sf):
    acts, _, obs = _all(spark, sf)
    return _chances(acts, obs)


@query(_chance_sql("idx"), "m")
def click_prob_lists(spark, sf):
    _, clicks, obs = _all(spark, sf)
    return _chances(clicks, obs)


# ---------------------------------------------------------------- similarity to what was met


_PARTS = "SELECT p_partkey AS item_id, list_distinct(list_concat([p_brand, p_type, 'size' || p_size::VARCHAR], string_split(p_name, ' '))) AS p FROM part"
_POIS = "SELECT item_id, list(DISTINCT device) AS p FROM ob GROUP BY item_id"


def _similar_sql(sets: str, keys: str) -> str:
    on = " AND ".join(f"i.{k} = c.{k}" for k in keys.split())
    return (
        _IA
        + f""", pr AS ({sets}), l AS (SELECT e.seq, max_by(c.item, c.seq) AS last FROM cl e LEFT JOIN (SELECT * FROM cl WHERE is_test = 0 AND item IS NOT NULL) c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq),
    d AS (SELECT DISTINCT c.seq, i.item AS other FROM cl c JOIN ia i ON {on} AND i.seq < c.seq WHERE i.item IS NOT NULL),
    j AS (SELECT b.seq, b.rank, b.item_id, d.other, round(len(list_intersect(x.p, coalesce(y.p, []))) / (len(list_distinct(list_concat(x.p, coalesce(y.p, [])))) + 1)::DOUBLE * 1000000000000)::BIGINT AS s FROM mb b JOIN pr x ON x.item_id = b.item_id JOIN d ON d.seq = b.seq LEFT JOIN pr y ON y.item_id = d.other),
    a AS (SELECT seq, rank, sum(s)::DOUBLE / (count(s) * 1000000000000) AS to_seen FROM j GROUP BY ALL),
    t AS (SELECT b.seq, b.rank, round(len(list_intersect(x.p, coalesce(y.p, []))) / (len(list_distinct(list_concat(x.p, coalesce(y.p, [])))) + 1)::DOUBLE * 1000000000000) / 1000000000000.0::DOUBLE AS to_last FROM mb b JOIN l USING (seq) JOIN pr x ON x.item_id = b.item_id LEFT JOIN pr y ON y.item_id = l.last WHERE l.last IS NOT NULL)
    SELECT b.seq, b.rank, b.item_id, round(coalesce(t.to_last, 0), 6) AS to_last, round(coalesce(a.to_seen, 0), 6) AS to_seen FROM mb b LEFT JOIN a USING (seq, rank) LEFT JOIN t USING (seq, rank)"""
    )


def _similarity(spark: SparkSession, sf: str, sets: DataFrame, *keys: str, ev: DataFrame | None = None) -> DataFrame:
    acts, clicks, obs = _all(spark, sf, ev)
    return rounded(feat.set_similarity(clicks, obs, sets, *keys, acts=acts.filter("is_test = 0")), "to_last", "to_seen")


def _pois(ev: DataFrame) -> DataFrame:
    return side.item_sets(ev.withColumn("label", F.col("device"))).withColumnRenamed("labels", "properties")


@query(_similar_sql(_PARTS, "user_id"), "m")
def similarity_to_interactions(spark, sf):
    return _similarity(spark, sf, _properties(spark, sf), "user_id")


@query(_similar_sql(_PARTS, "user_id session_id"), "m")
def similarity_in_session(spark, sf):
    return _similarity(spark, sf, _properties(spark, sf), "user_id", "session_id")


@query(_similar_sql(_POIS, "user_id"), "m")
def poi_similarity(spark, sf):
    ev = written(_o(spark, sf).drop("city", "filters", "step"))
    return _similarity(spark, sf, _pois(ev), "user_id", ev=ev)


@query(f", pr AS ({_POIS}) SELECT b.seq, b.rank, b.item_id, len(p)::INTEGER AS num_pois FROM mb b JOIN pr USING (item_id)", "m")
def num_pois(spark, sf):
    return _all(spark, sf)[2].join(_pois(_o(spark, sf)), "item_id").select("seq", "rank", "item_id", F.size("properties").alias("num_pois"))


def _price_sql(keys: str) -> str:
    on = " AND ".join(f"i.{k} = c.{k}" for k in keys.split())
    return (
        _IA
        + f""", p AS (SELECT item_id, round(avg(price))::BIGINT AS mp FROM ob GROUP BY item_id), d AS (SELECT DISTINCT c.seq, i.item AS other FROM cl c JOIN ia i ON {on} AND i.seq < c.seq WHERE i.item IS NOT NULL)
    SELECT b.seq, b.rank, b.item_id, round(coalesce(avg(abs(x.mp - y.mp)), 1000), 6) AS price_diff FROM mb b JOIN p x USING (item_id) LEFT JOIN (d JOIN p y ON y.item_id = d.other) ON d.seq = b.seq GROUP BY b.seq, b.rank, b.item_id"""
    )


def _price_similarity(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    acts, clicks, obs = _all(spark, sf)
    prices = side.mean_prices(obs).withColumn("mean_price", F.round("mean_price").cast("bigint"))
    return rounded(feat.price_item_similarity(clicks, obs, prices, *keys, acts=acts.filter("is_test = 0")), "price_diff")


@query(_price_sql("user_id"), "m")
def price_similarity_to_interactions(spark, sf):
    return _price_similarity(spark, sf, "user_id")


@query(_price_sql("user_id session_id"), "m")
def price_similarity_in_session(spark, sf):
    return _price_similarity(spark, sf, "user_id", "session_id")


# ---------------------------------------------------------------- actions


def _action_sql(action: str) -> str:
    return f""", d AS (SELECT * FROM lg WHERE action_type = '{action}' AND is_test = 0 AND item IS NOT NULL)
    SELECT p.seq, p.rank, p.item_id, count(d.seq) FILTER (WHERE d.item = p.item_id) AS n, least(coalesce(p.ts - max(d.ts) FILTER (WHERE d.item = p.item_id), 0), 1000000) AS since, p.ts - max(d.ts) FILTER (WHERE d.item = p.item_id) AS signed_since, coalesce(max_by(d.item, d.seq) = p.item_id, FALSE)::INTEGER AS was_last
    FROM mb p LEFT JOIN d ON d.user_id = p.user_id AND d.seq < p.seq GROUP BY p.seq, p.rank, p.item_id, p.ts"""


def _register_actions() -> None:
    for name, action in (("image", "interaction item image"), ("rating", "interaction item rating"), ("item_search", "search for item"), ("item_info", "interaction item info"), ("item_deals", "interaction item deals")):

        def run(spark, sf, action=action):
            acts, _, obs = _all(spark, sf)
            return feat.item_actions(acts, obs, action)

        run.__name__ = f"actions_{name}"
        query(_action_sql(action), "m")(run)


_register_actions()


@query(f" SELECT seq, coalesce(last_value(CASE WHEN action_type = 'change of sort order' THEN reference END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq {_BEFORE}), 'UNK') AS last_sort_order FROM lg", "m")
def last_sort_order(spark, sf):
    return feat.last_values(_log(spark, sf), {"last_sort_order": F.when(F.col("action_type") == "change of sort order", F.col("reference"))})


@query(_IA + " SELECT p.seq, p.rank, p.item_id, count(i.seq) AS n FROM mb p LEFT JOIN ia i ON i.action_type IN ('interaction item image', 'interaction item rating') AND i.item = p.item_id AND i.seq < p.seq GROUP BY p.seq, p.rank, p.item_id", "m")
def specific_interactions(spark, sf):
    """How often anybody's images and ratings were of the item."""
    obs = _all(spark, sf)[2]
    return feat.references_before(_log(spark, sf), obs, ["interaction item image", "interaction item rating"])


@query(
    ", i AS (SELECT seq, try_cast(regexp_extract(reference, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS item FROM lg WHERE is_test = 0) SELECT p.seq, p.rank, p.item_id, count(i.seq) AS n FROM mb p LEFT JOIN i ON i.item = p.item_id AND i.seq < p.seq GROUP BY p.seq, p.rank, p.item_id", "m"
)
def any_interactions(spark, sf):
    """How often any reference before starts with the item's number."""
    obs = _all(spark, sf)[2]
    return feat.references_before(_log(spark, sf), obs)


@query(" SELECT seq, rank, item_id, item_id AS identifier FROM mb", "m")
def identifiers(spark, sf):
    """The item itself as a counter."""
    return _all(spark, sf)[2].select("seq", "rank", "item_id", F.col("item_id").alias("identifier"))


_TYPES = {"a": "change of sort order", "b": "clickout item", "d": "interaction item deals", "e": "interaction item image", "f": "interaction item info", "h": "search for item", "j": "interaction item rating"}


def _tracker_sql() -> str:
    cells = [f"coalesce(max(x.{v}) FILTER (WHERE x.kind = '{k}'), 0)::BIGINT AS {v}_{k}" for k in [*_TYPES, "all"] for v in ("n", "ago")]
    cells += [f"coalesce(max(x.placed * (p.rank + 1) - x.places) FILTER (WHERE x.kind = '{k}'), 0)::BIGINT AS rel_{k}" for k in [*_TYPES, "all"]]
    kind = "CASE action_type " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in _TYPES.items()) + " END"
    return f""", t0 AS (SELECT user_id, seq, ts, {kind} AS kind, CASE WHEN on_item AND fake_idx >= 0 THEN fake_idx + 1 END AS place, on_item FROM lg WHERE is_test = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY seq) AS k FROM (SELECT * EXCLUDE (on_item) FROM t0 UNION ALL SELECT user_id, seq, ts, 'all', place FROM t0 WHERE on_item)),
    c AS (SELECT seq, user_id, ts FROM lg WHERE action_type = 'clickout item'), m AS (SELECT c.seq, c.ts, c.user_id, t.kind, max(t.k) AS k FROM c JOIN t ON t.user_id = c.user_id AND t.seq < c.seq GROUP BY ALL),
    x AS (SELECT m.seq, m.kind, count(*) AS n, sum(round(ln(1 + greatest(m.ts - t.ts, 0)) * 10000)::BIGINT) AS ago, coalesce(sum(t.place), 0) AS places, count(t.place) AS placed FROM m JOIN t ON t.user_id = m.user_id AND t.kind = m.kind AND t.k BETWEEN m.k - 9 AND m.k GROUP BY ALL),
    l AS (SELECT user_id, seq, list_sum(list_transform(prices, lambda q: round(ln(1 + q) * 10000)::BIGINT))::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM lg WHERE is_test = 0 AND prices IS NOT NULL),
    o AS (SELECT c.seq, max_by(l.v, l.k) AS p0, max(l.k) AS k, any_value(c.user_id) AS user_id FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.seq < c.seq GROUP BY c.seq)
    SELECT p.seq, p.rank, p.item_id, any_value(o.p0) AS prices_0, any_value(l1.v) AS prices_1, {', '.join(cells)} FROM mb p JOIN o USING (seq) LEFT JOIN l l1 ON l1.user_id = o.user_id AND l1.k = o.k - 1 LEFT JOIN x ON x.seq = p.seq GROUP BY p.seq, p.rank, p.item_id"""


@query(_tracker_sql(), "m")
def actions_tracker(spark, sf):
    """What the tracker holds, added up: events of each type, their times, their places against the rank, prices of the last two lists."""
    acts, _, obs = _all(spark, sf)
    recent = feat.recent_events(_log(spark, sf))
    rows = obs.select("seq", "rank", "item_id").join(recent, "seq")
    total = lambda c, f: F.coalesce(F.aggregate(F.filter(F.transform(c, f), lambda v: v.isNotNull()), F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0))
    whole = lambda v: F.round(v * 10_000).cast("bigint")
    cells = []
    for name, c in [*((k, k) for k in _TYPES), ("all", "interactions")]:
        cells += [F.size(c).cast("bigint").alias(f"n_{name}"), total(c, lambda e: whole(e["ago"])).alias(f"ago_{name}"), total(c, lambda e: (F.col("rank") + 1 - e["place"]).cast("bigint")).alias(f"rel_{name}")]
    lists = [F.when(F.size("prices") > i, total(F.get("prices", F.lit(i)), whole)).alias(f"prices_{i}") for i in range(2)]
    return rows.select("seq", "rank", "item_id", *lists, *cells)


@query()
def actions_tracker_json(spark, sf):
    """The tracker itself, as one JSON object for each list member."""
    acts, _, obs = _all(spark, sf)
    return feat.tracker_json(_log(spark, sf), obs)


# ---------------------------------------------------------------- further keys and criteria of feed O


@query(
    ", u AS (SELECT seq, reference AS item_id, array_to_string(items, '|') AS lk FROM ev WHERE is_test = 0 AND reference IS NOT NULL), k AS (SELECT seq, array_to_string(items, '|') AS lk FROM ev) SELECT p.seq, p.rank, k.lk, p.item_id, count(u.seq) AS n FROM ob p JOIN k USING (seq) LEFT JOIN u ON u.lk = k.lk AND u.item_id = p.item_id AND u.seq < p.seq GROUP BY ALL",
    "o",
)
def identical_list_clicks_in_order(spark, sf):
    ev = _o(spark, sf).withColumn("lk", S.list_key("items"))
    return feat.list_clicks(ev, feeds.observations(ev), "lk")


_CRITERIA = ("URGENT", "HIGH", "LOW")


@query(
    ", k AS (SELECT unnest(['URGENT', 'HIGH', 'LOW']) AS criterion), p AS (SELECT DISTINCT criterion, a.item_id AS above, b.item_id AS below FROM ob a JOIN ob b ON a.seq = b.seq AND a.rank < b.rank JOIN k ON contains(a.filters, criterion)), s AS (SELECT criterion, above AS item_id, 1 AS win FROM p UNION ALL SELECT criterion, below, 0 FROM p) SELECT criterion, item_id, round(sum(win) / count(*)::DOUBLE, 6) AS rating FROM s GROUP BY ALL",
    "o",
)
def dominance_by_criterion(spark, sf):
    """Ratings under each of three criteria."""
    ev, out = _o(spark, sf), None
    for c in _CRITERIA:
        part = side.dominance_ratings(ev, F.contains(F.col("filters"), F.lit(c))).select(F.lit(c).alias("criterion"), "item_id", F.round("rating", 6).alias("rating"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """, c AS (SELECT reference AS item_id, idx AS place, seq FROM ev WHERE is_test = 0 AND idx >= 0), t AS (SELECT item_id, rank AS place, seq FROM ob WHERE is_test = 0),
    p AS (SELECT seq, rank, item_id, n, rank + s.d AS place, CASE WHEN s.d = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM ob, (VALUES (-1), (0), (1)) s(d)),
    x AS (SELECT p.seq, p.rank, p.place, count(c.seq) AS c FROM p LEFT JOIN c ON c.item_id = p.item_id AND c.place = p.place AND c.seq < p.seq GROUP BY ALL),
    y AS (SELECT p.seq, p.rank, p.place, count(t.seq) AS i FROM p LEFT JOIN t ON t.item_id = p.item_id AND t.place = p.place AND t.seq < p.seq GROUP BY ALL)
    SELECT p.seq, p.rank, p.item_id, round(sum(p.w * CASE WHEN p.place < 0 THEN 0.3::DOUBLE WHEN p.place >= p.n THEN 0.2::DOUBLE ELSE (x.c + 1) / (y.i + 2)::DOUBLE END), 6) AS rank_ctr
    FROM p JOIN x USING (seq, rank, place) JOIN y USING (seq, rank, place) GROUP BY p.seq, p.rank, p.item_id""",
    "o",
)
def rank_based_ctr_of_clicked(spark, sf):
    """Clicks are booked on the clicked item."""
    ev = _o(spark, sf)
    return rounded(feat.rank_based_ctr(ev, feeds.observations(ev), credit="clicked"), "rank_ctr")
