"""Queries over prequential features."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import features as feat
from asofkit.operators import side_tables as side
from asofkit.plans.prep import _e, _o, _properties
from asofkit.plans.registry import query
from asofkit.sources import feeds
from asofkit.sources.work import written


def _both(spark, sf):
    ev = _o(spark, sf)
    return ev, feeds.observations(ev)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_U = ", u AS (SELECT seq, reference AS item_id, user_id, session_id, platform, device, idx, ts FROM ev WHERE is_test = 0 AND reference IS NOT NULL), tr AS (SELECT * FROM ob WHERE is_test = 0)"
_IN = "seq, rank, item_id"


def _ctr(k=""):
    j = "".join(f" AND u.{x} = p.{x}" for x in k.split())
    i = "".join(f" AND t.{x} = p.{x}" for x in k.split())
    cols = "".join(f", p.{x}" for x in k.split())
    return (
        _U
        + f""", c AS (SELECT p.seq, p.rank, count(u.seq) AS clicks FROM ob p LEFT JOIN u ON u.item_id = p.item_id AND u.seq < p.seq{j} GROUP BY p.seq, p.rank),
    i AS (SELECT p.seq, p.rank, count(t.seq) AS impressions, count(t.seq) FILTER (WHERE t.rank <= t.idx) AS corrected FROM ob p LEFT JOIN tr t ON t.item_id = p.item_id AND t.seq < p.seq{i} GROUP BY p.seq, p.rank)
    SELECT p.seq, p.rank, p.item_id{cols}, clicks, impressions, corrected, round(clicks / (impressions + 1)::DOUBLE, 6) AS ctr, round(clicks / (corrected + 1)::DOUBLE, 6) AS ctr_corr FROM ob p JOIN c USING (seq, rank) JOIN i USING (seq, rank)"""
    )


@query(_ctr(), "o")
def item_ctr(spark, sf):
    return rounded(feat.item_ctr(*_both(spark, sf)), "ctr", "ctr_corr")


@query(_ctr("platform"), "o")
def item_ctr_by_platform(spark, sf):
    return rounded(feat.item_ctr(*_both(spark, sf), "platform"), "ctr", "ctr_corr")


@query(_ctr("device"), "o")
def item_ctr_by_device(spark, sf):
    return rounded(feat.item_ctr(*_both(spark, sf), "device"), "ctr", "ctr_corr")


@query(_ctr("platform device"), "o")
def item_ctr_by_platform_device(spark, sf):
    return rounded(feat.item_ctr(*_both(spark, sf), "platform", "device"), "ctr", "ctr_corr")


@query(
    """, m AS (SELECT seq, rank, item_id, coalesce(sum(CASE WHEN is_test = 0 THEN rank + 1 END) OVER w, 0) AS weighted_impressions, coalesce(sum(CASE WHEN was_clicked = 1 AND rank = idx THEN idx + 1 END) OVER w, 0) AS weighted_clicks
    FROM ob WINDOW w AS (PARTITION BY item_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, rank, item_id, weighted_clicks::BIGINT AS weighted_clicks, weighted_impressions::BIGINT AS weighted_impressions, round(weighted_clicks / (weighted_impressions + 1)::DOUBLE, 6) AS ctr FROM m""",
    "o",
)
def ctr_rank_weighted(spark, sf):
    return rounded(feat.ctr_rank_weighted(*_both(spark, sf)), "ctr")


@query(
    """, l AS (SELECT seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rev FROM ev), b AS (SELECT ob.*, l.rev FROM ob JOIN l USING (seq)),
    m AS (SELECT seq, rank, item_id, coalesce(sum(CASE WHEN was_clicked = 1 AND rank = idx AND rev = 1 THEN 1 END) OVER w, 0)::BIGINT AS clicks, count(CASE WHEN is_test = 0 AND rev = 1 THEN 1 END) OVER w AS impressions,
    coalesce(sum(CASE WHEN was_clicked = 1 AND rank = idx THEN rev END) OVER w, 0) AS places, count(CASE WHEN was_clicked = 1 AND rank = idx THEN rev END) OVER w AS n FROM b WINDOW w AS (PARTITION BY item_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, rank, item_id, clicks, impressions, round(clicks / (impressions + 1)::DOUBLE, 6) AS ctr, round(places / (n + 1)::DOUBLE, 6) AS avg_reverse_place FROM m""",
    "o",
)
def ctr_in_sequence(spark, sf):
    return rounded(feat.ctr_in_sequence(*_both(spark, sf)), "ctr", "avg_reverse_place")


@query(
    """, c AS (SELECT items[-1] AS item_id, idx AS place, seq FROM ev WHERE is_test = 0 AND idx >= 0), t AS (SELECT item_id, rank AS place, seq FROM ob WHERE is_test = 0),
    p AS (SELECT seq, rank, item_id, n, rank + s.d AS place, CASE WHEN s.d = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM ob, (VALUES (-1), (0), (1)) s(d)),
    x AS (SELECT p.seq, p.rank, p.place, count(c.seq) AS c FROM p LEFT JOIN c ON c.item_id = p.item_id AND c.place = p.place AND c.seq < p.seq GROUP BY ALL),
    y AS (SELECT p.seq, p.rank, p.place, count(t.seq) AS i FROM p LEFT JOIN t ON t.item_id = p.item_id AND t.place = p.place AND t.seq < p.seq GROUP BY ALL)
    SELECT p.seq, p.rank, p.item_id, round(sum(p.w * CASE WHEN p.place < 0 THEN 0.3::DOUBLE WHEN p.place >= p.n THEN 0.2::DOUBLE ELSE (x.c + 1) / (y.i + 2)::DOUBLE END), 6) AS rank_ctr
    FROM p JOIN x USING (seq, rank, place) JOIN y USING (seq, rank, place) GROUP BY p.seq, p.rank, p.item_id""",
    "o",
)
def rank_based_ctr(spark, sf):
    return rounded(feat.rank_based_ctr(*_both(spark, sf)), "rank_ctr")


def _place(*k):
    return _U + f" SELECT p.seq, p.item_id, {''.join(f'p.{x}, ' for x in k)}p.rank, count(u.seq) AS n FROM ob p LEFT JOIN u ON u.idx = p.rank AND u.seq < p.seq AND u.idx >= 0 {' '.join(f'AND u.{x} = p.{x}' for x in k)} GROUP BY ALL"


@query(_place("user_id").replace("p.item_id, ", "p.item_id, ", 1), "o")
def user_rank_pref(spark, sf):
    return feat.place_counts(*_both(spark, sf), "user_id")


@query(_place("user_id", "session_id"), "o")
def user_session_rank_pref(spark, sf):
    return feat.place_counts(*_both(spark, sf), "user_id", "session_id")


@query(
    _U
    + """ SELECT p.seq, p.rank, p.item_id, coalesce(max_by(u.idx, u.seq), -1) AS last_place, round(CASE WHEN count(u.seq) > 0 THEN sum(u.idx) / (count(u.seq) + 1)::DOUBLE ELSE -1 END, 6) AS avg_place
    FROM ob p LEFT JOIN u ON u.session_id = p.session_id AND u.item_id = p.item_id AND u.seq < p.seq GROUP BY p.seq, p.rank, p.item_id""",
    "o",
)
def item_avg_rank(spark, sf):
    return rounded(feat.item_average_rank(*_both(spark, sf)), "avg_place")


@query(
    """ SELECT seq, rank, item_id, round(coalesce(sum(CASE WHEN step <= 2 AND is_test = 0 THEN rank END) OVER w, 0) / (count(CASE WHEN step <= 2 AND is_test = 0 THEN rank END) OVER w + 1)::DOUBLE, 6) AS fresh_place,
    round(coalesce(sum(CASE WHEN step <= 2 AND is_test = 0 THEN rank END) OVER w, 0) / (count(CASE WHEN step <= 2 AND is_test = 0 THEN rank END) OVER w + 1)::DOUBLE - rank, 6) AS fresh_place_minus_rank
    FROM ob WINDOW w AS (PARTITION BY item_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "o",
)
def fresh_rank(spark, sf):
    return rounded(feat.fresh_rank(_both(spark, sf)[1]), "fresh_place", "fresh_place_minus_rank")


@query(
    _U
    + """, l AS (SELECT session_id, seq, item_id, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS until FROM u)
    SELECT p.seq, p.rank, p.item_id, count(l.seq) AS holders FROM ob p LEFT JOIN l ON l.item_id = p.item_id AND l.seq < p.seq AND (l.until IS NULL OR l.until >= p.seq) GROUP BY p.seq, p.rank, p.item_id""",
    "o",
)
def last_clickout_stats(spark, sf):
    return feat.last_click_holders(*_both(spark, sf))


_SAME = _U + ", k AS (SELECT seq, {expr} AS lk FROM ev), q AS (SELECT p.*, k.lk FROM ob p JOIN k USING (seq)), v AS (SELECT u.*, k.lk FROM u JOIN k USING (seq))"


def _keyed(spark, sf, key):
    ev = _o(spark, sf).withColumn("lk", key)
    return ev, feeds.observations(ev)


@query(_SAME.format(expr="array_to_string(list_sort(items), '|')") + " SELECT q.seq, q.rank, q.lk, q.item_id, count(v.seq) AS n FROM q LEFT JOIN v ON v.lk = q.lk AND v.item_id = q.item_id AND v.seq < q.seq GROUP BY ALL", "o")
def identical_list_clicks(spark, sf):
    return feat.list_clicks(*_keyed(spark, sf, S.sorted_key("items")), "lk")


_OTHERS = """ SELECT q.seq, q.rank, q.item_id, count(v.seq) FILTER (WHERE v.item_id = q.item_id) AS n, count(v.seq) AS n_all, round(count(v.seq) FILTER (WHERE v.item_id = q.item_id) / (count(v.seq) + 1)::DOUBLE, 6) AS ctr
    FROM q LEFT JOIN v ON v.lk = q.lk AND v.user_id <> q.user_id AND v.seq < q.seq GROUP BY q.seq, q.rank, q.item_id"""


@query(_SAME.format(expr="array_to_string(items, '|')") + _OTHERS, "o")
def same_list_other_user(spark, sf):
    ev, obs = _keyed(spark, sf, S.list_key("items"))
    return rounded(feat.list_clicks_of_others(ev, obs, "lk"), "ctr")


@query(_SAME.format(expr="array_to_string(items[1:1], '|')") + _OTHERS, "o")
def same_list_topn(spark, sf):
    ev, obs = _keyed(spark, sf, S.list_key(F.slice("items", 1, 1)))
    return rounded(feat.list_clicks_of_others(ev, obs, "lk"), "ctr")


@query(
    """, l AS (SELECT seq, coalesce(lag(device) OVER (PARTITION BY user_id ORDER BY seq), 'UNK') AS label FROM ev), b AS (SELECT ob.*, label FROM ob JOIN l USING (seq)),
    m AS (SELECT seq, rank, item_id, label, coalesce(sum(CASE WHEN is_test = 0 THEN was_clicked END) OVER w, 0)::BIGINT AS clicks, count(CASE WHEN is_test = 0 THEN 1 END) OVER w AS impressions FROM b WINDOW w AS (PARTITION BY label, item_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT *, round(clicks / (impressions + 1)::DOUBLE, 6) AS ctr FROM m""",
    "o",
)
def poi_ctr(spark, sf):
    ev, obs = _both(spark, sf)
    out = feat.poi_ctr(obs, ev, "device")
    return rounded(out.withColumn("impressions", F.col("impressions").cast("bigint")), "ctr")


@query(
    """, pr AS (SELECT a.seq, a.item_id AS a, b.item_id AS b, (a.item_id = a.reference) AS ha, (b.item_id = a.reference) AS hb FROM ob a JOIN ob b ON a.seq = b.seq AND b.rank = a.rank + 1 WHERE a.is_test = 0),
    lf AS (SELECT b.seq, b.rank, b.item_id, a.item_id AS l FROM ob b JOIN ob a ON a.seq = b.seq AND a.rank = CASE WHEN b.rank = 0 THEN b.n - 1 ELSE b.rank - 1 END), rg AS (SELECT b.seq, b.rank, c.item_id AS r FROM ob b JOIN ob c ON c.seq = b.seq AND c.rank = b.rank + 1),
    x AS (SELECT lf.seq, lf.rank, lf.item_id, count(*) FILTER (WHERE NOT ha AND hb) AS left_wins, count(*) FILTER (WHERE ha) AS left_losses, count(*) FILTER (WHERE NOT ha AND NOT hb) AS left_draws FROM lf LEFT JOIN pr ON pr.a = lf.l AND pr.b = lf.item_id AND pr.seq < lf.seq GROUP BY ALL),
    y AS (SELECT rg.seq, rg.rank, count(*) FILTER (WHERE ha) AS right_wins, count(*) FILTER (WHERE NOT ha AND hb) AS right_losses, count(*) FILTER (WHERE NOT ha AND NOT hb) AS right_draws FROM rg JOIN ob USING (seq, rank) LEFT JOIN pr ON pr.a = ob.item_id AND pr.b = rg.r AND pr.seq < rg.seq GROUP BY ALL)
    SELECT x.*, coalesce(right_wins, 0) AS right_wins, coalesce(right_losses, 0) AS right_losses, coalesce(right_draws, 0) AS right_draws FROM x LEFT JOIN y USING (seq, rank)""",
    "o",
)
def pairwise_ctr(spark, sf):
    return feat.pairwise_ctr(*_both(spark, sf))


# ---------------------------------------------------------------- users and sessions


@query(
    """, w AS (SELECT seq, items, lag(items) OVER (PARTITION BY user_id ORDER BY seq) AS was FROM ev)
    SELECT seq, coalesce(list_sort(was) = list_sort(items), FALSE)::INTEGER AS same, coalesce(len(list_intersect(list_distinct(was), items)), 0)::INTEGER AS overlap FROM w""",
    "o",
)
def is_list_same(spark, sf):
    return feat.list_repeats(_o(spark, sf))


@query(", w AS (SELECT seq, lag(items) OVER (PARTITION BY user_id ORDER BY seq) AS was FROM ev) SELECT seq, rank, item_id, coalesce(list_contains(was, item_id), FALSE)::INTEGER AS in_previous FROM ob JOIN w USING (seq)", "o")
def prev_list_overlap(spark, sf):
    return feat.in_previous_list(*_both(spark, sf))


_LAST = ", w AS (SELECT seq, last_value(CASE WHEN is_test = 0 THEN nullif(idx, 0) END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ev) SELECT seq, rank, item_id, coalesce(was - rank, -1000)::INTEGER AS last_index FROM ob JOIN w USING (seq)"


@query(_LAST.format(k="user_id"), "o")
def last_item_index(spark, sf):
    return feat.last_index(*_both(spark, sf), "user_id")


@query(_LAST.format(k="user_id, device"), "o")
def last_index_same_view(spark, sf):
    return feat.last_index(*_both(spark, sf), "user_id", "device")


@query(
    """ SELECT seq, coalesce(last_value(CASE WHEN action_type = 'filter selection' THEN reference END IGNORE NULLS) OVER w, 'UNK') AS last_filter, coalesce(last_value(CASE WHEN action_type = 'search for poi' THEN reference END IGNORE NULLS) OVER w, 'UNK') AS last_poi,
    coalesce(last_value(CASE WHEN action_type = 'clickout item' THEN reference END IGNORE NULLS) OVER w, '0') AS last_item FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "e",
)
def last_selections(spark, sf):
    ref = lambda a: F.when(F.col("action_type") == a, F.col("reference"))
    out = feat.last_values(_e(spark, sf), {"last_filter": ref("filter selection"), "last_poi": ref("search for poi"), "last_item": ref("clickout item")})
    return out.withColumn("last_item", F.when(F.col("last_item") == S.UNKNOWN, "0").otherwise(F.col("last_item")))


_LETTER = "CASE action_type WHEN 'clickout item' THEN 'b' WHEN 'interaction item info' THEN 'f' WHEN 'interaction item deals' THEN 'd' WHEN 'filter selection' THEN 'c' ELSE 'i' END"


@query(f" SELECT seq, action_type, 'q' || coalesce(string_agg({_LETTER}, '') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || 'x' AS actions FROM ac", "e")
def action_string(spark, sf):
    return feat.action_string(_e(spark, sf))


@query(
    " SELECT seq, "
    + ", ".join(f"ts - max(CASE WHEN action_type = '{n}' THEN ts END) OVER w AS since_{x}" for n, x in (("clickout item", "b"), ("filter selection", "c"), ("interaction item deals", "d"), ("interaction item info", "f"), ("search for poi", "i")))
    + " FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "e",
)
def last_event_ts(spark, sf):
    return feat.since_actions(_e(spark, sf)).drop("as_json")


@query(
    ", w AS (SELECT seq, "
    + ", ".join(f"ts - max(CASE WHEN action_type = '{n}' THEN ts END) OVER w AS {x}" for n, x in (("clickout item", "b"), ("filter selection", "c"), ("interaction item deals", "d"), ("interaction item info", "f"), ("search for poi", "i")))
    + " FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT seq, '{' || concat_ws(',', "
    + ", ".join(f"""'"{x}":' || {x}::VARCHAR""" for x in "bcdfi")
    + ") || '}' AS as_json FROM w",
    "e",
)
def last_event_ts_json(spark, sf):
    """The same as one JSON object for each event, without what there is not."""
    return feat.since_actions(_e(spark, sf)).select("seq", "as_json")


@query(
    """ SELECT seq, coalesce(ts - min(ts) OVER s, 0) AS since_session, coalesce(ts - min(ts) OVER u, 0) AS since_user, (SELECT count(DISTINCT b.session_id) FROM ac b WHERE b.user_id = a.user_id AND b.seq < a.seq) AS sessions,
    count(CASE WHEN action_type = 'filter selection' THEN 1 END) OVER u AS filters_used FROM ac a WINDOW s AS (PARTITION BY user_id, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "e",
)
def session_and_user_starts(spark, sf):
    return feat.starts(_e(spark, sf))


@query(
    """, i AS (SELECT seq, user_id, session_id, coalesce(try_cast(reference AS BIGINT), 0) AS item FROM ac WHERE action_type IN ('clickout item', 'interaction item info', 'interaction item deals'))
    SELECT a.seq, coalesce(array_to_string(list_sort(list(DISTINCT i.item)), '|'), '') AS by_user, coalesce(array_to_string(list_sort(list(DISTINCT i.item) FILTER (WHERE i.session_id = a.session_id)), '|'), '') AS by_session
    FROM ac a LEFT JOIN i ON i.user_id = a.user_id AND i.seq < a.seq GROUP BY a.seq""",
    "e",
)
def interaction_lists(spark, sf):
    return feat.interaction_lists(_e(spark, sf))


@query(
    """, f AS (SELECT seq, user_id, unnest(string_split(filters, '|')) AS f FROM ev) SELECT a.seq, coalesce(array_to_string(list_sort(list(DISTINCT f.f)), '|'), '') AS filters FROM ev a LEFT JOIN f ON f.user_id = a.user_id AND f.seq < a.seq GROUP BY a.seq""",
    "o",
)
def all_filters(spark, sf):
    return feat.all_filters(_o(spark, sf))


def _inter(a):
    return f""", d AS (SELECT * FROM ac WHERE action_type = '{a}') SELECT p.seq, count(d.seq) FILTER (WHERE d.reference = p.reference) AS n, least(coalesce(p.ts - max(d.ts) FILTER (WHERE d.reference = p.reference), 0), 1000000) AS since,
    coalesce(max_by(d.reference, d.seq) = p.reference, FALSE)::INTEGER AS was_last FROM ac p LEFT JOIN d ON d.user_id = p.user_id AND d.seq < p.seq WHERE p.action_type = 'clickout item' GROUP BY p.seq, p.reference, p.ts"""


@query(_inter("interaction item info"), "e")
def interaction_info(spark, sf):
    return feat.interactions(_e(spark, sf), "interaction item info")


@query(_inter("interaction item deals"), "e")
def interaction_deals(spark, sf):
    return feat.interactions(_e(spark, sf), "interaction item deals")


@query(_inter("clickout item"), "e")
def interaction_clicks(spark, sf):
    return feat.interactions(_e(spark, sf), "clickout item")


@query(
    """, i AS (SELECT * FROM ac WHERE action_type IN ('clickout item', 'interaction item info', 'interaction item deals')) SELECT p.seq, count(q.seq) FILTER (WHERE q.action_type = 'clickout item') AS clicks, count(q.seq) AS actions,
    round(count(q.seq) FILTER (WHERE q.action_type = 'clickout item') / (count(q.seq) + 1)::DOUBLE, 6) AS ctr FROM i p LEFT JOIN i q ON q.reference = p.reference AND q.seq < p.seq WHERE p.action_type = 'clickout item' GROUP BY p.seq""",
    "e",
)
def interaction_ctr(spark, sf):
    return rounded(feat.interaction_ctr(_e(spark, sf)), "ctr")


def _distinct(k):
    return f""", i AS (SELECT * FROM ac WHERE action_type IN ('clickout item', 'interaction item info', 'interaction item deals')), c AS (SELECT p.seq, count(q.seq) AS n, count(DISTINCT q.reference) AS u, count(q.seq) FILTER (WHERE q.reference = p.reference) AS s
    FROM i p LEFT JOIN i q ON {' AND '.join(f'q.{x} = p.{x}' for x in k.split())} AND q.seq < p.seq WHERE p.action_type = 'clickout item' GROUP BY p.seq) SELECT seq, round(u / (n + 1)::DOUBLE, 6) AS uniq, round(CASE WHEN s = 0 THEN (u + 1) / (n + 2)::DOUBLE ELSE 1 - (u + 1) / (n + 2)::DOUBLE END, 6) AS prob FROM c"""


@query(_distinct("user_id"), "e")
def distinct_interactions(spark, sf):
    return rounded(feat.distinct_interactions(_e(spark, sf), "user_id"), "uniq", "prob")


@query(_distinct("user_id session_id"), "e")
def distinct_interactions_in_session(spark, sf):
    return rounded(feat.distinct_interactions(_e(spark, sf), "user_id", "session_id"), "uniq", "prob")


@query(
    """, x AS (SELECT *, lag(reference) OVER s AS pr FROM ac WINDOW s AS (PARTITION BY session_id ORDER BY seq)), st AS (SELECT session_id, seq, ts FROM x WHERE pr IS NULL OR pr <> reference),
    g AS (SELECT session_id, seq, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY seq) AS gap FROM st),
    m AS (SELECT a.seq, a.ts, avg(g.gap) AS span FROM ac a LEFT JOIN g ON g.session_id = a.session_id AND g.seq < a.seq GROUP BY a.seq, a.ts), n AS (SELECT a.seq, max(st.ts) AS run FROM ac a LEFT JOIN st ON st.session_id = a.session_id AND st.seq < a.seq GROUP BY a.seq)
    SELECT seq, round(coalesce(span, -1), 6) AS span, coalesce(ts - run <= span, FALSE)::INTEGER AS within_1, coalesce(ts - run <= 2 * span, FALSE)::INTEGER AS within_2 FROM m JOIN n USING (seq)""",
    "e",
)
def attention_span(spark, sf):
    return rounded(feat.attention_span(_e(spark, sf)), "span")


@query(
    _U
    + """, m AS (SELECT p.seq, p.rank, p.item_id, p.user_id, p.ts, max_by(u.ts, u.seq) AS t, max_by(u.user_id, u.seq) AS w FROM ob p LEFT JOIN u ON u.item_id = p.item_id AND u.seq < p.seq GROUP BY ALL)
    SELECT seq, rank, item_id, ts - t AS since, coalesce(w = user_id, FALSE)::INTEGER AS same_user, CASE WHEN NOT coalesce(w = user_id, FALSE) THEN ts - t END AS since_other, w AS last_user FROM m""",
    "o",
)
def global_last_click(spark, sf):
    return feat.global_last_click(*_both(spark, sf))


# ---------------------------------------------------------------- sequences


@query(
    """, w AS (SELECT seq, min(CASE WHEN is_test = 0 THEN idx END) OVER s AS lo, max(CASE WHEN is_test = 0 THEN idx END) OVER s AS hi, avg(CASE WHEN is_test = 0 THEN idx END) OVER s AS mean, stddev_samp(CASE WHEN is_test = 0 THEN idx END) OVER s AS sd, count(CASE WHEN is_test = 0 THEN idx END) OVER s AS m
    FROM ev WINDOW s AS (PARTITION BY user_id, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, rank, item_id, coalesce(lo, -1000) AS lo, coalesce(hi, -1000) AS hi, coalesce(lo - rank, -1000) AS lo_rel, coalesce(hi - rank, -1000) AS hi_rel, round(coalesce(mean, -1000), 6) AS mean, round(CASE WHEN m > 0 THEN CASE WHEN m = 1 THEN 0 ELSE sd END ELSE -1000 END, 6)::DOUBLE AS sd, CASE WHEN m > 0 THEN m ELSE -1000 END AS length FROM ob JOIN w USING (seq)""",
    "o",
)
def click_sequence_stats(spark, sf):
    return rounded(feat.click_sequence(*_both(spark, sf)), "mean", "sd")


@query()
def click_sequence_gzip(spark, sf):
    return feat.click_sequence_gzip(*_both(spark, sf))


@query(
    """, c AS (SELECT user_id, seq, idx, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k, ts FROM ev WHERE is_test = 0 AND idx >= 0), m AS (SELECT e.seq, coalesce(max(c.k), 0) AS k FROM ev e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq),
    z AS (SELECT p.seq, p.rank, p.item_id, m.k, coalesce(max(c.k), 0) AS other FROM ob p JOIN m USING (seq) LEFT JOIN c ON c.user_id = p.user_id AND c.k <= m.k AND c.idx <> p.rank GROUP BY ALL)
    SELECT z.seq, z.rank, z.item_id, """
    + ", ".join(f"c{i}.idx AS place_{i}, c{i}.idx - z.rank AS place_{i}_rel, e.ts - c{i}.ts AS since_{i}" for i in range(5))
    + ", (z.k - z.other)::INTEGER AS consecutive FROM z JOIN ev e USING (seq) "
    + " ".join(f"LEFT JOIN c c{i} ON c{i}.user_id = e.user_id AND c{i}.k = z.k - {i}" for i in range(5)),
    "o",
)
def indices_last5(spark, sf):
    return feat.last_places(*_both(spark, sf))


@query(
    f""", i AS (SELECT user_id, seq, {_LETTER} || coalesce(reference, '') AS a, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM ac WHERE action_type IN ('clickout item', 'interaction item info', 'interaction item deals')),
    m AS (SELECT e.seq, e.user_id, coalesce(max(i.k), 0) AS k FROM ac e LEFT JOIN i ON i.user_id = e.user_id AND i.seq < e.seq GROUP BY ALL) SELECT m.seq, '' AS action_0, """
    + ", ".join(f"coalesce(i{n}.a, '') AS action_{n + 1}" for n in range(9))
    + " FROM m "
    + " ".join(f"LEFT JOIN i i{n} ON i{n}.user_id = m.user_id AND i{n}.k = m.k - {n}" for n in range(9)),
    "e",
)
def last10_actions(spark, sf):
    return feat.last_actions(_e(spark, sf))


@query(
    """, c AS (SELECT user_id, seq, idx::DOUBLE AS y, ts / 86400.0::DOUBLE AS x FROM ev WHERE is_test = 0 AND idx >= 0),
    m AS (SELECT e.seq, e.ts / 86400.0::DOUBLE AS now, count(c.seq) AS n, min_by(c.y, c.seq) AS y0, max_by(c.y, c.seq) AS y1, min_by(c.x, c.seq) AS x0, max_by(c.x, c.seq) AS x1, avg(c.y) AS my, avg(c.x) AS mx, covar_pop(c.y, c.x) AS cov, var_pop(c.x) AS vx, var_pop(c.y) AS vy FROM ev e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq, e.ts)
    SELECT seq, rank, item_id, round(coalesce(CASE WHEN m.n > 1 AND x1 <> x0 THEN y1 + (y1 - y0) / (x1 - x0) * (now - x1) END - rank, -1), 6) AS minmax, round(coalesce(CASE WHEN m.n > 1 AND vy > 1e-9 AND vx > 1e-9 THEN my + cov / vx * (x1 - mx) END - rank, -1), 6) AS regression FROM ob JOIN m USING (seq)""",
    "o",
)
def trend(spark, sf):
    """Extrapolated places: through first and last click, and by regression."""
    return rounded(feat.trends(*_both(spark, sf)), "minmax", "regression")


# ---------------------------------------------------------------- prices and similarity


@query(
    """, c AS (SELECT user_id, seq, prices[(idx + 1)::BIGINT] AS price FROM ev WHERE is_test = 0 AND idx >= 0), l AS (SELECT e.seq, max_by(c.price, c.seq) AS last FROM ev e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq),
    d AS (SELECT DISTINCT e.seq, c.price AS q FROM ev e JOIN c ON c.user_id = e.user_id AND c.seq < e.seq)
    SELECT p.seq, p.rank, p.item_id, round(coalesce(avg(abs(d.q - p.price)), 1000), 6) AS mean_diff, coalesce(l.last - p.price, 1000) AS last_diff FROM ob p JOIN l USING (seq) LEFT JOIN d ON d.seq = p.seq GROUP BY p.seq, p.rank, p.item_id, p.price, l.last""",
    "o",
)
def price_similarity(spark, sf):
    return rounded(feat.price_similarity(*_both(spark, sf)), "mean_diff")


@query(
    """, d AS (SELECT seq, rank, price, lag(price) OVER (PARTITION BY seq ORDER BY rank) AS before FROM ob), x AS (SELECT seq, coalesce(min(rank) FILTER (WHERE price < before) - 1, max(rank))::INTEGER AS sorted_until, max(price) AS high, avg(price) AS mean, (count(*) FILTER (WHERE price < before) = 0)::INTEGER AS ascending, (count(*) FILTER (WHERE price > before) = 0)::INTEGER AS descending FROM d GROUP BY seq)
    SELECT seq, rank, item_id, high - price AS below_max, round(price / mean, 6) AS vs_mean, price % 100 AS cents, ascending, descending, sorted_until, (rank < sorted_until)::INTEGER AS in_sorted, (contains(filters, 'URGENT') AND ascending = 0)::INTEGER AS wrong_sorting FROM ob JOIN x USING (seq)""",
    "o",
)
def price_features(spark, sf):
    return rounded(feat.price_features(*_both(spark, sf)), "vs_mean")


@query(
    """, pr AS (SELECT p_partkey AS item_id, list_distinct(list_concat([p_brand, p_type, 'size' || p_size::VARCHAR], string_split(p_name, ' '))) AS p FROM part), c AS (SELECT user_id, reference AS item_id, seq FROM ev WHERE is_test = 0 AND reference IS NOT NULL),
    l AS (SELECT e.seq, max_by(c.item_id, c.seq) AS last FROM ev e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq), d AS (SELECT DISTINCT e.seq, c.item_id AS other FROM ev e JOIN c ON c.user_id = e.user_id AND c.seq < e.seq),
    j AS (SELECT b.seq, b.rank, b.item_id, d.other, l.last, round(len(list_intersect(x.p, y.p)) / (len(list_distinct(list_concat(x.p, y.p))) + 1)::DOUBLE * 1000000000000)::BIGINT AS s FROM ob b JOIN l USING (seq) JOIN pr x ON x.item_id = b.item_id LEFT JOIN d ON d.seq = b.seq LEFT JOIN pr y ON y.item_id = d.other)
    SELECT seq, rank, item_id, round(coalesce((max(s) FILTER (WHERE other = last)) / 1000000000000.0::DOUBLE, 0), 6) AS to_last, round(coalesce(sum(s)::DOUBLE / (count(s) * 1000000000000), 0), 6) AS to_seen FROM j GROUP BY seq, rank, item_id""",
    "o",
)
def jaccard_similarity(spark, sf):
    return rounded(feat.set_similarity(*_both(spark, sf), _properties(spark, sf)), "to_last", "to_seen")


@query(
    """, m AS (SELECT item_id, round(avg(price))::BIGINT AS mp FROM ob GROUP BY item_id), c AS (SELECT user_id, reference AS item_id, seq FROM ev WHERE is_test = 0 AND reference IS NOT NULL), d AS (SELECT DISTINCT e.seq, c.item_id AS other FROM ev e JOIN c ON c.user_id = e.user_id AND c.seq < e.seq)
    SELECT b.seq, b.rank, b.item_id, round(coalesce(avg(abs(x.mp - y.mp)), 1000), 6) AS price_diff FROM ob b JOIN m x USING (item_id) LEFT JOIN d ON d.seq = b.seq LEFT JOIN m y ON y.item_id = d.other GROUP BY b.seq, b.rank, b.item_id""",
    "o",
)
def price_item_similarity(spark, sf):
    ev, obs = _both(spark, sf)
    prices = side.mean_prices(obs).withColumn("mean_price", F.round("mean_price").cast("bigint"))
    return rounded(feat.price_item_similarity(ev, obs, prices), "price_diff")


@query(
    """, c AS (SELECT user_id, seq, idx, ts, platform FROM ev WHERE is_test = 0 AND idx >= 0), l AS (SELECT e.seq, e.ts, max_by(c.idx, c.seq) AS li, max_by(c.ts, c.seq) AS lt FROM ev e LEFT JOIN c ON c.user_id = e.user_id AND c.seq < e.seq GROUP BY e.seq, e.ts),
    t AS (SELECT b.bucket, o."offset"::INTEGER AS "offset", round(1.0::DOUBLE / (2 + abs(o."offset") + b.bucket / 60), 6) AS prob FROM (VALUES (0), (60), (120)) b(bucket), generate_series(-3, 3) o("offset")),
    r AS (SELECT ob.seq, ob.rank, ob.item_id, ob.rank - l.li AS "offset", (CASE WHEN l.ts - l.lt <= 12 THEN l.ts - l.lt ELSE floor((l.ts - l.lt) / 4.0) * 4 END)::BIGINT AS bucket FROM ob JOIN l USING (seq))
    SELECT r.seq, r.rank, r.item_id, coalesce(a.prob, b.prob, CASE r.rank WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 WHEN 3 THEN 0.07 WHEN 4 THEN 0.05 ELSE 0.03 END)::DOUBLE AS click_prob
    FROM r LEFT JOIN t a ON a.bucket = r.bucket AND a."offset" = r."offset" LEFT JOIN t b ON b.bucket = 120 AND b."offset" = r."offset\"""",
    "o",
)
def click_prob_lookup(spark, sf):
    """The lookup with a small made-up table of probabilities; a user's lists count as the same if their platform is."""
    offset, bucket = F.col("offset"), F.col("bucket")
    table = spark.range(3).select((F.col("id") * 60).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("offset")).withColumn("prob", F.round(1.0 / (2 + F.abs(offset) + F.floor(bucket / 60)), 6))
    return feat.click_probability(*_both(spark, sf), table, "platform")


# ---------------------------------------------------------------- the user-item graph


_G = ", g AS (SELECT user_id, reference AS item_id, min(seq) AS f FROM ev WHERE is_test = 0 AND reference IS NOT NULL GROUP BY ALL)"


@query(
    _G + " SELECT p.seq, p.rank, p.item_id, count(c.f) AS paths FROM ob p LEFT JOIN (SELECT a.user_id, c.item_id, greatest(a.f, b.f, c.f) AS f FROM g a JOIN g b ON a.item_id = b.item_id AND a.user_id <> b.user_id JOIN g c ON c.user_id = b.user_id) c ON c.user_id = p.user_id AND c.item_id = p.item_id AND c.f < p.seq GROUP BY p.seq, p.rank, p.item_id", "o"
)
def similar_users_2hop(spark, sf):
    ev = written(_o(spark, sf).select("seq", "user_id", "is_test", "reference", "items"))
    return feat.similar_users(ev, ev.select("seq", "user_id", F.posexplode("items").alias("rank", "item_id")))


_N = (
    _G
    + """, m AS (SELECT e.seq, e.user_id, g.item_id FROM ev e JOIN g ON g.user_id = e.user_id AND g.f < e.seq), z AS (SELECT seq, count(*) AS mine FROM m GROUP BY seq), c AS (SELECT m.seq, g.user_id AS v, count(*) AS common FROM m JOIN g ON g.item_id = m.item_id AND g.f < m.seq AND g.user_id <> m.user_id GROUP BY ALL),
    t AS (SELECT c.seq, c.v, count(*) AS theirs FROM c JOIN g ON g.user_id = c.v AND g.f < c.seq GROUP BY ALL), s AS (SELECT c.seq, c.v, mine + theirs - common AS uni, common FROM c JOIN t USING (seq, v) JOIN z USING (seq)),
    b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY {o} DESC, v) AS place FROM s)"""
)


@query(_N.format(o="uni") + " SELECT p.seq, p.rank, p.item_id, count(g.f) AS n FROM ob p LEFT JOIN b ON b.seq = p.seq AND b.place = 1 LEFT JOIN g ON g.user_id = b.v AND g.item_id = p.item_id AND g.f < p.seq GROUP BY p.seq, p.rank, p.item_id", "o")
def best_neighbour(spark, sf):
    return feat.neighbour_items(*_both(spark, sf), k=1, score="union")


@query(_N.format(o="common") + " SELECT seq, v, common AS score, place::INTEGER AS place FROM b WHERE place <= 3", "o")
def topk_neighbours(spark, sf):
    return feat.neighbours(_o(spark, sf), 3, "intersection")
