"""The canonical event logs as SQL, for the counterparts of queries."""

#: Feed O: an order is a clickout on the list of its lines. One row per event in ev, one per list member in ob.
FEED_O = """
ln AS (
  SELECT l_orderkey, l_partkey AS item_id, floor(l_extendedprice)::BIGINT AS price,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS rank
  FROM lineitem),
ag AS (SELECT l_orderkey, count(*)::INTEGER AS n, list(item_id ORDER BY rank) AS items, list(price ORDER BY rank) AS prices FROM ln GROUP BY l_orderkey),
e0 AS (
  SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 10000000 + o_orderkey AS seq, o_orderkey AS event_id, o_custkey AS user_id,
         epoch(o_orderdate)::BIGINT AS ts, o_custkey::VARCHAR || '-' || year(o_orderdate)::VARCHAR AS session_id,
         n_name AS platform, c_mktsegment || ', ' || n_name AS city, o_orderpriority AS device, o_orderstatus || '|' || o_orderpriority AS filters,
         (o_orderkey % 10 = 0)::INTEGER AS is_test, n, items, prices, items[(o_orderkey % n + 1)::BIGINT] AS chosen
  FROM orders JOIN ag ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ev AS (
  SELECT * EXCLUDE (chosen), CASE WHEN is_test = 0 THEN chosen END AS reference,
         CASE WHEN is_test = 0 THEN (list_position(items, chosen) - 1)::INTEGER ELSE -1000 END AS idx,
         (row_number() OVER (PARTITION BY session_id ORDER BY seq))::INTEGER AS step
  FROM e0),
ob AS (
  SELECT ev.* EXCLUDE (items, prices), ln.item_id, ln.price, ln.rank, (coalesce(ln.item_id = ev.reference, FALSE))::INTEGER AS was_clicked
  FROM ev JOIN ln ON ev.event_id = ln.l_orderkey)"""

#: Feed E: a log of actions with references.
FEED_E = """
ac AS (
  SELECT event_id AS seq, user_id, floor(epoch(ts))::BIGINT AS ts, user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
         CASE event_type WHEN 'click' THEN 'clickout item' WHEN 'view' THEN 'interaction item info' WHEN 'purchase' THEN 'interaction item deals'
              WHEN 'signup' THEN 'filter selection' ELSE 'search for poi' END AS action_type,
         json_extract_string(props, '$.k') AS reference, floor(value)::BIGINT AS price
  FROM events)"""

#: Feed M: clickouts of feed O with item actions before them. lg has all events with their next lists, mb a row per clickout and list member.
FEED_M = (
    FEED_O
    + """,
lg0 AS (
  SELECT e.seq * 100 + ln.rank AS seq, e.user_id, e.session_id, e.ts - 600 + 40 * ln.rank AS ts,
         CASE (e.event_id + ln.rank) % 6 WHEN 0 THEN 'interaction item image' WHEN 1 THEN 'interaction item rating' WHEN 2 THEN 'interaction item info' WHEN 3 THEN 'search for item' WHEN 4 THEN 'interaction item deals' ELSE 'change of sort order' END AS action_type,
         CASE WHEN (e.event_id + ln.rank) % 6 = 5 THEN CASE ln.rank % 3 WHEN 0 THEN 'price only' WHEN 1 THEN 'distance' ELSE 'rating' END
              WHEN ln.item_id % 7 = 0 THEN (ln.item_id + 1)::VARCHAR WHEN ln.item_id % 11 = 0 THEN '5 Star' ELSE ln.item_id::VARCHAR END AS reference,
         0 AS is_test, e.platform, e.device, NULL::BIGINT[] AS items, NULL::BIGINT[] AS prices, NULL::INTEGER AS n, NULL::INTEGER AS idx
  FROM ev e JOIN ln ON ln.l_orderkey = e.event_id
  UNION ALL
  SELECT seq * 100 + 99, user_id, session_id, ts, 'clickout item', reference::VARCHAR, is_test, platform, device, items, prices, n, idx FROM ev),
lg1 AS (
  SELECT *, try_cast(reference AS BIGINT) AS item, first_value(items IGNORE NULLS) OVER w AS fake_items, first_value(prices IGNORE NULLS) OVER w AS fake_prices
  FROM lg0 WINDOW w AS (PARTITION BY user_id, session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lg AS (
  SELECT *, coalesce(list_position(fake_items, item) - 1, -1000)::INTEGER AS fake_idx, array_to_string(fake_items, '|') AS fk,
         action_type IN ('clickout item', 'interaction item deals', 'interaction item image', 'interaction item info', 'interaction item rating', 'search for item') AS on_item
  FROM lg1),
mb AS (
  SELECT l.seq, l.user_id, l.session_id, l.ts, l.is_test, l.platform, l.device, l.n, l.idx, l.item, l.fk, ln.item_id, ln.price, ln.rank
  FROM lg l JOIN ev ON l.seq = ev.seq * 100 + 99 JOIN ln ON ln.l_orderkey = ev.event_id)"""
)
