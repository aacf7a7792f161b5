"""Viewer replay keys (N01-N03) and viewer helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.functions.text import gesture_class, phase_label, phase_text
from deckflow.operators import viewer as V
from deckflow.plans.catalog import register
from deckflow.plans.oracle_views import CARDS, with_views
from deckflow.sources import bindings as B

_NAV_SQL = with_views(CARDS, """decks AS (
  SELECT topic, count(*) AS n FROM cards WHERE topic <> 'all' GROUP BY topic UNION ALL SELECT 'all', count(*) FROM cards),
raw AS (
  SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'next' WHEN event_type = 'error' THEN 'prev'
              WHEN event_type = 'signup' THEN 'topic' END AS op FROM events),
ev AS (
  SELECT r.user_id, r.event_id, r.ts, r.op, r.topic, coalesce(d.n, 0) AS n,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.event_id) AS rn
  FROM (SELECT r.*, CASE WHEN op = 'topic' THEN CASE WHEN k % 7 = 0 THEN 'all' ELSE coalesce(c.topic, 'none') END END AS topic
        FROM raw r LEFT JOIN cards c ON c.card_id = r.k) r LEFT JOIN decks d ON d.topic = r.topic),
held AS (
  SELECT h.user_id, h.topic, coalesce(d.n, 0) AS n, h.phase, h.idx
  FROM (SELECT c_custkey AS user_id, c_custkey * 13 % 900 - 20 AS idx, c_custkey % 3 AS phase,
               CASE WHEN c_custkey % 2 = 0 THEN 'all' ELSE coalesce(nullif(k.topic, ''), 'all') END AS topic
        FROM customer LEFT JOIN cards k ON k.card_id = c_custkey WHERE c_custkey % 3 <> 0) h LEFT JOIN decks d ON d.topic = h.topic),
st(user_id, rn, event_id, ts, p, topic, n) AS (
  SELECT u.user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP),
         CAST(coalesce(3 * CASE WHEN h.n = 0 THEN greatest(h.idx, 0) WHEN h.idx >= h.n THEN 0 WHEN h.idx < 0 THEN h.n - 1 ELSE h.idx END + h.phase, 0) AS BIGINT),
         coalesce(h.topic, 'all'), coalesce(h.n, (SELECT n FROM decks WHERE topic = 'all'))
  FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN held h ON h.user_id = u.user_id
  UNION ALL
  SELECT s.user_id, e.rn, e.event_id, e.ts,
         CASE e.op WHEN 'next' THEN CASE WHEN s.n > 0 THEN (s.p + 1) % (3 * s.n) ELSE s.p + 1 END WHEN 'prev' THEN greatest(s.p - 1, 0) ELSE 0 END,
         CASE e.op WHEN 'topic' THEN e.topic ELSE s.topic END, CASE e.op WHEN 'topic' THEN e.n ELSE s.n END
  FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
""").replace("WITH ", "WITH RECURSIVE ", 1)
# the same for users without a stored state
NAV_SQL_FRESH = _NAV_SQL.replace("WHERE c_custkey % 3 <> 0)", "WHERE false)")
assert NAV_SQL_FRESH != _NAV_SQL
_LAST = " QUALIFY rn = max(rn) OVER (PARTITION BY user_id)"


def _views(spark, sf):
    return V.replay_views(B.nav_events(spark, sf), B.cards(spark, sf), B.stored_states(spark, sf))


@register("nav_replay", _NAV_SQL + """
SELECT user_id, CAST(p // 3 AS INTEGER) AS idx, CAST(p % 3 AS INTEGER) AS phase, rn AS n_events FROM st""" + _LAST)
def nav_replay(spark, sf):
    """Final viewer position of every user."""
    return V.last_state(_views(spark, sf)).drop("topic")


@register("nav_views", _NAV_SQL + """
SELECT user_id, event_id, topic, CAST(p // 3 AS INTEGER) AS idx, CAST(p % 3 AS INTEGER) AS phase FROM st WHERE rn > 0""")
def nav_views(spark, sf):
    """The topic, card and phase shown after every event."""
    return _views(spark, sf).drop("ts")


@register("nav_resume", _NAV_SQL + """
SELECT user_id, CAST(p // 3 AS INTEGER) AS idx, CAST(p % 3 AS INTEGER) AS phase, topic FROM st""" + _LAST)
def nav_resume(spark, sf):
    """The latest saved state per user."""
    return V.last_state(_views(spark, sf)).drop("n_events")


@register("fn_phase_label", with_views(CARDS) + """
SELECT card_id, (['Idea', 'Example', 'Think about it'])[card_id % 3 + 1] AS label,
       ([idea, example, probe])[card_id % 3 + 1] AS text FROM cards""")
def fn_phase_label(spark, sf):
    c = B.cards(spark, sf)
    ph = (F.col("card_id") % 3).cast("int")
    return c.select("card_id", phase_label(ph).alias("label"), phase_text("idea", "example", "probe", ph).alias("text"))


@register("gesture_class", """
SELECT event_id, CASE WHEN abs(value - 100) < 30 AND abs(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50) < 30 THEN 'next'
  WHEN abs(value - 100) > abs(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50) AND abs(value - 100) > 50
    THEN CASE WHEN value - 100 < 0 THEN 'next' ELSE 'prev' END
  ELSE 'none' END AS gesture FROM events""")
def gesture_class_q(spark, sf):
    """H19 over touches: dx = value - 100, dy = k - 50."""
    e = B.table(spark, sf, "events")
    dx = F.col("value") - 100
    dy = F.get_json_object("props", "$.k").try_cast("double") - 50
    return e.select("event_id", gesture_class(dx, dy).alias("gesture"))
