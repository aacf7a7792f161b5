"""DuckDB SQL for the feed keys, written the way the reference states each
step (sequential exclusion via NOT EXISTS over the earlier picks)."""

from deckflow.operators.feed import FILL, SOURCES, slot_quota
from deckflow.plans.oracle_views import ACCEPTED, CARDS, ENGAGEMENT, with_views


def feed_sql(limit: int = 20, as_of: str = "2024-01-31", seed: str = "42", only: str | None = None) -> str:
    q = slot_quota(limit)
    h = f"md5('{seed}' || ':' || CAST(c.card_id AS VARCHAR))"
    not_in = lambda p: f"NOT EXISTS (SELECT 1 FROM {p} x WHERE x.user_id = u.user_id AND x.card_id = c.card_id)"
    body = f""",
ec AS (SELECT a.user_id, a.card_id, a.created_at, c.concept, c.depth, c.connections
       FROM acc a JOIN cards c ON c.card_id = a.card_id),
users AS (SELECT user_id FROM events WHERE user_id IS NOT NULL UNION SELECT c_custkey FROM customer),
seen AS (SELECT DISTINCT user_id, card_id FROM acc),
lastc AS (SELECT user_id, concept FROM ec
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, concept DESC) = 1),
k1 AS (SELECT u.user_id, c.card_id, 1 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY c.depth, c.card_id) AS ord
       FROM lastc u JOIN cards c ON c.concept = u.concept
       WHERE {not_in('seen')} QUALIFY ord <= {q['continue']}),
p1 AS (SELECT user_id, card_id FROM k1),
k2 AS (SELECT u.user_id, c.card_id, 2 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY c.created_at DESC NULLS LAST, c.card_id) AS ord
       FROM users u CROSS JOIN cards c
       WHERE {not_in('seen')} AND {not_in('p1')} QUALIFY ord <= {q['fresh']}),
p2 AS (SELECT user_id, card_id FROM p1 UNION ALL SELECT user_id, card_id FROM k2),
adj AS (SELECT DISTINCT user_id, unnest(connections) AS concept FROM ec),
k3 AS (SELECT u.user_id, c.card_id, 3 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY c.depth, c.card_id) AS ord
       FROM adj u JOIN cards c ON c.concept = u.concept
       WHERE {not_in('p2')} QUALIFY ord <= {q['bridge']}),
p3 AS (SELECT user_id, card_id FROM p2 UNION ALL SELECT user_id, card_id FROM k3),
old AS (SELECT DISTINCT user_id, card_id FROM ec
        WHERE created_at < CAST(DATE '{as_of}' - 3 AS TIMESTAMP)),
k4 AS (SELECT u.user_id, c.card_id, 4 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY {h}, c.card_id) AS ord
       FROM old u JOIN cards c ON c.card_id = u.card_id
       WHERE {not_in('p3')} QUALIFY ord <= {q['resurface']}),
p4 AS (SELECT user_id, card_id FROM p3 UNION ALL SELECT user_id, card_id FROM k4),
deep AS (SELECT DISTINCT user_id, concept FROM ec WHERE depth > 1),
k5 AS (SELECT u.user_id, c.card_id, 5 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY c.card_id) AS ord
       FROM deep u JOIN cards c ON c.concept = u.concept AND c.depth = 1
       WHERE {not_in('seen')} AND {not_in('p4')} QUALIFY ord <= {q['backfill']}),
p5 AS (SELECT user_id, card_id FROM p4 UNION ALL SELECT user_id, card_id FROM k5),
cnt AS (SELECT u.user_id, count(p.card_id) AS n FROM users u LEFT JOIN p5 p ON p.user_id = u.user_id
        GROUP BY u.user_id),
k6 AS (SELECT u.user_id, c.card_id, 6 AS src,
              row_number() OVER (PARTITION BY u.user_id ORDER BY {h}, c.card_id) AS ord
       FROM cnt u CROSS JOIN cards c
       WHERE u.n < {limit} AND {not_in('p5')} QUALIFY ord <= {limit} - u.n),
allp AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3
         UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5 UNION ALL SELECT * FROM k6),
named AS (SELECT *, ({list(SOURCES) + [FILL]!r})[src] AS source FROM allp)
"""
    head = with_views(CARDS, ENGAGEMENT, ACCEPTED).rstrip("\n") + body
    if only is not None:
        return head + f"""SELECT n.user_id, n.card_id, n.source, CAST(n.ord AS BIGINT) AS ord
FROM named n WHERE n.source = '{only}'"""
    return head + f"""SELECT f.user_id, CAST(f.position AS INTEGER) AS position, f.source, f.card_id,
       c.concept, c.title, c.topic, c.depth
FROM (SELECT user_id, card_id, source,
             row_number() OVER (PARTITION BY user_id ORDER BY src, ord) AS position
      FROM named QUALIFY position <= {limit}) f
JOIN cards c ON c.card_id = f.card_id"""
