"""Feed keys (F05, K01-K07) over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.operators.feed import BlendedFeed, FeedInputs, slot_quota_col
from deckflow.plans.catalog import register
from deckflow.plans.oracle_feed import feed_sql
from deckflow.sources import bindings as B


def _feed(spark, sf_dir) -> BlendedFeed:
    return BlendedFeed(FeedInputs(B.cards(spark, sf_dir), B.engagement(spark, sf_dir),
                                  B.LIMIT, B.AS_OF, B.SEED, B.users(spark, sf_dir)))


@register("feed", feed_sql(B.LIMIT, B.AS_OF, B.SEED))
def feed(spark, sf_dir):
    return _feed(spark, sf_dir).feed()


def _step_key(key: str, source: str):
    @register(key, feed_sql(B.LIMIT, B.AS_OF, B.SEED, only=source))
    def step(spark, sf_dir):
        return _feed(spark, sf_dir).step(source)
    return step


for _key, _src in [("feed_continue", "continue"), ("feed_fresh", "fresh"), ("feed_bridge", "bridge"),
                   ("feed_resurface", "resurface"), ("feed_backfill", "backfill"), ("feed_fill", "fill")]:
    _step_key(_key, _src)


_SLOT_SQL = """
WITH l AS (SELECT DISTINCT p_size AS lim FROM part),
s AS (SELECT lim, greatest(1, CAST(floor(lim * 0.40) AS INTEGER)) AS c0,
             greatest(1, CAST(floor(lim * 0.25) AS INTEGER)) AS fresh,
             greatest(1, CAST(floor(lim * 0.15) AS INTEGER)) AS bridge,
             greatest(1, CAST(floor(lim * 0.10) AS INTEGER)) AS resurface,
             greatest(1, CAST(floor(lim * 0.10) AS INTEGER)) AS backfill FROM l)
SELECT lim AS "limit",
       CASE WHEN c0 + lim - (c0 + fresh + bridge + resurface + backfill) < 0 THEN lim
            ELSE c0 + lim - (c0 + fresh + bridge + resurface + backfill) END AS "continue",
       fresh, bridge, resurface, backfill
FROM s"""


@register("slot_quota", _SLOT_SQL)
def slot_quota(spark, sf_dir):
    """F05 for every distinct requested limit (here: the distinct part sizes)."""
    lims = B.table(spark, sf_dir, "part").select(F.col("p_size").alias("limit")).distinct()
    return lims.select("limit", slot_quota_col(F.col("limit")).alias("s")).select("limit", "s.*")
