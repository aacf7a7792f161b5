"""Streaming keys (I01-I04): each runs its stream to completion
(availableNow) over the events file and returns the sink's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.plans import q_engagement as QE
from deckflow.plans import q_viewer as QV
from deckflow.plans.catalog import register
from deckflow.sources import bindings as B
from deckflow.streaming import engagement as ST


STORE = "spark.sql.streaming.stateStore.providerClass"


def _events_stream(spark, sf):
    """The events file of ``sf`` as a file stream, bound to the canonical engagement schema."""
    schema = B.table(spark, sf, "events").schema
    raw = ST.file_stream(spark, sf, schema, glob="events.parquet")
    return raw.select(F.col("event_id").alias("id"), "user_id",
                      F.get_json_object("props", "$.k").cast("bigint").alias("card_id"),
                      F.col("event_type").alias("event"), F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
                      F.col("props").alias("metadata"), F.col("ts").alias("created_at"))


@register("stream_engagement", QE.V + "SELECT id, user_id, card_id, event FROM acc")
def stream_engagement(spark, sf):
    base = ST.scratch(spark, "engagement")
    acc, rej = ST.split_accepted(_events_stream(spark, sf), B.cards(spark, sf))
    for q in (ST.run_append(acc, base, "accepted"), ST.run_append(rej, base, "rejected")):
        q.awaitTermination()
    return spark.read.parquet(f"{base}/accepted").select("id", "user_id", "card_id", "event")


@register("stream_stats", QE.V + "SELECT card_id, event, count(*) AS count FROM acc GROUP BY card_id, event")
def stream_stats(spark, sf):
    base = ST.scratch(spark, "stats")
    acc, _ = ST.split_accepted(_events_stream(spark, sf), B.cards(spark, sf))
    ST.run_upsert(ST.running_stats(acc), base, "stats", ["card_id", "event"]).awaitTermination()
    return ST.read_latest(spark, base, "stats", ["card_id", "event"])


@register("stream_last_concept", QE.V + """
SELECT a.user_id, c.concept, a.created_at AS last_engaged FROM acc a JOIN cards c ON c.card_id = a.card_id
QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY a.created_at DESC, c.concept DESC) = 1""")
def stream_last_concept(spark, sf):
    base = ST.scratch(spark, "last_concept")
    cards = B.cards(spark, sf)
    acc, _ = ST.split_accepted(_events_stream(spark, sf), cards)
    ST.run_upsert(ST.running_last_concept(acc, cards), base, "last", ["user_id"]).awaitTermination()
    return ST.read_latest(spark, base, "last", ["user_id"])


@register("stream_nav", QV.NAV_SQL_FRESH + """
SELECT user_id, CAST(p // 3 AS INTEGER) AS idx, CAST(p % 3 AS INTEGER) AS phase, topic, rn AS n_events FROM st
QUALIFY rn = max(rn) OVER (PARTITION BY user_id)""")
def stream_nav(spark, sf):
    """N01 as a stream, for users without a stored state."""
    base = ST.scratch(spark, "nav")
    cards = B.cards(spark, sf)
    events = ST.file_stream(spark, sf, B.table(spark, sf, "events").schema, glob="events.parquet")
    provider = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ST.ROCKSDB)
    try:
        ST.run_append(ST.nav_stream(B.nav_events_of(events, cards), cards), base, "nav").awaitTermination()
    finally:
        spark.conf.set(STORE, provider) if provider else spark.conf.unset(STORE)
    return ST.latest_nav(spark.read.parquet(f"{base}/nav"))
