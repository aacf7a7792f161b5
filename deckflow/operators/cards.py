"""Card-table operators: lookups, per-concept / per-topic ordering, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.operators.ranking import global_rank, null_safe_join, rank_within, top_n


def lookup(requests: DataFrame, cards: DataFrame, cols: list[str]) -> DataFrame:
    """B01 batched: requests LEFT JOIN cards; ``found`` false = not found."""
    c = cards.select("card_id", *cols, F.lit(True).alias("found"))
    return requests.join(c, "card_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def by_concept(cards: DataFrame, order: list) -> DataFrame:
    """Position of every card inside its concept (skew-safe rank). Give
    it the columns that are ranked and join others by card_id after."""
    return rank_within(cards, ["concept"], order, "pos")


def topic_filter(cards: DataFrame, topic: str) -> DataFrame:
    """B04: 'all' keeps everything, otherwise exact topic equality."""
    return cards.filter((F.lit(topic) == "all") | (F.col("topic") == topic))


def topics_in_order(cards: DataFrame) -> DataFrame:
    """Topics in first-appearance order (cards ordered by id), 'all' first."""
    first = cards.groupBy("topic").agg(F.min("card_id").alias("_first"))
    ranked = global_rank(first, ["_first"], "rank").select("topic", F.col("rank").cast("int").alias("rank"))
    return ranked.unionByName(cards.sparkSession.range(1).select(F.lit("all").alias("topic"),
                                                                 F.lit(0).alias("rank")))


def topn_recent(events: DataFrame, n: int) -> DataFrame:
    """Each user's n most recently engaged cards (partial top-n per user)."""
    last = events.groupBy("user_id", "card_id").agg(F.max("created_at").alias("_t"))
    return (top_n(last, ["user_id"], [F.col("_t").desc(), "card_id"], n)
            .select("user_id", "card_id", F.col("rn").cast("int").alias("rn")))


def deck_position(cards: DataFrame) -> DataFrame:
    """E02: 'i / N' inside the topic deck; the rank is skew-safe and N is a
    partial aggregate joined back."""
    r = rank_within(cards.select("card_id", "topic"), ["topic"], ["card_id"], "pos")
    n = cards.groupBy(F.col("topic").alias("_k_topic")).agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(r, n, ["topic"]).select(
        "card_id", "topic", "pos", "n",
        F.concat(F.col("pos").cast("string"), F.lit(" / "), F.col("n").cast("string")).alias("label"))


def ordered(cards: DataFrame) -> DataFrame:
    """all cards by (concept, depth), numbered without a single-partition sort."""
    return global_rank(cards.select("card_id", "concept", "depth"), ["concept", "depth", "card_id"], "pos")


def concepts_from_cards(cards: DataFrame) -> DataFrame:
    """Concept records derived from the card table (one per concept): the
    connections of its cards as weighted edges with weight 1.0."""
    edges = cards.select("concept", F.explode("connections").alias("to")).distinct()
    conn = edges.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct(
        F.col("to"), F.lit(1.0).alias("weight"), F.lit("").alias("relationship")))).alias("connections"))
    base = cards.groupBy("concept").agg(F.min("topic").alias("cluster"), F.min("depth").alias("depth"))
    return base.join(conn, "concept", "left").select(
        "concept", F.col("concept").alias("name"), "cluster", "depth", "connections")
