"""Engagement log operators: validation, joins with cards, aggregates.

All of them work for every user at once. Exclusions are semi / anti joins on
keys (never literal IN lists, never null-aware NOT IN), aggregates are plain
groupBy so Spark combines partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nonempty(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def is_valid():
    """An event is accepted iff card_id and event are non-empty."""
    return _nonempty("card_id") & _nonempty("event")


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(is_valid())


def invalid_events(events: DataFrame) -> DataFrame:
    """B05 complement: the quarantine of malformed events."""
    return events.filter(~is_valid())


def orphan_events(events: DataFrame, cards: DataFrame) -> DataFrame:
    """Events whose card does not exist (the reference's FK failure)."""
    return events.join(cards.select("card_id"), "card_id", "left_anti")


def accepted_events(events: DataFrame, cards: DataFrame) -> DataFrame:
    """B05 + C08: valid events of existing cards."""
    return valid_events(events).join(cards.select("card_id"), "card_id", "left_semi")


def engaged_cards(events: DataFrame, cards: DataFrame, cols=("concept", "depth")) -> DataFrame:
    """Engagement inner-join cards on card id (only the needed card columns)."""
    return events.join(cards.select("card_id", *cols), "card_id")


def engaged_pairs(events: DataFrame) -> DataFrame:
    """Distinct (user, card) pairs with first and last event time.
    A partial+final aggregate, so a hot user or card is combined map-side."""
    return (events.groupBy("user_id", "card_id")
            .agg(F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"),
                 F.count(F.lit(1)).alias("n_events")))


def last_concept(pairs_with_cards: DataFrame) -> DataFrame:
    """Concept of each user's latest engagement; at equal time the
    greatest concept. max(struct) is one aggregate with no sort."""
    return (pairs_with_cards.groupBy("user_id")
            .agg(F.max(F.struct("last_ts", "concept")).alias("_m"))
            .select("user_id", F.col("_m.concept").alias("concept"),
                    F.col("_m.last_ts").alias("last_engaged")))


def max_depth_seen(events: DataFrame, cards: DataFrame) -> DataFrame:
    """Per (user, concept) the max engaged depth (0 when none)."""
    return (engaged_cards(events, cards).groupBy("user_id", "concept")
            .agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")))


def engagement_stats(events: DataFrame) -> DataFrame:
    """Event -> count for every card."""
    return events.groupBy("card_id", "event").agg(F.count(F.lit(1)).alias("count"))


def engagement_stats_map(events: DataFrame) -> DataFrame:
    """The same as one map per card (event names sorted for a stable map)."""
    return (engagement_stats(events).groupBy("card_id")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "count")))).alias("stats")))


def seen_before(events: DataFrame, cutoff) -> DataFrame:
    """One row per (user, card) having an event before ``cutoff``."""
    return events.filter(F.col("created_at") < cutoff).select("user_id", "card_id").distinct()


def concepts_engaged_deeper(events: DataFrame, cards: DataFrame) -> DataFrame:
    """(user, concept) pairs with an engaged card at depth > 1."""
    return (engaged_cards(events, cards).filter(F.col("depth") > 1)
            .select("user_id", "concept").distinct())


def adjacent_concepts(events: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct neighbours of every engaged card's connections."""
    return (engaged_cards(events, cards, ("connections",))
            .select("user_id", F.explode("connections").alias("neighbour")).distinct())


def adjacent_card_rows(events: DataFrame, cards: DataFrame) -> DataFrame:
    """All cards whose concept is a neighbour of any user's, with ``neighbour``;
    linear in the cards. ``adjacent_concepts`` says whose neighbours they are."""
    near = adjacent_concepts(events, cards).select("neighbour").distinct()
    return cards.join(near, cards["concept"] == near["neighbour"])


def concept_edges(concepts: DataFrame) -> DataFrame:
    """Weighted edges (from, to, weight, relationship) of concept records."""
    return concepts.select(F.col("concept").alias("src"), F.inline("connections")).select(
        "src", F.col("to").alias("dst"), "weight", "relationship")
