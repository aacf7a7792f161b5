"""Card and engagement keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.functions.text import day_cutoff, seeded_order
from deckflow.operators import engagement as eng
from deckflow.operators import cards as cops
from deckflow.operators.feed import BlendedFeed, FeedInputs
from deckflow.plans.catalog import register
from deckflow.plans.oracle_feed import feed_sql
from deckflow.plans.oracle_views import ACCEPTED, CARDS, ENGAGEMENT, with_views
from deckflow.sources import bindings as B

V = with_views(CARDS, ENGAGEMENT, ACCEPTED)
VC = with_views(CARDS)
VE = with_views(ENGAGEMENT)
VCE = with_views(CARDS, ENGAGEMENT)
CUTOFF_SQL = f"CAST(DATE '{B.AS_OF}' - 3 AS TIMESTAMP)"


def _cards(spark, sf):
    return B.cards(spark, sf)


def _acc(spark, sf):
    return eng.accepted_events(B.engagement(spark, sf), _cards(spark, sf))


def _cutoff(df):
    return day_cutoff(F.lit(B.AS_OF)).cast(dict(df.dtypes)["created_at"])


# ---- B01-B07 ---------------------------------------------------------------
@register("card_lookup", VCE + """
SELECT e.id AS request_id, e.card_id, c.title, c.concept, c.depth, c.card_id IS NOT NULL AS found
FROM engagement e LEFT JOIN cards c ON c.card_id = e.card_id""")
def card_lookup(spark, sf):
    """B01 batched: every event is a lookup request for its card."""
    req = B.engagement(spark, sf).select(F.col("id").alias("request_id"), "card_id")
    return cops.lookup(req, _cards(spark, sf), ["title", "concept", "depth"])


@register("cards_by_concept", VC + """
SELECT concept, card_id, depth,
       row_number() OVER (PARTITION BY concept ORDER BY depth, card_id) AS pos
FROM cards""")
def cards_by_concept(spark, sf):
    """B02 for all concepts at once: position by depth inside each concept."""
    return cops.by_concept(_cards(spark, sf).select("concept", "card_id", "depth"), ["depth", "card_id"])


@register("concept_feed", VC + """
SELECT concept, card_id, depth, CAST(created_at AS VARCHAR) AS created_at,
       row_number() OVER (PARTITION BY concept ORDER BY depth, created_at NULLS FIRST, card_id) AS pos
FROM cards""")
def concept_feed(spark, sf):
    """By depth then created_at inside each concept."""
    r = cops.by_concept(_cards(spark, sf).select("concept", "card_id", "depth", "created_at"), ["depth", F.col("created_at").asc_nulls_first(), "card_id"])
    return r.select("concept", "card_id", "depth", F.col("created_at").cast("string").alias("created_at"), "pos")


@register("topic_filter", VC + """
SELECT 'all' AS selected, card_id FROM cards
UNION ALL SELECT 'SMALL' AS selected, card_id FROM cards WHERE topic = 'SMALL'""")
def topic_filter(spark, sf):
    """B04: 'all' or an exact topic."""
    c = _cards(spark, sf)
    return cops.topic_filter(c, "all").select(F.lit("all").alias("selected"), "card_id").unionByName(
        cops.topic_filter(c, "SMALL").select(F.lit("SMALL").alias("selected"), "card_id"))


@register("engagement_valid", VE + """
SELECT id, id % 9 <> 0 AND id % 11 <> 0 AND coalesce(CAST(card_id AS VARCHAR), '') <> '' AND coalesce(event, '') <> '' AS valid FROM engagement""")
def engagement_valid(spark, sf):
    """B05 over the log with gaps: every ninth event has no card, every eleventh no name."""
    e = B.engagement(spark, sf)
    gaps = e.withColumn("card_id", F.when(F.col("id") % 9 != 0, F.col("card_id"))).withColumn("event", F.when(F.col("id") % 11 == 0, F.lit("")).otherwise(F.col("event")))
    return gaps.select("id", eng.is_valid().alias("valid"))


@register("exclude_ids", VCE + """
SELECT c.card_id FROM cards c WHERE NOT EXISTS (SELECT 1 FROM engagement e WHERE e.card_id = c.card_id)""")
def exclude_ids(spark, sf):
    """Exclusion by an id table (anti join), here: cards nobody engaged with."""
    return _cards(spark, sf).select("card_id").join(
        B.engagement(spark, sf).select("card_id"), "card_id", "left_anti")


@register("depth_filter", VC + """
SELECT card_id, depth = 1 AS fundamental FROM cards WHERE depth = 1 OR depth > 1""")
def depth_filter(spark, sf):
    c = _cards(spark, sf)
    return c.filter(F.col("depth") >= 1).select("card_id", (F.col("depth") == 1).alias("fundamental"))


# ---- C01-C10 ---------------------------------------------------------------
@register("engaged_cards", V + """
SELECT a.id, a.user_id, a.card_id, c.concept, c.depth FROM acc a JOIN cards c ON c.card_id = a.card_id""")
def engaged_cards(spark, sf):
    return eng.engaged_cards(_acc(spark, sf), _cards(spark, sf)).select("id", "user_id", "card_id", "concept", "depth")


@register("unseen_cards", V + """,
lastc AS (SELECT a.user_id, c.concept FROM acc a JOIN cards c ON c.card_id = a.card_id
          QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY a.created_at DESC, c.concept DESC) = 1)
SELECT user_id, card_id, CAST(rn AS BIGINT) AS rn FROM (
  SELECT l.user_id, c.card_id, row_number() OVER (PARTITION BY l.user_id ORDER BY c.depth, c.card_id) AS rn
  FROM lastc l JOIN cards c ON c.concept = l.concept
  WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.user_id = l.user_id AND a.card_id = c.card_id))
WHERE rn <= 20""")
def unseen_cards(spark, sf):
    """Cards of the user's last concept the user never engaged with (anti
    join), the first 20 by (depth, card_id). Candidates come from the bounded
    rank expansion, so a large concept is never paired with all its users."""
    f = _feed(spark, sf)
    return f.continue_(B.LIMIT).select("user_id", "card_id", F.col("ord").alias("rn"))


@register("seen_before", V + f"""
SELECT DISTINCT user_id, card_id FROM acc WHERE created_at < {CUTOFF_SQL}""")
def seen_before(spark, sf):
    a = _acc(spark, sf)
    return eng.seen_before(a, _cutoff(a))


@register("concepts_engaged_deeper", V + """
SELECT DISTINCT a.user_id, c.concept FROM acc a JOIN cards c ON c.card_id = a.card_id WHERE c.depth > 1""")
def concepts_engaged_deeper(spark, sf):
    return eng.concepts_engaged_deeper(_acc(spark, sf), _cards(spark, sf))


@register("adjacent_concepts", V + """
SELECT DISTINCT a.user_id, unnest(c.connections) AS neighbour FROM acc a JOIN cards c ON c.card_id = a.card_id""")
def adjacent_concepts(spark, sf):
    return eng.adjacent_concepts(_acc(spark, sf), _cards(spark, sf))


@register("adjacent_cards", V + """,
adj AS (SELECT DISTINCT a.user_id, unnest(c.connections) AS neighbour FROM acc a JOIN cards c ON c.card_id = a.card_id)
SELECT adj.user_id, adj.neighbour, count(*) AS n_cards FROM adj JOIN cards c ON c.concept = adj.neighbour
GROUP BY adj.user_id, adj.neighbour""")
def adjacent_cards(spark, sf):
    """C06, counted per (user, neighbour); the cards are in ``adjacent_card_rows``,
    once per neighbour concept, and the pairs in ``adjacent_concepts``."""
    c = _cards(spark, sf)
    per_concept = c.groupBy(F.col("concept").alias("neighbour")).agg(F.count(F.lit(1)).alias("n_cards"))
    return eng.adjacent_concepts(_acc(spark, sf), c).join(per_concept, "neighbour")


@register("adjacent_card_rows", V + """,
adj AS (SELECT DISTINCT unnest(c.connections) AS neighbour FROM acc a JOIN cards c ON c.card_id = a.card_id)
SELECT adj.neighbour, c.card_id, c.depth FROM adj JOIN cards c ON c.concept = adj.neighbour""")
def adjacent_card_rows(spark, sf):
    """The cards of each neighbour concept, once for all users. A user's
    cards are these joined with ``adjacent_concepts`` on the neighbour."""
    c = _cards(spark, sf)
    return eng.adjacent_card_rows(_acc(spark, sf), c).select("neighbour", "card_id", "depth")


@register("picked_anti", V + f"""
SELECT DISTINCT user_id, card_id FROM acc a
WHERE NOT EXISTS (SELECT 1 FROM acc b WHERE b.user_id = a.user_id AND b.card_id = a.card_id
                  AND b.created_at < {CUTOFF_SQL})""")
def picked_anti(spark, sf):
    """Per-user exclusion of an earlier pick set (here: cards already seen
    before the cutoff), an anti join on (user_id, card_id)."""
    a = _acc(spark, sf)
    return (a.select("user_id", "card_id").distinct()
            .join(eng.seen_before(a, _cutoff(a)), ["user_id", "card_id"], "left_anti"))


@register("orphan_events", with_views(ENGAGEMENT) + """
SELECT e.id, e.card_id FROM engagement e
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 10 <> 0 AND p.p_partkey = e.card_id)""")
def orphan_events(spark, sf):
    """C08 against a card table missing every tenth card."""
    parents = _cards(spark, sf).filter(F.col("card_id") % 10 != 0)
    return eng.orphan_events(B.engagement(spark, sf), parents).select("id", "card_id")


@register("concept_edges", VC + """
SELECT DISTINCT concept AS src, unnest(connections) AS dst, 1.0::DOUBLE AS weight, '' AS relationship FROM cards""")
def concept_edges(spark, sf):
    return eng.concept_edges(cops.concepts_from_cards(_cards(spark, sf)))


# ---- D01-D08 ---------------------------------------------------------------
@register("last_concept", V + """
SELECT a.user_id, c.concept, a.created_at AS last_engaged FROM acc a JOIN cards c ON c.card_id = a.card_id
QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY a.created_at DESC, c.concept DESC) = 1""")
def last_concept(spark, sf):
    c = _cards(spark, sf)
    return eng.last_concept(eng.engaged_pairs(_acc(spark, sf)).join(c.select("card_id", "concept"), "card_id"))


@register("max_depth_seen", V + """
SELECT a.user_id, c.concept, coalesce(max(c.depth), 0) AS max_depth FROM acc a JOIN cards c ON c.card_id = a.card_id
GROUP BY a.user_id, c.concept""")
def max_depth_seen(spark, sf):
    return eng.max_depth_seen(_acc(spark, sf), _cards(spark, sf))


@register("engagement_stats", V + """
SELECT card_id, event, count(*) AS count FROM acc GROUP BY card_id, event""")
def engagement_stats(spark, sf):
    return eng.engagement_stats(_acc(spark, sf))


@register("engagement_stats_map", V + """
SELECT card_id, CAST(to_json(map_from_entries(list(struct_pack(k := event, v := n) ORDER BY event))) AS VARCHAR) AS stats
FROM (SELECT card_id, event, count(*) AS n FROM acc GROUP BY card_id, event) GROUP BY card_id""")
def engagement_stats_map(spark, sf):
    """One event -> count map per card (as JSON text for a stable compare)."""
    return eng.engagement_stats_map(_acc(spark, sf)).select("card_id", F.to_json("stats").alias("stats"))


@register("topics_distinct", VC + """
SELECT 'all' AS topic, 0 AS rank
UNION ALL
SELECT topic, CAST(row_number() OVER (ORDER BY min(card_id)) AS INTEGER) AS rank FROM cards GROUP BY topic""")
def topics_distinct(spark, sf):
    return cops.topics_in_order(_cards(spark, sf))


@register("distinct_engaged", V + """
SELECT DISTINCT a.user_id, c.concept FROM acc a JOIN cards c ON c.card_id = a.card_id""")
def distinct_engaged(spark, sf):
    return eng.engaged_cards(_acc(spark, sf), _cards(spark, sf)).select("user_id", "concept").distinct()


@register("dedupe_group", V + """
SELECT user_id, card_id FROM acc GROUP BY user_id, card_id""")
def dedupe_group(spark, sf):
    return _acc(spark, sf).dropDuplicates(["user_id", "card_id"]).select("user_id", "card_id")


@register("row_counts", V + """
SELECT 'cards' AS stage, count(*) AS n FROM cards
UNION ALL SELECT 'events', count(*) FROM engagement
UNION ALL SELECT 'accepted', count(*) FROM acc
UNION ALL SELECT 'concepts', count(DISTINCT concept) FROM cards""")
def row_counts(spark, sf):
    """Per-stage row counts as one DataFrame (each a global aggregate)."""
    c, e = _cards(spark, sf), B.engagement(spark, sf)
    a = eng.accepted_events(e, c)
    cnt = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    return (cnt(c, "cards").unionByName(cnt(e, "events")).unionByName(cnt(a, "accepted"))
            .unionByName(cnt(c.select("concept").distinct(), "concepts")))


# ---- E01-E02, F01-F06, G01-G02 --------------------------------------------
@register("topn_per_user", V + """
SELECT user_id, card_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT user_id, card_id, row_number() OVER (PARTITION BY user_id ORDER BY max(created_at) DESC, card_id) AS rn
  FROM acc GROUP BY user_id, card_id) WHERE rn <= 3""")
def topn_per_user(spark, sf):
    """Each user's three most recently engaged cards."""
    return cops.topn_recent(_acc(spark, sf), 3)


@register("deck_position", VC + """
SELECT card_id, topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY card_id) AS BIGINT) AS pos,
       count(*) OVER (PARTITION BY topic) AS n,
       CAST(row_number() OVER (PARTITION BY topic ORDER BY card_id) AS VARCHAR) || ' / ' ||
       CAST(count(*) OVER (PARTITION BY topic) AS VARCHAR) AS label
FROM cards""")
def deck_position(spark, sf):
    return cops.deck_position(_cards(spark, sf))


@register("cards_ordered", VC + """
SELECT card_id, concept, depth, row_number() OVER (ORDER BY concept, depth, card_id) AS pos FROM cards""")
def cards_ordered(spark, sf):
    return cops.ordered(_cards(spark, sf))


@register("cards_first_n", VC + """
SELECT card_id, concept, depth FROM cards ORDER BY concept, depth, card_id LIMIT 20""")
def cards_first_n(spark, sf):
    return _cards(spark, sf).orderBy("concept", "depth", "card_id").limit(B.LIMIT).select("card_id", "concept", "depth")


@register("newest_n", VC + """
SELECT card_id, CAST(created_at AS VARCHAR) AS created_at FROM cards
ORDER BY created_at DESC NULLS LAST, card_id LIMIT 20""")
def newest_n(spark, sf):
    return (_cards(spark, sf).orderBy(F.col("created_at").desc_nulls_last(), "card_id").limit(B.LIMIT)
            .select("card_id", F.col("created_at").cast("string").alias("created_at")))


@register("random_n", VC + f"""
SELECT card_id FROM cards ORDER BY md5('{B.SEED}' || ':' || CAST(card_id AS VARCHAR)), card_id LIMIT 20""")
def random_n(spark, sf):
    c = _cards(spark, sf)
    return c.orderBy(seeded_order(B.SEED, "card_id"), "card_id").limit(B.LIMIT).select("card_id")


def _feed(spark, sf, limit=B.LIMIT):
    return BlendedFeed(FeedInputs(_cards(spark, sf), B.engagement(spark, sf), limit, B.AS_OF, B.SEED,
                                  B.users(spark, sf)))


@register("feed_cut", feed_sql(3, B.AS_OF, B.SEED))
def feed_cut(spark, sf):
    """F06 (and Q2): limit 3 gives a negative continue slot and five 1-slots; the cut keeps 3."""
    return _feed(spark, sf, 3).feed()


@register("feed_union", feed_sql(B.LIMIT, B.AS_OF, B.SEED).rsplit("SELECT f.user_id", 1)[0] + """
SELECT user_id, card_id, source, CAST(ord AS BIGINT) AS ord FROM named""")
def feed_union(spark, sf):
    """The ordered concatenation of all sources before the cut."""
    return _feed(spark, sf).served()


@register("neighbour_union", V + """
SELECT a.user_id, list_sort(list_distinct(flatten(list(c.connections)))) AS neighbours
FROM acc a JOIN cards c ON c.card_id = a.card_id GROUP BY a.user_id""")
def neighbour_union(spark, sf):
    """Distinct neighbours first (partial aggregate), then one sorted array
    per user, bounded by the number of concepts rather than by the user's events."""
    adj = eng.adjacent_concepts(_acc(spark, sf), _cards(spark, sf))
    return adj.groupBy("user_id").agg(F.array_sort(F.collect_list("neighbour")).alias("neighbours"))
