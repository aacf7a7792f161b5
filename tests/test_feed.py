import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import types as T

import feed_model
from deckflow.operators.feed import BlendedFeed, FeedInputs, slot_quota

CARD_SCHEMA = T.StructType([T.StructField("card_id", T.LongType()), T.StructField("concept", T.StringType()),
                            T.StructField("title", T.StringType()), T.StructField("topic", T.StringType()),
                            T.StructField("depth", T.IntegerType()), T.StructField("created_at", T.DateType()),
                            T.StructField("connections", T.ArrayType(T.StringType()))])
EVENT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()),
                             T.StructField("card_id", T.LongType()), T.StructField("event", T.StringType()),
                             T.StructField("created_at", T.TimestampNTZType())])


def random_tables(seed, n_cards=40, n_concepts=6, n_users=7, n_events=120):
    rnd = random.Random(seed)
    concepts = [f"c{i}" for i in range(n_concepts)]
    cards = {}
    for cid in range(1, n_cards + 1):
        cards[cid] = {"concept": rnd.choice(concepts), "depth": rnd.randint(1, 4),
                      "created_at": date(2024, 1, 1) + timedelta(days=rnd.randint(0, 5)),
                      "connections": rnd.sample(concepts + ["missing"], rnd.randint(0, 3))}
    events = []
    for i in range(n_events):
        u = rnd.randint(1, n_users)
        cid = rnd.randint(1, n_cards + 3)  # a few unknown cards (rejected)
        t = datetime(2024, 1, 20) + timedelta(hours=rnd.randint(0, 24 * 10))
        if rnd.random() < 0.1:
            t = datetime(2024, 1, 28)  # exactly at the cutoff midnight
        events.append((i, u, cid, rnd.choice(["seen", "tap"]), t))
    return cards, events


def spark_feed(spark, cards, events, limit, seed="7"):
    cdf = spark.createDataFrame([(k, v["concept"], f"t{k}", "x", v["depth"], v["created_at"], v["connections"])
                                 for k, v in cards.items()], CARD_SCHEMA)
    edf = spark.createDataFrame(events, EVENT_SCHEMA)
    rows = BlendedFeed(FeedInputs(cdf, edf, limit, "2024-01-31", seed)).feed().collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append((r.card_id, r.source))
    return got


def test_slot_quota_values():
    expect = {5: [1, 1, 1, 1, 1], 10: [5, 2, 1, 1, 1], 20: [8, 5, 3, 2, 2], 50: [21, 12, 7, 5, 5],
              100: [40, 25, 15, 10, 10]}
    for limit, vals in expect.items():
        assert list(slot_quota(limit).values()) == vals
    assert slot_quota(2)["continue"] == 2  # negative slot -> limit
    with pytest.raises(ValueError):
        slot_quota(-1)


@pytest.mark.parametrize("limit", [0, 1, 3, 4, 6, 10, 25])
def test_feed_matches_single_user_model(spark, limit):
    cards, events = random_tables(11)
    got = spark_feed(spark, cards, events, limit)
    users = sorted({u for _, u, c, _, _ in events if c in cards})
    for u in users:
        ev = [(c, t) for _, uu, c, _, t in events if uu == u]
        want = feed_model.feed(cards, ev, limit, "2024-01-31", "7")
        assert got.get(u, []) == want, (u, limit)


def test_feed_invariants_and_partition_independence(spark):
    cards, events = random_tables(5, n_cards=25)
    base = spark_feed(spark, cards, events, 20)
    engaged = {}
    for _, u, c, _, _ in events:
        if c in cards:
            engaged.setdefault(u, set()).add(c)
    for u, feed in base.items():
        ids = [c for c, _ in feed]
        assert not [c for c, s in feed if s in ("continue", "fresh", "backfill") and c in engaged[u]]
        assert len(ids) == len(set(ids)) == min(20, len(cards))
        order = ["continue", "fresh", "bridge", "resurface", "backfill", "fill"]
        ranks = [order.index(s) for _, s in feed]
        assert ranks == sorted(ranks)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert spark_feed(spark, cards, events, 20) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_user_alone_equals_batch(spark):
    cards, events = random_tables(3)
    batch = spark_feed(spark, cards, events, 10)
    u = next(iter(batch))
    alone = spark_feed(spark, cards, [e for e in events if e[1] == u], 10)
    assert alone[u] == batch[u]


@pytest.mark.parametrize("limit", [4, 20])
def test_feed_of_cold_users(spark, limit):
    """Users without events, or with rejected ones only, get fresh and fill cards."""
    cards, events = random_tables(17)
    events += [(900, 77, 10_000, "seen", datetime(2024, 1, 20))]
    cdf = spark.createDataFrame([(k, v["concept"], f"t{k}", "x", v["depth"], v["created_at"], v["connections"])
                                 for k, v in cards.items()], CARD_SCHEMA)
    users = spark.createDataFrame([(1,), (88,), (88,), (None,)], "user_id long")
    f = BlendedFeed(FeedInputs(cdf, spark.createDataFrame(events, EVENT_SCHEMA), limit, "2024-01-31", "7", users))
    got = {}
    for r in sorted(f.feed().collect(), key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append((r.card_id, r.source))
    assert set(got) == {u for _, u, _, _, _ in events} | {88}
    for u in got:
        ev = [(c, t) for _, uu, c, _, t in events if uu == u]
        assert got[u] == feed_model.feed(cards, ev, limit, "2024-01-31", "7"), (u, limit)
    nothing = spark.createDataFrame([], EVENT_SCHEMA)
    alone = BlendedFeed(FeedInputs(cdf, nothing, limit, "2024-01-31", "7", users)).feed().collect()
    assert {r.user_id for r in alone} == {1, 88} and len(alone) == 2 * limit


def test_feed_hot_user_chunked_expansion_matches_model(spark):
    """A tiny chunk size sends every user through the chunked (hot-user) rank expansion."""
    cards, events = random_tables(23, n_users=3, n_events=150)
    cdf = spark.createDataFrame([(k, v["concept"], f"t{k}", "x", v["depth"], v["created_at"], v["connections"])
                                 for k, v in cards.items()], CARD_SCHEMA)
    edf = spark.createDataFrame(events, EVENT_SCHEMA)
    f = BlendedFeed(FeedInputs(cdf, edf, 20, "2024-01-31", "7"))
    f.CHUNK = 4
    rows = f.feed().collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append((r.card_id, r.source))
    for u in sorted({u for _, u, c, _, _ in events if c in cards}):
        ev = [(c, t) for _, uu, c, _, t in events if uu == u]
        assert got.get(u, []) == feed_model.feed(cards, ev, 20, "2024-01-31", "7"), u


def test_candidates_end_where_a_users_first_ones_do(spark):
    """A user of many concepts gets its first cards of all of them, from a part of the first of each."""
    rnd = random.Random(4)
    names = [f"c{i}" for i in range(20)]
    cards = {c: {"concept": rnd.choice(names), "depth": rnd.randint(1, 2), "created_at": date(2024, 1, 1), "connections": names} for c in range(1, 1501)}
    events = [(i, 1, c, "seen", datetime(2024, 1, 20)) for i, c in enumerate(rnd.sample(range(1, 400), 120))]
    cdf = spark.createDataFrame([(k, v["concept"], "t", "x", v["depth"], v["created_at"], v["connections"]) for k, v in cards.items()], CARD_SCHEMA)
    feed = BlendedFeed(FeedInputs(cdf, spark.createDataFrame(events, EVENT_SCHEMA), 20))
    seen = {e[2] for e in events}
    deep = {cards[c]["concept"] for c in seen if cards[c]["depth"] > 1}
    n = 20
    raw = [r.card_id for r in feed._raw_backfill(n).collect()]
    want = sorted(c for c, v in cards.items() if v["depth"] == 1 and v["concept"] in deep and c not in seen)[:n]
    assert sorted(set(raw) - seen)[:n] == want and len(deep) > 10 and len(set(raw) - seen) < n * len(deep) / 2
    n = feed.slots["bridge"] + feed._before("bridge")
    assert [r.card_id for r in feed.bridge().sort("ord").collect()] == sorted(cards, key=lambda c: (cards[c]["depth"], c))[:n]
    # a concept of few cards: no end, nothing is left out
    req = spark.createDataFrame([(1, "c0", 5), (1, "none", 5), (2, "c0", 5)], "user_id long, concept string, bound long")
    ends = {(r.user_id, r.concept): r.end for r in feed._ends(req, feed.rank("backfill"), "brank", feed.rank("backfill")["card_id"], 5).collect()}
    assert ends == {(1, "c0"): None, (1, "none"): None, (2, "c0"): sorted(c for c, v in cards.items() if v["depth"] == 1 and v["concept"] == "c0")[4]}
