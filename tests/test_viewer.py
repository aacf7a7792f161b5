"""N01-N03 on histories that fill whole tasks, against a plain walk."""

import random

import numpy as np
import pytest

from deckflow.operators import viewer as V


def plain(ops, p, size):
    out = []
    for x in ops:
        p = (p + 1) % size if x > 0 and size else p + 1 if x > 0 else max(p - 1, 0)
        out.append(p)
    return out


@pytest.mark.parametrize("size", [0, 3, 6, 42, 300])
def test_walk_and_drift_equal_single_steps(size):
    rng = np.random.default_rng(size)
    for up in (0.3, 0.5, 0.7, 0.95):
        steps = np.where(rng.random(3000) < up, 1, -1).astype(np.int8)
        for p in sorted({0, 1, size // 2, max(size - 1, 0)}):
            assert V.walk(steps, p, size).tolist() == plain(steps, p, size)
        drift = V.Drift(size)
        for part in np.array_split(steps[:700], 5):
            drift.add(part)
        for p in range(size or 40):
            assert drift.after(p) == plain(steps[:700], p, size)[-1]
        assert len(drift.holder) <= 2 * 700


def replay(events, cards, stored):
    decks = {"all": len(cards)}
    for t in cards:
        decks[t] = decks.get(t, 0) + 1
    at, out = {}, {}
    for u, idx, phase, topic in stored:
        n = decks.get(topic or "all", 0)
        idx = max(idx, 0) if n == 0 else 0 if idx >= n else n - 1 if idx < 0 else idx
        at[u] = (3 * idx + phase, topic or "all")
    for u, ts, i, op, topic in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1], e[2])):
        p, own = at.get(u, (0, "all"))
        if op == "topic":
            at[u] = (0, topic or "all")
        else:
            at[u] = (plain([1 if op == "next" else -1], p, 3 * decks.get(own, 0))[0], own)
        out[i] = (u, at[u][1], at[u][0] // 3, at[u][0] % 3)
    return out


def test_a_history_over_many_tasks(spark):
    """One user holds nearly all events and changes topic rarely, so whole tasks
    lie inside one stretch; others come before and after; a null user too."""
    rng = random.Random(3)
    cards = ["t"] * 4 + ["u"] * 9
    events, n = [], 0
    for u, many in ((None, 40), (1, 60), (2, 6000), (3, 1), (4, 500)):
        for _ in range(many):
            op = rng.choices(["next", "prev", "topic"], [6, 4, 0.002 if u == 2 else 0.3])[0]
            events.append((u, 1000 + n // 3, n, op, rng.choice(["t", "u", "all", "", "none"]) if op == "topic" else None))
            n += 1
    stored = [(1, 3, 2, "t"), (2, 50, 1, ""), (4, -2, 1, "u"), (9, 1, 1, "t")]
    df = spark.createDataFrame(events, "user_id long, s long, event_id long, op string, topic string").selectExpr("user_id", "timestamp_seconds(s) as ts", "event_id", "op", "topic")
    deck = spark.createDataFrame([(i, t) for i, t in enumerate(cards)], "card_id long, topic string")
    kept = spark.createDataFrame(stored, "user_id long, idx int, phase int, topic string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.event_id: (r.user_id, r.topic, r.idx, r.phase) for r in V.replay_views(df, deck, kept).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == replay(events, cards, stored)
