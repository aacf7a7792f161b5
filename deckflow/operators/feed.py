"""The blended feed (continue, fresh, bridge, resurface, backfill, fill) for
every user in one job.

The reference answers one implicit user with five ``ORDER BY .. LIMIT`` queries
that each skip the ids already picked. Here every step is a per-user top-n over
a *bounded* candidate set, never users x cards:

* a user can only need the first ``engaged + picked + quota`` cards of a fixed
  order (anything further down is preceded by enough non-excluded cards), so
  candidates are generated as (user, rank) rows and equi-joined to a ranked
  card table (``ranking.expand_ranks``);
* exclusions are anti joins on (user_id, card_id);
* the engaged pairs, the users, the ranks within concepts and the picks are
  written tables, which keeps the plan flat and makes a lost executor restart
  from the last of them instead of from the scans;
* users without engaged cards share one feed, which is computed once.

Ties the reference leaves undefined are broken by ``card_id``; ORDER BY RANDOM()
is replaced by the seeded md5 order, so Spark and SQL agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.functions.text import day_cutoff, seeded_order
from deckflow.operators import engagement as eng
from deckflow.operators.ranking import expand_ranks, global_rank, rank_within, top_n
from deckflow.session import cut

# Feed sources in serving order with their share of the limit.
SOURCES = ["continue", "fresh", "bridge", "resurface", "backfill"]
WEIGHTS = [0.40, 0.25, 0.15, 0.10, 0.10]
FILL = "fill"


def slot_quota(limit: int) -> dict[str, int]:
    """F05 for one limit: each source gets max(1, int(limit * w)); ``continue``
    absorbs the difference to ``limit`` either way. A negative continue slot
    (limits 1-3) means "no limit" in the reference's SQL, which yields the same
    final list as a slot of ``limit``, since continue is served first."""
    if limit < 0:
        raise ValueError("feed limit must be >= 0")
    slots = {s: max(1, int(limit * w)) for s, w in zip(SOURCES, WEIGHTS)}
    slots["continue"] += limit - sum(slots.values())
    if slots["continue"] < 0:
        slots["continue"] = limit
    return slots


def slot_quota_col(limit: Column) -> Column:
    """F05 as a column expression over a table of limits: struct of six slots."""
    parts = {s: F.greatest(F.lit(1), F.floor(limit * F.lit(w)).cast("int")) for s, w in zip(SOURCES, WEIGHTS)}
    total = sum(parts.values())
    cont = parts["continue"] + (limit - total)
    parts["continue"] = F.when(cont < 0, limit).otherwise(cont)
    return F.struct(*[parts[s].alias(s) for s in SOURCES])


@dataclass
class FeedInputs:
    cards: DataFrame          # card_id, concept, depth, created_at, connections, ...
    events: DataFrame         # user_id, card_id, event, created_at (raw engagement)
    limit: int = 20
    as_of: str = "2024-01-31"
    seed: str = "42"
    users: DataFrame | None = None  # user_id of users that may have no events (cold start)


class BlendedFeed:
    """Builds the feed step by step; each public method is one inventory key."""

    # requests with a bound above this are exploded in chunks spread over tasks
    CHUNK = 4096

    def __init__(self, inp: FeedInputs):
        self.inp = inp
        self.slots = slot_quota(inp.limit)
        cards = inp.cards.select("card_id", "concept", "depth", "created_at", "connections")
        self.cards = cards
        accepted = eng.accepted_events(inp.events, cards)
        # Distinct engaged (user, card) pairs with the card attributes the steps
        # need; everything below reads this, so it is materialised once.
        self.pairs = cut(eng.engaged_pairs(accepted)
                         .join(cards.select("card_id", "concept", "depth", "connections"), "card_id"))
        # Every user gets a feed; one without accepted events has m = 0.
        engaged = self.pairs.select("user_id", F.lit(1).alias("one"))
        known = inp.events.select("user_id")
        if inp.users is not None:
            known = known.union(inp.users.select("user_id"))
        known = known.filter("user_id is not null").select("user_id", F.lit(0).alias("one"))
        self.users = cut(engaged.union(known).groupBy("user_id").agg(F.sum("one").alias("m")))
        # Users without engaged cards all get the same feed: one of them stands
        # for the class, and the others take its rows at the end (``_everyone``).
        self._one_cold = lambda: self.users.filter("m = 0").agg(F.min("user_id")).scalar()
        self.active = self.users.filter((F.col("m") > 0) | F.col("user_id").eqNullSafe(self._one_cold()))
        self._ranks: dict[str, DataFrame] = {}
        self._steps: dict[str, DataFrame] = {}

    # ---- ranked card tables (computed once, shared by all users) -------------
    def rank(self, name: str) -> DataFrame:
        if name not in self._ranks:
            c = self.cards
            if name == "concept":      # within concept by (depth, card_id); read by three steps
                r = cut(rank_within(c.select("card_id", "concept", "depth"), ["concept"], ["depth", "card_id"],
                                    "crank"))
            elif name == "fresh":      # newest first, nulls last
                r = global_rank(c.select("card_id", "created_at"),
                                [F.col("created_at").desc_nulls_last(), F.col("card_id")], "frank")
            elif name == "random":     # seeded stand-in for ORDER BY RANDOM(); fill reads the first ``limit``
                order = [F.col("h"), F.col("card_id")]
                top = c.select("card_id", seeded_order(self.inp.seed, "card_id").alias("h")).orderBy(*order).limit(
                    self.inp.limit)
                r = top.withColumn("mrank", F.row_number().over(Window.orderBy(*order)).cast("long"))
            elif name == "backfill":   # depth-1 cards within concept by card_id
                r = rank_within(c.filter(F.col("depth") == 1).select("card_id", "concept"),
                                ["concept"], ["card_id"], "brank")
            else:
                raise KeyError(name)
            self._ranks[name] = r
        return self._ranks[name]

    # ---- helpers ------------------------------------------------------------
    def _not_engaged(self, cand: DataFrame) -> DataFrame:
        """Candidates the user never engaged with. Written as a left outer join
        on the distinct engaged pairs plus an IS NULL filter (an anti join): a
        LeftAnti join over a Union would be pushed into every branch of the
        Union by the optimizer, shuffling the engaged pairs once per branch."""
        seen = self.pairs.select("user_id", "card_id", F.lit(True).alias("_seen"))
        return cand.join(seen, ["user_id", "card_id"], "left").filter(F.col("_seen").isNull()).drop("_seen")

    def _upto(self, ranked: DataFrame, rank_col: str, req: DataFrame) -> DataFrame:
        """Rank-table rows a request can reach: rank <= max(bound). The max is
        a scalar subquery (partial + final aggregate), so a global card order of
        any size shrinks to the few leading ranks, which AQE can broadcast."""
        return ranked.filter(F.col(rank_col) <= req.select(F.max("bound")).scalar())

    def _before(self, source: str) -> int:
        """Most cards the sources served before ``source`` can have picked."""
        i = SOURCES.index(source)
        return sum(self.slots[s] for s in SOURCES[:i])

    @staticmethod
    def _emit(df: DataFrame, source: str, order_col: str) -> DataFrame:
        return df.select("user_id", "card_id", F.lit(source).alias("source"),
                         F.col(order_col).cast("long").alias("ord"))

    @staticmethod
    def _ends(req: DataFrame, ranked: DataFrame, rank_col: str, key: Column, n: int) -> DataFrame:
        """``req(user_id, concept, bound)`` with ``end``, a key beyond which none of
        a user's first ``n`` of all its concepts lies. ``bound - n`` cards of a
        concept may be excluded, so its first ``bound - n + m`` leave ``m``; with
        ``m = n / concepts`` of each there are ``n``, the largest at ``end``. It is
        null (no such key) where a concept has fewer cards."""
        w = Window.partitionBy("user_id")
        at = F.col("bound") - n + F.ceil(F.lit(n) / F.count(F.lit(1)).over(w))
        last = ranked.select(F.col("concept").alias("_c"), F.col(rank_col).alias("_at"), key.alias("_key"))
        found = req.withColumn("_r", at).join(last, (F.col("concept") == F.col("_c")) & (F.col("_r") == F.col("_at")), "left")
        whole = F.count("_key").over(w) == F.count(F.lit(1)).over(w)
        return found.withColumn("end", F.when(whole, F.max("_key").over(w))).select("user_id", "concept", "bound", "end")

    # ---- candidates of K01 .. K06 ----------------------------------------------
    # Each source needs at most quota + (picks of the earlier sources) of its
    # own candidates, because only those picks can still exclude one. The
    # candidate sets are therefore independent of each other and are built in
    # one job; the sequential "skip what is picked" rule is applied afterwards
    # by one per-user fold over at most ~6 x limit rows (``picks``).
    def _raw_continue(self, q: int) -> DataFrame:
        """Cards of the user's last concept, ranks 1..(engaged there + q)."""
        lastc = eng.last_concept(self.pairs).select("user_id", "concept")
        n_in = self.pairs.join(lastc, ["user_id", "concept"], "left_semi").groupBy("user_id", "concept").count()
        req = lastc.join(n_in, ["user_id", "concept"], "left").select(
            "user_id", "concept", (F.coalesce("count", F.lit(0)) + q).alias("bound"))
        cand = expand_ranks(req, ["user_id", "concept"], "bound", "crank", chunk=self.CHUNK).join(
            self._upto(self.rank("concept"), "crank", req).select("concept", "crank", "card_id"), ["concept", "crank"])
        return cand.select("user_id", "card_id", F.struct(F.col("crank").alias("k"), F.col("card_id").alias("id"))
                           .alias("key"))

    def _raw_fresh(self, n: int) -> DataFrame:
        """Newest cards, ranks 1..(engaged + n)."""
        req = self.active.select("user_id", (F.col("m") + n).alias("bound"))
        cand = expand_ranks(req, ["user_id"], "bound", "frank", chunk=self.CHUNK).join(
            self._upto(self.rank("fresh"), "frank", req), "frank")
        return cand.select("user_id", "card_id", F.struct(F.col("frank").alias("k"), F.col("card_id").alias("id"))
                           .alias("key"))

    def _raw_backfill(self, n: int) -> DataFrame:
        """Depth-1 cards of concepts engaged at depth > 1, ranks 1..(engaged depth-1 + n)."""
        deep = self.pairs.filter(F.col("depth") > 1).select("user_id", "concept").distinct()
        seen1 = self.pairs.filter(F.col("depth") == 1).groupBy("user_id", "concept").count()
        req = deep.join(seen1, ["user_id", "concept"], "left").select(
            "user_id", "concept", (F.coalesce("count", F.lit(0)) + n).alias("bound"))
        ranked = self._upto(self.rank("backfill"), "brank", req)
        req = self._ends(req, ranked, "brank", F.col("card_id"), n)
        cand = expand_ranks(req, ["user_id", "concept", "end"], "bound", "brank", chunk=self.CHUNK).join(
            ranked, ["concept", "brank"]).filter(F.col("end").isNull() | (F.col("card_id") <= F.col("end")))
        return cand.select("user_id", "card_id", F.struct(F.lit(0).cast("long").alias("k"),
                                                          F.col("card_id").alias("id")).alias("key"))

    def _unseen_sources(self, limits: dict[str, int]) -> DataFrame:
        """Continue, fresh and backfill skip the cards the user engaged with:
        their raw candidates are united and anti-joined with the engaged pairs
        once (one shuffle of the largest table instead of three), then cut to
        each source's own limit with one window per (user, source)."""
        raw = {"continue": lambda n: self._raw_continue(n), "fresh": self._raw_fresh, "backfill": self._raw_backfill}
        u = None
        for name, n in limits.items():
            part = raw[name](n).withColumn("source", F.lit(name))
            u = part if u is None else u.unionByName(part)
        u = self._not_engaged(u)
        lim = F.create_map(*[x for name, n in limits.items() for x in (F.lit(name), F.lit(n))])
        top = top_n(u, ["user_id", "source"], ["key"], max(limits.values()))   # partial WindowGroupLimit
        return top.filter(F.col("rn") <= lim[F.col("source")]).select(
            "user_id", "card_id", "source", F.col("rn").cast("long").alias("ord"))

    def continue_(self, q: int | None = None) -> DataFrame:
        """K01 candidates: unseen cards of the user's last concept, by depth
        (first ``q``, default the continue slot; nothing is picked before)."""
        return self._unseen_sources({"continue": self.slots["continue"] if q is None else q})

    def bridge(self) -> DataFrame:
        """K03 candidates: cards of concepts adjacent to engaged cards, by depth.
        (Engaged cards may come back: the reference does not exclude them.)"""
        n = self.slots["bridge"] + self._before("bridge")
        adj = self.pairs.select("user_id", F.explode("connections").alias("concept")).distinct()
        req = adj.select("user_id", "concept", F.lit(n).cast("long").alias("bound"))
        ranked, key = self._upto(self.rank("concept"), "crank", req), F.struct("depth", "card_id")
        req = self._ends(req, ranked, "crank", key, n)
        cand = expand_ranks(req, ["user_id", "concept", "end"], "bound", "crank", max_bound=n).join(
            ranked, ["concept", "crank"]).filter(F.col("end").isNull() | (key <= F.col("end")))
        return self._emit(top_n(cand, ["user_id"], ["depth", "card_id"], n), "bridge", "rn")

    def resurface(self) -> DataFrame:
        """K04 candidates: cards with any event before as_of - 3 days, seeded random."""
        n = self.slots["resurface"] + self._before("resurface")
        ts_type = dict(self.pairs.dtypes)["first_ts"]
        cutoff = day_cutoff(F.lit(self.inp.as_of)).cast(ts_type)
        cand = self.pairs.filter(F.col("first_ts") < cutoff).select(
            "user_id", "card_id", seeded_order(self.inp.seed, "card_id").alias("h"))
        return self._emit(top_n(cand, ["user_id"], ["h", "card_id"], n), "resurface", "rn")

    def fill(self) -> DataFrame:
        """K06 candidates: the first ``limit`` cards of the seeded random order
        (a user takes at most limit - picks of them, skipping picks), the same
        for every user. (Engaged cards may come back, as in the reference.)"""
        limit = self.inp.limit
        top = self.rank("random").filter(F.col("mrank") <= limit).select("card_id", "mrank")
        req = self.active.select("user_id", F.lit(limit).cast("long").alias("bound"))
        cand = expand_ranks(req, ["user_id"], "bound", "mrank", max_bound=limit).join(top, "mrank")
        return self._emit(cand, FILL, "mrank")

    # ---- K07 ------------------------------------------------------------------
    def picks(self, upto: str = FILL) -> DataFrame:
        """All picks in serving order (before the cut to ``limit``) of the sources
        up to ``upto``, for the users with engaged cards and one without: the
        reference's sequential rule as one fold per user over its candidates,
        sorted by (source, order): a candidate is taken when it is not picked
        yet and its source still has quota (fill: while fewer than ``limit``).
        Later sources never change the picks of earlier ones, so they are left out."""
        if upto in self._steps:
            return self._steps[upto]
        order = [*SOURCES, FILL]
        served = order[:order.index(upto) + 1]
        unseen = {name: self.slots[name] + self._before(name) for name in ("continue", "fresh", "backfill") if name in served}
        parts = [self._unseen_sources(unseen)] if unseen else []
        parts += [getattr(self, name)() for name in ("bridge", "resurface", FILL) if name in served]
        cands = parts[0]
        for c in parts[1:]:
            cands = cands.unionByName(c)
        src = (F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source")) - 1).cast("int")
        ct = dict(self.cards.dtypes)["card_id"]
        items = (cands.select("user_id", F.struct(src.alias("src"), F.col("ord").alias("o"),
                                                  F.col("card_id").cast(ct).alias("card_id")).alias("x"))
                 .groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("items")))
        quotas = F.array(*[F.lit(self.slots[x]) for x in SOURCES])
        limit = self.inp.limit
        init = F.struct(F.array().cast(f"array<{ct}>").alias("picked"),
                        F.array().cast(f"array<struct<card_id:{ct},src:int,ord:int>>").alias("out"),
                        F.array(*[F.lit(0) for _ in order]).alias("cnt"))

        def take(acc, x):
            used = F.element_at(acc["cnt"], x["src"] + 1)
            room = F.when(x["src"] < len(SOURCES), used < F.element_at(quotas, x["src"] + 1)).otherwise(
                F.size(acc["picked"]) < limit)
            ok = ~F.array_contains(acc["picked"], x["card_id"]) & room
            return F.when(ok, F.struct(
                F.concat(acc["picked"], F.array(x["card_id"])).alias("picked"),
                F.concat(acc["out"], F.array(F.struct(x["card_id"].alias("card_id"), x["src"].alias("src"),
                                                      (used + 1).alias("ord")))).alias("out"),
                F.transform(acc["cnt"], lambda v, i: F.when(i == x["src"], v + 1).otherwise(v)).alias("cnt"),
            )).otherwise(acc)

        folded = items.select("user_id", F.posexplode(F.aggregate("items", init, take, lambda a: a["out"]))
                              .alias("idx", "p"))
        self._steps["uncut"] = folded  # for the plan digest
        picks = cut(folded.select(
            "user_id", F.col("p.card_id").alias("card_id"),
            F.element_at(F.array(*[F.lit(x) for x in order]), F.col("p.src") + 1).alias("source"),
            F.col("p.ord").cast("long").alias("ord"), (F.col("idx") + 1).cast("int").alias("position")))
        self._steps[upto] = picks
        return picks

    def _everyone(self, rows: DataFrame) -> DataFrame:
        """``rows`` for all users: the rows of the one cold user, at most a few
        times ``limit``, are repeated for each user without engaged cards. That
        is a projection of the user table; nothing of it is shuffled."""
        cols = [c for c in rows.columns if c != "user_id"]
        shared = rows.filter(F.col("user_id") == self._one_cold()).agg(F.array_sort(F.collect_list(F.struct(*cols)))).scalar()
        cold = self.users.filter("m = 0").select("user_id", F.inline(shared))
        return rows.filter(~F.col("user_id").eqNullSafe(self._one_cold())).unionByName(cold)

    def served(self) -> DataFrame:
        """All picks of all users, before the cut to ``limit``."""
        return self._everyone(self.picks().drop("position"))

    def step(self, source: str) -> DataFrame:
        """One source's picks (given the sources served before it)."""
        return self._everyone(self.picks(source).filter(F.col("source") == source).drop("position"))

    def feed(self, card_cols=("concept", "title", "topic", "depth")) -> DataFrame:
        """K07 = G01 + F06: ordered concatenation cut to ``limit``, card columns joined last."""
        ordered = self.picks().filter(F.col("position") <= self.inp.limit)
        return self._everyone(ordered.join(self.inp.cards.select("card_id", *card_cols), "card_id")
                              .select("user_id", "position", "source", "card_id", *card_cols))


def blended_feed(cards: DataFrame, events: DataFrame, limit: int = 20,
                 as_of: str = "2024-01-31", seed: str = "42", users: DataFrame | None = None) -> DataFrame:
    return BlendedFeed(FeedInputs(cards, events, limit, as_of, seed, users)).feed()
