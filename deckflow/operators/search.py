"""Full-text search over a postings table (token, card_id, field, pos).

The reference uses an FTS5 index and a query string; here the index is a
stored table built from the current cards (``index.py``), and a query is a
structured clause (all / any / not / phrase / prefix / field / near / initial).
Every clause first restricts the postings to the query tokens (a filter that
the stored index prunes by row-group statistics), so the work is proportional
to the postings of those tokens, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import tokens
from deckflow.operators.ranking import top_n
from deckflow.session import cut

# The indexed columns, in index order (concept is not indexed).
FIELDS = ["id", "title", "topic", "idea", "example", "probe"]
DEFAULT_LIMIT = 20


def postings(corpus: DataFrame) -> DataFrame:
    """One row per token occurrence, positions 0-based within a field."""
    vals = F.array(*[F.struct(F.lit(f).alias("field"),
                              (F.col("card_id") if f == "id" else F.col(f)).cast("string").alias("val"))
                     for f in FIELDS])
    return (corpus.select("card_id", F.inline(vals))
            .select("card_id", "field", F.posexplode(tokens("val")).alias("pos", "token")))


def all_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """Cards holding every term (in any field). One shuffle: a card
    gathers the set of query tokens it holds."""
    toks = sorted(set(terms))
    if not toks:
        return post.select("card_id").limit(0)
    return (post.filter(F.col("token").isin(toks)).groupBy("card_id").agg(F.collect_set("token").alias("_t"))
            .filter(F.size("_t") == len(toks)).select("card_id"))


def any_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """Cards holding at least one term."""
    return post.filter(F.col("token").isin(sorted(set(terms)))).select("card_id").distinct()


def not_terms(post: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """``a NOT b`` in one pass over the postings of the query tokens."""
    inc, exc = sorted(set(include)), sorted(set(exclude))
    hits = (post.filter(F.col("token").isin(inc + exc)).groupBy("card_id")
            .agg(F.size(F.collect_set(F.when(F.col("token").isin(inc), F.col("token")))).alias("_i"),
                 F.max(F.col("token").isin(exc).cast("int")).alias("_x")))
    return hits.filter((F.col("_i") == len(inc)) & (F.col("_x") == 0)).select("card_id")


def phrase(post: DataFrame, words: list[str]) -> DataFrame:
    """Consecutive tokens in one field. Each occurrence of word i votes
    for the phrase start pos - i; a start with all offsets voted is a match
    (a repeated word such as "the the" votes once per offset it can fill).
    One pass over the postings of the phrase's tokens."""
    offsets: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        offsets.setdefault(w, []).append(i)
    table = F.create_map(*[x for w, offs in offsets.items()
                           for x in (F.lit(w), F.array(*[F.lit(o) for o in offs]))])
    votes = (post.filter(F.col("token").isin(list(offsets)))
             .select("card_id", "field", "pos", F.explode(table[F.col("token")]).alias("off"))
             .select("card_id", "field", (F.col("pos") - F.col("off")).alias("start"), "off"))
    # dealt by card once: the votes of a start and the distinct need no further shuffle
    return (votes.repartition("card_id").groupBy("card_id", "field", "start").agg(F.count(F.lit(1)).alias("_k"))
            .filter(F.col("_k") == len(words)).select("card_id").distinct())


def prefix(post: DataFrame, p: str) -> DataFrame:
    """``p*``."""
    return post.filter(F.col("token").startswith(p)).select("card_id").distinct()


def in_fields(post: DataFrame, fields: list[str], term: str) -> DataFrame:
    """``{f1 f2}: term``."""
    return (post.filter(F.col("field").isin(fields) & (F.col("token") == term))
            .select("card_id").distinct())


FAR = -(1 << 30)  # the place of a word not seen yet


def least_span(hits, n) -> Column:
    """The least stretch (last place - first place) that holds each of ``n``
    words, by one sweep over ``hits``, an array of structs (pos, off) in order
    of pos: ``off`` numbers the words. Very large where a word is missing."""
    start = F.struct(F.array_repeat(F.lit(FAR), n).alias("last"), F.lit(-FAR).alias("best"))

    def step(acc, h):
        last = F.transform(acc["last"], lambda x, i: F.when(i == h["off"], h["pos"]).otherwise(x))
        return F.struct(last.alias("last"), F.least(acc["best"], h["pos"] - F.array_min(last)).alias("best"))

    return F.aggregate(hits, start, step, lambda acc: acc["best"])


def has_phrase(hits, n) -> Column:
    """Do ``n`` consecutive words start anywhere? Every hit (pos, off) votes for
    the start pos - off; a start with n votes has them all (a word at two
    offsets votes for two starts)."""
    starts = F.array_sort(F.transform(hits, lambda h: h["pos"] - h["off"]))
    begin = F.struct(F.lit(FAR).alias("at"), F.lit(0).alias("votes"), F.lit(0).alias("most"))

    def step(acc, x):
        votes = F.when(acc["at"] == x, acc["votes"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("at"), votes.alias("votes"), F.greatest(acc["most"], votes).alias("most"))

    return F.aggregate(starts, begin, step, lambda acc: acc["most"]) >= n


def near(post: DataFrame, words: list[str], n: int = 10) -> DataFrame:
    """``NEAR(a b .., n)``: at most n tokens between the first and the last
    of a stretch of one field that holds every word (a word named twice counts
    once). Each (card, field) sweeps its sorted positions of the words once."""
    toks = sorted(set(words))
    table = F.create_map(*[F.lit(x) for i, w in enumerate(toks) for x in (w, i)])
    hits = (post.filter(F.col("token").isin(toks)).select("card_id", "field", "pos", table[F.col("token")].alias("off"))
            .repartition("card_id").groupBy("card_id", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "off"))).alias("hits")))
    return hits.filter(least_span(F.col("hits"), F.lit(len(toks))) <= n + 1).select("card_id").distinct()


def initial(post: DataFrame, term: str) -> DataFrame:
    """``^term``: the first token of some field."""
    return post.filter((F.col("pos") == 0) & (F.col("token") == term)).select("card_id").distinct()


def batch_all_terms(post: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, pairs: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """AND-search for a table of queries (qid, text) at once; empty
    query -> no rows; per query the first ``limit`` cards by card_id.

    Each query starts from its rarest token, so a query made of frequent words
    costs the postings of one word; the other tokens are then checked by an
    equi-join on (card_id, token) against the distinct (card, token) pairs.
    An index has those pairs and the cards of every token (``pairs``, ``terms``);
    without them both are counted from ``post``."""
    qt = queries.select("qid", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    nq = qt.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    # only the batch's own tokens matter
    qtok = qt.select("token").distinct()
    if pairs is None:  # read three times, so it is materialised once (after the semi join it is small)
        dt = cut(post.join(qtok, "token", "left_semi").select("card_id", "token").distinct())
    else:
        dt = pairs.join(qtok, "token", "left_semi").select("card_id", "token")
    freq = dt.groupBy("token").agg(F.count(F.lit(1)).alias("df")) if terms is None else terms.join(qtok, "token", "left_semi")
    rare = (qt.join(freq, "token", "left").fillna(0, ["df"])
            .groupBy("qid").agg(F.min(F.struct("df", "token")).alias("_r"))
            .select("qid", F.col("_r.token").alias("token")))
    cand = rare.join(dt, "token").select("qid", "card_id")
    checked = (cand.join(qt, "qid").join(dt, ["card_id", "token"], "left_semi")
               .groupBy("qid", "card_id").agg(F.count(F.lit(1)).alias("_k")))
    hits = checked.join(nq, "qid").filter(F.col("_k") == F.col("n")).select("qid", "card_id")
    return top_n(hits, ["qid"], ["card_id"], limit, "rank").withColumn("rank", F.col("rank").cast("int"))


LONGEST_PREFIX = 32  # letters of a prefix that the join with the terms goes by


def batch_clauses(post: DataFrame, terms: DataFrame, clauses: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """B17 for all kinds of clauses: ``(qid, card_id, rank)``, the first
    ``limit`` cards by card_id that fulfil all clauses of a query.

    ``clauses``: qid, clause (number in the query), kind, words (array), fields
    (array or null: any field), distance. Kinds:

    * ``all``: every word, in any of the fields (``field`` is the same);
    * ``any``: at least one word; ``not``: none of the words;
    * ``phrase``: the words one after another in one field; ``initial``: a
      phrase at the start of a field;
    * ``prefix``: a word that begins with the (first) word;
    * ``near``: every word in one field with at most ``distance`` tokens between
      the first and the last of them.

    A query without any clause but ``not`` has no rows, nor has one without
    words. A query starts from the postings of its cheapest clause: of the rarest
    word, or of all words where any of them will do. Its other words are then
    looked up for those cards only, by (token, card_id); prefixes are first
    expanded to terms. All of a (query, card) meets in one place by one shuffle
    and is decided there, from position lists per clause and field.
    """
    c = (clauses.select("qid", "clause", F.when(F.col("kind") == "field", "all").otherwise(F.col("kind")).alias("kind"),
                        F.filter("words", lambda w: w != "").alias("words"), "fields", "distance")
         .filter(F.size("words") > 0)
         .withColumn("words", F.when(F.col("kind") == "prefix", F.slice("words", 1, 1))
                     .when(F.col("kind").isin("phrase", "initial"), F.col("words")).otherwise(F.array_distinct("words")))
         .withColumn("n", F.size("words")))
    wanted = c.groupBy("qid").agg(F.sum((F.col("kind") != "not").cast("int")).alias("wanted"))
    words = c.select("qid", "clause", "kind", "fields", "distance", "n", F.posexplode("words").alias("off", "word"))
    cut_to = lambda x: F.substring(x, 1, LONGEST_PREFIX)
    heads = (terms.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(LONGEST_PREFIX)))))
             .select(F.expr("substring(token, 1, size)").alias("head"), "token", "df"))
    prefixes = words.filter("kind = 'prefix'").withColumn("head", cut_to("word"))
    expanded = prefixes.join(heads, "head").filter(F.col("token").startswith(F.col("word"))).drop("head")
    exact = words.filter("kind <> 'prefix'").join(terms, F.col("word") == F.col("token"))
    asked = cut(expanded.unionByName(exact).drop("word"))

    loose = F.col("kind").isin("any", "prefix")
    cost = asked.filter("kind <> 'not'").groupBy("qid", "clause", "kind", "n").agg(
        F.sum("df").alias("every"), F.min(F.struct("df", "token")).alias("rarest"), F.size(F.collect_set("off")).alias("known"))
    cost = cost.withColumn("cost", F.when(loose, F.col("every")).when(F.col("known") < F.col("n"), F.lit(0)).otherwise(F.col("rarest.df")))
    # a clause none of whose words is known has no row here, and its query fails at the count of clauses
    first = cost.groupBy("qid").agg(F.min_by(F.struct("clause", "cost", "rarest"), F.struct("cost", "clause")).alias("f")).filter("f.cost > 0")
    begin = (asked.join(first, "qid").filter((F.col("clause") == F.col("f.clause")) & (loose | (F.col("token") == F.col("f.rarest.token"))))
             .select("qid", "token").distinct())
    used = cut(post.join(asked.select("token").distinct(), "token", "left_semi"))
    cand = cut(begin.join(used.select("token", "card_id").distinct(), "token").select("qid", "card_id").distinct())
    by_card = asked.filter("kind <> 'prefix'").join(cand, "qid").join(used, ["token", "card_id"])
    by_term = asked.filter("kind = 'prefix'").join(used, "token").join(cand, ["qid", "card_id"], "left_semi")
    hits = by_card.unionByName(by_term).filter(F.col("fields").isNull() | F.array_contains(F.col("fields"), F.col("field")))

    ordered = F.col("kind").isin("phrase", "near")
    place = F.struct("pos", "off")
    fields = (hits.repartition("qid", "card_id").groupBy("qid", "card_id", "clause", "kind", "n", "distance", "field")
              .agg(F.collect_set("off").alias("offs"), F.array_sort(F.collect_list(F.when(ordered, place))).alias("hits"),
                   F.size(F.collect_set(F.when(F.col("pos") == F.col("off"), F.col("off")))).alias("at_start")))
    here = (F.when(F.col("kind") == "phrase", has_phrase(F.col("hits"), F.col("n")))
            .when(F.col("kind") == "near", least_span(F.col("hits"), F.col("n")) <= F.coalesce("distance", F.lit(10)) + 1)
            .when(F.col("kind") == "initial", F.col("at_start") == F.col("n")).otherwise(F.lit(True)))
    held = (fields.withColumn("here", here).groupBy("qid", "card_id", "clause", "kind", "n")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("offs"), F.max("here").alias("here")))
    true = F.when(F.col("kind") == "all", F.col("offs") == F.col("n")).otherwise(F.col("here"))
    met = held.groupBy("qid", "card_id").agg(F.sum((true & (F.col("kind") != "not")).cast("int")).alias("met"),
                                             F.max(true & (F.col("kind") == "not")).alias("barred"))
    good = met.filter(~F.col("barred")).join(wanted, "qid").filter((F.col("met") == F.col("wanted")) & (F.col("wanted") > 0))
    return top_n(good.select("qid", "card_id"), ["qid"], ["card_id"], limit, "rank").withColumn("rank", F.col("rank").cast("int"))


CARD_COLUMNS = ("title", "topic", "idea", "example", "probe")


def first_cards(hits: DataFrame, corpus: DataFrame, limit: int = DEFAULT_LIMIT, cols=CARD_COLUMNS) -> DataFrame:
    """The first ``limit`` hits with the result columns. The ids (at most
    ``limit``) are known before the corpus is read, so the scan gets them as a
    pushed filter and reads the texts of their row groups only."""
    ids = [r.card_id for r in hits.orderBy("card_id").limit(limit).collect()]
    return corpus.filter(F.col("card_id").isin(ids)).select("card_id", *cols)
