"""Canonical views over the driver's parquet tables.

``cards`` comes from ``part`` and ``engagement`` from ``events``; every
operator is written against these schemas, so a real
deployment swaps these readers for its own card / event tables. Only the
columns a query uses are read: Catalyst prunes the projection into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.functions.text import tokens
from deckflow.session import parallelism

# Fixed parameters of the checked workload (same in the SQL oracle).
AS_OF = "2024-01-31"
SEED = "42"
LIMIT = 20


# The driver's files hold one parquet row group each, so a scan of one is a
# single task. Tables with CPU-heavy per-row work (tokenising, regexes, JSON)
# are spread over the session's parallelism right after the scan (a
# deterministic round-robin repartition). A production table of many files /
# row groups is read in parallel anyway and needs no such step.
SPREAD = {"documents", "lineitem", "conversations", "pages", "orders"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPREAD if spread is None else spread:
        n = parallelism(spark)
        try:
            few = df.rdd.getNumPartitions() < n
        except Exception:  # noqa: BLE001  (no RDD view, e.g. a Connect session)
            few = True
        if few:
            df = df.repartition(n)
    return df


def cards(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread`` for callers with heavy per-row work (document render / parse)."""
    p = table(spark, sf_dir, "part", spread)
    b = F.substring("p_brand", 7, 1 << 20).cast("int")
    brand = lambda n: F.concat(F.lit("Brand#"), n.cast("string"))
    return p.select(
        F.col("p_partkey").alias("card_id"),
        F.col("p_brand").alias("concept"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("topic"),
        (F.lit(1) + F.col("p_size") % 3).alias("depth"),
        F.col("p_name").alias("idea"),
        F.col("p_type").alias("example"),
        F.col("p_brand").alias("probe"),
        F.array(brand(b % 25 + 1), brand((b + 6) % 25 + 1)).alias("connections"),
        F.lit("part").alias("source_type"),
        F.col("p_partkey").cast("string").alias("source_id"),
        F.concat(F.lit("cards/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("file_path"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") * 7 % 30).cast("int")).alias("created_at"),
    )


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("card_id"),
        F.col("event_type").alias("event"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered users: the customers, most of whom have no events."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("card_id"), F.col("source").alias("title"),
                    F.col("lang").alias("topic"), F.col("text").alias("idea"),
                    F.lit("").alias("example"), F.lit("").alias("probe"))


def clause_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of typed clauses for every benchmark passage of five words or
    more: its words number 1 to 5, the kinds of clauses by item_id mod 7."""
    b = table(spark, sf_dir, "benchmark")
    word = lambda n: F.element_at("w", n)

    def clause(kind: str, words: list, fields: list[str] | None = None, distance: int | None = None):
        return F.struct(F.lit(kind).alias("kind"), F.array(*words).alias("words"),
                        (F.array(*[F.lit(f) for f in fields]) if fields else F.lit(None).cast("array<string>")).alias("fields"),
                        F.lit(distance).cast("int").alias("distance"))

    kinds = [[clause("all", [word(1), word(2), word(3)])],
             [clause("any", [word(1), word(5)]), clause("not", [word(2)])],
             [clause("phrase", [word(2), word(3)])],
             [clause("prefix", [F.substring(word(4), 1, 4)]), clause("all", [word(1)])],
             [clause("field", [F.lit("en")], ["topic"]), clause("phrase", [word(1), word(2)])],
             [clause("near", [word(1), word(3), word(4)], distance=6)],
             [clause("initial", [word(1)]), clause("any", [word(2), word(3)])]]
    chosen = F.coalesce(*[F.when(F.col("item_id") % len(kinds) == i, F.array(*k)) for i, k in enumerate(kinds)])
    return (b.select("item_id", tokens("text").alias("w")).filter(F.size("w") >= 5)
            .select(F.col("item_id").alias("qid"), F.posexplode(chosen).alias("clause", "c")).select("qid", "clause", "c.*"))


def bookmark_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export document per conversation: every other turn is a tweet, the
    turn after it its quoted tweet, its role the hashtag; the document shape
    (array / {data} / {tweets}) rotates with conv_id."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def tweet(i):
        t = lambda k: F.get("t", k)
        return F.struct(
            F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")).alias("id"),
            t(i * 2)["text"].alias("full_text"),
            F.struct(t(i * 2 + 1)["text"].alias("full_text")).alias("quoted_status"),
            F.struct(F.array(F.struct(t(i * 2)["role"].alias("tag"))).alias("hashtags")).alias("entities"))

    tweets = F.to_json(F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int")), tweet))
    shape = F.col("conv_id") % 3
    doc = (F.when(shape == 0, tweets)
           .when(shape == 1, F.concat(F.lit('{"data":'), tweets, F.lit("}")))
           .otherwise(F.concat(F.lit('{"tweets":'), tweets, F.lit("}"))))
    return turns.select(F.col("conv_id").alias("export_id"), doc.alias("doc"))


def _slug(of: int = 1):
    """Concept of an order; with ``of`` > 1 one for that many neighbouring orders of a priority."""
    return F.concat(F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("-"))), F.lit("-"),
                    (F.col("o_orderkey") - F.col("o_orderkey") % of).cast("string"))


def research_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that ``research_refs`` names: ``text_id, text``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESEARCH records from orders / lineitem / documents, in the order of the
    orders (``_seq``); several name the same concept."""
    return (research_refs(spark, sf_dir).join(research_texts(spark, sf_dir), "text_id", "left")
            .select("o_orderkey", "_seq", "concept", "cluster", F.col("text").alias("fundamentals"), "examples", "probes", "connections_discovered"))


def research_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the name of their text (``text_id``) for the text itself,
    which is stored once and named by many of them."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    n_docs = table(spark, sf_dir, "documents").select(F.max("doc_id") + 1).scalar()
    key = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    ex = (li.filter(F.col("l_linenumber") % 2 == 1).groupBy(F.col("l_orderkey").alias("o_orderkey"))
          .agg(F.array_sort(F.collect_list(F.struct(*key, F.struct(F.col("l_returnflag").alias("title"),
                                                                 F.col("l_linestatus").alias("body")).alias("x")))).alias("_e"))
          .select("o_orderkey", F.transform("_e", lambda s: s["x"]).alias("examples")))
    pr = (li.filter(F.col("l_linenumber") % 2 == 0).groupBy(F.col("l_orderkey").alias("o_orderkey"))
          .agg(F.array_sort(F.collect_list(F.struct(*key, F.struct(
              F.col("l_shipdate").cast("date").cast("string").alias("question"),
              F.col("l_returnflag").alias("hint")).alias("x")))).alias("_p"))
          .select("o_orderkey", F.transform("_p", lambda s: s["x"]).alias("probes")))
    return (o.join(ex, "o_orderkey", "left").join(pr, "o_orderkey", "left")
            .select("o_orderkey", F.col("o_orderkey").alias("_seq"), _slug(4).alias("concept"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(
                        F.concat("o_orderpriority", F.lit("/"), (F.col("o_orderkey") % 4).cast("string")))).alias("cluster"),
                    (F.col("o_orderkey") % n_docs).alias("text_id"), "examples", "probes",
                    F.array(F.struct(F.concat(F.lit("status-"), F.lower("o_orderstatus")).alias("slug"),
                                     F.col("o_orderstatus").alias("name"),
                                     F.col("o_orderpriority").alias("relationship"))).alias("connections_discovered")))


def concept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONCEPT_EXTRACT rows (what the model would return) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(_slug().alias("slug"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
                    F.col("o_orderstatus").alias("cluster"), (F.lit(1) + F.col("o_orderkey") % 3).cast("int").alias("depth"),
                    F.array(F.concat(F.lit("status-"), F.lower("o_orderstatus"))).alias("connections"),
                    F.col("o_orderpriority").alias("description"))


def existing_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept documents already on disk: the concept of every third order
    (some with an empty name or cluster), plus an archived concept for the
    orders after those, which no research touches."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 != 2)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 28).cast("int"))
    slug = F.when(F.col("o_orderkey") % 3 == 0, _slug()).otherwise(
        F.concat(F.lit("archived-"), F.col("o_orderkey").cast("string")))
    return o.select(slug.alias("slug"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(
                        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("name"),
                    F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("cluster"),
                    (F.lit(1) + F.col("o_orderkey") % 5).cast("int").alias("depth"),
                    F.lit("old").alias("description"),
                    F.array().cast("array<struct<to:string,weight:double,relationship:string>>").alias("connections"),
                    day.alias("created"), day.alias("updated"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: even events carry the JSON inside a fence after a line, odd ones bare."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("response_id"),
                    F.when(F.col("event_id") % 2 == 0,
                           F.concat(F.lit("x\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
                    .alias("response"))


def _as_sent(n, body):
    """A response text: every second one in a fence after a line of prose."""
    return F.when(n % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(body)


def concept_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction responses, one for up to four neighbouring orders: a list, an
    object with ``concepts``, the first concept alone, or a text that breaks off."""
    c = concept_records(spark, sf_dir).withColumn("key", F.regexp_extract("slug", r"(\d+)$", 1).cast("long"))
    obj = F.struct("name", "slug", "cluster", "depth", "connections", "description")
    g = c.groupBy(F.floor(F.col("key") / 4).alias("response_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", obj.alias("o")))), lambda x: x["o"]).alias("l"))
    shape = F.col("response_id") % 4
    body = (F.when(shape == 1, F.concat(F.lit('{"concepts": '), F.to_json("l"), F.lit("}"))).when(shape == 2, F.to_json(F.col("l")[0]))
            .when(shape == 3, F.expr("left(to_json(l), length(to_json(l)) - 9)")).otherwise(F.to_json("l")))
    return g.select("response_id", _as_sent(F.floor(F.col("response_id") / 4), body).alias("response"))


def research_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research responses of the research records. Of every six one breaks off,
    and one has a text where the list of examples belongs; absent fields are left
    out of the JSON."""
    r = research(spark, sf_dir)
    fields = ["concept", "cluster", "fundamentals", "examples", "probes", "connections_discovered"]
    whole = F.to_json(F.struct(*fields))
    wrong = F.to_json(F.struct("concept", F.lit("none yet").alias("examples")))
    n = F.col("_seq") % 6
    body = F.when(n == 3, F.substring(whole, 1, 40)).when(n == 4, wrong).otherwise(whole)
    return r.select("_seq", _as_sent(F.floor(F.col("_seq") / 6), body).alias("response"))


def answer_concepts(blocks: DataFrame) -> DataFrame:
    """Stands for the model: a concept per prompt block, the same for every
    fiftieth; every fifth answer breaks off."""
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("batch-"), F.col("batch") % 50).alias("slug"), F.substring("block", 5, 12).alias("cluster"))).alias("concepts")))
    return blocks.select("batch", F.when(F.col("batch") % 5 == 4, F.substring(body, 1, 20)).otherwise(_as_sent(F.col("batch"), body)).alias("response"))


def answer_research(prompts: DataFrame) -> DataFrame:
    """Stands for the model: the prompt as fundamentals, one to three examples."""
    n = F.length("slug") % 3
    ex = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.concat(F.lit("Example "), i.cast("string")).alias("title"), F.col("slug").alias("body")))
    return prompts.select("slug", F.to_json(F.struct(F.col("prompt").alias("fundamentals"), ex.alias("examples"))).alias("response"))


# Fixed values of the navigation binding: event type -> viewer action.
NAV_ACTIONS = {"click": "next", "view": "next", "purchase": "next", "error": "prev", "signup": "topic"}


def nav_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_events_of(table(spark, sf_dir, "events"), cards(spark, sf_dir))


def nav_events_of(events: DataFrame, cards: DataFrame) -> DataFrame:
    """Viewer actions of a table or stream of events; a topic change goes to the
    topic of the card that the event names, to ``all`` for every seventh card, and
    to a topic without cards where there is no such card."""
    op = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in NAV_ACTIONS.items()])
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    acted = events.select("user_id", "ts", "event_id", op.alias("op"), F.when(op == "topic", k).alias("k"))
    topics = cards.select(F.col("card_id").alias("k"), F.col("topic").alias("own"))
    change = acted.filter("op = 'topic'").join(topics, "k", "left").withColumn(
        "topic", F.when(F.col("k") % 7 == 0, F.lit("all")).otherwise(F.coalesce("own", F.lit("none"))))
    return acted.filter("op <> 'topic'").withColumn("topic", F.lit(None).cast("string")).drop("k").unionByName(change.drop("k", "own"))


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored viewer states of two customers in three: some beyond their deck,
    some in a topic (the topic of the card of their number), some without one."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0)
    topics = cards(spark, sf_dir).select(F.col("card_id").alias("c_custkey"), "topic")
    return c.join(topics, "c_custkey", "left").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 13 % 900 - 20).cast("int").alias("idx"), (F.col("c_custkey") % 3).cast("int").alias("phase"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("topic")).alias("topic"))
