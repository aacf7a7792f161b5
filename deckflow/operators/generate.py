"""Card generation from research records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import (card_file_id, depth_cap, format_example, format_probe,
                                     hint_suffix, pluck, title_from_slug, truncate, truncate_dots)
from deckflow.operators.ranking import global_rank
from deckflow.operators.upsert import SEQ, in_order, last_per_key

# Prompt layout and card-generation constants of the reference.
RESEARCH_PROMPT = ["Research this concept deeply:", "", "Name: {name}", "Slug: {slug}", "Cluster: {cluster}",
                   "Description: {description}", "Known connections: {connections}", "",
                   "Produce teaching material at multiple depth levels."]
SIGNAL_CHARS = 1000        # signal text cut in a prompt block
IDEA_CHARS = 200           # idea text of follow-up cards (then "...")
DESCRIPTION_CHARS = 300    # concept description
MAX_DEPTH = 3
ANGLE = "{title} — Angle {n}"
SOURCE_TYPE = "pipeline"


def _py_json_list(arr: Column) -> Column:
    """json.dumps of a list of strings (", " separator, letters as they are);
    each element is escaped by ``to_json``."""
    text = F.transform(arr, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]"))


def research_prompts(concepts: DataFrame) -> DataFrame:
    """One research prompt per concept record (missing -> '' / [])."""
    fields = {"name": F.coalesce("name", F.lit("")), "slug": F.coalesce("slug", F.lit("")),
              "cluster": F.coalesce("cluster", F.lit("")), "description": F.coalesce("description", F.lit("")),
              "connections": _py_json_list(F.coalesce("connections", F.array().cast("array<string>")))}
    parts = []
    for line in RESEARCH_PROMPT:
        key = next((k for k in fields if "{" + k + "}" in line), None)
        parts.append(F.concat(F.lit(line.split("{")[0]), fields[key]) if key else F.lit(line))
    return concepts.select("slug", F.concat_ws("\n", *parts).alias("prompt"))


def cluster_carry(research: DataFrame, concepts: DataFrame) -> DataFrame:
    """Research without a cluster takes its concept's cluster (default '');
    an empty cluster is kept."""
    c = concepts.select(F.col("slug").alias("concept"), F.col("cluster").alias("_cc"))
    return (research.join(c, "concept", "left")
            .withColumn("cluster", F.when(F.col("cluster").isNull(), F.coalesce("_cc", F.lit("")))
                        .otherwise(F.col("cluster"))).drop("_cc"))


_EXAMPLES = "array<struct<title:string,body:string>>"
_PROBES = "array<struct<question:string,hint:string>>"
_LINKS = "array<struct<slug:string,name:string,relationship:string>>"


def _or_empty(col: str, kind: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast(kind))


def generate_cards(research: DataFrame, as_of: str, texts: DataFrame | None = None) -> DataFrame:
    """Research rows -> card rows. Card 1 has the full fundamentals and the
    first example/probe; cards 2.. pair the remaining examples and probes
    (zip-longest), depth min(n, 3), idea cut to 200 chars + '...'. A card is
    written over by a later row's card of the same id (rows in the order of their
    ``_seq``, or of the input); what an earlier row had more stays.

    With ``texts`` (text_id, text) the rows name their fundamentals by ``text_id``:
    the last row of each card is found first and the text joined to what is left,
    so a text travels once and not with every card that is made of it."""
    rows = research if SEQ in research.columns else in_order(research)
    fund = F.coalesce("fundamentals", F.lit("")) if texts is None else F.col("text_id")
    base = rows.select(SEQ, F.coalesce("concept", F.lit("unknown")).alias("slug"), F.coalesce("cluster", F.lit("")).alias("topic"),
                       fund.alias("fund"), _or_empty("examples", _EXAMPLES).alias("ex"), _or_empty("probes", _PROBES).alias("pr"),
                       pluck(_or_empty("connections_discovered", _LINKS), "slug").alias("connections"))

    def idea(text, num):
        return F.when(num == 1, text).otherwise(truncate_dots(text, IDEA_CHARS))

    def card(num, title, depth, example, probe):
        return F.struct(num.cast("int").alias("num"), title.alias("title"), depth.cast("int").alias("depth"), example.alias("example"), probe.alias("probe"))

    first = card(F.lit(1), title_from_slug("slug"), F.lit(1),
                 F.when(F.size("ex") > 0, format_example(F.col("ex")[0])).otherwise(F.lit("")),
                 F.when(F.size("pr") > 0, format_probe(F.col("pr")[0])).otherwise(F.lit("")))
    rest = F.arrays_zip(F.slice("ex", 2, 1 << 30).alias("e"), F.slice("pr", 2, 1 << 30).alias("p"))
    more = F.transform(rest, lambda z, i: card(
        i + 2, F.coalesce(z["e"]["title"], F.concat(title_from_slug("slug"), F.lit(" — Angle "), (i + 2).cast("string"))),
        depth_cap(i + 2, MAX_DEPTH), format_example(z["e"]), format_probe(z["p"])))
    cards = base.select(SEQ, "slug", "topic", "connections", "fund", F.inline(F.concat(F.array(first), more)))
    own = [card_file_id("slug", "num").alias("card_id"), F.col("slug").alias("concept"), "title", "topic", "depth"]
    if texts is None:
        cards = last_per_key(cards.select(SEQ, *own, idea(F.col("fund"), F.col("num")).alias("idea"), "example", "probe", "connections"), "card_id")
    else:
        won = last_per_key(cards.select(SEQ, *own, "num", "fund", "example", "probe", "connections"), "card_id")
        of = texts.groupBy(F.col("text_id").alias("fund")).agg(F.collect_set(F.coalesce("text", F.lit(""))).alias("_texts"))
        # of several texts by one name the card with the greatest hash wins, as among rows of one _seq
        ideas = F.transform(F.coalesce("_texts", F.array(F.lit(""))), lambda t: idea(t, F.col("num")))
        hashed = F.transform(ideas, lambda x: F.struct(F.xxhash64("card_id", "concept", "title", "topic", "depth", x, "example", "probe", "connections").alias("h"), x.alias("idea")))
        cards = won.join(of, "fund", "left").select("card_id", "concept", "title", "topic", "depth", F.when(F.size(ideas) == 1, ideas[0]).otherwise(F.array_max(hashed)["idea"]).alias("idea"),
                                                    "example", "probe", "connections")
    return cards.select("*", F.lit(SOURCE_TYPE).alias("source_type"), F.lit("").alias("source_id"), F.lit(as_of).cast("date").alias("created_at"))


def concept_merge(research: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """Merged concept snapshot. Researched concepts keep an existing
    non-empty name/cluster, depth and created; description (first 300 chars),
    connections (weight 1.0) and updated are replaced. Untouched concepts stay.
    Several rows for one concept count as one after the other (in the order of
    ``_seq``, or of the input): the last one's description and connections, and
    the first cluster that isn't empty. Texts are cut before they are shuffled."""
    rows = research if SEQ in research.columns else in_order(research)
    conn = F.transform(_or_empty("connections_discovered", _LINKS),
                       lambda c: F.struct(c["slug"].alias("to"), F.lit(1.0).alias("weight"), F.coalesce(c["relationship"], F.lit("")).alias("relationship")))
    cut = rows.select(SEQ, F.col("concept").alias("slug"), F.nullif("cluster", F.lit("")).alias("n_cluster"),
                      truncate(F.coalesce("fundamentals", F.lit("")), DESCRIPTION_CHARS).alias("n_desc"), conn.alias("n_conn"))
    order = F.struct(F.col(SEQ), F.xxhash64("n_desc", "n_conn"))
    new = (cut.groupBy("slug").agg(F.max_by(F.struct("n_desc", "n_conn"), order).alias("last"),
                                   F.min_by("n_cluster", F.when(F.col("n_cluster").isNotNull(), F.struct(F.col(SEQ), F.col("n_cluster")))).alias("n_cluster"))
           .select("slug", "last.n_desc", "last.n_conn", "n_cluster", F.lit(True).alias("_new")))
    old = existing.select("slug", "name", "cluster", "depth", "description", "connections", "created", "updated")
    m = new.join(old, "slug", "full_outer")
    is_new = F.col("_new").isNotNull()
    return m.select(
        "slug",
        F.when(is_new, F.coalesce(F.nullif("name", F.lit("")), title_from_slug("slug"))).otherwise(F.col("name")).alias("name"),
        F.when(is_new, F.coalesce(F.nullif("cluster", F.lit("")), F.col("n_cluster"), F.lit(""))).otherwise(F.col("cluster")).alias("cluster"),
        F.when(is_new, F.coalesce("depth", F.lit(1))).otherwise(F.col("depth")).alias("depth"),
        F.when(is_new, F.col("n_desc")).otherwise(F.col("description")).alias("description"),
        F.when(is_new, F.col("n_conn")).otherwise(F.col("connections")).alias("connections"),
        F.when(is_new, F.coalesce("created", F.lit(as_of).cast("date"))).otherwise(F.col("created")).alias("created"),
        F.when(is_new, F.lit(as_of).cast("date")).otherwise(F.col("updated")).alias("updated"))


def prompt_blocks(signals: DataFrame, order: list, batch_size: int = 10) -> DataFrame:
    """Signals numbered in ``order`` -> one prompt block per batch of
    ``batch_size``: ``[i] text[:1000] (topics: ..)`` joined by blank lines.
    Numbering is a distributed global rank; each batch collects a bounded
    ``batch_size`` lines."""
    cut = F.concat(truncate("text", SIGNAL_CHARS), hint_suffix("topics_hint"))  # before the ranking, which writes its rows
    r = global_rank(signals.select(*[o for o in order if isinstance(o, str)], cut.alias("cut")), order, "n")
    i = (F.col("n") - 1) % batch_size + 1
    line = F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.col("cut"))
    return (r.select(((F.col("n") - 1) / batch_size).cast("long").alias("batch"), i.alias("i"), line.alias("line"))
            .groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("_l"))
            .select("batch", F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n").alias("block")))
