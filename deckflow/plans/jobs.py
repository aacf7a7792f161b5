"""Batch jobs that chain operators end to end: the build path and A11 re-index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.operators.generate import cluster_carry, concept_merge, generate_cards, prompt_blocks, research_prompts
from deckflow.operators.index import write_index
from deckflow.operators.upsert import SEQ, in_order, last_per_key, read_snapshot, upsert_buckets
from deckflow.session import cut, shuffle_partitions, started
from deckflow.sources.documents import CONN, parse_cards, parse_concepts
from deckflow.sources.responses import concepts, json_text, rejects, research, research_rejects
from deckflow.sources.signals import read_documents, signals_or_none

CONCEPT_ROW = f"slug string, name string, cluster string, depth int, description string, connections {CONN}, created date, updated date"


def _count(stage: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")


def _stages(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


Ask = Callable[[DataFrame], DataFrame]


def build(spark: SparkSession, signals: DataFrame, order: list[str], ask_concepts: Ask, ask_research: Ask, out_dir: str, as_of: str) -> DataFrame:
    """The build path: signals, concepts, research, cards, index; returns the row
    count of every stage.

    The model is asked from outside: ``ask_concepts`` takes the prompt blocks
    (batch, block) and gives (batch, response), ``ask_research`` takes (slug,
    prompt) and gives (slug, response), for instance by a join with a table of
    answers. Responses that can't be read are counted as rejects. Without signals
    nothing further runs. Cards and concepts go to a new version of the snapshots
    at ``out_dir`` (which keep what they had), the index is built from the cards."""
    found = signals_or_none(signals)
    if found is None:
        return spark.createDataFrame([("signals", 0)], "stage string, n long")
    version = 1 + max([0, *(v for kind in ("cards", "concepts") for v in started(spark, f"{out_dir}/{kind}", "v"))])
    blocks = cut(prompt_blocks(found, order))
    answers = cut(ask_concepts(blocks).select("batch", json_text("response").alias("json")))
    # several batches may name a concept; the last one's record counts
    named = last_per_key(concepts(answers).withColumn(SEQ, F.struct("batch", "idx")), "slug").filter("slug is not null")
    named = cut(named.drop("batch", "idx"))
    replies = cut(ask_research(research_prompts(named)).select("slug", json_text("response").alias("json")))
    records = cluster_carry(research(replies).withColumn("concept", F.coalesce("concept", "slug")), named)
    records = cut(records.withColumn(SEQ, F.col("slug")).drop("slug"))
    cards = cut(generate_cards(records, as_of).withColumn("file_path", F.concat(F.lit("cards/"), F.col("card_id"), F.lit(".md"))))
    upsert_buckets(in_order(cards), f"{out_dir}/cards", "card_id", version)
    old = read_snapshot(spark, f"{out_dir}/concepts", version)
    fresh = concept_merge(records, old if old is not None else spark.createDataFrame([], CONCEPT_ROW), as_of)
    upsert_buckets(in_order(fresh.join(records.select(F.col("concept").alias("slug")), "slug", "left_semi")), f"{out_dir}/concepts", "slug", version)
    now = read_snapshot(spark, f"{out_dir}/cards")
    index = write_index(now, f"{out_dir}/index/v{version:06d}", shuffle_partitions(spark))
    return _stages([_count("signals", found), _count("prompt_blocks", blocks), _count("concepts", named), _count("concept_rejects", rejects(answers)),
                    _count("research", records), _count("research_rejects", research_rejects(replies)), _count("cards", cards), _count("indexed", now),
                    _count("terms", index.terms)])


def reindex_all(spark: SparkSession, cards_dir: str, concepts_dir: str, out_dir: str, as_of: str) -> DataFrame:
    """Parse every card and concept document once, upsert them into a new
    version of the snapshots (no deletes), rebuild the index from the cards, and
    return the stage row counts. A version whose write didn't end is never read,
    nor is its number used again."""
    n = shuffle_partitions(spark)
    version = 1 + max([0, *(v for kind in ("cards", "concepts") for v in started(spark, f"{out_dir}/{kind}", "v"))])
    parsed = {"cards": (parse_cards(read_documents(spark, f"{cards_dir}/*.md"), as_of), "card_id"),
              "concepts": (parse_concepts(read_documents(spark, f"{concepts_dir}/*.yaml"), as_of), "concept")}
    counts = []
    for kind, (rows, key) in parsed.items():
        rows = cut(in_order(rows))
        upsert_buckets(rows, f"{out_dir}/{kind}", key, version)
        now = read_snapshot(spark, f"{out_dir}/{kind}")
        counts += [_count(f"{kind}_parsed", rows), _count(kind, rows if now is None else now)]
    cards = read_snapshot(spark, f"{out_dir}/cards")
    if cards is not None:
        write_index(cards, f"{out_dir}/index/v{version:06d}", n)
    return _stages(counts)
