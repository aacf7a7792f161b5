"""Documents to training shards in five stages.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns what its stage keeps, all columns of ``docs`` unchanged
(the last stage returns the placement instead). ``run`` applies them to the
table ``documents``, writing every stage's result as Parquet in the shared
checkpoint folder and reading it again as the next one's input, so a lost
executor costs a stage at most.

Nulls, empty texts, repeated rows and clashing column names are handled as the
operators state: null, empty and letterless texts go in the first stage; of
repeated rows one stays in the second; an empty table passes through empty.

``ORACLE_SQL`` is None: the field, XXH64 and the embedding have no SQL form.
tests/llm/test_queries.py compares every stage, on what its predecessor kept,
with plain Python or SQL instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.llm.common import cut, table
from deckflow.llm.decontam import decontaminate
from deckflow.llm.langid import keep_identified, labelled_sample, train
from deckflow.llm.mixing import mix
from deckflow.llm.queries import mix_levels, mix_weights
from deckflow.llm.sharding import shard_documents
from deckflow.llm.simhash import keep_one_per_group

# A document is rejected when no language holds this share of its words;
# one that switches between two languages has about a half for each.
LEAST_SHARE = 0.35
SHINGLE_WORDS, MAX_BITS = 3, 3
# As many tokens as there are, dealt to the target weights; scarce sources are
# read up to twice.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 1), 2, "pipeline-1"
SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without an identified language go."""
    return keep_identified(docs, train(labelled_sample(docs, F.lit(True))), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays."""
    return keep_one_per_group(docs, words_per_shingle=SHINGLE_WORDS, max_bits=MAX_BITS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a row for every epoch that a document enters."""
    return mix(docs, mix_levels(docs), mix_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED).select("doc.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    placed = shard_documents(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("mixing sources", target_mix), ("sharding", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
