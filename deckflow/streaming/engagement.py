"""Streaming engagement: validation + quarantine, running stats, running last
concept, stateful viewer replay, card documents arriving in a folder.

Sinks: the parquet file sink (exactly-once, append) for row streams; for
running aggregates (update mode) ``foreachBatch`` overwrites the folder of
its batch id, so a replayed batch rewrites the same files (idempotent); every
few batches they are merged, so readers scan a bounded number of folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from deckflow.functions.text import decoded_path
from deckflow.operators import engagement as eng
from deckflow.operators.viewer import ALL, NEXT, PREV, deck_sizes, go_on
from deckflow.session import committed, ensure_checkpoint_dir, file_system


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a sink + checkpoint."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


# ---- I01 ------------------------------------------------------------------------
def split_accepted(events: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stream-static: valid events of existing cards, and the quarantine
    (invalid or orphan) with a reason."""
    valid = eng.valid_events(events)
    accepted = valid.join(cards.select("card_id"), "card_id", "left_semi")
    orphan = valid.join(cards.select("card_id"), "card_id", "left_anti").withColumn("reason", F.lit("unknown_card"))
    invalid = eng.invalid_events(events).withColumn("reason", F.lit("missing_field"))
    return accepted, invalid.unionByName(orphan)


def run_append(df: DataFrame, base: str, name: str, available_now: bool = True):
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/_ck_{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---- I02 / I03: running aggregates ---------------------------------------------
MERGE_EVERY = 10  # batches; a reader scans one merged table and fewer than this many batches


def run_upsert(df: DataFrame, base: str, name: str, key: list[str], available_now: bool = True, merge_every: int = MERGE_EVERY):
    """Write every batch of updates to its own folder, and every ``merge_every``
    batches the newest rows per key of all so far to ``merged=<batch>``. A batch
    that is run again rewrites its own folders with the same rows; a merge that
    is already committed stays."""
    path = f"{base}/{name}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % merge_every == 0 and batch_id not in committed(spark, path, "merged="):
            rows = _upto(spark, path, batch_id)
            cols = [c for c in rows.columns if c not in key]
            rows.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("_v")).select(*key, "_v.*").write.mode("overwrite").parquet(f"{path}/merged={batch_id}")

    w = (df.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/_ck_{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def parts_to_read(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest committed merge and the batches after it (up to a batch)."""
    merged = [m for m in committed(spark, path, "merged=") if upto is None or m < upto]
    batches = [n for n in committed(spark, path, "batch=") if (not merged or n > merged[-1]) and (upto is None or n <= upto)]
    return [*[f"{path}/merged={m}" for m in merged[-1:]], *[f"{path}/batch={n}" for n in batches]]


def _upto(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    return spark.read.parquet(*parts_to_read(spark, path, batch_id))


def drop_merged(spark: SparkSession, base: str, name: str) -> int:
    """Delete the batches and merges that the newest merge replaces (for a time
    without readers). Returns the count."""
    path, n = f"{base}/{name}", 0
    where, fs = file_system(spark, path)
    merged = committed(spark, path, "merged=")
    for m in merged[:-1]:
        n += bool(fs.delete(where(f"{path}/merged={m}"), True))
    for b in committed(spark, path, "batch="):
        if merged and b <= merged[-1]:
            n += bool(fs.delete(where(f"{path}/batch={b}"), True))
    return n


def read_latest(spark: SparkSession, base: str, name: str, key: list[str]) -> DataFrame:
    """Newest row per key."""
    df = _upto(spark, f"{base}/{name}")
    cols = [c for c in df.columns if c not in (*key, "_batch")]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("_v"))
    return last.select(*key, *[F.col(f"_v.{c}").alias(c) for c in cols])


def running_stats(accepted: DataFrame) -> DataFrame:
    """Event counts per card (keys: cards x event names, bounded)."""
    return eng.engagement_stats(accepted)


def running_last_concept(accepted: DataFrame, cards: DataFrame) -> DataFrame:
    """Stream-static join, then max(struct(time, concept)) per user."""
    j = accepted.join(cards.select("card_id", "concept"), "card_id")
    return (j.groupBy("user_id").agg(F.max(F.struct("created_at", "concept")).alias("_m"))
            .select("user_id", F.col("_m.concept").alias("concept"), F.col("_m.created_at").alias("last_engaged")))


# ---- I04: stateful viewer --------------------------------------------------------
NAV_OUT = "user_id long, idx int, phase int, topic string, counter long"
NAV_STATE = "p long, size long, topic string, counter long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NavProcessor(StatefulProcessor):
    """A user's place in the deck of its topic, kept in the state store."""

    def __init__(self, all_cards: int):
        self.all_cards = all_cards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("place", NAV_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The frames of a batch come in any order, so times, ids and steps are
        gathered (a few bytes an event; topics only of topic changes), ordered
        and walked at once (``viewer.go_on``)."""
        import numpy as np
        at = self.state.get() if self.state.exists() else (0, 3 * self.all_cards, ALL, 0)
        ts, ids, steps, changes = [], [], [], {}
        for f in rows:
            change = f["step"].to_numpy() == 0
            for t, i, topic, n in f.loc[change, ["ts", "event_id", "topic", "n"]].itertuples(index=False):
                changes[t, i] = (0, 3 * int(n), topic)
            ts.append(f["ts"].to_numpy())
            ids.append(f["event_id"].to_numpy())
            steps.append(f["step"].to_numpy().astype(np.int8))
        ts, ids, steps = (np.concatenate(x) for x in (ts, ids, steps))
        order = np.lexsort((ids, ts))
        ts, ids, steps = ts[order], ids[order], steps[order]
        marks = {i: changes[pd.Timestamp(ts[i]), ids[i]] for i in np.flatnonzero(steps == 0).tolist()}
        _, _, (p, size, topic) = go_on(steps, marks, tuple(at[:3]))
        counter = int(at[3]) + len(steps)
        self.state.update((int(p), int(size), topic, counter))
        yield pd.DataFrame({"user_id": [key[0]], "idx": [p // 3], "phase": [p % 3], "topic": [topic], "counter": [counter]}).astype({"idx": "int32", "phase": "int32"})

    def close(self) -> None:
        pass


def nav_stream(events: DataFrame, cards: DataFrame) -> DataFrame:
    """The place of every user carried across micro-batches. Inside a batch
    events count in (ts, event_id) order, across batches in order of arrival. One
    row per user and batch, with the number of events so far. ``events``: user_id,
    ts, event_id, op, topic; a topic change meets the deck sizes before the state.
    The session's state store must be RocksDB (``ROCKSDB``)."""
    decks = deck_sizes(cards)
    all_cards = decks.filter(F.col("topic") == ALL).first()["n"]
    step = F.when(F.col("op") == NEXT, 1).when(F.col("op") == PREV, -1).otherwise(0)
    topic = F.when(step == 0, F.coalesce(F.nullif("topic", F.lit("")), F.lit(ALL)))
    # few distinct topics, so the deck table is a map that goes with the plan
    sizes = F.create_map(*[x for r in decks.collect() for x in (F.lit(r["topic"]), F.lit(r["n"]))])
    rows = (events.select("user_id", "ts", "event_id", step.cast("int").alias("step"), topic.alias("topic"))
            .withColumn("n", F.coalesce(sizes[F.col("topic")], F.lit(0)).cast("long")))
    return rows.groupBy("user_id").transformWithStateInPandas(NavProcessor(all_cards), outputStructType=NAV_OUT, outputMode="append", timeMode="none")


def latest_nav(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("user_id").agg(F.max_by(F.struct("idx", "phase", "topic", "counter"), "counter").alias("s"))
            .select("user_id", "s.idx", "s.phase", "s.topic", F.col("s.counter").alias("n_events")))


# ---- I05: card documents -------------------------------------------------------
def card_folder_stream(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md")
            .load(folder).select(decoded_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content")))


def run_card_upsert(docs: DataFrame, snapshot_base: str, ckpt: str, as_of: str, available_now: bool = True):
    """Each batch of documents is parsed (A05) and upserted (A08) as the snapshot
    version of its batch id: only the key buckets it touches are written, and a
    batch that is run again rewrites its own version."""
    from deckflow.operators.upsert import upsert_buckets
    from deckflow.sources.documents import parse_cards

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        upsert_buckets(parse_cards(batch, as_of), snapshot_base, "card_id", batch_id)

    w = docs.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
