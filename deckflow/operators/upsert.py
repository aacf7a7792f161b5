"""Snapshot upserts and event appends.

A snapshot is a set of key buckets. A version folder ``v<number>`` holds the
buckets that it changed and nothing else; of every bucket the newest committed
one counts. So an upsert reads and writes the buckets of its keys only, a
reader never sees half a version (a version counts once its write is
committed), and writing a version again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.session import committed, file_system

SEQ = "_seq"
BUCKETS = 256  # of a snapshot; fixed when its first version is written


def in_order(df: DataFrame) -> DataFrame:
    """``df`` with the order of its input as ``_seq`` (Spark numbers the rows of
    a file in their order)."""
    return df.withColumn(SEQ, F.monotonically_increasing_id())


def last_per_key(df: DataFrame, key: Column | str, name: str | None = None) -> DataFrame:
    """One row per key: the last by ``_seq``, which the input must have. (Of rows
    with one ``_seq`` the one with the greatest hash wins, so the result is
    defined.) One aggregation, combined before the shuffle."""
    cols = [c for c in df.columns if c != SEQ]
    k = F.col(key) if isinstance(key, str) else key
    order = F.struct(F.col(SEQ), F.xxhash64(*cols))
    return df.groupBy(k.alias("_key")).agg(F.max_by(F.struct(*cols), order).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert-or-replace by ``key``, last write wins, no deletes.
    Only ``new`` is reduced; ``old`` keeps the rows whose key isn't in it."""
    won = last_per_key(new if SEQ in new.columns else in_order(new), key)
    kept = old.join(won.select(F.col(key).alias("_new")), old[key].eqNullSafe(F.col("_new")), "left_anti")
    return kept.unionByName(won)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def live_buckets(spark: SparkSession, base: str, below: int | None = None) -> dict[int, str]:
    """Bucket -> folder of its newest committed version (below a number)."""
    path, fs = file_system(spark, base)
    found: dict[int, str] = {}
    for v in committed(spark, base, "v"):
        if below is None or v < below:
            for s in fs.listStatus(path(f"{base}/v{v:06d}")):
                name = s.getPath().getName()
                if name.startswith("bucket="):
                    found[int(name[7:])] = f"{base}/v{v:06d}/{name}"
    return found


def read_snapshot(spark: SparkSession, base: str, below: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a snapshot, or of some of its buckets; None if there are none."""
    live = live_buckets(spark, base, below)
    paths = [p for b, p in sorted(live.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def upsert_buckets(new: DataFrame, base: str, key: str, version: int, buckets: int = BUCKETS) -> None:
    """Upsert ``new`` as a version of the snapshot at ``base``. What is written
    grows with the buckets that ``new`` touches, not with the snapshot."""
    spark = new.sparkSession
    won = last_per_key(new if SEQ in new.columns else in_order(new), key).withColumn("bucket", _bucket(key, buckets))
    touched = [r["bucket"] for r in won.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = read_snapshot(spark, base, version, touched)
    if old is not None:
        kept = old.join(won.select(F.col(key).alias("_new")), old[key].eqNullSafe(F.col("_new")), "left_anti")
        won = kept.withColumn("bucket", _bucket(key, buckets)).unionByName(won, allowMissingColumns=True)
    won.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{version:06d}")


def drop_old_buckets(spark: SparkSession, base: str) -> int:
    """Delete bucket folders that newer versions replace (for a time without
    readers of old versions). Returns the count."""
    path, fs = file_system(spark, base)
    live, n = set(live_buckets(spark, base).values()), 0
    for v in committed(spark, base, "v"):
        for s in fs.listStatus(path(f"{base}/v{v:06d}")):
            name = s.getPath().getName()
            if name.startswith("bucket=") and f"{base}/v{v:06d}/{name}" not in live:
                n += bool(fs.delete(s.getPath(), True))
    return n


def normalise_events(requests: DataFrame, as_of_ts: str) -> DataFrame:
    """A10: defaults of an engagement write: duration 0, metadata '{}',
    created_at the write time (here the explicit ``as_of_ts``)."""
    return requests.select(
        "id", "user_id", "card_id", "event",
        F.coalesce("duration_ms", F.lit(0).cast("long")).alias("duration_ms"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.coalesce(F.col("created_at"), F.lit(as_of_ts).cast(dict(requests.dtypes)["created_at"])).alias("created_at"))


def append_events(events: DataFrame, path: str, key: str = "id", days_back: int | None = 1) -> None:
    """A10: append to the event log, partitioned by day, each request once.

    A request whose ``key`` the log already holds is left out, so a repeated write
    changes nothing. Looked at are the days of the batch and ``days_back`` days
    before the first of them (None: the whole log): a scan of ids that the
    partitions prune. Of repeats inside the batch the earliest stays. Days are
    dealt by a rebalance, which splits a day that holds most rows."""
    spark = events.sparkSession
    e = events.withColumn("day", F.to_date("created_at"))
    cols = [c for c in e.columns if c != key]
    once = e.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("created_at", F.xxhash64(*cols))).alias("_row")).select(key, "_row.*").select(*e.columns)
    where, fs = file_system(spark, path)
    if fs.exists(where(path)) and any(s.getPath().getName().startswith("day=") for s in fs.listStatus(where(path))):
        log = spark.read.schema(e.schema).parquet(path).select(key, "day")
        if days_back is not None:
            first, last = e.agg(F.min("day"), F.max("day")).first()
            if first is not None:
                log = log.filter(F.col("day").between(F.date_sub(F.lit(first), days_back), F.lit(last)))
        once = once.join(log.select(key), key, "left_anti")
    once.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
