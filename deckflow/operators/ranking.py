"""Distributed ranking and bounded candidate expansion.

These are the building blocks that keep the per-user feed linear in the size
of the engagement log instead of users x cards:

* ``global_rank`` numbers rows in a total order without a single-partition
  window: range-partition on the order, sort inside each partition, number the
  rows locally and add the row count of all earlier partitions.
* ``rank_within`` ranks inside groups via the global rank minus the first
  global rank of the group (a partial aggregate), so a group holding a third
  of all rows is still ranked by many tasks.
* ``expand_ranks`` turns (key, bound) requests into one row per rank 1..bound
  so a later equi-join on rank picks the candidates. Large bounds are cut
  into chunks that are spread over tasks before they are exploded.
* ``top_n`` is ``row_number() <= n`` per group, which Spark plans as a partial
  WindowGroupLimit before the shuffle and a final one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.session import cut, shuffle_partitions

_PID_SHIFT = 33  # monotonically_increasing_id puts the partition id above bit 33


def global_rank(df: DataFrame, order: list, name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = 1-based position of each row in ``order`` (a total order)."""
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = (df.repartitionByRange(n, *order_cols)
                  .sortWithinPartitions(*order_cols)
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_local", F.monotonically_increasing_id()
                              - F.shiftleft(F.spark_partition_id().cast("long"), _PID_SHIFT)))
    # Offsets and local numbers must come from one evaluation of the range
    # partitioning: materialise it once, then both branches read the same rows.
    numbered = cut(numbered)
    # One row per partition: the running total runs in one task over n rows.
    offsets = (numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_pid", "_off"))
    # offsets holds at most n rows (the partition count): a proven broadcast bound.
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def rank_within(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank of each row inside ``group`` by ``order`` (total within group)."""
    g = global_rank(df, [*group, *order], "_g")
    first = g.groupBy(*[F.col(c).alias(f"_k_{c}") for c in group]).agg(F.min("_g").alias("_g0"))
    return (null_safe_join(g, first, group).withColumn(name, F.col("_g") - F.col("_g0") + 1)
            .drop("_g", "_g0", *[f"_k_{c}" for c in group]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``keys`` with ``right``'s ``_k_<key>``; null keys are equal."""
    on = left[keys[0]].eqNullSafe(right[f"_k_{keys[0]}"])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[f"_k_{k}"])
    return left.join(right, on)


def expand_ranks(req: DataFrame, keys: list[str], bound: str, name: str,
                 chunk: int = 4096, max_bound: int | None = None) -> DataFrame:
    """One row (keys..., name) for every rank 1..bound of each request row.
    ``max_bound``: a known upper limit of ``bound`` (then no chunking is needed
    when it is at most ``chunk``)."""
    live = req.filter(F.col(bound) > 0)
    small = live.filter(F.col(bound) <= chunk).select(
        *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col(bound).cast("long"))).alias(name))
    if max_bound is not None and max_bound <= chunk:
        return small
    big = (live.filter(F.col(bound) > chunk)
           .select(*keys, F.col(bound).cast("long").alias("_b"),
                   F.explode(F.sequence(F.lit(0).cast("long"),
                                        ((F.col(bound) - 1) / chunk).cast("long"))).alias("_c"))
           .repartition(*keys, "_c")
           .select(*keys, F.explode(F.sequence(F.col("_c") * chunk + 1,
                                               F.least(F.col("_b"), (F.col("_c") + 1) * chunk))).alias(name)))
    return small.unionByName(big)


def top_n(df: DataFrame, by: list[str], order: list, n: int | Column, name: str = "rn") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    limit = F.lit(n) if isinstance(n, int) else n
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit)
