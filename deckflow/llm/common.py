"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckflow import session
from deckflow.session import ensure_checkpoint_dir

__all__ = ["cut", "drop", "table", "slim", "components", "total_prefix", "new_folder", "small_batches", "put_file",
           "get_file", "is_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder (zstandard pages) and go
    on from there: a lost executor costs no step before this one."""
    path = new_folder(df.sparkSession, "deckflow")
    df.write.option("compression", "zstd").parquet(path)
    session._CUTS.append(path)
    return df.sparkSession.read.parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table written by ``cut`` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("deckflow-"):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def slim(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else
    the input carries (clashing names included) is left behind."""
    return df.select(*[df[src].alias(dst) for dst, src in cols.items()])


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes (a batch
    of very long texts is cut by its bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def _store(path: str):
    from pyarrow import fs
    if path.startswith("s3a://"):
        path = "s3" + path[3:]  # the name that pyarrow has for it
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.LocalFileSystem(), path


def put_file(path: str, chunks) -> None:
    """Write a file in the shared store: under a name of this attempt first,
    then moved, so a task that is run again or runs twice leaves one whole file."""
    store, name = _store(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    attempt = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        for c in chunks:
            out.write(c)
    store.move(attempt, name)


def get_file(path: str):
    """A random-access reader of a file in the shared store."""
    store, name = _store(path)
    return store.open_input_file(name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as ``(u, v)`` longs.

    Alternates large-star and small-star (Kiveris et al., 2014): each step
    replaces a node's edges by edges to the least neighbour, so no step makes
    more rows than it reads. Every step is written, so a lost executor costs
    one step. Returns ``(node, root)`` for the nodes that have an edge; root is
    the least node of the component.
    """
    def norm(e: DataFrame) -> DataFrame:
        return (e.filter(F.col("u") != F.col("v"))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    e = cut(norm(edges))
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = norm(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(norm(small))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def total_prefix(df: DataFrame, order: list[str], size: str, carry: list[str]) -> DataFrame:
    """Running total of ``size`` over all rows in ``order``: ``(carry.., before, upto)``.

    Rows are range-partitioned and summed inside each partition by a streaming
    pass; only one total per partition (as many as partitions) meets on the
    driver. The running rows are written once, so both passes see the same
    partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = list(dict.fromkeys([*carry, *order]))
    part = (df.select(*keep, F.col(size).cast("long").alias("_size"))
            .repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_part", F.spark_partition_id()))
    schema = T.StructType([*part.schema.fields, T.StructField("_upto", T.LongType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        at = 0
        for b in batches:
            if b.num_rows:
                upto = pc.add(pc.cumulative_sum(b.column("_size")), pa.scalar(at, pa.int64()))
                at = upto[-1].as_py()
                yield pa.RecordBatch.from_arrays([*b.columns, upto], [*b.schema.names, "_upto"])

    ran = cut(part.mapInArrow(run, schema))
    totals = sorted((r["_part"], r["t"]) for r in ran.groupBy("_part").agg(F.max("_upto").alias("t")).collect())
    starts, at = [0] * (1 + max([p for p, _ in totals], default=0)), 0
    for p, t in totals:
        starts[p], at = at, at + t
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part") + 1)
    return ran.select(*carry, (start + F.col("_upto") - F.col("_size")).alias("before"), (start + F.col("_upto")).alias("upto"))
