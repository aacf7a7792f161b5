"""Session helpers: building a session, checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on at any scale. AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small), splits skewed join
# partitions and coalesces small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "deckflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs (a cluster passes its own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present. Only a local-mode
    session without one (tests) gets a fresh scratch folder; on a cluster an
    unset value is an error, since a machine-local folder would not survive
    the loss of the executor that wrote it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (no JVM context handle, e.g. a Connect session)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        master = sc.master
    else:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.conf.get("spark.master", "")
    if configured:
        if sc is not None:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir()
        return configured
    if not str(master).startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS)")
    path = tempfile.mkdtemp(prefix="deckflow-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` as it was set, for tables that
    outlive a session (Spark gives every session its own folder below it)."""
    own = ensure_checkpoint_dir(spark)
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and continue from that table.

    Used between feed steps (each step reads the picks of the previous one),
    so the plan does not grow with the number of steps, and recomputation after
    a lost executor restarts from the written table rather than from the scans.
    One write job (``Dataset.checkpoint`` would compute its input twice), and
    the re-read carries real file sizes for AQE's join planning.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/deckflow-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _CUTS.append(path)
    return spark.read.parquet(path)


def file_system(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def started(spark: SparkSession, base: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` below ``base``. A missing
    ``base`` has none; any other failure to list it is raised."""
    path, fs = file_system(spark, base)
    if not fs.exists(path(base)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(base)) if s.isDirectory()]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def committed(spark: SparkSession, base: str, prefix: str) -> list[int]:
    """Those of them whose write was committed (the folder holds ``_SUCCESS``)."""
    path, fs = file_system(spark, base)
    name = {int(s.getPath().getName()[len(prefix):]): s.getPath() for s in (fs.listStatus(path(base)) if fs.exists(path(base)) else [])
            if s.isDirectory() and s.getPath().getName().startswith(prefix) and s.getPath().getName()[len(prefix):].isdigit()}
    return [n for n in sorted(name) if fs.exists(path(name[n], "_SUCCESS"))]


_CUTS: list[str] = []


def drop_cuts(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote with ``cut`` (call it
    once the results that read them have been written). Returns the count."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _CUTS:
        p = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        if p.getFileSystem(conf).delete(p, True):
            n += 1
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parallelism(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return shuffle_partitions(spark)
