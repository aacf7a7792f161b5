"""The stored full-text index: postings by token range, and the term table.

``postings`` holds (token, card_id, field, pos), range-partitioned on (token,
card_id) and sorted inside each file, in small row groups: a filter on tokens
or a token prefix skips the row groups of all others by their statistics, and a
token that a third of all cards hold is spread over several files. ``terms``
holds (token, df): the cards that hold a token, for choosing the rarest token
first and for expanding prefixes without reading postings.

An index is named by a stamp of what it was built from (paths, sizes and times
of the source files). ``open_index`` reads the index of the present stamp and
builds it only if there is none: first under a name of its own, then moved, so
a reader never sees half an index and of two builders one wins.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckflow.operators.search import FIELDS, postings
from deckflow.session import file_system, shared_folder, shuffle_partitions

LAYOUT = "2"
ROW_GROUP = 4 << 20  # bytes: what a lookup of one token reads at least
PART = 4 << 20  # letters of the corpus a partition: some million postings, which a task sorts in memory
COLUMNS = ["token", "card_id", "field", "pos"]


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        stored = spark.read.parquet(f"{path}/postings")
        self.postings: DataFrame = stored.select(*COLUMNS)
        self.pairs: DataFrame = stored.filter("first").select("token", "card_id")
        self.terms: DataFrame = spark.read.parquet(f"{path}/terms")


def parts_of(corpus: DataFrame, least: int) -> int:
    """Partitions of the index: as many as the corpus has pieces of ``PART`` letters,
    so that what a task sorts doesn't grow with the corpus."""
    letters = sum((F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)) for f in FIELDS if f != "id"), F.lit(0))
    return max(least, (corpus.agg(F.sum(letters.cast("long"))).first()[0] or 0) // PART + 1)


def write_index(corpus: DataFrame, path: str, partitions: int) -> SearchIndex:
    """Writes the index in ``partitions`` ranges or more. All postings of a (token,
    card) are in one range, so the first of them is marked there and the cards of a
    token are counted from the marks: postings are shuffled once."""
    spark = corpus.sparkSession
    n = parts_of(corpus, partitions)
    mark = F.row_number().over(Window.partitionBy("token", "card_id").orderBy("field", "pos")) == 1
    (postings(corpus).select(*COLUMNS).repartitionByRange(n, "token", "card_id").withColumn("first", mark)
     .sortWithinPartitions(*COLUMNS).write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{path}/postings"))
    (spark.read.parquet(f"{path}/postings").filter("first").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
     .repartitionByRange(max(1, partitions // 8), "token").sortWithinPartitions("token")
     .write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{path}/terms"))
    return SearchIndex(spark, path)


def stamp(source: DataFrame) -> str:
    """Digest of the files that ``source`` reads: path, length, time."""
    spark, seen = source.sparkSession, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in source.inputFiles()}):
        path, fs = file_system(spark, folder)
        seen += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path(folder)) if s.isFile()]
    files = {f.split(":", 1)[-1].lstrip("/") for f in source.inputFiles()}
    own = sorted(x for x in seen if x[0].split(":", 1)[-1].lstrip("/") in files)
    return hashlib.sha256(repr((LAYOUT, own)).encode()).hexdigest()[:32]


def open_index(corpus: DataFrame, name: str, of: str | None = None) -> SearchIndex:
    """The index of ``corpus`` as its files are now (``of``: its stamp, for a
    corpus that isn't read from files)."""
    spark = corpus.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/search-index/{name}"
    at = f"{base}/{of or stamp(corpus)}"
    path, fs = file_system(spark, base)
    if not fs.exists(path(f"{at}/terms/_SUCCESS")):
        own = f"{base}/.build-{uuid.uuid4().hex}"
        write_index(corpus, own, shuffle_partitions(spark))
        if not fs.rename(path(own), path(at)):
            if not fs.exists(path(f"{at}/terms/_SUCCESS")):
                raise OSError(f"can't move the index to {at}")
            fs.delete(path(own), True)
    return SearchIndex(spark, at)
