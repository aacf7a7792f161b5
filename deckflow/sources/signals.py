"""Signal ingestion (A01-A04): bookmark exports, text drops, paged documents.

Inputs are tables: one row per export document / text / paged document, so
thousands of files are read in parallel (``spark.read.text(path,
wholetext=True)`` gives exactly that shape)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import decoded_path, first_nonempty, py_strip, quote_append

TWEET = ("struct<full_text:string,text:string,id_str:string,id:string,"
         "entities:struct<hashtags:array<struct<tag:string,text:string>>>,"
         "quoted_status:struct<full_text:string>>")
SIGNAL_COLS = ["text", "source_type", "source_id", "topics_hint"]
# Source type labels of the signals.
BOOKMARK_TYPE = "twitter_bookmark"
TEXT_TYPE = "manual"
PAGED_TYPE = "pdf"
KINDS = ["bookmarks", "pdf", "text"]


def read_documents(spark, path: str) -> DataFrame:
    """One row per file: (path, content); CRLF normalised like Python text reads."""
    return spark.read.text(path, wholetext=True).select(
        decoded_path(F.col("_metadata.file_path")).alias("path"),
        F.regexp_replace("value", "\r\n", "\n").alias("content"))


def bookmarks(exports: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(export_id, doc JSON) -> one signal per tweet.

    The export is an array, or an object with ``data``, else ``tweets``.
    The array test is ``json_array_length`` (``from_json`` of an object with
    an array schema does not give null, so coalescing parses would be wrong)."""
    d = F.col(doc_col)
    as_obj = F.from_json(d, f"struct<data:array<{TWEET}>,tweets:array<{TWEET}>>")
    tweets = F.when(F.json_array_length(d).isNotNull(), F.from_json(d, f"array<{TWEET}>")).otherwise(
        F.coalesce(as_obj["data"], as_obj["tweets"], F.array().cast(f"array<{TWEET}>")))
    t = F.col("t")
    text = first_nonempty(t["full_text"], F.coalesce(t["text"], F.lit("")))
    tags = F.transform(F.coalesce(t["entities"]["hashtags"], F.array().cast("array<struct<tag:string,text:string>>")),
                       lambda h: first_nonempty(h["tag"], F.coalesce(h["text"], F.lit(""))))
    return (exports.select("export_id", F.posexplode(tweets).alias("idx", "t"))
            .select("export_id", "idx",
                    py_strip(quote_append(text, t["quoted_status"]["full_text"])).alias("text"),
                    F.lit(BOOKMARK_TYPE).alias("source_type"),
                    first_nonempty(t["id_str"], F.coalesce(t["id"], F.lit(""))).alias("source_id"),
                    tags.alias("topics_hint")))


def bookmark_rejects(exports: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Exports that A01 can't read, ``(export_id, reason)``: a null document, or
    one that is neither a JSON array nor a JSON object."""
    d = F.col(doc_col)
    bad = exports.filter(F.json_array_length(d).isNull() & F.json_object_keys(d).isNull())
    return bad.select("export_id", F.when(F.col(doc_col).isNull(), "no document").otherwise("not JSON").alias("reason"))


def text_drop(texts: DataFrame, text_col: str = "text", source_type: str = TEXT_TYPE) -> DataFrame:
    """Every text -> one stripped signal without hints."""
    return texts.select(*[c for c in texts.columns if c != text_col],
                        py_strip(F.col(text_col)).alias("text"), F.lit(source_type).alias("source_type"),
                        F.lit("").alias("source_id"), F.array().cast("array<string>").alias("topics_hint"))


def paged(docs: DataFrame, stem_col: str, text_col: str, sep: str = "\n") -> DataFrame:
    """One signal per non-blank page; page numbers count blank pages too."""
    pages = docs.select(stem_col, F.posexplode(F.split(F.col(text_col), sep, -1)).alias("i", "page"))
    return (pages.select(stem_col, "i", py_strip("page").alias("text"))
            .filter(F.col("text") != "")
            .select(stem_col, "i", "text", F.lit(PAGED_TYPE).alias("source_type"),
                    F.concat(F.col(stem_col).cast("string"), F.lit(":page-"), (F.col("i") + 1).cast("string"))
                    .alias("source_id"),
                    F.array().cast("array<string>").alias("topics_hint")))


def by_type(kind: str, frame: DataFrame, **kw) -> DataFrame:
    """A04 router: bookmarks / pdf / text; anything else is an error."""
    if kind == "bookmarks":
        return bookmarks(frame, **kw)
    if kind == "pdf":
        return paged(frame, **kw)
    if kind == "text":
        return text_drop(frame, **kw)
    raise ValueError(f"Unknown source type: {kind}")


def signals_or_none(signals: DataFrame) -> DataFrame | None:
    """A04's early stop: ``None`` when there are no signals (``isEmpty`` reads
    at most one row), so the rest of the build path is not started."""
    return None if signals.isEmpty() else signals
