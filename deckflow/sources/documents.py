"""Card and concept documents.

A card document is front matter between ``---`` lines followed by ``## Idea``,
``## Example`` and ``## Probe`` sections. The front matter read here: a
``key: value`` per line, the value plain, in single or in double quotes, a flow
list or map with or without quotes (``[a, b]``, ``{to: a, weight: 0.8}``), or a
block list or map on the indented lines below; values go on over indented lines,
comments are left out. ``render_cards`` writes the JSON form of the same. No
general YAML (anchors, tags, block scalars, deeper nesting). A list or map that
doesn't parse is empty and named by ``document_errors``. Parsing is column
expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.functions.text import file_stem, py_strip, sections_map

# Fixed value: the card document pattern (front matter, then body), dot-all.
FRONT = r"(?s)^---\n(.+?)\n---\n(.+)"


def _js(c: Column) -> Column:
    """A JSON string literal of ``c`` (quotes, backslashes and control chars escaped)."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))


DQ, SQ = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"'[^']*+(?:''[^']*+)*+'"
# Parts of a flow value: quoted text, punctuation, plain text (a colon inside it has no space after it, one after quotes ends a key).
FLOW_PART = rf"""{DQ}|{SQ}|[\[\]{{}},]|:(?=[\s"'\[\]{{}},]|$)|(?<=["']):|[^\s\[\]{{}},"'][^\[\]{{}},:]*+(?::(?=[^\s\[\]{{}},])[^\[\]{{}},:]*+)*+"""


def _key(meta: Column, key: str) -> Column:
    """Raw text after ``key:``, further indented lines and list lines included; null when the key is absent."""
    raw = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*(.*(?:\n(?:[ \t]+|-[ \t]).*)*+)", 1)
    return F.when(F.regexp_like(meta, F.lit(rf"(?m)^{key}:")), F.regexp_replace(raw, r"[ \t]+$", ""))


# One entry of the front matter: its key, then its raw text with all further indented and list lines.
ENTRY = r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*(?:\n(?:[ \t]+|-[ \t]).*)*+)"


def _entries(docs: DataFrame, meta: Column) -> DataFrame:
    """With the entries of the front matter as ``_k`` and ``_v``: it is read once,
    whatever the number of keys that are looked up."""
    return docs.withColumn("_k", F.regexp_extract_all(meta, F.lit(ENTRY), 1)).withColumn("_v", F.regexp_extract_all(meta, F.lit(ENTRY), 2))


def _entry(key: str) -> Column:
    """As ``_key``, from the entries."""
    at = F.array_position("_k", key)
    return F.when(at > 0, F.rtrim(F.get("_v", (at - 1).cast("int")), F.lit(" \t")))


def _unquote(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part, r"^'|'$", ""), "''", "'")


def _scalar(raw: Column) -> Column:
    """A scalar: double quotes are decoded as JSON, single ones taken off, a
    plain one is kept without its comment; ``null``, ``~`` and nothing are null."""
    line = F.regexp_replace(raw, r"[ \t]*\n[ \t]*", " ")
    plain = F.regexp_replace(line, r"(^|[ \t]+)#.*$", "")
    return (F.when(line.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_extract(line, f"^{DQ}", 0), F.lit("}")), "$.v"))
            .when(line.startswith("'"), _unquote(F.regexp_extract(line, f"^{SQ}", 0)))
            .when(~plain.isin("", "~", "null"), plain))


def _flow(raw: Column) -> Column:
    """A list or map, flow or block, as JSON text."""
    clean = F.regexp_replace(raw, r"(?m)(^|[ \t]+)#[^\"'\n]*$", "")

    def pairs(lines: Column) -> Column:
        return F.concat(F.lit("{"), F.regexp_replace(lines, r"[ \t]*\n[ \t]*", ", "), F.lit("}"))

    def item(x: Column) -> Column:
        one = F.regexp_replace(x, r"\s+$", "")
        return F.when(F.regexp_like(one, F.lit(r"^[\[{\"']")), one).when(F.regexp_like(one, F.lit(r"^\w+:\s")), pairs(one)).otherwise(_js(one))

    items = F.transform(F.filter(F.split(clean, r"(?:^|\n)[ \t]*-[ \t]+"), lambda x, i: i > 0), item)
    flow = (F.when(F.regexp_like(clean, F.lit(r"^\s*\n[ \t]*-[ \t]")), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
            .when(F.regexp_like(clean, F.lit(r"^\s*\n[ \t]+\w+:")), pairs(F.regexp_replace(clean, r"^\s+|\s+$", "")))
            .otherwise(F.regexp_replace(clean, r"\s*\n\s*", " ")))
    part = lambda t: (F.when(F.regexp_like(t, F.lit(r"^(?:\"|[\[\]{},:]$|-?\d+(?:\.\d+)?$|null$|true$|false$)")), t)
                      .when(t == "~", F.lit("null")).when(t.startswith("'"), _js(_unquote(t))).otherwise(_js(t)))
    return F.array_join(F.transform(F.regexp_extract_all(flow, F.lit(FLOW_PART), 0), lambda t: part(F.regexp_replace(t, r"\s+$", ""))), "")


def render_cards(cards: DataFrame) -> DataFrame:
    """Card rows -> (path, content) documents; bodies stripped."""
    src = F.to_json(F.struct(F.col("source_type").alias("type"), F.col("source_id").alias("id")))
    meta = F.concat_ws("\n",
                       F.concat(F.lit("concept: "), _js(F.col("concept"))),
                       F.concat(F.lit("title: "), _js(F.col("title"))),
                       F.concat(F.lit("topic: "), _js(F.col("topic"))),
                       F.concat(F.lit("depth: "), F.col("depth").cast("string")),
                       F.concat(F.lit("connections: "), F.to_json(F.coalesce("connections", F.array().cast("array<string>")))),
                       F.concat(F.lit("source: "), src),
                       F.concat(F.lit("created: "), _js(F.col("created_at").cast("string"))))
    body = F.concat_ws("\n", F.lit("## Idea"), py_strip("idea"), F.lit(""), F.lit("## Example"),
                       py_strip("example"), F.lit(""), F.lit("## Probe"), py_strip("probe"), F.lit(""))
    return cards.select(F.concat(F.lit("cards/"), F.col("card_id").cast("string"), F.lit(".md")).alias("path"),
                        F.concat_ws("\n", F.lit("---"), meta, F.lit("---"), F.lit(""), body).alias("content"))


def parse_cards(docs: DataFrame, as_of: str) -> DataFrame:
    """(path, content) -> card rows; documents without front matter are
    skipped (see ``card_rejects``). Defaults: topic '', depth 1,
    connections [], source '' unless a map, created = as_of."""
    content = F.regexp_replace("content", "\r\n", "\n")
    # stage 1: split each document once (kept as columns, so the document
    # regex is not re-evaluated for every key below)
    split = (docs.filter(F.regexp_like(content, F.lit(FRONT)))
             .select("path", F.regexp_extract(content, FRONT, 1).alias("_meta"),
                     F.regexp_extract(content, FRONT, 2).alias("_body")))
    split = _entries(split, F.col("_meta"))
    sec = sections_map(F.col("_body"))
    src_json = _flow(_entry("source"))
    src = F.when(src_json.startswith("{"), F.from_json(src_json, "struct<type:string,id:string>"))
    conns = _flow(_entry("connections"))
    return (split
            .select(
                file_stem("path").alias("card_id"),
                F.coalesce(_scalar(_entry("concept")), F.lit("")).alias("concept"),
                F.coalesce(_scalar(_entry("title")), F.lit("")).alias("title"),
                F.coalesce(_scalar(_entry("topic")), F.lit("")).alias("topic"),
                F.coalesce(_scalar(_entry("depth")).try_cast("int"), F.lit(1)).alias("depth"),
                F.coalesce(sec["idea"], F.lit("")).alias("idea"),
                F.coalesce(sec["example"], F.lit("")).alias("example"),
                F.coalesce(sec["probe"], F.lit("")).alias("probe"),
                F.coalesce(F.from_json(conns, "array<string>"), F.array().cast("array<string>")).alias("connections"),
                F.coalesce(src["type"], F.lit("")).alias("source_type"),
                F.coalesce(src["id"], F.lit("")).alias("source_id"),
                F.col("path").alias("file_path"),
                F.coalesce(_scalar(_entry("created")).try_cast("date"), F.lit(as_of).cast("date")).alias("created_at")))


def card_rejects(docs: DataFrame) -> DataFrame:
    """Documents that do not match the front-matter pattern."""
    return docs.filter(~F.regexp_like(F.regexp_replace("content", "\r\n", "\n"), F.lit(FRONT))).select("path")


def document_errors(docs: DataFrame) -> DataFrame:
    """``(path, key, value)``: lists, maps and numbers that were given but
    don't parse, of card or concept documents."""
    c = F.regexp_replace("content", "\r\n", "\n")
    meta = F.when(F.regexp_like(c, F.lit(FRONT)), F.regexp_extract(c, FRONT, 1)).otherwise(c)
    at = docs.select("path", meta.alias("_meta"))
    conns, depth = _key(F.col("_meta"), "connections"), _key(F.col("_meta"), "depth")
    given = lambda raw: raw.isNotNull() & ~F.trim(raw).isin("", "~", "null")
    bad = F.array(F.struct(F.lit("connections").alias("key"), conns.alias("value"), (given(conns) & (F.json_array_length(_flow(conns)).isNull())).alias("bad")),
                  F.struct(F.lit("depth").alias("key"), depth.alias("value"), (given(depth) & _scalar(depth).try_cast("int").isNull()).alias("bad")))
    return at.select("path", F.inline(bad)).filter("bad").select("path", "key", "value")


CONN = "array<struct<to:string,weight:double,relationship:string>>"


def render_concepts(concepts: DataFrame, with_name: Column | None = None) -> DataFrame:
    """Concept records -> (path, content) YAML documents (JSON flow values)."""
    name_line = F.concat(F.lit("name: "), _js(F.col("name")))
    if with_name is not None:
        name_line = F.when(with_name, name_line)
    body = F.concat_ws("\n", name_line,
                       F.concat(F.lit("slug: "), _js(F.col("concept"))),
                       F.concat(F.lit("cluster: "), _js(F.col("cluster"))),
                       F.concat(F.lit("depth: "), F.col("depth").cast("string")),
                       *[F.concat(F.lit("description: "), _js(F.col("description"))) for c in ["description"] if c in concepts.columns],
                       F.concat(F.lit("connections: "), F.to_json(F.coalesce("connections", F.array().cast(CONN)))),
                       *[F.concat(F.lit(f"{c}: "), _js(F.col(c).cast("string"))) for c in ("created", "updated") if c in concepts.columns],
                       F.lit(""))
    return concepts.select(F.concat(F.lit("concepts/"), F.col("concept"), F.lit(".yaml")).alias("path"),
                           body.alias("content"))


def parse_concepts(docs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Concept documents -> rows; name defaults to the file stem,
    cluster '', depth 1, connections [], description '', created ``as_of``,
    updated the same day as created."""
    c = F.regexp_replace("content", "\r\n", "\n")
    stem = file_stem("path")
    return _entries(docs, c).select(
        stem.alias("concept"),
        F.coalesce(_scalar(_entry("name")), stem).alias("name"),
        F.coalesce(_scalar(_entry("cluster")), F.lit("")).alias("cluster"),
        F.coalesce(_scalar(_entry("depth")).try_cast("int"), F.lit(1)).alias("depth"),
        F.coalesce(F.from_json(_flow(_entry("connections")), CONN), F.array().cast(CONN)).alias("connections"),
        F.coalesce(_scalar(_entry("description")), F.lit("")).alias("description"),
        F.coalesce(_scalar(_entry("created")).try_cast("date"), F.lit(as_of).cast("date")).alias("created"),
        F.coalesce(_scalar(_entry("updated")).try_cast("date"), _scalar(_entry("created")).try_cast("date"), F.lit(as_of).cast("date")).alias("updated"))


def export_json(cards: DataFrame) -> DataFrame:
    """The nine exported card columns as one JSON text per card."""
    return cards.select("card_id", F.to_json(F.struct(
        F.col("card_id").alias("id"), "concept", "title", "topic", "depth", "connections",
        "idea", "example", "probe")).alias("json"))
