"""Scalar helper keys (H01-H17) applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.functions import text as T
from deckflow.plans.catalog import register
from deckflow.plans.oracle_text import BOOKMARK_SIGNALS, NL, RESEARCH, fmt_example, fmt_probe, strip, title_from_slug
from deckflow.plans.oracle_views import with_views
from deckflow.sources import bindings as B
from deckflow.sources import signals as S


@register("fn_first_nonempty", """
SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 3 = 0 THEN '' ELSE text END, ''), role) AS v FROM conversations""")
def fn_first_nonempty(spark, sf):
    """H01 ``a or b``: a is the turn's text, emptied on every third turn."""
    c = B.table(spark, sf, "conversations")
    a = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.first_nonempty(a, "role").alias("v"))


@register("fn_strip", f"SELECT page_id, {strip('html')} AS v FROM pages")
def fn_strip(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.py_strip("html").alias("v"))


@register("fn_quote_append", f"""
SELECT conv_id, turn, CASE WHEN coalesce(text, '') <> '' THEN role || {NL} || {NL} || '> ' || text ELSE role END AS v
FROM conversations""")
def fn_quote_append(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.quote_append("role", "text").alias("v"))


@register("fn_title_from_slug", f"""
SELECT o_orderkey, {title_from_slug("lower(replace(o_orderpriority, ' ', '-')) || '-' || CAST(o_orderkey AS VARCHAR) || '-' || o_orderstatus")} AS v
FROM orders""")
def fn_title_from_slug(spark, sf):
    o = B.table(spark, sf, "orders")
    slug = F.concat(F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-"))), F.lit("-"),
                    F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_orderstatus"))
    return o.select("o_orderkey", T.title_from_slug(slug).alias("v"))


@register("fn_truncate", """
SELECT doc_id, substr(text, 1, 1000) AS t1000, substr(text, 1, 300) AS t300, substr(text, 1, 200) || '...' AS t200
FROM documents""")
def fn_truncate(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", T.truncate("text", 1000).alias("t1000"), T.truncate("text", 300).alias("t300"),
                    T.truncate_dots("text", 200).alias("t200"))


@register("fn_card_id", """
SELECT l_orderkey, l_linenumber, printf('%s-%03d', 'order-' || CAST(l_orderkey AS VARCHAR), l_linenumber) AS v,
       least(l_linenumber, 3) AS depth FROM lineitem""")
def fn_card_id(spark, sf):
    """H06 + H07: card file ids and capped depths."""
    li = B.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     T.card_file_id(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")), "l_linenumber").alias("v"),
                     T.depth_cap("l_linenumber").alias("depth"))


@register("fn_depth_cap", "SELECT l_orderkey, l_linenumber, least(l_linenumber, 3) AS depth FROM lineitem")
def fn_depth_cap(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.depth_cap("l_linenumber").alias("depth"))


_EX = "struct_pack(title := CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END, body := l_linestatus)"
_PR = ("struct_pack(question := CAST(CAST(l_shipdate AS DATE) AS VARCHAR), "
       "hint := CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END)")


@register("fn_format_example", f"SELECT l_orderkey, l_linenumber, {fmt_example(_EX)} AS v FROM lineitem")
def fn_format_example(spark, sf):
    li = B.table(spark, sf, "lineitem")
    ex = F.struct(F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("title"),
                  F.col("l_linestatus").alias("body"))
    return li.select("l_orderkey", "l_linenumber", T.format_example(ex).alias("v"))


@register("fn_format_probe", f"SELECT l_orderkey, l_linenumber, {fmt_probe(_PR)} AS v FROM lineitem")
def fn_format_probe(spark, sf):
    li = B.table(spark, sf, "lineitem")
    pr = F.struct(F.col("l_shipdate").cast("date").cast("string").alias("question"),
                  F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("hint"))
    return li.select("l_orderkey", "l_linenumber", T.format_probe(pr).alias("v"))


@register("fn_zip_longest", with_views(RESEARCH) + """
SELECT o_orderkey, CAST(greatest(coalesce(len(examples), 0), coalesce(len(probes), 0)) AS INTEGER) AS n,
       CAST(greatest(coalesce(len(probes), 0) - coalesce(len(examples), 0), 0) AS INTEGER) AS pad_examples,
       CAST(greatest(coalesce(len(examples), 0) - coalesce(len(probes), 0), 0) AS INTEGER) AS pad_probes FROM r""")
def fn_zip_longest(spark, sf):
    """Zip-longest of examples and probes; padding is a null element."""
    r = B.research(spark, sf)
    z = F.arrays_zip(F.coalesce("examples", F.array().cast("array<struct<title:string,body:string>>")).alias("e"),
                     F.coalesce("probes", F.array().cast("array<struct<question:string,hint:string>>")).alias("p"))
    return r.select("o_orderkey", z.alias("z")).select(
        "o_orderkey", F.size("z").alias("n"),
        F.size(F.filter("z", lambda x: x["e"].isNull())).alias("pad_examples"),
        F.size(F.filter("z", lambda x: x["p"].isNull())).alias("pad_probes"))


def _md_body(text):
    """Documents as markdown: every third line (from the first) becomes a heading."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.concat(F.lit("## "), l)).otherwise(l)), "\n")


_SEC_SQL = f"""WITH b AS (
  SELECT doc_id, {NL} || array_to_string(list_transform(string_split(text, {NL}),
         lambda l, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' || l ELSE l END), {NL}) AS body FROM documents),
s AS (SELECT doc_id, list_transform(string_split(body, {NL} || '## ')[2:], lambda x: struct_pack(
         k := {strip("lower(split_part(x, chr(10), 1))")},
         v := {strip("CASE WHEN instr(x, chr(10)) > 0 THEN substr(x, instr(x, chr(10)) + 1) ELSE '' END")})) AS secs
      FROM b),
f AS (SELECT doc_id, list_filter(secs, lambda x, i: x.k <> '' AND NOT list_contains(
         list_transform(secs[i + 1:], lambda y: y.k), x.k)) AS secs FROM s)
SELECT doc_id, CAST(to_json(map_from_entries(secs)) AS VARCHAR) AS sections FROM f"""


@register("fn_sections", _SEC_SQL)
def fn_sections(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.to_json(T.sections_map(_md_body(F.col("text")))).alias("sections"))


@register("fn_repr_list", """
SELECT p_partkey, try(from_json(replace(CASE WHEN p_partkey % 7 = 0 THEN '[''' || p_name || '''s'', ''x'']'
                                        ELSE '[''' || p_name || ''', ''' || p_type || ''']' END, '''', '"'),
                               '["VARCHAR"]')) AS v FROM part""")
def fn_repr_list(spark, sf):
    p = B.table(spark, sf, "part")
    txt = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("['"), F.col("p_name"), F.lit("'s', 'x']"))).otherwise(
        F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_type"), F.lit("']")))
    return p.select("p_partkey", T.repr_list(txt).alias("v"))


@register("fn_stem", r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS v FROM pages")
def fn_stem(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.file_stem("url").alias("v"))


@register("fn_cutoff", "SELECT event_id, CAST(CAST(ts AS DATE) - 3 AS VARCHAR) AS v FROM events")
def fn_cutoff(spark, sf):
    return B.table(spark, sf, "events").select("event_id", T.day_cutoff("ts").cast("string").alias("v"))


@register("fn_pluck", with_views(RESEARCH) + "SELECT o_orderkey, list_transform(connections_discovered, lambda c: c.slug) AS v FROM r")
def fn_pluck(spark, sf):
    return B.research(spark, sf).select("o_orderkey", T.pluck("connections_discovered", "slug").alias("v"))


@register("fn_hint_suffix", with_views(BOOKMARK_SIGNALS) + """
SELECT export_id, CASE WHEN len(topics_hint) > 0 THEN ' (topics: ' || array_to_string(topics_hint, ', ') || ')' ELSE '' END AS v
FROM sig""")
def fn_hint_suffix(spark, sf):
    return S.bookmarks(B.bookmark_exports(spark, sf)).select("export_id", T.hint_suffix("topics_hint").alias("v"))


@register("fn_metadata_json", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{}' ELSE CAST(json(props) AS VARCHAR) END AS v FROM events""")
def fn_metadata_json(spark, sf):
    e = B.table(spark, sf, "events")
    m = F.when(F.col("event_id") % 9 != 0, F.from_json("props", "map<string,bigint>"))
    return e.select("event_id", T.metadata_json(m).alias("v"))
