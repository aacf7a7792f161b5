"""Model responses (A15-A16, research): fenced JSON, shape dispatch, records.

A response is parsed once, to a VARIANT, and read by the shape it has. What has
another shape than a record needs is listed with a reason and ends no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the fence pattern (optional ``json`` tag, body up to the next closing fence).
FENCE = r"```(?:json)?\s*\n([\s\S]*?)\n```"
OPENING, CLOSING = r"```(?:json)?\s*\n", "\n```"

# The fields of a research record and of its lists.
CONCEPT_FIELDS = {"name": "string", "slug": "string", "cluster": "string", "depth": "int", "connections": "array<string>", "description": "string"}
RESEARCH_LISTS = {"examples": ["title", "body"], "probes": ["question", "hint"], "connections_discovered": ["slug", "name", "relationship"]}


def json_text(response) -> Column:
    """Content of the first fence if there is one, else the whole text.

    ``FENCE`` tries its end at every letter of the content, so the fence is found by
    its opening and the first end after it. Without such an end the pattern can match
    only where the end begins in the opening's own line breaks."""
    r = F.col(response) if isinstance(response, str) else response
    opening = F.regexp_extract(r, OPENING, 0)
    rest = F.substring(r, F.instr(r, opening) + F.length(opening), F.length(r))
    edge = F.concat(opening, F.substring(rest, 1, 3))
    return (F.when(opening == "", r).when(F.instr(rest, CLOSING) > 0, F.substring_index(rest, CLOSING, 1))
            .when(F.regexp_like(edge, F.lit(FENCE)), F.regexp_extract(edge, FENCE, 1)).otherwise(r))


def _shape(v: Column) -> Column:
    """ARRAY, OBJECT, VOID (JSON null), a scalar's type, or null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols``, each computed once a row. A filter on a plain column is
    moved below its projection, where every mention of the column is computed anew
    (a response was built, matched and parsed for each field that the filter looks
    at); it isn't moved below ``inline``."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(name) for name, x in cols.items()]))))


def _parsed(df: DataFrame, json_col: str) -> DataFrame:
    return _once(df, v=F.try_parse_json(json_col)).drop(json_col).withColumn("shape", _shape(F.col("v")))


def _listed(df: DataFrame, json_col: str) -> DataFrame:
    """With the response's concepts as ``list`` (VARIANT): an array, the value of
    ``concepts``, or the one object itself."""
    v = _parsed(df, json_col)
    named = F.try_variant_get("v", "$.concepts", "variant")
    one = F.col("shape") == "OBJECT"
    v = v.withColumn("named", F.when(one, named))
    return (v.withColumn("list", F.when(F.col("shape") == "ARRAY", F.col("v")).when(one, F.col("named")))
            .withColumn("wrapped", one & F.col("named").isNull()))


def concepts(df: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per concept, its place in the response as ``idx``. Elements
    that aren't objects are skipped; a field of another type is null."""
    keep = [c for c in df.columns if c != json_col]
    items = F.when(F.col("wrapped"), F.array("v")).when(_shape(F.col("list")) == "ARRAY", F.try_variant_get("list", "$", "array<variant>"))
    rows = _listed(df, json_col).select(*keep, F.posexplode(items).alias("idx", "c")).filter(_shape(F.col("c")) == "OBJECT")
    return rows.select(*keep, "idx", *[F.try_variant_get("c", f"$.{f}", t).alias(f) for f, t in CONCEPT_FIELDS.items()])


def rejects(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Responses without a list of concepts, with the reason."""
    keep = [c for c in df.columns if c != json_col]
    listed = _listed(df, json_col)
    reason = (F.when(F.col("v").isNull(), "not JSON").when(~F.col("shape").isin("ARRAY", "OBJECT"), "no list or object")
              .when(~F.col("wrapped") & (_shape(F.col("list")) != "ARRAY"), "concepts is no list"))
    return _once(listed, reason=reason).select(*keep, "reason").filter("reason is not null")


def _text(v: Column, path: str) -> Column:
    """A string field; null where it is absent."""
    return F.try_variant_get(v, path, "string")


def _record(keys: list[str]):
    """Reads an object of a list as a struct of text fields."""
    def read(x: Column) -> Column:
        return F.struct(*[_text(x, f"$.{k}").alias(k) for k in keys])
    return read


def _research(df: DataFrame, json_col: str) -> DataFrame:
    """With every field read and ``reason`` for what can't be a research record:
    text that is no JSON object, a list field that is no list of objects, a text
    field that is no text."""
    v = _parsed(df, json_col)
    text = {f: F.try_variant_get("v", f"$.{f}", "variant") for f in ("concept", "cluster", "fundamentals")}
    lists = {f: F.try_variant_get("v", f"$.{f}", "variant") for f in RESEARCH_LISTS}
    v = v.select("*", *[x.alias(f"_{f}") for f, x in {**text, **lists}.items()])
    has = lambda f: F.col(f"_{f}").isNotNull() & (_shape(F.col(f"_{f}")) != "VOID")
    items = {f: F.try_variant_get(f"_{f}", "$", "array<variant>") for f in lists}
    bad = [F.when(has(f) & (_shape(F.col(f"_{f}")) != "STRING"), F.lit(f"{f} is no text")) for f in text]
    bad += [F.when(has(f) & ((_shape(F.col(f"_{f}")) != "ARRAY") | F.exists(F.coalesce(items[f], F.array().cast("array<variant>")), lambda x: _shape(x) != "OBJECT")),
                   F.lit(f"{f} is no list of objects")) for f in lists]
    reason = F.coalesce(F.when(F.col("v").isNull(), "not JSON"), F.when(F.col("shape") != "OBJECT", "no object"), *bad)
    fields = [F.when(_shape(F.col(f"_{f}")) == "STRING", _text(F.col("v"), f"$.{f}")).alias(f) for f in text]
    fields += [F.transform(items[f], _record(keys)).alias(f) for f, keys in RESEARCH_LISTS.items()]
    keep = [c for c in df.columns if c != json_col]
    return _once(v, reason=reason).select(*keep, "reason", *fields)


def research(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Research responses as the records that card generation (H21) and the
    concept merge (A13) read: concept, cluster, fundamentals, examples, probes,
    connections_discovered; an absent field is null."""
    return _research(df, json_col).filter("reason is null").drop("reason")


def research_rejects(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Responses that are no research record, with the reason."""
    keep = [c for c in df.columns if c != json_col]
    return _research(df, json_col).filter("reason is not null").select(*keep, "reason")
