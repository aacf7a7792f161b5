"""Ingestion, document and generation keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckflow.operators import cards as cops
from deckflow.operators import generate as gen
from deckflow.operators import upsert as ups
from deckflow.plans import jobs
from deckflow.plans.catalog import register
from deckflow.plans.oracle_text import (BOOKMARK_SIGNALS, CONCEPT_RECORDS, EXISTING, NL, PAGES, RESEARCH,
                                        fmt_example, fmt_probe, js, strip, title_from_slug as tfs)
from deckflow.plans.oracle_views import CARDS, ENGAGEMENT, with_views
from deckflow.sources import bindings as B
from deckflow.sources import documents as D
from deckflow.sources import responses as R
from deckflow.sources import signals as S
from deckflow.streaming.engagement import scratch

AS_OF_DATE = B.AS_OF


# ---- A01-A04 signals ---------------------------------------------------------
@register("signals_bookmarks", with_views(BOOKMARK_SIGNALS) + "SELECT * FROM sig")
def signals_bookmarks(spark, sf):
    return S.bookmarks(B.bookmark_exports(spark, sf))


@register("bookmark_rejects", "SELECT DISTINCT conv_id AS export_id, 'not JSON' AS reason FROM conversations WHERE conv_id % 7 = 0")
def bookmark_rejects(spark, sf):
    """A01's rejects: every seventh export has lost its last character."""
    exports = B.bookmark_exports(spark, sf)
    broken = F.when(F.col("export_id") % 7 == 0, F.expr("left(doc, length(doc) - 1)")).otherwise(F.col("doc"))
    return S.bookmark_rejects(exports.withColumn("doc", broken))


@register("signals_text", f"""SELECT doc_id, {strip('text')} AS text, 'manual' AS source_type, '' AS source_id,
       []::VARCHAR[] AS topics_hint FROM documents""")
def signals_text(spark, sf):
    return S.text_drop(B.table(spark, sf, "documents").select("doc_id", "text"))


@register("signals_pages", with_views(PAGES) + "SELECT * FROM pg")
def signals_pages(spark, sf):
    return S.paged(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@register("signals_by_type", with_views(BOOKMARK_SIGNALS, PAGES) + f"""
SELECT 'bookmarks' AS kind, source_type, source_id, text FROM sig
UNION ALL SELECT 'pdf', source_type, source_id, text FROM pg
UNION ALL SELECT 'text', 'manual', '', {strip('text')} FROM documents""")
def signals_by_type(spark, sf):
    """The router applied to each kind of input, as one signal table."""
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    parts = {"bookmarks": S.by_type("bookmarks", B.bookmark_exports(spark, sf)),
             "pdf": S.by_type("pdf", docs, stem_col="doc_id", text_col="text"),
             "text": S.by_type("text", docs)}
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "source_type", "source_id", "text")
        out = df if out is None else out.unionByName(df)
    return out


# ---- A05-A07, A12, A14 documents ---------------------------------------------
def _card_docs(spark, sf):
    """Rendered card documents; every 50th has lost its front matter."""
    docs = D.render_cards(B.cards(spark, sf, spread=True)).withColumn(
        "_id", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    body_only = F.regexp_extract("content", r"(?s)\n---\n(.*)$", 1)
    return docs.select("path", F.when(F.col("_id") % 50 == 0, body_only).otherwise(F.col("content")).alias("content"))


_RENDER_SQL = f"""'---' || {NL} || 'concept: ' || {js('concept')} || {NL} || 'title: ' || {js('title')} || {NL}
  || 'topic: ' || {js('topic')} || {NL} || 'depth: ' || CAST(depth AS VARCHAR) || {NL}
  || 'connections: ' || CAST(to_json(connections) AS VARCHAR) || {NL}
  || 'source: ' || CAST(to_json(struct_pack(type := source_type, id := source_id)) AS VARCHAR) || {NL}
  || 'created: ' || {js('CAST(created_at AS VARCHAR)')} || {NL} || '---' || {NL} || {NL}
  || '## Idea' || {NL} || {strip('idea')} || {NL} || {NL} || '## Example' || {NL} || {strip('example')} || {NL} || {NL}
  || '## Probe' || {NL} || {strip('probe')} || {NL}"""


@register("cards_render", with_views(CARDS) + f"""
SELECT 'cards/' || CAST(card_id AS VARCHAR) || '.md' AS path, {_RENDER_SQL} AS content FROM cards""")
def cards_render(spark, sf):
    return D.render_cards(B.cards(spark, sf, spread=True))


@register("cards_scan", with_views(CARDS) + f"""
SELECT CAST(card_id AS VARCHAR) AS card_id, concept, title, topic, depth, {strip('idea')} AS idea,
       {strip('example')} AS example, {strip('probe')} AS probe, connections, source_type, source_id,
       'cards/' || CAST(card_id AS VARCHAR) || '.md' AS file_path, CAST(created_at AS VARCHAR) AS created_at
FROM cards WHERE card_id % 50 <> 0""")
def cards_scan(spark, sf):
    """Render every card, parse the documents back (round trip)."""
    return D.parse_cards(_card_docs(spark, sf), AS_OF_DATE).withColumn("created_at", F.col("created_at").cast("string"))


@register("card_rejects", with_views(CARDS) + """
SELECT 'cards/' || CAST(card_id AS VARCHAR) || '.md' AS path FROM cards WHERE card_id % 50 = 0""")
def card_rejects(spark, sf):
    return D.card_rejects(_card_docs(spark, sf))


_CONCEPTS_SQL = with_views(CARDS) + """,
e AS (SELECT DISTINCT concept, unnest(connections) AS "to" FROM cards),
cc AS (SELECT concept, list(struct_pack("to" := "to", weight := 1.0::DOUBLE, relationship := '') ORDER BY "to") AS connections
       FROM e GROUP BY concept),
base AS (SELECT concept, min(topic) AS cluster, min(depth) AS depth FROM cards GROUP BY concept),
fields AS (SELECT *, 'All of: "' || concept || '"' || chr(10) || '# ' || cluster AS description,
  CASE WHEN n % 4 <> 0 THEN day END AS created, CASE WHEN n % 3 <> 0 THEN CAST(day + 3 AS DATE) END AS updated
  FROM (SELECT *, CAST(substr(concept, 7) AS INTEGER) AS n, CAST(DATE '2024-01-01' + CAST(substr(concept, 7) AS INTEGER) % 28 AS DATE) AS day FROM base))
"""


def _concepts(spark, sf):
    c = cops.concepts_from_cards(B.cards(spark, sf))
    n = F.substring("concept", 7, 10).cast("int")
    day = F.date_add(F.lit("2024-01-01").cast("date"), n % 28)
    return (c.withColumn("name", F.concat(F.lit("Concept "), F.col("concept")))
            .withColumn("description", F.concat(F.lit("All of: \""), F.col("concept"), F.lit("\"\n# "), F.col("cluster")))
            .withColumn("created", F.when(n % 4 != 0, day)).withColumn("updated", F.when(n % 3 != 0, F.date_add(day, 3))))


@register("concepts_scan", _CONCEPTS_SQL + """
SELECT b.concept, CASE WHEN CAST(substr(b.concept, 7) AS INTEGER) % 5 = 0 THEN b.concept
                      ELSE 'Concept ' || b.concept END AS name, b.cluster, b.depth,
       CAST(to_json(cc.connections) AS VARCHAR) AS connections, description,
       CAST(coalesce(created, DATE '2024-01-31') AS VARCHAR) AS created, CAST(coalesce(updated, created, DATE '2024-01-31') AS VARCHAR) AS updated
FROM fields b JOIN cc ON cc.concept = b.concept""")
def concepts_scan(spark, sf):
    """Concept documents (every fifth without a name line) parsed back."""
    c = _concepts(spark, sf)
    docs = D.render_concepts(c, with_name=F.substring("concept", 7, 10).cast("int") % 5 != 0)
    return (D.parse_concepts(docs, AS_OF_DATE).withColumn("connections", F.to_json("connections"))
            .withColumn("created", F.col("created").cast("string")).withColumn("updated", F.col("updated").cast("string")))


@register("cards_export", with_views(CARDS) + """
SELECT card_id, CAST(to_json(struct_pack(id := card_id, concept := concept, title := title, topic := topic,
       depth := depth, connections := connections, idea := idea, example := example, probe := probe)) AS VARCHAR) AS json
FROM cards""")
def cards_export(spark, sf):
    return D.export_json(B.cards(spark, sf))


# ---- A08-A10 upserts / appends -----------------------------------------------
@register("cards_upsert", with_views(CARDS) + """
SELECT card_id, CASE WHEN card_id % 2 = 0 THEN upper(title) ELSE title END AS title
FROM cards WHERE card_id % 3 <> 0 OR card_id % 2 = 0""")
def cards_upsert(spark, sf):
    """Two versions of a bucketed snapshot; the second names each card
    twice, and the later row counts."""
    c = B.cards(spark, sf)
    old = c.filter(F.col("card_id") % 3 != 0).select("card_id", "title")
    new = c.filter(F.col("card_id") % 2 == 0).select("card_id", F.upper("title").alias("title"))
    twice = new.withColumn(ups.SEQ, F.lit(2)).unionByName(new.withColumn("title", F.lower("title")).withColumn(ups.SEQ, F.lit(1)))
    base = scratch(spark, "cards")
    ups.upsert_buckets(old, base, "card_id", 1, buckets=16)
    ups.upsert_buckets(twice, base, "card_id", 2, buckets=16)
    return ups.read_snapshot(spark, base)


@register("concepts_upsert", _CONCEPTS_SQL + """
SELECT concept, CASE WHEN n % 2 = 0 THEN lower(cluster) ELSE cluster END AS cluster, CASE WHEN n % 2 = 0 THEN 'new: ' || concept ELSE description END AS description,
       CAST(created AS VARCHAR) AS created, CAST(CASE WHEN n % 2 = 0 THEN DATE '2024-01-31' ELSE updated END AS VARCHAR) AS updated
FROM fields""")
def concepts_upsert(spark, sf):
    """Concept records with all fields, every second one replaced."""
    c = _concepts(spark, sf).select("concept", "cluster", "description", "created", "updated")
    new = c.filter(F.substring("concept", 7, 10).cast("int") % 2 == 0).select(
        "concept", F.lower("cluster").alias("cluster"), F.concat(F.lit("new: "), F.col("concept")).alias("description"), "created",
        F.lit(AS_OF_DATE).cast("date").alias("updated"))
    base = scratch(spark, "concepts")
    ups.upsert_buckets(c, base, "concept", 1, buckets=16)
    ups.upsert_buckets(new, base, "concept", 2, buckets=16)
    return ups.read_snapshot(spark, base).withColumn("created", F.col("created").cast("string")).withColumn("updated", F.col("updated").cast("string"))


@register("engagement_append", with_views(ENGAGEMENT) + f"""
SELECT id, user_id, card_id, event, CASE WHEN id % 4 = 0 THEN 0 ELSE duration_ms END AS duration_ms,
       CASE WHEN id % 5 = 0 THEN '{{}}' ELSE metadata END AS metadata,
       CAST(CASE WHEN id % 7 = 0 THEN TIMESTAMP '{B.AS_OF} 00:00:00' ELSE created_at END AS VARCHAR) AS created_at
FROM engagement""")
def engagement_append(spark, sf):
    """A10: requests with missing duration / metadata / time get the defaults and
    are appended to the day-partitioned log; a third of them is sent again."""
    e = B.engagement(spark, sf)
    req = e.select("id", "user_id", "card_id", "event",
                   F.when(F.col("id") % 4 != 0, F.col("duration_ms")).alias("duration_ms"),
                   F.when(F.col("id") % 5 != 0, F.col("metadata")).alias("metadata"),
                   F.when(F.col("id") % 7 != 0, F.col("created_at")).alias("created_at"))
    out, log = ups.normalise_events(req, f"{B.AS_OF} 00:00:00"), scratch(spark, "events")
    ups.append_events(out, log)
    ups.append_events(out.filter(F.col("id") % 3 == 0), log)
    return spark.read.schema(out.schema).parquet(log).select(*out.columns).withColumn("created_at", F.col("created_at").cast("string"))


# ---- A15-A17 responses / scans ------------------------------------------------
_FENCE_SQL = "'" + R.FENCE + "'"
_RESP_SQL = f"""WITH resp AS (SELECT event_id AS response_id,
  CASE WHEN event_id % 2 = 0 THEN 'x' || {NL} || '```json' || {NL} || props || {NL} || '```' ELSE props END AS response
  FROM events),
j AS (SELECT response_id, CASE WHEN regexp_matches(response, {_FENCE_SQL})
                               THEN regexp_extract(response, {_FENCE_SQL}, 1) ELSE response END AS json FROM resp)
"""


@register("llm_json_extract", _RESP_SQL + "SELECT response_id, json, json_extract_string(json, '$.k') AS k FROM j")
def llm_json_extract(spark, sf):
    r = B.responses(spark, sf).select("response_id", R.json_text("response").alias("json"))
    return r.withColumn("k", F.get_json_object("json", "$.k"))


@register("concepts_extracted", with_views(CONCEPT_RECORDS) + r""",
k AS (SELECT *, CAST(regexp_extract(slug, '(\d+)$', 1) AS BIGINT) AS key FROM cr),
n AS (SELECT *, key // 4 AS response_id, CAST(row_number() OVER (PARTITION BY key // 4 ORDER BY key) - 1 AS INTEGER) AS idx FROM k)
SELECT response_id, idx, name, slug, cluster, depth, connections, description FROM n
WHERE response_id % 4 < 2 OR (response_id % 4 = 2 AND idx = 0)""")
def concepts_extracted(spark, sf):
    """A16 over all three shapes, fenced and bare; broken texts give no rows."""
    r = B.concept_responses(spark, sf).select("response_id", R.json_text("response").alias("json"))
    return R.concepts(r).select("response_id", "idx", "name", "slug", "cluster", "depth", "connections", "description")


@register("concept_rejects", with_views(CONCEPT_RECORDS) + r"""
SELECT DISTINCT CAST(regexp_extract(slug, '(\d+)$', 1) AS BIGINT) // 4 AS response_id, 'not JSON' AS reason FROM cr
WHERE CAST(regexp_extract(slug, '(\d+)$', 1) AS BIGINT) // 4 % 4 = 3""")
def concept_rejects(spark, sf):
    """Responses without concepts."""
    return R.rejects(B.concept_responses(spark, sf).select("response_id", R.json_text("response").alias("json")))


@register("research_records", with_views(RESEARCH) + """
SELECT o_orderkey AS seq, concept, cluster, fundamentals, CAST(to_json(examples) AS VARCHAR) AS examples, CAST(to_json(probes) AS VARCHAR) AS probes,
       list_transform(connections_discovered, lambda c: c.slug || ':' || c.relationship) AS links
FROM r WHERE o_orderkey % 6 NOT IN (3, 4)""")
def research_records(spark, sf):
    """Research responses to records."""
    r = B.research_responses(spark, sf).select(F.col("_seq").alias("seq"), R.json_text("response").alias("json"))
    return R.research(r).select("seq", "concept", "cluster", "fundamentals", F.to_json("examples").alias("examples"), F.to_json("probes").alias("probes"),
                                F.transform("connections_discovered", lambda c: F.concat(c["slug"], F.lit(":"), c["relationship"])).alias("links"))


@register("research_rejects", with_views(RESEARCH) + """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 6 = 3 THEN 'not JSON' ELSE 'examples is no list of objects' END AS reason
FROM r WHERE o_orderkey % 6 IN (3, 4)""")
def research_rejects(spark, sf):
    r = B.research_responses(spark, sf).select(F.col("_seq").alias("seq"), R.json_text("response").alias("json"))
    return R.research_rejects(r)


@register("engagement_scan", with_views(ENGAGEMENT) + """
SELECT id, user_id, card_id, event, json_extract_string(metadata, '$.k') AS k FROM engagement""")
def engagement_scan(spark, sf):
    e = B.engagement(spark, sf)
    return e.select("id", "user_id", "card_id", "event", F.get_json_object("metadata", "$.k").alias("k"))


# ---- generation -----------------------------------------------------------------
@register("research_prompts", with_views(CONCEPT_RECORDS) + f"""
SELECT slug, 'Research this concept deeply:' || {NL} || {NL} || 'Name: ' || coalesce(name, '') || {NL}
  || 'Slug: ' || coalesce(slug, '') || {NL} || 'Cluster: ' || coalesce(cluster, '') || {NL}
  || 'Description: ' || coalesce(description, '') || {NL}
  || 'Known connections: [' || array_to_string(list_transform(connections, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'
  || {NL} || {NL} || 'Produce teaching material at multiple depth levels.' AS prompt
FROM cr""")
def research_prompts(spark, sf):
    return gen.research_prompts(B.concept_records(spark, sf))


@register("cluster_carry", with_views(RESEARCH, CONCEPT_RECORDS) + """
SELECT r.concept, CASE WHEN r.cluster IS NULL THEN coalesce(cr.cluster, '') ELSE r.cluster END AS cluster
FROM r LEFT JOIN cr ON cr.slug = r.concept""")
def cluster_carry(spark, sf):
    return gen.cluster_carry(B.research(spark, sf), B.concept_records(spark, sf)).select("concept", "cluster")


_GEN_SQL = with_views(RESEARCH) + f""",
g AS (SELECT o_orderkey AS seq, coalesce(concept, 'unknown') AS slug, coalesce(cluster, '') AS topic, coalesce(fundamentals, '') AS fund,
             examples AS ex, probes AS pr, coalesce(len(examples), 0) AS nex, coalesce(len(probes), 0) AS npr,
             list_transform(connections_discovered, lambda c: c.slug) AS connections FROM r),
c1 AS (SELECT seq, slug, topic, connections, 1 AS num, {tfs('slug')} AS title, 1 AS depth, fund AS idea,
              CASE WHEN nex > 0 THEN {fmt_example('ex[1]')} ELSE '' END AS example,
              CASE WHEN npr > 0 THEN {fmt_probe('pr[1]')} ELSE '' END AS probe FROM g),
z AS (SELECT seq, slug, topic, connections, fund, ex, pr, unnest(range(1, greatest(nex, npr))) AS i FROM g),
cn AS (SELECT seq, slug, topic, connections, CAST(i + 1 AS INTEGER) AS num,
              coalesce(ex[i + 1].title, {tfs('slug')} || ' — Angle ' || CAST(i + 1 AS VARCHAR)) AS title,
              least(i + 1, 3) AS depth, substr(fund, 1, 200) || '...' AS idea,
              {fmt_example('ex[i + 1]')} AS example, {fmt_probe('pr[i + 1]')} AS probe FROM z),
allc AS (SELECT * FROM c1 UNION ALL SELECT * FROM cn)
SELECT printf('%s-%03d', slug, num) AS card_id, slug AS concept, title, topic, CAST(depth AS INTEGER) AS depth,
       idea, example, probe, connections, 'pipeline' AS source_type, '' AS source_id, '{B.AS_OF}' AS created_at
FROM allc QUALIFY row_number() OVER (PARTITION BY slug, num ORDER BY seq DESC) = 1"""


@register("generate_cards", _GEN_SQL)
def generate_cards(spark, sf):
    return gen.generate_cards(B.research_refs(spark, sf), B.AS_OF, B.research_texts(spark, sf)).withColumn("created_at", F.col("created_at").cast("string"))


@register("concept_merge", with_views(RESEARCH, EXISTING) + f""",
n AS (SELECT concept AS slug, (SELECT arg_min(x.cluster, x.o_orderkey) FROM r x WHERE x.concept = r.concept AND x.cluster <> '') AS n_cluster, substr(coalesce(fundamentals, ''), 1, 300) AS n_desc,
             list_transform(connections_discovered, lambda c: struct_pack("to" := c.slug, weight := 1.0::DOUBLE,
                            relationship := coalesce(c.relationship, ''))) AS n_conn
      FROM r QUALIFY row_number() OVER (PARTITION BY concept ORDER BY o_orderkey DESC) = 1)
SELECT coalesce(n.slug, ex.slug) AS slug,
       CASE WHEN n.slug IS NOT NULL THEN coalesce(nullif(ex.name, ''), {tfs('n.slug')}) ELSE ex.name END AS name,
       CASE WHEN n.slug IS NOT NULL THEN coalesce(nullif(ex.cluster, ''), n.n_cluster, '') ELSE ex.cluster END AS cluster,
       CASE WHEN n.slug IS NOT NULL THEN coalesce(ex.depth, 1) ELSE ex.depth END AS depth,
       CASE WHEN n.slug IS NOT NULL THEN n.n_desc ELSE ex.description END AS description,
       CAST(to_json(CASE WHEN n.slug IS NOT NULL THEN n.n_conn ELSE [] END) AS VARCHAR) AS connections,
       CAST(CASE WHEN n.slug IS NOT NULL THEN coalesce(ex.created, DATE '{B.AS_OF}') ELSE ex.created END AS VARCHAR) AS created,
       CAST(CASE WHEN n.slug IS NOT NULL THEN DATE '{B.AS_OF}' ELSE ex.created END AS VARCHAR) AS updated
FROM n FULL OUTER JOIN ex ON ex.slug = n.slug""")
def concept_merge(spark, sf):
    m = gen.concept_merge(B.research(spark, sf), B.existing_concepts(spark, sf), B.AS_OF)
    return (m.withColumn("created", F.col("created").cast("string")).withColumn("updated", F.col("updated").cast("string"))
            .withColumn("connections", F.to_json("connections")))


@register("prompt_blocks", with_views(BOOKMARK_SIGNALS) + f""",
n AS (SELECT *, row_number() OVER (ORDER BY export_id, idx) AS rn FROM sig)
SELECT CAST((rn - 1) // 10 AS BIGINT) AS batch,
       string_agg('[' || CAST((rn - 1) % 10 + 1 AS VARCHAR) || '] ' || substr(text, 1, 1000)
                  || CASE WHEN len(topics_hint) > 0 THEN ' (topics: ' || array_to_string(topics_hint, ', ') || ')' ELSE '' END,
                  {NL} || {NL} ORDER BY rn) AS block
FROM n GROUP BY (rn - 1) // 10""")
def prompt_blocks(spark, sf):
    """Bookmark signals in export order, ten per prompt block."""
    return gen.prompt_blocks(S.bookmarks(B.bookmark_exports(spark, sf)), ["export_id", "idx"], 10)


@register("build_job", with_views(BOOKMARK_SIGNALS) + """,
b AS (SELECT unnest(range((count(*) + 9) // 10)) AS batch FROM sig),
c AS (SELECT DISTINCT 'batch-' || CAST(batch % 50 AS VARCHAR) AS slug FROM b WHERE batch % 5 <> 4)
SELECT 'signals' AS stage, count(*) AS n FROM sig UNION ALL SELECT 'prompt_blocks', count(*) FROM b UNION ALL SELECT 'concepts', count(*) FROM c
UNION ALL SELECT 'concept_rejects', count(*) FROM b WHERE batch % 5 = 4 UNION ALL SELECT 'research', count(*) FROM c UNION ALL SELECT 'research_rejects', 0
UNION ALL SELECT 'cards', CAST(sum(1 + len(slug) % 3) AS BIGINT) FROM c UNION ALL SELECT 'indexed', CAST(sum(1 + len(slug) % 3) AS BIGINT) FROM c""")
def build_job(spark, sf):
    """The build path over all bookmark signals: rows of every stage."""
    counts = jobs.build(spark, S.bookmarks(B.bookmark_exports(spark, sf)), ["export_id", "idx"], B.answer_concepts, B.answer_research, scratch(spark, "build"), B.AS_OF)
    return counts.filter(F.col("stage") != "terms")
