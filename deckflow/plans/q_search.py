"""Search keys (B08-B17) over the stored index of the documents corpus."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from deckflow.operators import search as S
from deckflow.operators.index import open_index
from deckflow.plans.catalog import register
from deckflow.plans.oracle_views import CORPUS, with_views
from deckflow.sources import bindings as B

POST_SQL = with_views(CORPUS, r"""post AS (
  SELECT card_id, field, CAST(pos - 1 AS INTEGER) AS pos, tok AS token FROM (
    SELECT card_id, field, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
      SELECT card_id, field, regexp_extract_all(strip_accents(lower(val)), '[\p{L}\p{N}]+') AS toks FROM (
        SELECT card_id, 'id' AS field, CAST(card_id AS VARCHAR) AS val FROM corpus
        UNION ALL SELECT card_id, 'title', title FROM corpus
        UNION ALL SELECT card_id, 'topic', topic FROM corpus
        UNION ALL SELECT card_id, 'idea', idea FROM corpus
        UNION ALL SELECT card_id, 'example', example FROM corpus
        UNION ALL SELECT card_id, 'probe', probe FROM corpus))))""")


def _index(spark, sf):
    """The stored index of this folder's documents (built by whoever asks first)."""
    return open_index(B.search_corpus(spark, sf), hashlib.sha256(sf.encode()).hexdigest()[:16])


def _post(spark, sf):
    return _index(spark, sf).postings


@register("search_postings", POST_SQL + "SELECT card_id, field, pos, token FROM post")
def search_postings(spark, sf):
    return _post(spark, sf).select("card_id", "field", "pos", "token")


@register("search_terms_all", POST_SQL + """
SELECT c.card_id, c.title, c.topic, c.idea, c.example, c.probe FROM corpus c WHERE c.card_id IN (
  SELECT card_id FROM post WHERE token IN ('in', 'the') GROUP BY card_id HAVING count(DISTINCT token) = 2)
ORDER BY c.card_id LIMIT 20""")
def search_terms_all(spark, sf):
    """``in the`` (implicit AND), first 20 by card_id."""
    hits = S.all_terms(_post(spark, sf), ["in", "the"])
    return S.first_cards(hits, B.search_corpus(spark, sf))


@register("search_any", POST_SQL + "SELECT DISTINCT card_id FROM post WHERE token IN ('that', 'this')")
def search_any(spark, sf):
    return S.any_terms(_post(spark, sf), ["that", "this"])


@register("search_not", POST_SQL + """
SELECT DISTINCT card_id FROM post WHERE token = 'the'
EXCEPT SELECT DISTINCT card_id FROM post WHERE token = 'of'""")
def search_not(spark, sf):
    return S.not_terms(_post(spark, sf), ["the"], ["of"])


@register("search_phrase", POST_SQL + """
SELECT DISTINCT a.card_id FROM post a JOIN post b
  ON a.card_id = b.card_id AND a.field = b.field AND b.pos = a.pos + 1
WHERE a.token = 'of' AND b.token = 'the'""")
def search_phrase(spark, sf):
    return S.phrase(_post(spark, sf), ["of", "the"])


@register("search_phrase_repeat", POST_SQL + """
SELECT DISTINCT a.card_id FROM post a JOIN post b
  ON a.card_id = b.card_id AND a.field = b.field AND b.pos = a.pos + 1
WHERE a.token = 'the' AND b.token = 'the'""")
def search_phrase_repeat(spark, sf):
    """B12 with a repeated word ("the the")."""
    return S.phrase(_post(spark, sf), ["the", "the"])


@register("search_prefix", POST_SQL + "SELECT DISTINCT card_id FROM post WHERE starts_with(token, 'th')")
def search_prefix(spark, sf):
    return S.prefix(_post(spark, sf), "th")


@register("search_field", POST_SQL + """
SELECT DISTINCT card_id FROM post WHERE field IN ('topic', 'idea') AND token = 'en'""")
def search_field(spark, sf):
    return S.in_fields(_post(spark, sf), ["topic", "idea"], "en")


@register("search_near", POST_SQL + """
SELECT DISTINCT a.card_id FROM post a JOIN post b ON a.card_id = b.card_id AND a.field = b.field
WHERE a.token = 'in' AND b.token = 'that' AND abs(a.pos - b.pos) <= 3""")
def search_near(spark, sf):
    """NEAR(in that, 2)."""
    return S.near(_post(spark, sf), ["in", "that"], 2)


@register("search_near_three", POST_SQL + """
SELECT DISTINCT a.card_id FROM post a JOIN post b ON a.card_id = b.card_id AND a.field = b.field
JOIN post c ON a.card_id = c.card_id AND a.field = c.field
WHERE a.token = 'in' AND b.token = 'the' AND c.token = 'of'
  AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 5""")
def search_near_three(spark, sf):
    """NEAR(in the of the, 4): three different words, one named twice."""
    return S.near(_post(spark, sf), ["in", "the", "of", "the"], 4)


@register("search_initial", POST_SQL + "SELECT DISTINCT card_id FROM post WHERE pos = 0 AND token = 'the'")
def search_initial(spark, sf):
    return S.initial(_post(spark, sf), "the")


BATCH_SQL = POST_SQL.rstrip("\n") + r""",
qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token
       FROM benchmark),
nq AS (SELECT qid, count(*) AS n FROM qt GROUP BY qid),
dt AS (SELECT DISTINCT card_id, token FROM post),
m AS (SELECT qt.qid, dt.card_id, count(*) AS k FROM qt JOIN dt ON dt.token = qt.token GROUP BY qt.qid, dt.card_id)
SELECT m.qid, m.card_id, CAST(row_number() OVER (PARTITION BY m.qid ORDER BY m.card_id) AS INTEGER) AS rank
FROM m JOIN nq ON nq.qid = m.qid WHERE m.k = nq.n
QUALIFY rank <= 20"""


@register("search_batch", BATCH_SQL)
def search_batch(spark, sf):
    """Every benchmark passage as an AND query over all documents (which
    documents contain every word of the passage), first 20 per query."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    index = _index(spark, sf)
    return S.batch_all_terms(index.postings, q, pairs=index.pairs, terms=index.terms)


MIXED_SQL = POST_SQL.rstrip("\n") + r""",
q AS (SELECT qid, w, qid % 7 AS m FROM (SELECT item_id AS qid, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) >= 5),
one AS (SELECT qid, p.card_id, p.field, p.pos, p.token, w, m FROM q JOIN post p
  ON p.token IN (q.w[1], q.w[2], q.w[3], q.w[4], q.w[5]) OR (q.m = 3 AND starts_with(p.token, q.w[4][1:4])) OR (q.m = 4 AND p.token = 'en' AND p.field = 'topic')),
per AS (SELECT qid, card_id, m,
  bool_or(token = w[1]) AS h1, bool_or(token = w[2]) AS h2, bool_or(token = w[3]) AS h3, bool_or(token = w[5]) AS h5,
  bool_or(starts_with(token, w[4][1:4])) AS p4, bool_or(token = 'en' AND field = 'topic') AS en, bool_or(token = w[1] AND pos = 0) AS first1
  FROM one GROUP BY ALL),
ph AS (SELECT DISTINCT a.qid, a.card_id, a.m FROM one a JOIN one b ON a.qid = b.qid AND a.card_id = b.card_id AND a.field = b.field AND b.pos = a.pos + 1
  WHERE (a.m = 2 AND a.token = a.w[2] AND b.token = b.w[3]) OR (a.m = 4 AND a.token = a.w[1] AND b.token = b.w[2])),
nr AS (SELECT DISTINCT a.qid, a.card_id FROM one a JOIN one b ON a.qid = b.qid AND a.card_id = b.card_id AND a.field = b.field
  JOIN one c ON a.qid = c.qid AND a.card_id = c.card_id AND a.field = c.field
  WHERE a.m = 5 AND a.token = a.w[1] AND b.token = b.w[3] AND c.token = c.w[4] AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 7),
good AS (SELECT qid, card_id FROM per WHERE (m = 0 AND h1 AND h2 AND h3) OR (m = 1 AND (h1 OR h5) AND NOT h2) OR (m = 3 AND p4 AND h1) OR (m = 6 AND first1 AND (h2 OR h3))
  UNION ALL SELECT ph.qid, ph.card_id FROM ph JOIN per USING (qid, card_id) WHERE ph.m = 2 OR en
  UNION ALL SELECT qid, card_id FROM nr)
SELECT qid, card_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY card_id) AS INTEGER) AS rank FROM good QUALIFY rank <= 20"""


@register("search_batch_mixed", MIXED_SQL)
def search_batch_mixed(spark, sf):
    """B17 with every kind of clause: a query per benchmark passage, of its
    first words, the kinds in turn (``bindings.clause_queries``); first 20 each."""
    index = _index(spark, sf)
    return S.batch_clauses(index.postings, index.terms, B.clause_queries(spark, sf))
