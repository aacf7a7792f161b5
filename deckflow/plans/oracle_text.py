"""SQL (DuckDB) counterparts of the scalar helpers, for oracle text."""

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"
NL = "chr(10)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def title_from_slug(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(replace({x}, '-', ' '), '\p{{L}}+|\P{{L}}+'), "
            r"lambda t: upper(t[1]) || lower(t[2:])), '')")


def fmt_example(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN '' WHEN coalesce({e}.title, '') <> '' "
            f"THEN '**' || {e}.title || '** — ' || coalesce({e}.body, '') ELSE coalesce({e}.body, '') END")


def fmt_probe(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN '' WHEN coalesce({p}.hint, '') <> '' "
            f"THEN coalesce({p}.question, '') || {NL} || {NL} || '*Hint: ' || {p}.hint || '*' "
            f"ELSE coalesce({p}.question, '') END")


def js(x: str) -> str:
    """JSON string literal of a text."""
    return f"to_json({x})"


SLUG = "lower(replace(o.o_orderpriority, ' ', '-')) || '-' || CAST(o.o_orderkey AS VARCHAR)"

# research rows of up to four neighbouring orders of one priority name the same concept
RESEARCH_SLUG = "lower(replace(o.o_orderpriority, ' ', '-')) || '-' || CAST(o.o_orderkey - o.o_orderkey % 4 AS VARCHAR)"

RESEARCH = f"""r AS (
  SELECT o.o_orderkey, {RESEARCH_SLUG} AS concept,
         CASE WHEN o.o_orderkey % 2 = 0 THEN CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE o.o_orderpriority || '/' || CAST(o.o_orderkey % 4 AS VARCHAR) END END AS cluster,
         d.text AS fundamentals,
         (SELECT list(struct_pack(title := l.l_returnflag, body := l.l_linestatus)
                      ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey)
          FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = 1) AS examples,
         (SELECT list(struct_pack(question := CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR), hint := l.l_returnflag)
                      ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey)
          FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = 0) AS probes,
         [struct_pack(slug := 'status-' || lower(o.o_orderstatus), name := o.o_orderstatus,
                      relationship := o.o_orderpriority)] AS connections_discovered
  FROM orders o LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT max(doc_id) + 1 FROM documents))"""

CONCEPT_RECORDS = f"""cr AS (
  SELECT {SLUG} AS slug, 'Order ' || CAST(o.o_orderkey AS VARCHAR) AS name, o.o_orderstatus AS cluster,
         CAST(1 + o.o_orderkey % 3 AS INTEGER) AS depth, ['status-' || lower(o.o_orderstatus)] AS connections,
         o.o_orderpriority AS description
  FROM orders o)"""

EXISTING = f"""ex AS (
  SELECT CASE WHEN o.o_orderkey % 3 = 0 THEN {SLUG} ELSE 'archived-' || CAST(o.o_orderkey AS VARCHAR) END AS slug,
         CASE WHEN o.o_orderkey % 2 = 0 THEN '' ELSE 'Order ' || CAST(o.o_orderkey AS VARCHAR) END AS name,
         CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE o.o_orderstatus END AS cluster,
         CAST(1 + o.o_orderkey % 5 AS INTEGER) AS depth, 'old' AS description,
         CAST(DATE '2024-01-01' + CAST(o.o_orderkey % 28 AS INTEGER) AS DATE) AS created
  FROM orders o WHERE o.o_orderkey % 3 <> 2)"""

BOOKMARK_SIGNALS = f"""turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         row_number() OVER w - 1 AS pos, lead(text) OVER w AS quoted
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sig AS (
  SELECT conv_id AS export_id, CAST(pos // 2 AS INTEGER) AS idx,
         {strip(f"CASE WHEN coalesce(quoted, '') <> '' THEN text || {NL} || {NL} || '> ' || quoted ELSE text END")} AS text,
         'twitter_bookmark' AS source_type, CAST(conv_id AS VARCHAR) || '-' || CAST(pos // 2 AS VARCHAR) AS source_id,
         [role] AS topics_hint
  FROM turns WHERE pos % 2 = 0)"""

PAGES = f"""pg AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, {strip('page')} AS text, 'pdf' AS source_type,
         CAST(doc_id AS VARCHAR) || ':page-' || CAST(i AS VARCHAR) AS source_id, []::VARCHAR[] AS topics_hint
  FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS page, generate_subscripts(string_split(text, {NL}), 1) AS i
        FROM documents)
  WHERE {strip('page')} <> '')"""
