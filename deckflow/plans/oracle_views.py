"""SQL text of the canonical views, for the DuckDB oracle (same bindings as
sources/bindings.py)."""

CARDS = """cards AS (
  SELECT p_partkey AS card_id, p_brand AS concept, p_name AS title, p_type AS topic,
         1 + p_size % 3 AS depth, p_name AS idea, p_type AS example, p_brand AS probe,
         ['Brand#' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 25 + 1 AS VARCHAR),
          'Brand#' || CAST((CAST(substr(p_brand, 7) AS INTEGER) + 6) % 25 + 1 AS VARCHAR)] AS connections,
         'part' AS source_type, CAST(p_partkey AS VARCHAR) AS source_id,
         'cards/' || CAST(p_partkey AS VARCHAR) || '.md' AS file_path,
         CAST(DATE '2024-01-01' + CAST(p_partkey * 7 % 30 AS INTEGER) AS DATE) AS created_at
  FROM part)"""

ENGAGEMENT = """engagement AS (
  SELECT event_id AS id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS card_id,
         event_type AS event, CAST(round(value * 1000) AS BIGINT) AS duration_ms,
         props AS metadata, ts AS created_at
  FROM events)"""

ACCEPTED = """acc AS (
  SELECT e.* FROM engagement e
  WHERE coalesce(CAST(e.card_id AS VARCHAR), '') <> '' AND coalesce(e.event, '') <> ''
    AND EXISTS (SELECT 1 FROM cards c WHERE c.card_id = e.card_id))"""

CORPUS = """corpus AS (
  SELECT doc_id AS card_id, source AS title, lang AS topic, text AS idea, '' AS example, '' AS probe
  FROM documents)"""


def with_views(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
