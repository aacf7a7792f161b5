"""The queries ``opN_<name>`` and ``pipeline``, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return put


# --- 2 sharding -----------------------------------------------------------

@query("op2_minimax_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.sharding import shard_documents
    got = shard_documents(table(spark, sf_dir, "documents"), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_bytes")


# --- 4 token files --------------------------------------------------------

def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.tokenfile import read_token_files, write_token_files
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))


# --- 6 URL lists ----------------------------------------------------------

def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day of 2024, which the table lacks: by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("day"))


def page_list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists, derived from the hosts of all pages by the
    digits of a host's md5: ``abuse`` adds the registered domain of some hosts
    and removes it again later, ``adult`` adds single hosts, ``trusted`` allows
    some hosts for a while."""
    from deckflow.llm.urllists import url_host
    hosts = pages.select(url_host(F.col("url")).alias("host")).filter("host is not null").distinct()
    parts = F.split("host", r"\.")
    named = hosts.withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.lit(3), F.size(parts))), "."))

    def log(key: str, name: str, role: str, kind: str, below: str, days: int) -> DataFrame:
        h = F.md5(F.concat(F.lit(name), F.col("key")))
        at = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring(h, 2, 2), 16, 10).cast("int"))
        on = named.select(F.col(key).alias("key")).distinct().filter(F.substring(h, 1, 1) < below).select("key", at.alias("day"))
        again = F.substring(F.md5("key"), 3, 1) < "8"
        logs = [(F.lit("add"), F.col("day"), F.lit(True)), (F.lit("remove"), F.date_add("day", days), F.lit(True)), (F.lit("add"), F.date_add("day", 2 * days), again)]
        out = on.select("key", F.explode(F.array(*[F.struct(a.alias("action"), d.alias("day"), c.alias("on")) for a, d, c in logs])).alias("x")).filter("x.on")
        return out.select(F.lit(name).alias("list"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), "key", F.col("x.action").alias("action"), F.col("x.day").alias("day"), F.lit(0).alias("seq"))

    return log("domain", "abuse", "block", "domain", "6", 60).union(log("host", "adult", "block", "host", "4", 90)).union(log("host", "trusted", "allow", "host", "3", 45))


def _log_sql(key: str, name: str, role: str, kind: str, below: str, days: int) -> str:
    return f"""SELECT '{name}' AS list, '{role}' AS role, '{kind}' AS kind, key, x.action AS action, day + x.plus AS day FROM (
  SELECT key, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('{name}' || key), 2, 2) AS INTEGER) AS INTEGER) AS day, substr(md5(key), 3, 1) < '8' AS again
  FROM (SELECT DISTINCT {key} AS key FROM named) WHERE substr(md5('{name}' || key), 1, 1) < '{below}'),
  (VALUES ('add', 0, true), ('remove', {days}, true), ('add', {2 * days}, false)) x(action, plus, always) WHERE x.always OR again"""


@query("op6_url_lists_asof", f"""
WITH cap AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS day,
  nullif(rtrim(lower(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host FROM pages),
named AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM cap WHERE host IS NOT NULL),
entries AS ({_log_sql("domain", "abuse", "block", "domain", "6", 60)} UNION ALL {_log_sql("host", "adult", "block", "host", "4", 90)} UNION ALL {_log_sql("host", "trusted", "allow", "host", "3", 45)}),
valid AS (SELECT * FROM (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, kind, key ORDER BY day), DATE '9999-12-01') AS stop FROM entries) WHERE action = 'add'),
hit AS (SELECT c.page_id, c.host, c.day, v.role, v.list, v.key, v.day AS start FROM cap c JOIN valid v
  ON (c.host = v.key OR (v.kind = 'domain' AND ends_with(c.host, '.' || v.key))) AND v.day <= c.day AND c.day < v.stop),
one AS (SELECT page_id, host, day, count(DISTINCT CASE WHEN role = 'block' THEN list END) AS block_lists, count(DISTINCT CASE WHEN role = 'allow' THEN list END) AS allow_lists,
  max(CASE WHEN role = 'block' THEN lpad(CAST(strlen(key) AS VARCHAR), 6, '0') || list || ':' || key || '@' || CAST(CAST(start AS DATE) AS VARCHAR) END) AS b,
  max(CASE WHEN role = 'allow' THEN lpad(CAST(strlen(key) AS VARCHAR), 6, '0') || list || ':' || key || '@' || CAST(CAST(start AS DATE) AS VARCHAR) END) AS a
  FROM hit GROUP BY ALL)
SELECT c.page_id, c.host, c.day, coalesce(b IS NOT NULL AND (a IS NULL OR substr(b, 1, 6) > substr(a, 1, 6)), false) AS blocked,
  coalesce(block_lists, 0) AS block_lists, coalesce(allow_lists, 0) AS allow_lists,
  CASE WHEN b IS NOT NULL AND (a IS NULL OR substr(b, 1, 6) > substr(a, 1, 6)) THEN substr(b, 7) ELSE substr(coalesce(a, b), 7) END AS evidence
FROM cap c LEFT JOIN one o ON c.page_id = o.page_id AND c.host = o.host AND c.day = o.day""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.urllists import evaluate
    pages = table(spark, sf_dir, "pages")
    return evaluate(page_captures(pages), page_list_entries(pages))


# --- 8 SimHash ------------------------------------------------------------

@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.simhash import fingerprint_hex, simhash_groups
    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


# --- 9 top-k --------------------------------------------------------------

@query("op9_block_topk", """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS cr,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 5""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


# --- 10 mixing ------------------------------------------------------------

MIX_EPOCHS, MIX_SEED = 3, "mix-1"


def mix_domain(source: Column) -> Column:
    """The documents have no domain of their own: a source belongs to one by
    its name's md5."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(source.isNull(), "other").when(digit < "6", "web").when(digit < "b", "books").otherwise("forum")


def mix_levels(docs: DataFrame) -> list[Column]:
    return [mix_domain(docs["source"]), docs["lang"], docs["source"]]


def mix_weights() -> list[Column]:
    l1, l2 = F.col("l1"), F.col("l2")
    return [F.when(l1 == "web", 4).when(l1 == "books", 3).when(l1 == "forum", 2).otherwise(1),
            F.when(l2 == "en", 4).when(l2 == "de", 3).when(l2 == "fr", 2).otherwise(1), F.lit(1)]


def mix_sql(docs: str, share: tuple[int, int], epochs: int, seed: str) -> str:
    """SQL for the rows ``doc_id, domain, lang, source, n_tokens, budget,
    epoch`` and every other column of ``docs``, as the relation ``mixed``."""
    def level(n: int) -> str:
        here, above = ", ".join(f"l{i}" for i in range(1, n + 1)), [f"l{i}" for i in range(1, n)]
        on = " AND ".join(f"k.{c} IS NOT DISTINCT FROM u.{c}" for c in above) or "true"
        by = "PARTITION BY " + ", ".join(above) if above else ""
        order = f"{by} ORDER BY CAST(c AS DOUBLE) / CAST(w AS DOUBLE), l{n} ASC NULLS FIRST"
        w = ["CASE l1 WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END", "CASE l2 WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END", "1"][n - 1]
        return f"""
k{n} AS (SELECT k.*, u.budget AS b FROM (SELECT {here}, sum(cap) AS c, CAST({w} AS HUGEINT) AS w FROM leaves GROUP BY {here}) k JOIN n{n - 1} u ON {on}),
f{n} AS (SELECT *, c * (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   <= w * (b - coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own FROM k{n}),
g{n} AS (SELECT *, bool_and(own) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_ FROM f{n}),
s{n} AS (SELECT *, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({by}) AS sum_w, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_w,
   b - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER ({by}) AS rest FROM g{n}),
n{n} AS (SELECT {here}, CASE WHEN full_ THEN c ELSE (rest * upto_w) // sum_w - (rest * (upto_w - w)) // sum_w END AS budget FROM s{n})"""
    same = " AND ".join(f"d.l{i} IS NOT DISTINCT FROM l.l{i}" for i in (1, 2, 3))
    join = " AND ".join(f"a.l{i} IS NOT DISTINCT FROM l.l{i}" for i in (1, 2, 3))
    return f"""
mix_docs AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
   CASE WHEN source IS NULL THEN 'other' WHEN substr(md5(source), 1, 1) < '6' THEN 'web' WHEN substr(md5(source), 1, 1) < 'b' THEN 'books' ELSE 'forum' END AS l1,
   lang AS l2, source AS l3 FROM {docs}),
leaves AS (SELECT l1, l2, l3, sum(n) AS tokens, sum(n) * {epochs} AS cap FROM mix_docs GROUP BY ALL),
n0 AS (SELECT least(sum(cap), sum(tokens) * {share[0]} // {share[1]}) AS budget FROM leaves),{level(1)},{level(2)},{level(3)},
leaf AS (SELECT a.*, l.budget, CASE WHEN tokens > 0 THEN l.budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN l.budget % tokens ELSE 0 END AS rest FROM leaves a JOIN n3 l ON {join}),
keyed AS (SELECT d.*, l.budget, l.whole, l.rest, md5('{seed}:' || CAST(l.whole AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key FROM mix_docs d JOIN leaf l ON {same}),
ran AS (SELECT *, sum(n) OVER (PARTITION BY l1, l2, l3 ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
mixed AS (SELECT ran.*, CAST(e.epoch AS INTEGER) AS epoch FROM ran, (SELECT unnest(range({epochs + 1})) AS epoch) e WHERE e.epoch < whole OR (e.epoch = whole AND upto <= rest))"""


@query("op10_mix_sources", f"WITH {mix_sql('documents', (1, 2), MIX_EPOCHS, MIX_SEED)} "
       "SELECT doc_id, l1 AS domain, l2 AS lang, l3 AS source, CAST(n AS BIGINT) AS n_tokens, CAST(budget AS BIGINT) AS budget, epoch FROM mixed")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.mixing import mix
    docs = table(spark, sf_dir, "documents")
    got = mix(docs, mix_levels(docs), mix_weights(), (1, 2), MIX_EPOCHS, MIX_SEED)
    return got.select(F.col("doc.doc_id").alias("doc_id"), F.col("l1").alias("domain"), F.col("l2").alias("lang"), F.col("l3").alias("source"), "n_tokens", "budget", "epoch")


# --- 1 language ID --------------------------------------------------------

def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, mod n (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


@query("op1_crf_langid")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.langid import identify, labelled_sample, train
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, remainder(4) != 2))
    got = identify(docs, model)
    return got.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "shares", "switches")


# --- 5 toxicity -----------------------------------------------------------

@query("op5_knn_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.toxicity import learn, score_documents
    docs = table(spark, sf_dir, "documents")
    got = score_documents(docs, learn(docs, table(spark, sf_dir, "labels"), remainder(3) != 1))
    return got.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


# --- 7 benchmark decontamination -------------------------------------------

@query("op7_cgk_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- 3 near-duplicate passages ----------------------------------------------

@query("op3_compact_window_passages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.passages import passages
    return passages(table(spark, sf_dir, "documents"))


# --- 11 collocations ------------------------------------------------------------

def phrases_sql(least: int, top: int, longest: int) -> str:
    cut_at = " UNION ALL ".join(f"SELECT *, {k} AS k FROM c WHERE c.size > {k}" for k in range(1, longest))
    inner = " UNION ALL ".join(f"SELECT lang, a, array_to_string(w[{i}:{i + m - 1}], ' ') AS phrase FROM c WHERE c.size >= {max(i + m - 1, m + 1)}"
                               for m in range(2, longest) for i in range(1, longest - m + 2))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, size, w[i:i + size - 1] AS w FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, {longest + 1})) AS size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, size, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, size, w HAVING count(*) >= {least}),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2),
x AS (SELECT x.lang, x.phrase, x.a, x.k, l.a AS l, r.a AS r, t.n, CAST(1000 AS HUGEINT) * x.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM ({cut_at}) x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ') JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS a FROM ({inner}) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.a IS NULL OR 100 * i.a < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= {top}"""


@query("op11_collocations", phrases_sql(100, 2000, 5))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


# --- 12 quality rules -------------------------------------------------------------

@query("op12_kneser_ney_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.perplexity import judge
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "bits", "perplexity", "low", "high")


# --- 13 centroid clustering ---------------------------------------------------

def lloyd_sql(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """The same rounds in SQL: one relation per assignment and update."""
    def near(n: int) -> str:
        return f"""
a{n} AS MATERIALIZED (SELECT r, j, dist FROM (SELECT x.r, c.j, sum((x.x - c.x) * (x.x - c.x)) AS dist FROM x JOIN c{n} c ON c.d = x.d GROUP BY x.r, c.j)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, j) = 1)"""

    def moved(n: int) -> str:
        return f"""
c{n} AS MATERIALIZED (SELECT o.j, o.d, CAST(coalesce((s - ((s % m) + m) % m) // m, o.x) AS BIGINT) AS x FROM c{n - 1} o
  LEFT JOIN (SELECT a.j, x.d, sum(x.x) AS s, count(*) AS m FROM a{n - 1} a JOIN x ON x.r = a.r GROUP BY a.j, x.d) u ON u.j = o.j AND u.d = o.d)"""
    steps = ",".join([near(0), *[t for n in range(1, rounds + 1) for t in (moved(n), near(n))]])
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
c0 AS MATERIALIZED (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM (
  SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS j FROM v WHERE vec_id IS NOT NULL) WHERE j < {k}),{steps},
h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.dist AS BIGINT) AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{rounds} a JOIN v ON v.r = a.r JOIN h ON h.j = a.j"""


@query("op13_drift_clusters", lloyd_sql(8, 10, 64, 1024, "3"))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deckflow.llm.clusters import cluster, with_inertia
    return with_inertia(cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3"))


# --- the pipeline -----------------------------------------------------------

@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
