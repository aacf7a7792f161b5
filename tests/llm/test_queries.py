"""Queries with SQL against DuckDB, the pipeline's stages, and the contracts' columns."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["op6_url_lists_asof", "op9_block_topk", "op10_mix_sources", "op11_collocations", "op13_drift_clusters"])
def test_query_equals_sql(spark, key):
    from compare import compare
    r = compare(spark, SF, [key])[key]
    assert r.get("match") and r.get("types_match"), r


def test_pipeline_equals_brute_force(spark):
    """Every stage on what its predecessor kept, against plain Python or SQL."""
    import duckdb
    import corpus_pipeline as P
    from deckflow.llm.decontam import _ends, words_of
    from deckflow.llm.langid import label_words, labelled_sample, train
    from deckflow.llm.queries import mix_sql
    from test_operators import naive_components, naive_fingerprint
    docs = P.cut(spark.read.parquet(f"{SF}/documents.parquet"))
    columns, model = docs.columns, train(labelled_sample(docs, F.lit(True)))
    for n, (_, stage) in enumerate(P.STAGES):
        rows, got = docs.collect(), P.cut(stage(spark, docs, SF))
        kept = sorted(r.doc_id for r in got.select("doc_id").collect())
        assert n == 4 or got.columns == columns
        if n == 0:  # documents alone, one after the other
            share = [label_words(model, [r.text])[1][0] for r in rows]
            assert kept == sorted(r.doc_id for r, p in zip(rows, share) if len(p) and p.mean(0).max() >= P.LEAST_SHARE)
        elif n == 1:
            group = naive_components([naive_fingerprint(r.text) for r in rows], P.MAX_BITS)
            of = {r.doc_id: g for r, g in zip(rows, group)}
            assert sorted(of[i] for i in kept) == sorted(set(group))
        elif n == 2:
            items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {r.doc_id for r in rows if any(_ends(w, words_of(r.text))[0] <= int(0.2 * len(w)) for w in items)}
            assert kept == sorted(r.doc_id for r in rows if r.doc_id not in leaks)
        elif n == 3:
            held = docs.toPandas()  # noqa: F841  (read by DuckDB)
            want = duckdb.sql(f"WITH {mix_sql('held', P.MIX_SHARE, P.MIX_EPOCHS, P.MIX_SEED)} SELECT doc_id FROM mixed").fetchall()
            assert kept == sorted(i for i, in want)
        else:
            placed = got.collect()
            assert kept == sorted(r.doc_id for r in rows) and {r.doc_id: r.size for r in placed} == {r.doc_id: len((r.text or "").encode()) + 1 for r in rows}
            groups = {}
            for r in placed:
                groups.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in groups.values()) and set(groups) <= set(range(P.SHARDS))
        docs = got
    assert docs.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_pipeline_on_no_documents(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, SF))
    assert docs.count() == 0
