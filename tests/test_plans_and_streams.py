"""Plan shape (no all-pairs joins, partial top-n, pruned scans), the search
index, snapshots, streaming = batch, and the folder-driven jobs (A11, I05)."""

import os
import tempfile
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from deckflow.operators import engagement as eng
from deckflow.operators import viewer as V
from deckflow.operators.index import SearchIndex
from deckflow.operators.upsert import append_events, live_buckets, read_snapshot, upsert_buckets
from deckflow.sources import bindings as B
from deckflow.sources import documents as D
from deckflow.streaming import engagement as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_no_all_pairs_joins(spark):
    qs = E.queries()
    for key in ["feed", "search_batch", "search_near", "search_phrase", "unseen_cards", "adjacent_cards",
                "nav_views", "generate_cards", "concept_merge"]:
        p = plan(qs[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def test_feed_top_n_is_partial_and_scans_are_pruned(spark):
    from deckflow.operators.feed import BlendedFeed, FeedInputs
    f = BlendedFeed(FeedInputs(B.cards(spark, SF_SMALL), B.engagement(spark, SF_SMALL)))
    p = f._unseen_sources({"continue": 8, "fresh": 13})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
    scan = B.engagement(spark, SF_SMALL).select("user_id", "card_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,props:string>" in scan


def _split_events(spark, parts):
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    ev = B.table(spark, SF_SMALL, "events")
    bounds = ev.select(F.percentile_approx("event_id", [i / parts for i in range(1, parts)]).alias("b")).first().b
    edges = [-1, *bounds, 1 << 60]
    for i in range(parts):  # files in time order: event_id grows with ts
        (ev.filter((F.col("event_id") > edges[i]) & (F.col("event_id") <= edges[i + 1])).coalesce(1)
         .write.parquet(f"{d}/part{i:02d}"))
        for f in os.listdir(f"{d}/part{i:02d}"):
            if f.endswith(".parquet"):
                os.rename(f"{d}/part{i:02d}/{f}", f"{d}/events-{i:02d}.parquet")
    return d, ev.schema


def test_streams_equal_batch(spark):
    d, schema = _split_events(spark, 3)
    raw = ST.file_stream(spark, d, schema, glob="events-*.parquet", max_files=1)
    stream = raw.select(F.col("event_id").alias("id"), "user_id",
                        F.get_json_object("props", "$.k").cast("bigint").alias("card_id"),
                        F.col("event_type").alias("event"), F.col("ts").alias("created_at"))
    cards = B.cards(spark, SF_SMALL)
    base = ST.scratch(spark, "test")
    acc, rej = ST.split_accepted(stream, cards)
    for q in (ST.run_append(acc, base, "acc"), ST.run_append(rej, base, "rej"),
              ST.run_upsert(ST.running_stats(acc), base, "stats", ["card_id", "event"])):
        q.awaitTermination()
    batch_acc = eng.accepted_events(B.engagement(spark, SF_SMALL), cards)
    assert spark.read.parquet(f"{base}/acc").count() + spark.read.parquet(f"{base}/rej").count() == 1000
    assert sorted(r.id for r in spark.read.parquet(f"{base}/acc").collect()) == sorted(r.id for r in batch_acc.collect())
    got = {(r.card_id, r.event): r["count"] for r in ST.read_latest(spark, base, "stats", ["card_id", "event"]).collect()}
    want = {(r.card_id, r.event): r["count"] for r in eng.engagement_stats(batch_acc).collect()}
    assert got == want
    assert len(os.listdir(f"{base}/stats".replace("file:", "", 1))) >= 3  # one folder per micro-batch

    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, ST.ROCKSDB)
    try:
        ST.run_append(ST.nav_stream(B.nav_events_of(raw, cards), cards), base, "nav").awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = {r.user_id: (r.idx, r.phase, r.topic, r.n_events) for r in ST.latest_nav(spark.read.parquet(f"{base}/nav")).collect()}
    want = {r.user_id: (r.idx, r.phase, r.topic, r.n_events)
            for r in V.last_state(V.replay_views(B.nav_events(spark, SF_SMALL), cards)).collect()}
    assert got == want
    assert len({r.counter for r in spark.read.parquet(f"{base}/nav").filter("user_id = 1").collect()}) >= 3  # one row per batch


def test_merged_batches_bound_what_a_reader_scans(spark):
    """20 batches of updates, one of them and one merge run again."""
    base, schema = ST.scratch(spark, "merge"), "k int, v int"
    folder = tempfile.mkdtemp(prefix="updates-", dir="/tmp")
    for i in range(20):
        spark.createDataFrame([(i % 7, 1), (100 + i, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = raw.groupBy("k").agg(F.sum("v").alias("n"))
    ST.run_upsert(counts, base, "t", ["k"], merge_every=6).awaitTermination()
    want = {**{k: len(range(k, 20, 7)) for k in range(7)}, **{100 + i: 1 for i in range(20)}}
    read = lambda: {r.k: r.n for r in ST.read_latest(spark, base, "t", ["k"]).collect()}
    assert read() == want
    parts = [p.rsplit("/", 1)[1] for p in ST.parts_to_read(spark, f"{base}/t")]
    assert parts == ["merged=17", "batch=18", "batch=19"]
    again = spark.read.parquet(f"{base}/t/batch=18").collect()  # batch 18 run again
    spark.createDataFrame(again).write.mode("overwrite").parquet(f"{base}/t/batch=18")
    assert read() == want
    assert ST.drop_merged(spark, base, "t") == 20 and read() == want


def _write_docs(folder, docs):
    os.makedirs(folder, exist_ok=True)
    for r in docs:
        with open(os.path.join(folder, os.path.basename(r.path)), "w") as fh:
            fh.write(r.content)


def test_reindex_and_card_stream(spark):
    from deckflow.plans.jobs import reindex_all
    root = tempfile.mkdtemp(prefix="content-", dir="/tmp")
    cards = B.cards(spark, SF_SMALL).filter(F.col("card_id") < 30)
    _write_docs(f"{root}/cards", D.render_cards(cards).collect())
    from deckflow.operators.cards import concepts_from_cards
    _write_docs(f"{root}/concepts", D.render_concepts(concepts_from_cards(cards)).collect())
    counts = {r.stage: r.n for r in reindex_all(spark, f"{root}/cards", f"{root}/concepts", f"{root}/out",
                                                "2024-01-31").collect()}
    assert counts["cards_parsed"] == 30 and counts["cards"] == 30
    # second run with one card changed and one new: upsert, no deletes
    with open(f"{root}/cards/5.md") as fh:
        txt = fh.read()
    with open(f"{root}/cards/5.md", "w") as fh:
        fh.write(txt.replace("## Idea\n", "## Idea\nchanged "))
    with open(f"{root}/cards/999.md", "w") as fh:
        fh.write(txt)
    os.remove(f"{root}/cards/7.md")
    counts = {r.stage: r.n for r in reindex_all(spark, f"{root}/cards", f"{root}/concepts", f"{root}/out",
                                                "2024-01-31").collect()}
    assert counts["cards"] == 31
    snap = read_snapshot(spark, f"{root}/out/cards")
    assert snap.filter("card_id = '5'").first().idea.startswith("changed")
    assert snap.filter("card_id = '7'").count() == 1  # no deletes
    index = SearchIndex(spark, f"{root}/out/index/v000002")
    assert "5" in {r.card_id for r in index.postings.filter("token = 'changed' and field = 'idea'").collect()}

    # The same documents arriving as a stream
    ck = ST.scratch(spark, "cards")
    ST.run_card_upsert(ST.card_folder_stream(spark, f"{root}/cards"), f"{ck}/snap", f"{ck}/_ck",
                       "2024-01-31").awaitTermination()
    streamed = read_snapshot(spark, f"{ck}/snap")
    assert streamed.select("card_id").distinct().count() == 30


def test_a_version_writes_only_the_buckets_it_touches(spark):
    base = ST.scratch(spark, "snapshot")
    upsert_buckets(spark.range(1000).selectExpr("id as k", "0 as v"), base, "k", 1, buckets=32)
    upsert_buckets(spark.createDataFrame([(7, 1), (2000, 1), (7, 2)], "k long, v int").coalesce(1), base, "k", 2, buckets=32)
    rows = {r.k: r.v for r in read_snapshot(spark, base).collect()}
    assert len(rows) == 1001 and rows[7] == 2 and rows[2000] == 1 and rows[8] == 0  # the last row for 7 counts
    written = [b for b, p in live_buckets(spark, base).items() if "/v000002/" in p]
    assert 1 <= len(written) <= 2
    upsert_buckets(spark.createDataFrame([(7, 2), (2000, 1)], "k long, v int"), base, "k", 2, buckets=32)  # run again
    assert {r.k: r.v for r in read_snapshot(spark, base).collect()} == rows
    assert read_snapshot(spark, base, below=2).count() == 1000


def test_repeated_requests_are_appended_once(spark):
    log = ST.scratch(spark, "log")
    schema = "id long, user_id long, created_at timestamp"
    rows = [(i, 1, f"2024-01-{1 + i % 3:02d} 10:00:00") for i in range(30)]
    df = lambda r: spark.createDataFrame(r, "id long, user_id long, t string").selectExpr("id", "user_id", "cast(t as timestamp) as created_at")
    append_events(df(rows), log)
    append_events(df([*rows[:10], (99, 2, "2024-01-03 11:00:00"), (99, 2, "2024-01-03 12:00:00")]), log)
    append_events(df([]), log)
    got = spark.read.schema(schema).parquet(log).select("id", F.date_format("created_at", "HH").alias("h")).collect()
    assert sorted(r.id for r in got) == [*range(30), 99]
    assert {r.id: r.h for r in got}[99] == "11"  # of repeats in a batch the earliest stays


def test_search_reads_the_index_only(spark):
    """Token filters reach the scan of the stored postings; nothing is tokenised
    again, and the corpus is read for the few hits only."""
    for key, pushed in (("search_any", "In(token, [that,this])"), ("search_phrase", "In(token, [of,the])"), ("search_prefix", "StringStartsWith(token,th)"),
                        ("search_initial", "EqualTo(token,the)"), ("search_near_three", "In(token, [in,of,the])")):
        df = E.queries()[key](spark, SF_SMALL)
        p = df._jdf.queryExecution().executedPlan().toString()
        assert pushed in p and "regexp_extract_all" not in p and "documents.parquet" not in p, (key, p)
    p = E.queries()["search_terms_all"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in p, p


def test_index_is_reused_and_follows_its_files(spark):
    from deckflow.operators.index import open_index
    folder = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    cols = "card_id long, title string, topic string, idea string, example string, probe string"
    spark.createDataFrame([(1, "one", "t", "red fox", "", "")], cols).write.mode("append").parquet(folder)
    first = open_index(spark.read.parquet(folder), "test-index")
    assert open_index(spark.read.parquet(folder), "test-index").path == first.path
    spark.createDataFrame([(2, "two", "t", "red hen", "", "")], cols).write.mode("append").parquet(folder)
    second = open_index(spark.read.parquet(folder), "test-index")
    assert second.path != first.path
    assert {(r.token, r.df) for r in second.terms.filter("token in ('red', 'fox', 'one')").collect()} == {("red", 2), ("fox", 1), ("one", 1)}


CLAUSE = "qid int, clause int, kind string, words array<string>, fields array<string>, distance int"


def _naive_search(cards, clauses):
    """Every clause on every card by plain lists."""
    import re
    fields = ["id", "title", "topic", "idea", "example", "probe"]
    tok = {c[0]: {f: re.findall(r"\w+", (str(c[0]) if f == "id" else c[1].get(f, "")).lower()) for f in fields} for c in cards}

    def met(kind, words, only, n, card):
        use = {f: t for f, t in tok[card].items() if only is None or f in only}
        has = lambda w: any(w in t for t in use.values())
        runs = [(f, i) for f, t in use.items() for i in range(len(t)) if t[i:i + len(words)] == words]
        if kind in ("all", "field"):
            return all(map(has, words))
        if kind in ("any", "not"):
            return any(map(has, words))
        if kind == "prefix":
            return any(x.startswith(words[0]) for t in use.values() for x in t)
        if kind == "phrase":
            return bool(runs)
        if kind == "initial":
            return any(i == 0 for _, i in runs)
        return any(set(words) <= set(t[i:i + n + 2]) for t in use.values() for i in range(len(t)))

    out = []
    for q in sorted({c[0] for c in clauses}):
        own = [c for c in clauses if c[0] == q and c[3]]
        good = [k for k in tok if any(c[2] != "not" for c in own) and all(met(c[2], c[3], c[4], c[5], k) != (c[2] == "not") for c in own)]
        out += [(q, k, i + 1) for i, k in enumerate(sorted(good)[:20])]
    return out


def test_clauses_equal_brute_force(spark):
    import random

    from deckflow.operators import search as S
    from deckflow.operators.index import write_index
    rng = random.Random(8)
    vocab = ["the", "the", "a", "fox", "hen", "then", "red", "reds", "foxes", "zoo"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, n)))
    cards = [(i, {"title": text(4), "topic": rng.choice(["t", "the", "zoo red"]), "idea": text(25), "example": text(6), "probe": ""}) for i in range(120)]
    df = spark.createDataFrame([(i, c["title"], c["topic"], c["idea"], c["example"], c["probe"]) for i, c in cards],
                               "card_id long, title string, topic string, idea string, example string, probe string")
    index = write_index(df, ST.scratch(spark, "clauses"), 4)
    kinds = ["all", "any", "not", "phrase", "prefix", "near", "initial", "field"]
    clauses = [(0, 0, "not", ["fox"], None, None), (1, 0, "all", [], None, None), (2, 0, "phrase", ["the", "the", "the"], None, None), (3, 0, "near", ["a", "hen", "a", "red"], None, 2),
               (4, 0, "any", ["unknown", "zoo"], None, None), (4, 1, "all", ["unknown"], None, None), (5, 0, "prefix", ["re"], None, None), (5, 1, "not", ["unknown"], None, None)]
    for q in range(6, 70):
        for n in range(rng.randint(1, 3)):
            words = rng.sample(vocab, rng.randint(1, 3))
            clauses.append((q, n, rng.choice(kinds), words, rng.choice([None, None, ["idea", "title"], ["topic"]]), rng.randint(0, 4)))
    got = S.batch_clauses(index.postings, index.terms, spark.createDataFrame(clauses, CLAUSE))
    assert sorted((r.qid, r.card_id, r["rank"]) for r in got.collect()) == _naive_search(cards, clauses)


def test_index_ranges_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    """The index has a partition for every ``PART`` letters, and its term table
    counts each card of a token once, also where a card's row comes twice."""
    from deckflow.operators import index
    from deckflow.operators import search as S
    rows = [(i % 90, "T", "t", " ".join(f"w{(i * j) % 13} the" for j in range(12)), None, "") for i in range(100)]
    corpus = spark.createDataFrame(rows, "card_id long, title string, topic string, idea string, example string, probe string")
    letters = sum(len(r[1]) + len(r[2]) + len(r[3]) for r in rows)
    monkeypatch.setattr(index, "PART", 500)
    assert index.parts_of(corpus, 2) == letters // 500 + 1 and index.parts_of(corpus, 10 ** 6) == 10 ** 6 and index.parts_of(corpus.limit(0), 2) == 2
    built = index.write_index(corpus, str(tmp_path / "index"), 2)
    want = S.postings(corpus)
    assert len([f for f in built.postings.inputFiles() if "part-" in f]) > 2
    assert sorted(map(tuple, built.postings.collect())) == sorted(map(tuple, want.select("token", "card_id", "field", "pos").collect()))
    pairs = {(r.token, r.card_id) for r in want.collect()}
    assert sorted(map(tuple, built.pairs.collect())) == sorted(pairs)
    assert {r.token: r.df for r in built.terms.collect()} == Counter(t for t, _ in pairs)
    queries = spark.createDataFrame([(1, "the w3 w9"), (2, "the"), (3, "nowhere the"), (4, "")], "qid long, text string")
    asked = lambda **of: sorted(map(tuple, S.batch_all_terms(built.postings, queries, **of).collect()))
    assert asked(pairs=built.pairs, terms=built.terms) == asked() != []
