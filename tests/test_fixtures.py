"""Edge cases of FIXTURES.md on small tables written by the tests themselves."""

import itertools
import json
import re
from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from deckflow.functions import text as T
from deckflow.operators import engagement as eng
from deckflow.operators import generate as gen
from deckflow.operators import viewer as V
from deckflow.sources import documents as D
from deckflow.sources import responses as R
from deckflow.sources import signals as S


def one(df, col):
    return [r[col] for r in df.collect()]


def test_bookmark_shapes(spark):
    t1 = {"full_text": "  hello  ", "id_str": "12", "entities": {"hashtags": [{"tag": "a"}, {"text": "b"}]}}
    t2 = {"full_text": "", "text": "fallback", "id": 12345678901234567890}
    t3 = {"text": "q", "id": "7", "quoted_status": {"full_text": "inner"}}
    t4 = {"text": "no quote", "quoted_status": {"full_text": ""}}
    docs = [(1, json.dumps([t1, t2])), (2, json.dumps({"data": [t3]})), (3, json.dumps({"tweets": [t4]})),
            (4, json.dumps({"other": [t1]}))]
    df = S.bookmarks(spark.createDataFrame(docs, ["export_id", "doc"])).orderBy("export_id", "idx").collect()
    assert [(r.export_id, r.text, r.source_id, list(r.topics_hint)) for r in df] == [
        (1, "hello", "12", ["a", "b"]), (1, "fallback", "12345678901234567890", []),
        (2, "q\n\n> inner", "7", []), (3, "no quote", "", [])]


def test_bookmark_rejects(spark):
    docs = [(1, "[]"), (2, '{"data": []}'), (3, '[{"text": "a"'), (4, None), (5, ""), (6, "text"), (7, '{"data": [{"text": "a"}]')]
    got = S.bookmark_rejects(spark.createDataFrame(docs, "export_id int, doc string")).collect()
    assert {r.export_id: r.reason for r in got} == {3: "not JSON", 4: "no document", 5: "not JSON", 6: "not JSON", 7: "not JSON"}


def test_text_and_pages(spark):
    t = S.text_drop(spark.createDataFrame([(1, "  x \n"), (2, "")], ["id", "text"]))
    assert sorted(one(t, "text")) == ["", "x"]
    p = S.paged(spark.createDataFrame([("doc", "one\n\n  \nfour")], ["stem", "text"]), "stem", "text")
    assert sorted((r.source_id, r.text) for r in p.collect()) == [("doc:page-1", "one"), ("doc:page-4", "four")]


def test_router_rejects_unknown_kind_and_stops_when_empty(spark):
    import pytest
    with pytest.raises(ValueError):
        S.by_type("csv", spark.range(1))
    empty = S.bookmarks(spark.createDataFrame([(1, "[]"), (2, '{"data": []}')], ["export_id", "doc"]))
    assert S.signals_or_none(empty) is None
    assert S.signals_or_none(S.text_drop(spark.createDataFrame([(1, "x")], ["id", "text"]))) is not None


CARD = """---\nconcept: "c"\ntitle: "T: yes"\ntopic: top\nconnections: ["a", "b"]\nsource: "x"\n---\nintro\n## Idea\n i1 \n### not a heading\n## Example\n```\n## fenced\n```\n## idea\nlast\n## \nempty\n"""


def test_card_document_edge_cases(spark):
    docs = spark.createDataFrame([("/x/c-001.md", CARD), ("/x/bad.md", "no front matter"),
                                  ("/x/crlf.md", CARD.replace("\n", "\r\n"))], ["path", "content"])
    rows = {r.card_id: r for r in D.parse_cards(docs, "2024-01-31").collect()}
    assert set(rows) == {"c-001", "crlf"}
    r = rows["c-001"]
    assert (r.title, r.topic, r.depth, list(r.connections), r.source_type) == ("T: yes", "top", 1, ["a", "b"], "")
    assert r.idea == "last"                 # repeated heading: last wins
    assert r.example == "```"               # '## fenced' inside a fence is still a heading
    assert str(r.created_at) == "2024-01-31"
    assert rows["crlf"].idea == "last"
    assert one(D.card_rejects(docs), "path") == ["/x/bad.md"]


def test_render_parse_round_trip(spark):
    cards = spark.createDataFrame([Row(card_id=5, concept="k", title='say "hi": yes', topic="", depth=2,
                                       idea=" a ", example="b\nc", probe="", connections=["k2"],
                                       source_type="pipeline", source_id="", created_at=datetime(2024, 1, 2).date())])
    back = D.parse_cards(D.render_cards(cards), "2024-01-31").collect()[0]
    assert (back.card_id, back.title, back.idea, back.example, back.depth) == ("5", 'say "hi": yes', "a", "b\nc", 2)


def test_concept_document_missing_name(spark):
    docs = spark.createDataFrame([("/c/some-slug.yaml", 'cluster: "x"\nconnections: [{"to": "y", "weight": 0.5}]\n')],
                                 ["path", "content"])
    r = D.parse_concepts(docs).collect()[0]
    assert (r.concept, r.name, r.depth, r.connections[0]["to"]) == ("some-slug", "some-slug", 1, "y")


def test_model_responses(spark):
    rows = [(1, 'intro\n```json\n[{"slug": "a"}, {"slug": "b"}]\n```'), (2, '```\n{"concepts": [{"slug": "c"}]}\n```'),
            (3, '{"slug": "d", "depth": 2}'), (4, "not json at all")]
    df = spark.createDataFrame(rows, ["response_id", "response"]).select("response_id",
                                                                        R.json_text("response").alias("json"))
    got = sorted((r.response_id, r.slug) for r in R.concepts(df).collect())
    assert got == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert one(R.rejects(df), "response_id") == [4]


def test_generate_cards_edge_cases(spark):
    schema = ("concept string, cluster string, fundamentals string, examples array<struct<title:string,body:string>>, "
              "probes array<struct<question:string,hint:string>>, "
              "connections_discovered array<struct<slug:string,name:string,relationship:string>>")
    rows = [("what's-3d", None, "short", [("E1", "b1"), (None, "b2"), ("E3", "b3")], [("q1", ""), ("q2", "h2")], []),
            ("empty", "", "f", [], [], None)]
    cards = {r.card_id: r for r in gen.generate_cards(spark.createDataFrame(rows, schema), "2024-01-31").collect()}
    assert sorted(cards) == ["empty-001", "what's-3d-001", "what's-3d-002", "what's-3d-003"]
    c1, c2, c3 = cards["what's-3d-001"], cards["what's-3d-002"], cards["what's-3d-003"]
    assert c1.title == "What'S 3D" and c1.idea == "short" and c1.example == "**E1** — b1" and c1.probe == "q1"
    assert c2.title == "What'S 3D — Angle 2" and c2.idea == "short..." and c2.example == "b2"
    assert c2.probe == "q2\n\n*Hint: h2*" and c2.depth == 2
    assert c3.title == "E3" and c3.probe == "" and c3.depth == 3
    assert cards["empty-001"].example == "" and cards["empty-001"].probe == ""


def test_concept_merge_names(spark):
    research = spark.createDataFrame([("a-b", None, "x" * 400, [("z", "Z", None)])],
                                     "concept string, cluster string, fundamentals string, "
                                     "connections_discovered array<struct<slug:string,name:string,relationship:string>>")
    existing = spark.createDataFrame([("a-b", "", "clu", 3, "old", [], None, None)],
                                     "slug string, name string, cluster string, depth int, description string, "
                                     "connections array<struct<to:string,weight:double,relationship:string>>, "
                                     "created date, updated date")
    r = gen.concept_merge(research, existing, "2024-01-31").collect()[0]
    assert (r.name, r.cluster, r.depth, len(r.description), r.connections[0]["relationship"]) == ("A B", "clu", 3, 300, "")
    assert str(r.created) == "2024-01-31" and str(r.updated) == "2024-01-31"


def test_engagement_validation(spark):
    ev = spark.createDataFrame([(1, 1, 10, "seen"), (2, 1, None, "tap"), (3, 1, 11, ""), (4, 1, 99, "tap")],
                               "id long, user_id long, card_id long, event string")
    cards = spark.createDataFrame([(10,), (11,)], "card_id long")
    assert sorted(one(eng.invalid_events(ev), "id")) == [2, 3]
    assert one(eng.accepted_events(ev, cards), "id") == [1]
    assert one(eng.orphan_events(eng.valid_events(ev), cards), "id") == [4]


def test_scalars(spark):
    df = spark.createDataFrame([("['a', 'b']", "  x  ", 29.0, 29.0), ("['it's']", "", 30.0, 0.0),
                                ("[]", " ", -51.0, 10.0), ("nope", "y", 10.0, -80.0)], "t string, s string, dx double, dy double")
    rows = df.select(T.repr_list("t").alias("l"), T.py_strip("s").alias("s"),
                     T.gesture_class("dx", "dy").alias("g")).collect()
    assert [r.l for r in rows] == [["a", "b"], None, [], None]
    assert [r.s for r in rows] == ["x", "", "", "y"]
    assert [r.g for r in rows] == ["next", "none", "next", "none"]


def test_nav_edges(spark):
    ops = ["prev", "next", "next", "next", "prev", "topic", "next"] + ["next"] * 6
    cards = spark.createDataFrame([(1, "t"), (2, None)], "card_id long, topic string")
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, i), i, op, "all") for i, op in enumerate(ops)],
                               "user_id long, ts timestamp_ntz, event_id long, op string, topic string")
    views = sorted(V.replay_views(ev, cards).collect(), key=lambda r: r.event_id)
    ps = [3 * r.idx + r.phase for r in views]
    assert ps == [0, 1, 2, 3, 2, 0, 1, 2, 3, 4, 5, 0, 1]   # prev at start stays, wraps at 3N = 6
    final = V.last_state(V.replay_views(ev, cards)).collect()[0]
    assert (final.idx, final.phase, final.n_events) == (0, 1, 13)


def test_upsert_snapshots_and_partitioned_append(spark, tmp_path):
    from deckflow.operators import upsert as U
    old = spark.createDataFrame([(1, "a"), (2, "b")], "card_id long, title string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "C")], "card_id long, title string").withColumn(
        "_seq", F.monotonically_increasing_id())
    merged = U.upsert(old, new, "card_id")
    base = str(tmp_path / "cards")
    U.upsert_buckets(merged, base, "card_id", 1)
    snap = {r.card_id: r.title for r in U.read_snapshot(spark, base).collect()}
    assert snap == {1: "a", 2: "B", 3: "C"}          # last write wins, no deletes
    ev = spark.createDataFrame([(1, 7, 10, "seen", None, None, None),
                                (2, 7, 11, "tap", 5, '{"a":1}', datetime(2024, 1, 3, 4, 5))],
                               "id long, user_id long, card_id long, event string, duration_ms long, "
                               "metadata string, created_at timestamp_ntz")
    norm = U.normalise_events(ev, "2024-01-31 00:00:00")
    rows = {r.id: r for r in norm.collect()}
    assert (rows[1].duration_ms, rows[1].metadata, str(rows[1].created_at)) == (0, "{}", "2024-01-31 00:00:00")
    U.append_events(norm, str(tmp_path / "log"))
    U.append_events(norm, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2  # a repeated request is appended once
    assert sorted(str(r.day) for r in log.select("day").distinct().collect()) == ["2024-01-03", "2024-01-31"]
    assert "PartitionFilters: [isnotnull(day" in log.filter(F.col("day") == "2024-01-03")._jdf.queryExecution() \
        .executedPlan().toString()


def test_concept_merge_idempotent_except_updated(spark):
    research = spark.createDataFrame([("a-b", "clu", "fundamentals text", [("z", "Z", "rel")])],
                                     "concept string, cluster string, fundamentals string, "
                                     "connections_discovered array<struct<slug:string,name:string,relationship:string>>")
    existing = spark.createDataFrame([("a-b", "", "", 2, "old", [], None, None), ("other", "O", "c", 1, "d", [], None, None)],
                                     "slug string, name string, cluster string, depth int, description string, "
                                     "connections array<struct<to:string,weight:double,relationship:string>>, "
                                     "created date, updated date")
    once = gen.concept_merge(research, existing, "2024-01-31")
    twice = gen.concept_merge(research, once, "2024-02-05")
    strip = lambda df: sorted(tuple(r) for r in df.drop("updated").collect())
    assert strip(once) == strip(twice)
    assert {str(r.updated) for r in twice.filter("slug = 'a-b'").collect()} == {"2024-02-05"}


def test_null_topics_keep_their_cards(spark):
    from deckflow.operators.cards import deck_position
    rows = [(1, "a"), (2, None), (3, "a"), (4, None)]
    got = deck_position(spark.createDataFrame(rows, "card_id long, topic string")).collect()
    assert sorted((r.card_id, r.label) for r in got) == [(1, "1 / 2"), (2, "1 / 2"), (3, "2 / 2"), (4, "2 / 2")]


def test_only_committed_snapshots_are_read(spark, tmp_path):
    from deckflow.operators.upsert import read_snapshot, upsert_buckets
    base = str(tmp_path / "cards")
    upsert_buckets(spark.range(10), base, "id", 1, buckets=4)
    upsert_buckets(spark.range(100, 102), base, "id", 2, buckets=4)
    (tmp_path / "cards" / "v000002" / "_SUCCESS").unlink()
    assert read_snapshot(spark, base).count() == 10
    assert read_snapshot(spark, str(tmp_path / "none")) is None


def test_unreadable_snapshot_fails_the_batch(spark, tmp_path):
    """A broken file beside the snapshot must not empty it, nor pass silently."""
    import pytest

    from deckflow.operators.upsert import read_snapshot
    from deckflow.streaming import engagement as S_
    cards, base = tmp_path / "cards", str(tmp_path / "snap")
    cards.mkdir()
    doc = '---\nconcept: "c"\ntitle: "t"\ntopic: "x"\ndepth: 1\nconnections: []\n---\n\n## Idea\ni\n'
    for i in range(3):
        (cards / f"c-{i}.md").write_text(doc)
    S_.run_card_upsert(S_.card_folder_stream(spark, str(cards)), base, str(tmp_path / "ck"), "2024-01-31").awaitTermination()
    assert read_snapshot(spark, base).count() == 3
    for p in (tmp_path / "snap" / "v000000").glob("*/*.parquet"):
        p.write_bytes(b"broken")
    for i in range(300):  # touches every bucket
        (cards / f"d-{i}.md").write_text(doc)
    with pytest.raises(Exception):
        S_.run_card_upsert(S_.card_folder_stream(spark, str(cards)), base, str(tmp_path / "ck"), "2024-01-31").awaitTermination()


def test_upsert_reduces_new_rows_and_keeps_old(spark):
    from deckflow.operators.upsert import upsert
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 4, 2), ("c", 7, 1)], "k string, v int, _seq long")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [("a", 1), ("b", 4), ("c", 7)]


def test_prompt_connections_are_escaped(spark):
    df = spark.createDataFrame([("s", "n", "c", "d", ['a"b', "é"])], "slug string, name string, cluster string, description string, connections array<string>")
    assert '["a\\"b", "é"]' in gen.research_prompts(df).first().prompt


def test_tokens_fold_marks_and_latin_additional(spark):
    df = spark.createDataFrame([("Tiếng Việt résumé",)], "t string")
    assert df.select(T.tokens("t").alias("w")).first().w == ["tieng", "viet", "resume"]


def test_bad_scalars_do_not_end_the_job(spark):
    doc = '---\nconcept: "c"\ntitle: "t"\ntopic: "x"\ndepth: two\ncreated: "soon"\nconnections: []\n---\n\n## Idea\ni\n'
    r = D.parse_cards(spark.createDataFrame([("cards/c-001.md", doc)], "path string, content string"), "2024-01-31").first()
    assert (r.depth, str(r.created_at)) == (1, "2024-01-31")


def test_documents_in_plain_front_matter(spark):
    def card(front):
        return f"---\n{front}\n---\n\n## Idea\ni\n"
    fronts = {
        "flow": "concept: stocks-and-flows\ntitle: \"Stocks: and flows\"\ntopic: Systems Thinking # note\ndepth: 2 # two\nconnections: [a-b, c]\nsource: {type: seed}\ncreated: 2026-04-10",
        "block": "concept: k\ntitle: 'It''s: a title'\ndepth: 3\nconnections:\n- a-b\n- 'c, d'\n- e # last\nsource:\n  type: twitter\n  id: '7'\ncreated: '2026-04-10'",
        "wrapped": "concept: k\ntitle: one\n  two\nconnections: [a-b,\n  c]\nsource: {type: pdf, id: x:page-1}\ntopic: null",
        "bad": "concept: k\ntitle: t\nconnections: [a, {b\ndepth: deep",
    }
    docs = spark.createDataFrame([(f"cards/{k}.md", card(v)) for k, v in fronts.items()], "path string, content string")
    got = {r.card_id: r for r in D.parse_cards(docs, "2024-01-31").collect()}
    r = got["flow"]
    assert (r.concept, r.title, r.topic, r.depth, r.connections, r.source_type, r.source_id, str(r.created_at)) == (
        "stocks-and-flows", "Stocks: and flows", "Systems Thinking", 2, ["a-b", "c"], "seed", "", "2026-04-10")
    r = got["block"]
    assert (r.title, r.topic, r.depth, r.connections, r.source_type, r.source_id, str(r.created_at)) == (
        "It's: a title", "", 3, ["a-b", "c, d", "e"], "twitter", "7", "2026-04-10")
    r = got["wrapped"]
    assert (r.title, r.topic, r.connections, r.source_type, r.source_id) == ("one two", "", ["a-b", "c"], "pdf", "x:page-1")
    assert (got["bad"].connections, got["bad"].depth) == ([], 1)
    assert sorted((r.path, r.key) for r in D.document_errors(docs).collect()) == [("cards/bad.md", "connections"), ("cards/bad.md", "depth")]


def test_concepts_with_block_lists(spark):
    text = "name: Stocks and flows\ncluster: systems-thinking\ndepth: 1\nconnections:\n  - {to: loops, weight: 0.8}\n  - to: delay\n    weight: 0.7\n    relationship: 'slows: it'\n"
    docs = spark.createDataFrame([("concepts/stocks.yaml", text)], "path string, content string")
    r = D.parse_concepts(docs).first()
    assert (r.concept, r.name, r.cluster, r.depth) == ("stocks", "Stocks and flows", "systems-thinking", 1)
    assert [(c.to, c.weight, c.relationship) for c in r.connections] == [("loops", 0.8, None), ("delay", 0.7, "slows: it")]
    assert D.document_errors(docs).count() == 0
    docs = spark.createDataFrame([("concepts/j.yaml", 'connections: [{"to":"B#2","weight":1.0,"relationship":"a: #b"}]\n')], "path string, content string")
    assert [(c.to, c.weight, c.relationship) for c in D.parse_concepts(docs).first().connections] == [("B#2", 1.0, "a: #b")]


def test_responses_of_every_shape(spark):
    rows = [(0, '[{"name": "A", "slug": "a", "depth": "2"}, 5, {"slug": "b", "connections": ["x"]}]'), (1, '{"concepts": [{"slug": "c"}]}'), (2, '{"slug": "d", "name": 7}'),
            (3, '[{"slug": "e"'), (4, '"text"'), (5, '{"concepts": "none"}'), (6, None), (7, "[]"), (8, '{"concepts": []}')]
    df = spark.createDataFrame(rows, "id int, json string")
    got = {(r.id, r.idx): r for r in R.concepts(df).collect()}
    assert sorted(got) == [(0, 0), (0, 2), (1, 0), (2, 0)]
    assert (got[0, 0].name, got[0, 0].depth, got[0, 2].connections, got[2, 0].slug) == ("A", 2, ["x"], "d")
    assert {r.id: r.reason for r in R.rejects(df).collect()} == {3: "not JSON", 4: "no list or object", 5: "concepts is no list", 6: "not JSON"}


def test_research_responses(spark):
    rows = [(0, '{"concept": "a", "fundamentals": "f", "examples": [{"title": "t", "body": "b"}, {"body": "c"}], "probes": null}'), (1, "{}"), (2, "[1]"), (3, '{"fundamentals": 5}'),
            (4, '{"probes": [{"question": "q"}, "x"]}'), (5, '{"examples": {"title": "t"}}'), (6, '{"concept": "a"')]
    df = spark.createDataFrame(rows, "id int, json string")
    got = {r.id: r for r in R.research(df).collect()}
    assert sorted(got) == [0, 1]
    assert [tuple(e) for e in got[0].examples] == [("t", "b"), (None, "c")] and got[0].probes is None and got[1].concept is None
    assert {r.id: r.reason for r in R.research_rejects(df).collect()} == {
        2: "no object", 3: "fundamentals is no text", 4: "probes is no list of objects", 5: "examples is no list of objects", 6: "not JSON"}


def test_responses_are_read_once(spark):
    """No filter makes Spark match or parse a response again."""
    replies = spark.createDataFrame([(1, "{}")], "id int, response string").select("id", R.json_text("response").alias("json"))
    for read in (R.research, R.research_rejects, R.rejects):
        plan = read(replies)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, plan


def test_fences_match_the_pattern(spark):
    """``json_text`` gives what the fence pattern gives, without its steps a letter."""
    parts, texts = ["```", "json", "\n", " ", "x"], ["", "`\n", "```\n```\n```", "é```json \n{}\n``` ```\nb\n```", "```json\n{"]
    texts += ["".join(p) for p in itertools.product(parts, repeat=5)]
    found = {t: re.search(R.FENCE, t) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "r string")
    assert {r.r: r.j for r in df.select("r", R.json_text("r").alias("j")).collect()} == {None: None, **{t: m.group(1) if m else t for t, m in found.items()}}
    plan = df.select(R.json_text("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(r#" not in plan  # the lazy pattern isn't run over whole texts


def test_later_rows_count(spark):
    """Of rows for one concept the last of the input counts, whatever its text."""
    links = "array<struct<slug:string,name:string,relationship:string>>"
    rows = [("k", "", "zzz first", [("e1", "b1"), ("e2", "b2"), ("e3", "b3")], []), ("k", "second", "bbb", [], []), ("k", "third", "aaa last", [("n1", "m1")], [])]
    research = spark.createDataFrame(rows, f"concept string, cluster string, fundamentals string, examples array<struct<title:string,body:string>>, connections_discovered {links}").coalesce(1)
    research = research.withColumn("probes", F.lit(None).cast("array<struct<question:string,hint:string>>"))
    none = spark.createDataFrame([], "slug string, name string, cluster string, depth int, description string, connections array<struct<to:string,weight:double,relationship:string>>, created date, updated date")
    m = gen.concept_merge(research, none, "2024-01-31").first()
    assert (m.description, m.cluster) == ("aaa last", "second")  # the first cluster that isn't empty stays
    cards = {r.card_id: r for r in gen.generate_cards(research, "2024-01-31").collect()}
    assert cards["k-001"].idea == "aaa last" and cards["k-001"].example == "**n1** — m1"
    assert sorted(cards) == ["k-001", "k-002", "k-003"] and cards["k-003"].title == "e3"  # what only the first row had stays


def test_cards_of_named_texts(spark):
    """Texts given by name make the same cards, also where a name is null, unknown
    or has several texts; they are not part of the rows that are reduced."""
    kinds = "_seq long, concept string, text_id long, examples array<struct<title:string,body:string>>"
    rows = [(i, f"c{i % 3}" if i % 5 else None, None if i == 4 else i % 6, [(f"t{j}", "b") for j in range(i % 4)]) for i in range(24)]
    rows += rows[-2:]
    texts = spark.createDataFrame([(0, "x" * 300), (1, "one"), (1, "another"), (1, None), (2, None), (3, "three"), (3, "three")], "text_id long, text string")
    refs = spark.createDataFrame(rows, kinds).select("*", F.lit("k").alias("cluster"), F.lit(None).cast("array<struct<question:string,hint:string>>").alias("probes"),
                                                     F.lit(None).cast("array<struct<slug:string,name:string,relationship:string>>").alias("connections_discovered"))
    whole = refs.join(texts, "text_id", "left").withColumnRenamed("text", "fundamentals")
    named = gen.generate_cards(refs, "2024-01-31", texts)
    assert sorted(map(str, named.collect())) == sorted(map(str, gen.generate_cards(whole, "2024-01-31").collect()))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "max_by" in line and "idea" in line], plan


def test_sections_with_many_headings(spark):
    text = "\n".join(f"## H{i % 700}\nbody {i}" for i in range(2000))
    got = spark.createDataFrame([(text,), ("no heading",)], "t string").select(T.sections_map("t").alias("m")).collect()
    assert got[0].m == {f"h{i}": f"body {max(x for x in range(i, 2000, 700))}" for i in range(700)} and got[1].m == {}


def test_paths_are_decoded(spark):
    df = spark.createDataFrame([("file:/a/my%20card%20%231.md",), ("a/x+y%.md",)], "p string")
    assert [r.s for r in df.select(T.file_stem(T.decoded_path("p")).alias("s")).collect()] == ["my card #1", "x+y%"]


def test_build_path(spark, tmp_path):
    from deckflow.operators.upsert import read_snapshot
    from deckflow.plans.jobs import build
    signals = S.text_drop(spark.createDataFrame([(i, f"text {i}") for i in range(25)], ["id", "text"]))
    ask = lambda b: b.select("batch", F.concat(F.lit('{"concepts": [{"slug": "b-'), F.col("batch"), F.lit('", "name": "B", "cluster": "C"}, {"slug": "both"}]}')).alias("response"))
    reply = lambda p: p.select("slug", F.when(p.slug == "b-1", "oops").otherwise('```json\n{"fundamentals": "why", "examples": [{"title": "t", "body": "b"}]}\n```').alias("response"))
    run = lambda s: {r.stage: r.n for r in build(spark, s, ["id"], ask, reply, str(tmp_path), "2024-01-31").collect()}
    counts = run(signals)
    assert {k: counts[k] for k in ("signals", "prompt_blocks", "concepts", "research", "research_rejects", "cards", "indexed")} == {
        "signals": 25, "prompt_blocks": 3, "concepts": 4, "research": 3, "research_rejects": 1, "cards": 3, "indexed": 3}
    assert {(r.slug, r.cluster) for r in read_snapshot(spark, f"{tmp_path}/concepts").collect()} == {("b-0", "C"), ("b-2", "C"), ("both", "")}
    assert run(signals.limit(0)) == {"signals": 0} and read_snapshot(spark, f"{tmp_path}/cards").count() == 3
    assert run(signals.filter("id < 10"))["cards"] == 2 and read_snapshot(spark, f"{tmp_path}/cards").count() == 3
