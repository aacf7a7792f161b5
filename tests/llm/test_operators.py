"""Operators against brute force, and their defined results on odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, n int, _size long"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", 7, 9) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    return docs_of(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "...", "en", None), (4, "the cat sat on the mat", "en", "s"),
                           (4, "the cat sat on the mat", "en", "s"), (None, "a b", None, "s"), (5, long_text, "de", "t"), (6, "the cat sat on the mat", None, "s")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).limit(0)


# --- 8 ---------------------------------------------------------------------

def naive_fingerprint(text):
    import xxhash
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    return sum(1 << bit for bit in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams))


def naive_components(fps, bits=3):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = sorted((root(i), root(j)))
            ids[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    from deckflow.llm.queries import op8
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [naive_fingerprint(d.text) for d in docs]
    roots = naive_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8(spark, SF).collect()}
    assert got == {d.doc_id: (f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, roots)}


@pytest.mark.parametrize("limit", [4096, 4])
def test_linking_any_fingerprints(spark, limit):
    from deckflow.llm.simhash import link_components
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(15)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in link_components(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, limit).collect()}
    want = naive_components(fps)
    classes, found = {}, {}
    for f, c in zip(signed, want):
        classes.setdefault(c, set()).add(f)
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def test_byte_sets_cover():
    from deckflow.llm.simhash import byte_sets
    sets = byte_sets(3)
    for gone in itertools.combinations(range(8), 3):
        lost = sum(0xFF << 8 * b for b in gone)
        assert any(not m & lost for m in sets)


def test_simhash_odd(spark, odd, none):
    from deckflow.llm.simhash import keep_one_per_group, simhash_groups
    got = sorted(((r.doc_id or 0), r.fp == 0, r.component_id) for r in simhash_groups(odd).collect())
    assert got[0][2] is None and got[1:3] == [(1, True, 1), (2, True, 1)] and [g[2] for g in got if g[0] in (4, 6)] == [4, 4, 4]
    kept = keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert simhash_groups(none).count() == 0 and keep_one_per_group(none).count() == 0


# --- 2 ---------------------------------------------------------------------

def naive_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        c, n, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        lo, hi = (lo, c) if n <= shards else (c + 1, hi)
    return lo


@pytest.mark.parametrize("seed,fences", [(1, 16), (2, 24), (3, 4096)])
def test_least_capacity(spark, seed, fences):
    from deckflow.llm.sharding import least_capacity
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(300)] + [rng.randint(200, 900)]
    rng.shuffle(sizes)
    upto = list(itertools.accumulate(sizes))
    capacity, cuts = least_capacity(spark.createDataFrame([(u,) for u in upto], "upto long"), 8, fences)
    assert capacity == naive_capacity(sizes, 8)
    edges = [0, *cuts, upto[-1]]
    assert all(0 <= b - a <= capacity for a, b in zip(edges, edges[1:])) and set(cuts) <= {0, *upto}


def test_shards_keep_groups_and_slots(spark, odd, none):
    from deckflow.llm.sharding import shard_documents
    got = shard_documents(odd, 8).collect()
    assert len(got) == 8
    assert len({r.shard for r in got if r.doc_id in (4, 6)}) == 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.doc_id: (r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {1: (1, 0), 2: (1, 0)}
    assert shard_documents(none, 8).count() == 0


# --- 4 ---------------------------------------------------------------------

def test_token_files_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    from deckflow.llm import tokenfile as TF
    from deckflow.llm.queries import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a  b\n c\t d", " x", "<|endoftext|> y", "x<|endoftext|>.  <|endoftext|>\n\n<|endoftext|>z, w <|endo ftext|>", "ñandú z", None, "", "it's  we'll 'tis", "tab em  \n\n end "]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        manifest = TF.write_token_files(df, tokenizer_path(), f"file://{tmp_path}/{df is odd}", file_bytes=64)
        got = sorted(map(tuple, TF.read_token_files(manifest).collect()), key=lambda r: r[1])
        at, want = 0, []
        for r in rows:
            ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(got, key=str) == sorted(want, key=str)
    first = manifest.orderBy("before").first()
    words = TF.get_file(first.dictionary).read()
    assert len(TF.Reader(first.path, words)) == first.docs
    with pytest.raises(ValueError):
        TF.Reader(first.path, words + b"x")
    assert TF.read_token_files(TF.write_token_files(none, tokenizer_path())).count() == 0


def test_encoder_equals_whole_texts(monkeypatch):
    """Pieces many at a time, a cache that is thinned again and again, texts of
    odd characters, special strings and line ends."""
    from deckflow.llm import tokenfile as TF
    from deckflow.llm.queries import tokenizer_path
    rng = random.Random(9)
    own = TF.Encoder(tokenizer_path())
    assert own.line is not None
    monkeypatch.setattr(TF, "CACHE", 200)
    parts = ["the", " fox", "'s", "\n", "  ", "\t", "é", "ñu", "日本", "\u00a0", "\u2003", "12", "<|endoftext|>", ".", ",", "!?", "\x1c", "\x85", "\u00ad", "🙂", "a" * 40, "\0"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else " " + "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        for text, ids in zip(texts, own.encode([*texts, None])):
            assert ids.tolist() == own.tok.encode(text, add_special_tokens=False).ids + [2], text
        assert len(own.used) < 1500
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))  # equal hashes, see test_collocations
    u = t.translate(str.maketrans("ab", "ba"))
    for text, ids in zip([t, f"{u} {t}", u], own.encode([t, f"{u} {t}", u])):
        assert ids.tolist() == own.tok.encode(text, add_special_tokens=False).ids + [2]


# --- 9 ---------------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    from deckflow.llm.topk import top_k
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    rows += [(7, rows[7][1], "copy"), (900, None, "n"), (950, [1.0, None], "n"), (1000, [float("nan")] * 6, "n"), (50, rows[50][1][:3], "short")]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string"), 5, 50, block=16, group=4)
    v = [(i, np.floor(np.array(e, np.float32).astype(float) * 256).astype(int)) for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for n, (i, q) in enumerate(v):
        if i % 50 == 0:
            s = sorted((-int(q[:min(len(q), len(c))] @ c[:min(len(q), len(c))]), j) for m, (j, c) in enumerate(v) if m != n)[:5]
            want += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 10 --------------------------------------------------------------------

def test_budgets_move_among_siblings_first(spark):
    from deckflow.llm.mixing import split_budgets
    leaves = [(0, "a", "x", 10), (0, "a", "y", 1000), (0, "b", "x", 1000), (0, "b", "y", 1000)]
    df = spark.createDataFrame(leaves, "root int, l1 string, l2 string, tokens long")
    got = {(r.l1, r.l2): r.budget for r in split_budgets(df, ["root", "l1", "l2"], [F.lit(1), F.lit(1)], (400, 3010), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}


def test_mix_odd(spark, odd, none):
    from deckflow.llm.mixing import mix
    from deckflow.llm.queries import mix_levels, mix_weights
    got = mix(odd, mix_levels(odd), mix_weights(), (1, 1), 2, "s")
    assert sum(r.n_tokens for r in got.collect()) <= odd.select(F.sum(F.size(F.split("text", " ")))).first()[0] + 1
    assert got.select("doc.*").columns == odd.columns
    assert mix(none, mix_levels(none), mix_weights()).count() == 0


# --- 1 ---------------------------------------------------------------------

def test_forward_backward_is_exact():
    from deckflow.llm.langid import forward_backward
    rng = np.random.default_rng(2)
    trans, lengths = rng.normal(size=(3, 3)), [1, 5, 70, 33]
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32)
    gamma, _ = forward_backward(scores, trans, lengths)
    at = 0
    for n in lengths:
        e, a = np.exp(scores[at:at + n].astype(float)), np.exp(trans)
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        f[0] = (np.ones(3) / 3 @ a) * e[0]
        for t in range(1, n):
            f[t] = (f[t - 1] / f[t - 1].sum()) @ a * e[t]
        for t in range(n - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b / (f * b).sum(1, keepdims=True)
        assert np.allclose(gamma[at:at + n], want, atol=1e-4)
        at += n


def test_language_held_out_accuracy(spark):
    from deckflow.llm.queries import op1
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op1(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95


def test_language_odd(spark, odd, none):
    from deckflow.llm.langid import identify, keep_identified, labelled_sample, spans, train
    model = train(labelled_sample(odd, F.lit(True)))
    got = {(r.doc_id or 0): (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and 0 <= got[4][1] <= 1
    kept = keep_identified(odd, model, 0.35)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, None}
    assert train(labelled_sample(none, F.lit(True))) is None
    assert identify(none, None).count() == 0 and {r.lang_pred for r in identify(odd, None).collect()} == {"und"}
    assert spans(model, "") == [] and spans(model, "the cat")[0][:2] == (0, 2)


# --- 5 ---------------------------------------------------------------------

def naive_terms(text):
    from collections import Counter
    tf = Counter(t for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for t in [w, *[w[:n] + "*" for n in range(4, 10) if len(w) >= n]])
    return {**tf, **{t + "2": c for t, c in tf.items() if c > 1 and t[-1] == "*"}}


def test_neighbours_equal_brute_force(spark):
    """Exact cosines over all terms, idf over all documents; every example is its
    own nearest neighbour."""
    import math

    from deckflow.llm.toxicity import learn, strength
    rng = random.Random(4)
    common = ["and", "the", "of"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 30))) + (" stupidly stupid" if i % 5 == 0 else "") + (" x" * 50 if i == 7 else ""), "en", "s") for i in range(300)]
    rows += [(400, "nothing " + "y" * 5000, "en", "s"), (401, "", "en", "s")]
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    index = learn(docs_of(spark, rows), labels, F.lit(True))
    tf = {i: naive_terms(t) for i, t, _, _ in rows}
    df = {}
    for v in tf.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    own = sorted({t for i in range(200) for t in tf[i]})
    held = {t: [i for i in range(200) if t in tf[i]] for t in own}
    factor = dict(zip(own, strength(np.array([sum(i % 5 == 0 for i in held[t]) for t in own], float), np.array([len(held[t]) for t in own], float), 0.2)))
    assert factor["stupi*"] > 30 and factor["and"] < 10

    def vector(i):
        v = {t: (1 + math.log(c)) * math.log(1 + len(rows) / df[t]) * factor[t] for t, c in tf[i].items() if t in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}
    made = {i: vector(i) for i in tf}
    texts = [t for _, t, _, _ in rows]
    for (i, *_), near in zip(rows, index.nearest(*index.vectors(texts), len(texts))):
        want = sorted((-round(sum(w * made[j].get(t, 0) for t, w in made[i].items()), 9), j) for j in range(200) if set(made[i]) & set(made[j]))[:15]
        assert np.allclose([s for s, _, _ in near], [-s for s, _ in want], atol=1e-8), i
        if i < 200:
            assert near[0][0] > 1 - 1e-9 and (near[0][1] == i or rows[near[0][1]][1] == rows[i][1])


def test_toxicity(spark, odd, none):
    from deckflow.llm.toxicity import learn, score_documents
    rows = [(i, f"plain text number n{i}" + (" you scumbag loser" if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(100)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    index = learn(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in score_documents(docs, index).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200))
    scores = [r.score for r in score_documents(odd, index).collect()]
    assert len(scores) == 8 and all(0 <= s < 0.7 for s in scores)
    assert learn(none, labels, F.lit(True)) is None and score_documents(none, index).count() == 0
    assert {r.score for r in score_documents(odd, None).collect()} == {0.0}


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_term_counts_equal_plain_ones(monkeypatch, size):
    """Counts from running sums over letters, a few words at a time, against the words themselves."""
    from collections import Counter

    from deckflow.llm import toxicity as tox
    monkeypatch.setattr(tox, "WORDS", size)
    texts = ["Insult insulted, INSULT! x1y2_z \u0130stanbul stra\u00dfe \u0663\u0664 caf\u00e9-cafe\u0301", None, "", "12 _ 34", "insults insult " * 5, "\ud800lone caf\u00e9 \u4e2d\u6587\u4e2d\u6587"]

    def of(word):
        h, _, stem = tox.term_hashes(*next(tox.words_of([word]))[1:])
        return h.tolist(), stem.tolist()

    want = []
    for t in texts:
        once, further = Counter(), {}
        for w in tox.WORD.findall((t or "").lower()):
            for h, stem in zip(*of(w)):
                once[h] += 1
                if stem:
                    further[h] = int(tox.twice(np.array([h], np.uint64))[0])
        want.append({**once, **{further[h]: n for h, n in once.items() if n > 1 and h in further}})

    def got(terms):
        out = [{} for _ in texts]
        for text, term, tf in zip(*(x.tolist() for x in terms.counts(texts))):
            h = term if terms.vocabulary is None else int(terms.vocabulary[term])
            assert h not in out[text]
            out[text][h] = tf
        return out

    assert got(tox.Terms()) == want and len(want[0]) > 20 and want[1:4] == [{}, {}, {}]
    vocabulary = np.unique(np.array([h for x in (want[0], want[4]) for h in x], np.uint64))
    assert got(tox.Terms(vocabulary)) == [{h: n for h, n in x.items() if h in vocabulary} for x in want]
    assert got(tox.Terms(np.zeros(0, np.uint64))) == [{} for _ in texts]
    assert len(of("insulting")[0]) == 1 + len(tox.STEMS) and of("insult")[0][1:] == of("insulting")[0][1:4]


def test_toxicity_postings():
    """Sums over postings equal those of whole vectors and need memory for one
    text at a time; terms with equal first bits are told apart."""
    import tracemalloc

    from deckflow.llm import toxicity as tox
    rng = np.random.default_rng(5)
    n, terms, number = 640, 2000, 200
    dense = (rng.random((n, terms)) < 0.06) * rng.integers(1, 4, (n, terms))
    dense[:, :5] = 1  # terms of many examples
    example, term = np.nonzero(dense)
    index = tox.Index(np.arange(terms).astype(np.uint64), np.ones(terms), list(range(n)), [i % 2 for i in range(n)], example, term, dense[example, term])
    asked = (rng.random((number, terms)) < 0.2) * 1.0
    asked[7] = 0
    text, term = np.nonzero(asked)
    value = tox.unit(text, np.ones(len(text)), number)
    order = rng.permutation(len(text))
    tracemalloc.start()
    near = index.nearest(text[order], term[order], value[order], number)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    weights = np.where(dense > 0, 1 + np.log(np.maximum(dense, 1)), 0)
    whole = (asked / np.maximum(np.linalg.norm(asked, axis=1), 1)[:, None]) @ (weights / np.linalg.norm(weights, axis=1)[:, None]).T
    for d in range(number):
        want = np.sort(whole[d])[::-1][:tox.NEIGHBOURS]
        assert np.allclose([x[0] for x in near[d]], want[want > 1e-12], atol=1e-9)
    assert near[7] == [] and peak < 20e6, peak  # all postings of the texts at once: over 60 MB

    vocabulary = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500), np.arange(40) + (1 << 62), [0, (1 << 63) - 1]]).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    asked = np.concatenate([vocabulary, vocabulary - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    place = tox.Terms(vocabulary).places(asked)
    assert place.tolist() == [{h: i for i, h in enumerate(vocabulary.tolist())}.get(h, len(vocabulary)) for h in asked.tolist()]


# --- 6 ---------------------------------------------------------------------

def test_url_lists(spark):
    from deckflow.llm.urllists import evaluate
    entries = [("l", "block", "domain", "bad.com", "add", "2024-01-10", 1), ("l", "block", "domain", "bad.com", "remove", "2024-03-05", 1),
               ("l", "block", "domain", "bad.com", "add", "2024-05-01", 1), ("ok", "allow", "host", "good.bad.com", "add", "2024-01-01", 1),
               (None, "block", "domain", "x.com", "add", "2024-01-01", 1)]
    e = spark.createDataFrame(entries, "list string, role string, kind string, key string, action string, day string, seq int").withColumn("day", F.to_date("day"))
    caps = [(1, "http://WWW.bad.com./a", "2024-01-09"), (2, "http://u@www.bad.com:80/a", "2024-01-10"), (3, "https://bad.com", "2024-03-04"), (4, "https://bad.com", "2024-03-05"),
            (5, "https://good.bad.com/x", "2024-06-01"), (6, "https://notbad.com/x", "2024-06-01"), (7, None, "2024-06-01"), (8, "nonsense", "2024-06-01"), (9, "http://bad.com/", None), (9, "http://bad.com/", "2025-01-01")]
    c = spark.createDataFrame(caps, "page_id int, url string, day string").withColumn("day", F.to_date("day")).withColumn("key", F.lit("clash"))
    got = sorted((r.page_id, r.blocked) for r in evaluate(c, e).collect())
    assert got == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False), (9, False), (9, True)]
    assert evaluate(c.limit(0), e).count() == 0 and not any(r.blocked for r in evaluate(c, e.limit(0)).collect())


# --- 7 ---------------------------------------------------------------------

def naive_fit(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    from deckflow.llm.decontam import fit
    rng = random.Random(6)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        dist, a, b = fit(item, text, 99)
        assert dist == naive_fit(item, text)
        assert naive_fit(item, text[a:b]) == dist


def test_leaks_are_found(spark, odd, none):
    """Leaks of every size at up to 20 % of their words, against the edit
    distance by dynamic programming; nothing else is reported."""
    from deckflow.llm.decontam import contaminated, decontaminate, words_of
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    items = {i: " ".join(word() for _ in range(rng.choice([9, 15, 25, 60, 140]))) for i in range(40)}
    rows, leaked = [], {}
    for d in range(240):
        text = [word() for _ in range(200)]
        if d % 2:
            i = rng.randrange(40)
            part = items[i].split()
            edits = int(len(part) * rng.choice([0, 0.05, 0.1, 0.2]))
            for at in sorted(rng.sample(range(len(part)), edits), reverse=True):
                kind = rng.randrange(3)
                part[at:at + 1] = [[], [word()], [word(), part[at]]][kind]
            text[50:50] = part
            leaked[d, i] = edits
        rows.append((d, " ".join(text).capitalize() + ".", "en", "s"))
    bench = spark.createDataFrame([*items.items(), (98, None), (97, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs_of(spark, rows), bench).collect()}
    texts = {d: words_of(t) for d, t, _, _ in rows}
    assert set(got) <= set(leaked) and len(got) >= 0.95 * len(leaked)
    for (d, i), r in got.items():
        assert r.distance == naive_fit(items[i].split(), texts[d]) <= leaked[d, i]
        assert naive_fit(items[i].split(), texts[d][r.first_word:r.end_word]) == r.distance
    for part in ((0, 15), (16, 60), (61, 200)):
        own = [k for k in leaked if part[0] <= len(items[k[1]].split()) <= part[1]]
        assert len([k for k in own if k in got]) >= 0.9 * len(own)
    clean = decontaminate(docs_of(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(240)) - {d for d, _ in got}
    assert decontaminate(odd, bench).count() == 8 and decontaminate(odd, bench).columns == odd.columns
    assert contaminated(none, bench).count() == 0 and contaminated(odd, bench.limit(0)).count() == 0


def test_short_and_equal_items_match(spark):
    from deckflow.llm.decontam import contaminated
    long_ = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, "Red fox!"), (2, "red fox"), (3, "zebra"), (4, long_), (5, long_.upper())], "item_id long, text string")
    rows = [(1, "a red fox, red fox", None, None), (2, "red", None, None), (3, "fox zebra red", None, None), (4, f"x {long_} y", None, None), (5, "red", None, None), (6, "fox", None, None)]
    got = sorted((r.doc_id, r.item_id, r.first_word, r.end_word, r.distance) for r in contaminated(docs_of(spark, rows), bench).collect())
    assert got == [(1, 1, 1, 3, 0), (1, 2, 1, 3, 0), (3, 3, 1, 2, 0), (4, 4, 1, 11, 0), (4, 5, 1, 11, 0)]


# --- 3 ---------------------------------------------------------------------

def test_compact_windows_cover_every_run():
    from deckflow.llm.passages import compact_windows
    rng = np.random.default_rng(1)
    sig = rng.integers(1, 60, 120).astype(np.uint64) << np.uint64(40)
    l, c, r = compact_windows(sig, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            k = [x for x in range(len(c)) if l[x] <= i <= c[x] <= j <= r[x]]
            assert len(k) == 1 and c[k[0]] == i + int(np.argmin(sig[i:j + 1]))


def test_passages(spark, odd, none):
    from deckflow.llm.passages import passages
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8)))
    shared = [[word() for _ in range(70)] for _ in range(4)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(150)]
        if d % 3:
            text[40:40] = shared[d % 4]
        rows.append((d, " ".join(text), "en", "s"))
    rows += [(100, rows[0][1], "en", "s"), (101, rows[0][1].upper(), "en", "s")]
    got = {}
    for r in passages(docs_of(spark, rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    want = {}
    for d in range(60):
        if d % 3:
            want.setdefault(d % 4, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted([*map(sorted, want.values()), [0, 100, 101]])
    assert passages(none).count() == 0 and passages(odd).count() == 0


def _similar_runs(a, b, t, similarity):
    """Whether any run of ``a`` and of ``b`` of ``t`` tokens and more are similar, by trying them all."""
    runs = [[frozenset(x[i:j]) for i in range(len(x)) for j in range(i + t, len(x) + 1)] for x in (a, b)]
    return any(len(p & q) >= similarity * len(p | q) for p in set(runs[0]) for q in set(runs[1]))


def test_verified_equals_brute_force():
    from deckflow.llm.passages import verified
    rng = random.Random(3)
    seen = set()
    for _ in range(400):
        t, n = rng.randint(4, 6), rng.randint(9, 14)
        pool = rng.choice((8, 40))
        a = [rng.randrange(pool) for _ in range(n)]
        b = [x if rng.random() < 0.85 else rng.randrange(pool) for x in a]
        if rng.random() < 0.5:
            i = rng.randrange(n)
            b = b[i:] + b[:i]
        found = verified(np.array(a, np.uint64), np.array(b, np.uint64), t, 0.8)
        assert bool(found) == _similar_runs(a, b, t, 0.8)
        seen.add(bool(found))
        for s, e, os_, oe, x in found:
            p, q = set(a[s:e]), set(b[os_:oe])
            assert min(e - s, oe - os_) >= t and x == pytest.approx(len(p & q) / len(p | q)) and x >= 0.8
    assert seen == {True, False}


def test_repeated_tokens_are_bounded_before_the_search(monkeypatch):
    from deckflow.llm import passages
    rng = random.Random(8)
    for _ in range(300):  # few tokens, so runs hold them again and again
        t, pool = rng.randint(4, 6), rng.choice((2, 3, 5))
        a, b = ([rng.randrange(pool) * (rng.random() < 0.7) for _ in range(rng.randint(8, 14))] for _ in "ab")
        b = [x + rng.choice((0, 1, 9)) for x in b]
        assert bool(passages.verified(np.array(a, np.uint64), np.array(b, np.uint64), t, 0.8)) == _similar_runs(a, b, t, 0.8)
    before = passages._previous(np.array([3, 3, 4, 3, 5, 5]))
    assert passages._distinct(before, 3).tolist() == [2, 2, 3, 2]
    # one token in common, and no run of the second text holds so few tokens: nothing to search
    tried = []
    monkeypatch.setattr(passages, "_search", lambda *a: tried.append(a))
    one, other = np.zeros(898, np.uint64), np.arange(46, dtype=np.uint64) % 6
    assert passages.verified(one, other, 46) == [] and not tried


def test_pieces_that_cannot_align_are_not_searched(monkeypatch):
    from deckflow.llm import passages
    draw = np.random.default_rng(7)
    tried, old = [], passages._search
    monkeypatch.setattr(passages, "_search", lambda *a: tried.append(a) or old(*a))
    for step in (6, 7):  # more than 0.8 of the tokens are in common, but each text misses others: 0.78 together
        x = draw.integers(1, 1 << 62, 400).astype(np.uint64)
        y = x.copy()
        y[::step] += np.uint64(1)
        assert passages.verified(x, y, 46) == [] and passages.verified(y, x, 46) == []
    assert not tried


def test_runs_of_repeated_lines():
    from deckflow.llm.passages import _repetitive
    rng = random.Random(10)
    for _ in range(300):
        n, pool, t = rng.randint(6, 40), rng.randint(1, 6), rng.randint(2, 6)
        ids = np.unique([rng.randrange(pool) for _ in range(n)], return_inverse=True)[1]
        worth = np.array([rng.choice((1.0, -0.8)) for _ in range(ids.max() + 1)])
        least = rng.randint(1, 4) * 0.8
        runs = [(i, j) for i in range(n) for j in range(i + t, n + 1) if worth[np.unique(ids[i:j])].sum() >= least - 1e-9]
        got = _repetitive(ids, worth, np.arange(n), least, t)
        assert (got is None) == (not runs)
        assert got is None or got in runs and got[1] - got[0] == max(j - i for i, j in runs)


def test_one_changed_word():
    from deckflow.llm.passages import MIN_WORDS, SHINGLE, tokens, verified
    rng = np.random.default_rng(4)
    t = MIN_WORDS - SHINGLE + 1
    for words in (50, 55, 60, 67, 74, 80):
        for at in range(words):
            x = rng.integers(1, 1 << 62, words).astype(np.uint64)
            y = x.copy()
            y[at] += np.uint64(1)
            a, b = (tokens(np.concatenate([rng.integers(1, 1 << 62, 30).astype(np.uint64), z, rng.integers(1, 1 << 62, 30).astype(np.uint64)])) for z in (x, y))
            # only runs at the same place can be similar; runs as long as they are, or with one token more or less, share no more
            want = any(2 * int((p == q).sum()) - (j - i) >= 0 and int((p == q).sum()) >= 0.8 * (2 * (j - i) - int((p == q).sum()))
                       for i in range(len(a)) for j in range(i + t, len(a) + 1) for p, q in [(a[i:j], b[i:j])])
            found = verified(a, b, t)
            assert bool(found) == want, (words, at)
            assert all(min(f[0], f[2]) >= 30 and max(f[1], f[3]) <= 30 + words - SHINGLE + 1 for f in found) or 55 > words  # a run of t tokens may need a miss


def test_windows_meet_behind_other_groups():
    from deckflow.llm.passages import overlapping, verified
    # a passage at 1000..1080: one function's window starts far to the left, others open groups in between
    met = [(0, 1080, 0, 1080, 0), *[(100 * i, 100 * i + 60, 5000 + 100 * i, 5060 + 100 * i, 2) for i in range(1, 10)], (1000, 1080, 1000, 1080, 1)]
    assert [g[4] for g in overlapping(sorted(met), 46) if len(g[4]) > 1] == [{0, 1}]
    rng = random.Random(5)
    for _ in range(200):
        met = sorted((l := rng.randrange(300), l + rng.randint(10, 80), m := rng.randrange(300), m + rng.randint(10, 80), rng.randrange(4)) for _ in range(30))
        where = [{i for i, g in enumerate(overlapping(met, 11)) if g[0] <= l and r <= g[1] and g[2] <= al and ar <= g[3] and k in g[4]} for l, r, al, ar, k in met]
        for x, p in zip(met, where):
            for y, q in zip(met, where):
                if min(x[1], y[1]) - max(x[0], y[0]) >= 10 and min(x[3], y[3]) - max(x[2], y[2]) >= 10:
                    assert p & q
    # one stretch of windows may hold a passage of one text twice in the other
    draw = np.random.default_rng(6)
    word = lambda n: draw.integers(1, 1 << 62, n).astype(np.uint64)
    passage = word(60)
    found = verified(np.concatenate([word(30), passage, word(30)]), np.concatenate([passage, word(50), passage]), 46)
    assert sorted(f[2:4] for f in found) == [(0, 60), (110, 170)]


def test_passages_around_a_common_line(spark):
    from deckflow.llm.passages import passages
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(n)]
    line, rows = words(40), []
    for d in range(0, 60, 2):  # pairs share a passage around a line that all texts hold
        shared = [*words(8), *line, *words(8)]
        rows += [(i, " ".join([*words(60), *shared, *words(60)]), "en", "s") for i in (d, d + 1)]
    for d in range(100, 190, 3):  # the second text shares one passage with the first and another with the third; the first holds a line of it
        one, short = words(60), words(40)
        two = [*words(8), *short, *words(8)]
        rows += [(d, " ".join([*one, *words(60), *short, *words(60)]), "en", "s"), (d + 1, " ".join([*one, *words(60), *two]), "en", "s"),
                 (d + 2, " ".join([*words(60), *two, *words(30)]), "en", "s")]
    classes = {}
    for r in passages(docs_of(spark, rows)).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    found = list(classes.values())
    missing = [(d, d + 1) for d in range(0, 60, 2) if not any({d, d + 1} <= x for x in found)]
    missing += [(d, d + 1) for d in range(100, 190, 3) if not any({d, d + 1} <= x for x in found)]
    missing += [(d + 1, d + 2) for d in range(100, 190, 3) if not any({d + 1, d + 2} <= x for x in found)]
    assert not missing


def test_unlike_texts_around_a_common_line_do_not_meet(spark, monkeypatch):
    from deckflow.llm import passages
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(n)]
    line, shared = words(40), words(12)
    rows = [(d, " ".join([*words(60), *line, *words(60)]), "en", "s") for d in range(40)]
    rows += [(d, " ".join([*words(60), *shared, *line, *words(60)]), "en", "s") for d in (50, 51)]
    met, old = [], passages.verify
    monkeypatch.setattr(passages, "verify", lambda found, *a: met.append(found.select("node", "other").distinct().count()) or old(found, *a))
    got = {}
    for r in passages.passages(docs_of(spark, rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert list(got.values()) == [{50, 51}]
    assert max(met[1:], default=0) <= 1  # the two that share a passage


def test_able_stretches_hold_every_run_that_may_be_similar():
    from deckflow.llm.passages import _able
    rng = random.Random(15)
    for _ in range(300):
        t, pool, n = rng.randint(3, 6), rng.choice((4, 12, 60)), rng.randint(1, 24)
        tok, shared = [rng.randrange(pool) for _ in range(n)], {x for x in range(pool) if rng.random() < 0.7}
        inside = {i for p, q in _able(np.array(tok), np.array(sorted(shared), np.int64), t, 0.8) for i in range(p, q)}
        for i in range(n):
            for j in range(i + t, n + 1):
                own = set(tok[i:j])
                assert len(own & shared) < 0.8 * len(own) or inside >= set(range(i, j))


def test_features_read_the_whole_word():
    from deckflow.llm.langid import features
    assert features("a" * 50 + "xyz", {}) != features("a" * 50 + "uvw", {})
    assert zlib.crc32(b"swxyz") % (1 << 17) in features("a" * 50 + "wxyz", {})
