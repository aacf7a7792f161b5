"""Operator 11 against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, a long, n int, fp long, row string, phrase string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 5, 1, 7, "x", "y") for i, t, lang in rows], SCHEMA)


def naive(rows, least, top, percent=100, longest=5):
    count, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i:i + n])] += 1
    frequent = {k: a for k, a in count.items() if a >= least}
    out = []
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        score, k = min((1000 * a * words[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(ql == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (ql, q), b in frequent.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], words[lang]))
    rank, got = Counter(), []
    for lang, score, a, p, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n, -score))
    return got


def rows_of(n=80):
    rng = np.random.default_rng(4)
    stems = ["the", "Red", "fox", "jumps", "over", "été", "new", "York", "naïve", "ÉCOLE", "a", "日本"]
    out = []
    for i in range(n):
        words = [stems[int(x) % len(stems)] for x in rng.zipf(1.5, int(rng.integers(1, 90)))]
        seps = [[" ", "  ", "\t", ", ", "\n", ". "][int(x)] for x in rng.choice(6, len(words), p=[.7, .1, .05, .05, .05, .05])]
        out.append((i, "".join(w + s for w, s in zip(words, seps)), ["en", "de", None][i % 3]))
    return out + [(100, None, "en"), (101, "", None), (102, " .,\n", "xx"), (None, "new york new york new york", "en"), (5, "a a a a a a", "de"), (5, "a a a a a a", "de")]


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("least,top,percent", [(5, 2000, 100), (3, 7, 60)])
def test_collocations_equal_brute_force(spark, least, top, percent):
    from deckflow.llm.collocations import collocations
    rows = rows_of()
    assert result(collocations(docs_of(spark, rows), least, top, percent)) == sorted(naive(rows, least, top, percent))


def test_long_texts_are_cut_without_loss(spark):
    """Texts beyond a chunk, with and without pieces, and a very long word."""
    from deckflow.llm.collocations import collocations
    rng = np.random.default_rng(6)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 60_000) % 50]
    rows = [(1, " ".join(words), "en"), (2, "x" * 200_000 + " w1 w2 w3 " + "\t".join(words[:5000]), "en"), (3, ".".join(" ".join(words[i:i + 7]) for i in range(0, 30_000, 7)), "en")]
    assert result(collocations(docs_of(spark, rows), 60, 500)) == sorted(naive(rows, 60, 500))


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """Words whose polynomials modulo 2**64 are equal (Thue-Morse strings)."""
    from deckflow.llm import grams
    from deckflow.llm.collocations import collocations
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    powers = grams.Powers()
    a, b = (grams.Fingerprints(np.frombuffer(x.encode(), np.uint8), powers).of(np.array([0]), np.array([2048]))[0] for x in (t, u))
    assert a == b and t != u
    rows = [(i, f"{t} fox. {u} hen. {t} fox", "en") for i in range(6)] + [(9, f"{u} hen. {u} fox", "en")]
    assert result(collocations(docs_of(spark, rows), 3, 100)) == sorted(naive(rows, 3, 100))


def test_blocks_hold_every_group(spark):
    """What a dispute would be settled from: the rows of the last pass, by text."""
    from pyspark.sql import functions as F

    from deckflow.llm import collocations as C
    rows = rows_of(40)
    texts = C.chunks(docs_of(spark, rows))
    passes = None
    for n in (1, 2):
        found = C.frequent(C.runs_of(texts, [n], passes, 16), 16, 4)
        passes = C.membership(spark, found)
    pointed = C.runs_of(texts, [1, 2], C.membership(spark, C.frequent(C.runs_of(texts, [1], None, 16), 16, 4).union(found)), 16, pointers=True)
    got = {(r.lang, r.phrase): r.n for r in C._read(C.spread(pointed), texts).groupBy("lang", "phrase").agg(F.sum("cnt").alias("n")).collect()}
    want = Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i:i + n])) for n in (1, 2) for i in range(len(w) - n + 1))
    want = {k: a for k, a in want.items() if a >= 4}
    assert {k: got[k] for k in want} == want
    assert {(r.lang, r.a) for r in C.groups_of(pointed, 16, 4).filter("fp is null").groupBy("lang").agg(F.sum("a").alias("a")).filter("a > 0").collect()} == {
        (lang, sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or "")) for _, t, x in rows if (x or "und") == lang)) for lang in ("en", "de", "und")}


def test_no_rows(spark):
    from deckflow.llm.collocations import collocations
    assert collocations(docs_of(spark, []).limit(0), 2, 10).collect() == []
