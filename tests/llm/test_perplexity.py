"""Operator 12 against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, c long, g string, size int, bits double, kept string"
WORDS = r"[^\x20\x09-\x0D]+"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 5, "x", 1, 2.0, "z") for i, t, lang in rows], SCHEMA)


def rows_of(n=60):
    rng = np.random.default_rng(3)
    stems = ["the", "red", "fox", "jumps", "over", "été", "9 lives", "A1", "naïve", "zebra", "#tag", "日本"]
    out = []
    for i in range(n):
        words = [stems[int(x)] for x in rng.integers(0, len(stems), int(rng.integers(1, 60)))]
        text = " ".join(words) if i % 4 else "\n".join([" ".join(words), "same line", "  ", "  ", "same line"])
        if i % 7 == 0:
            text = text + "\t" + text
        out.append((i, text, ["en", "de", None][i % 3]))
    return out + [(100, None, "en"), (101, "", "en"), (102, " \n ", None), (None, "a b", "en"), (5, "the red fox", "en"), (5, "the red fox", "en")]


def normal(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in text or "")
    return " ".join(re.findall(WORDS, low))


def base(text):
    t = text or ""
    words = re.findall(WORDS, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORDS, line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    inside = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


class Naive:
    """Modified Kneser-Ney of five characters, by dictionaries."""

    def __init__(self, texts, order=5):
        self.order, counts = order, Counter(t[i:i + order] for t in texts for i in range(len(t) - order + 1))
        self.share, self.left = {}, {}
        for n in range(order, 0, -1):
            t = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
            d = [0.5, 1.0, 1.5]
            if min(t) > 0:
                y = t[0] / (t[0] + 2 * t[1])
                for k in (1, 2, 3):
                    x = k - (k + 1) * y * t[k] / t[k - 1]
                    d[k - 1] = x if 0 <= x <= k else d[k - 1]
            total, kept = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
            for g, c in counts.items():
                if c >= 2 or n == 1:
                    self.share[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]]
                    kept[g[:-1]] += self.share[g]
            for h in total:
                self.left[h] = 1 - kept[h]
            if n == 1:
                self.alphabet = set(counts)
                self.left[""] /= len(counts) + 1
            counts = Counter(g[1:] for g in counts)

    def p(self, run):
        out = self.left.get("", 1 / 0x110000)
        for n in range(1, len(run) + 1):
            g = run[len(run) - n:]
            out = out * (self.left.get(g[:-1], 1.0) if n > 1 else 1.0) + self.share.get(g, 0.0)
        return out

    def bits(self, text):
        runs = [text[i:i + self.order] for i in range(len(text) - self.order + 1)]
        return sum(-math.log2(self.p(r)) for r in runs) / len(runs) if runs else None


@pytest.fixture(scope="module")
def models():
    texts = defaultdict(list)
    for _, t, lang in rows_of():
        texts[lang or "und"].append(normal(t))
    return {k: Naive(v) for k, v in texts.items()}


def test_naive_model_is_a_distribution(models):
    for m in models.values():
        for h in ("the ", "red ", "zzzz"):
            assert sum(m.p(h + w) for w in m.alphabet) <= 1 + 1e-9
            assert sum(m.p(h + w) for w in m.alphabet) > 0.8


def check(got, rows, models):
    want = sorted(((i is None, i or 0), *base(t), lang or "und", models[lang or "und"].bits(normal(t))) for i, t, lang in rows)
    have = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.lang, r.bits) for r in got)
    assert [x[:-1] for x in have] == [x[:-1] for x in want]
    for a, b in zip(have, want):
        assert (a[-1] is None) == (b[-1] is None) and (b[-1] is None or abs(a[-1] - b[-1]) < 1e-9)


def test_judge_equals_brute_force(spark, models):
    from deckflow.llm.perplexity import judge
    rows = rows_of()
    got = judge(docs_of(spark, rows)).collect()
    check(got, rows, models)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.low <= r.bits <= r.high)


def test_slices_segments_and_piles_change_nothing(spark, models):
    """The same figures when texts are cut into small slices and the model into
    many segments of which a task holds few."""
    from deckflow.llm import perplexity as P
    rows = rows_of()

    docs = docs_of(spark, rows)
    segments = P.write_model(P.model_entries(docs), segment=300)
    assert len(segments) > 2
    model = P.Model(segments)
    old = P.SLICE, P.HELD
    try:
        P.SLICE, P.HELD = 40, 2
        for _, t, lang in rows:
            text, total, n = normal(t), 0.0, 0
            for s in P._slices([(t or "").encode()], 5):
                mark = np.array([P.lang_mark(lang or "und")], np.uint64)
                _, place, _ = P._runs(s, mark, 5)
                if len(place):
                    total += model.bits([s.chars[place + j] for j in range(5)], np.repeat(mark, len(place))).sum()
                    n += len(place)
            want = models[lang or "und"].bits(text)
            assert n == max(0, len(text) - 4) and (want is None or abs(total / n - want) < 1e-9)
    finally:
        P.SLICE, P.HELD = old


def test_outliers_are_rejected_and_no_rows(spark):
    from deckflow.llm.perplexity import judge
    rng = np.random.default_rng(5)
    prose = ["river", "stone", "under", "bridge", "walks", "slowly", "and", "the", "morning", "light", "over", "houses"]
    rows = [(i, " ".join(prose[int(x)] for x in rng.integers(0, 12, 40)), "en") for i in range(200)]
    noise = "".join(chr(int(x)) for x in rng.integers(0x21, 0x17F, 300))
    rows += [(900, " ".join(noise[i:i + 6] for i in range(0, 240, 6)), "en")]
    got = {r.doc_id: r for r in judge(docs_of(spark, rows)).collect()}
    assert not got[900].kept and not got[900].base_failed
    assert all(got[i].kept for i in range(200) if not got[i].base_failed)
    assert judge(docs_of(spark, []).limit(0)).collect() == []
