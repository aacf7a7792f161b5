"""Toxicity by nearest labelled examples, exact under TF-IDF cosine.

Terms are words and word beginnings of four to nine letters (inflected insults
share those), and such a beginning once more where it occurs again in the text.
All terms of the labelled examples span the space: none is left out. A term
weighs its idf over all documents, times a factor from 1 to 1 + ``BOOST`` that
grows with the evidence that it goes with a label (binomial tail of the labels
of the examples that hold it, less than chance in the number of terms tried), so
that one insult outweighs much ordinary text. Vectors have the weights
(1 + ln tf) * weight and unit length; a copy of an example has cosine 1.

The index holds the examples in blocks of ``BLOCK``, similar examples side by
side: for every term its postings; for terms that many examples hold, which make
nearly all the work, a row of weights and the largest weight per block. A
document's bound for a block is the sum over its common terms of weight times
block maximum, plus the largest sum that its other terms reach there. Blocks are
scored in falling order of the bound, a few at a time and many documents at
once, until the k-th best cosine is above it, so the neighbours are exact (ties:
the smaller doc_id). Votes are weighted by closeness 1 / (0.05 + 1 - cosine).

Calibration: each example's vote share is found from the other examples (its
own entry left out); a monotone fit (pool adjacent violators) over vote shares,
smoothed by the base rate, turns a share into a probability.

The sample of labelled rows is bounded by ``EXAMPLES`` per label (rows of least
hash): a documented bound of the classifier. Document frequencies come from all
documents. Only texts and ``toxic`` are learned from; every whole text is scored.

Defined results: texts without a term of the examples (null and empty ones too)
get the base rate of such examples and no evidence. Without labelled rows every
score is 0; with labels of one kind every score is that label's smoothed rate.
Documents with conflicting repeated labels count as toxic. Repeated rows get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slim, small_batches

WORD = re.compile(r"[^\W\d_]+")
EXAMPLES = 800
NEIGHBOURS = 15
BLOCK, WAVE = 64, 8
STEMS = (4, 5, 6, 7, 8, 9)
WORDS = 1 << 16
BOOST, STRONG = 60.0, 2.0
_LETTERS: list = []  # which code points are letters, once a worker


def words_of(texts: list[str | None]):
    """``(text, total, off, size)`` of up to ``WORDS`` words at a time: the text
    that each belongs to, running sums over their letters, and each word's place
    and length in them. A hash is the sum of mixed (place, letter) pairs, so those
    of words and beginnings are differences of running sums."""
    import numpy as np
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        for m in WORD.finditer("".join(map(chr, range(0x110000)))):
            table[m.start():m.end()] = True
        _LETTERS.append(table)
    low = [t.lower() if t else "" for t in texts]
    upto = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    chars = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _LETTERS[0][chars]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]])))
    starts, ends = edge[::2], edge[1::2]
    for i in range(0, len(starts), WORDS):
        s, e = starts[i:i + WORDS], ends[i:i + WORDS]
        size = e - s
        off = np.cumsum(size) - size
        x = chars[s[0]:e[-1]][ok[s[0]:e[-1]]].astype(np.uint64)
        x |= (np.arange(1, len(x) + 1) - np.repeat(off, size)).astype(np.uint64) << np.uint64(21)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        yield np.searchsorted(upto, s, side="right"), np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]), off, size


def term_hashes(total, off, size):
    """``(hashes, owners, stems)``: of words and their beginnings, the word each
    belongs to, and whether it is a beginning."""
    import numpy as np
    every = np.arange(len(off))
    parts = [(total[off + size] - total[off], every, np.zeros(len(off), bool))]
    for n in STEMS:
        own = every[size >= n]
        parts.append(((total[off[own] + n] - total[off[own]]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n), own, np.ones(len(own), bool)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def twice(h):
    """The hash of the further term of a beginning that occurs again."""
    import numpy as np
    return h * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D)


class Terms:
    """Term counts of many texts at once. With ``vocabulary`` (sorted hashes)
    terms are places in it and others are left out; else they are hashes."""

    def __init__(self, vocabulary=None):
        import numpy as np
        self.vocabulary = vocabulary
        if vocabulary is not None:
            # where the terms begin that share their first bits, about one term in four
            self.shift = np.uint64(64 - len(vocabulary).bit_length() - 2)
            self.first = np.searchsorted(vocabulary >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64))
        # a text with a beginning that occurs again has the beginning itself
        self.again = None if vocabulary is None else self.places(twice(vocabulary))

    def places(self, h):
        """Place in the vocabulary, or its length."""
        import numpy as np
        out = np.full(len(h), len(self.vocabulary), np.uint64)
        bits = h >> self.shift
        at, end = self.first[bits], self.first[bits + np.uint64(1)]
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.vocabulary[at[todo]] == h[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def _pairs(self, text, total, off, size):
        """``(text, term, again, tf)`` of some words; a term comes once for each
        word of a text that it belongs to."""
        import numpy as np
        word = total[off + size] - total[off]
        order = np.argsort(word)
        new = np.diff(word[order], prepend=~word[order[:1]]) != 0
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        own = order[new]  # each different word once
        key, tf = np.unique(text * len(own) + number, return_counts=True)  # words of a text once
        text, number = np.divmod(key, len(own))
        term, owner, stem = term_hashes(total, off[own], size[own])
        if self.vocabulary is None:
            again = np.where(stem, twice(term), np.uint64(0))
        else:
            term = self.places(term)
            some = term < len(self.vocabulary)
            term, owner, stem = term[some], owner[some], stem[some]
            again = np.where(stem, self.again[term], np.uint64(len(self.vocabulary)))
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(own)))])
        n = ends[number + 1] - ends[number]
        at = order[np.arange(n.sum()) + np.repeat(ends[number] - (np.cumsum(n) - n), n)]
        return np.repeat(text, n), term[at], again[at], np.repeat(tf, n)

    def counts(self, texts: list[str | None]):
        """``(text, term, tf)`` arrays, each pair of text and term once."""
        import numpy as np
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        text, term, again, tf = (np.concatenate(x) for x in zip(none, *(self._pairs(*x) for x in words_of(texts))))
        if self.vocabulary is None:
            order = np.lexsort((term, text))
            text, term, tf, again = text[order], term[order], tf[order], again[order]
            first = np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])
        else:
            key = text * (len(self.vocabulary) + 1) + term.astype(np.int64)
            order = np.argsort(key)
            key = key[order]
            text, term, tf, again = text[order], term[order], tf[order], again[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
        if not len(term):
            return text, term, tf
        first = np.flatnonzero(first)
        text, term, again, tf = text[first], term[first], again[first], np.add.reduceat(tf, first)
        none = np.uint64(0) if self.vocabulary is None else np.uint64(len(self.vocabulary))
        more = (tf > 1) & (again != none)
        text, term, tf = np.concatenate([text, text[more]]), np.concatenate([term, again[more]]), np.concatenate([tf, tf[more]])
        known = term != none
        return text[known], term[known], tf[known]


def unit(text, values, number: int):
    """Values scaled so that those of each text have length 1."""
    import numpy as np
    norm = np.sqrt(np.bincount(text, weights=values * values, minlength=number))
    return values / np.maximum(norm, 1e-300)[text]


class Index:
    """Block-max inverted index over the labelled examples, given as sorted
    arrays (example, term, tf) over a vocabulary with a weight per term."""

    def __init__(self, vocabulary, weight, ids: list[int], labels: list[int], example, term, tf):
        import numpy as np
        self.vocabulary, self.weight, n = vocabulary, weight, len(ids)
        value = unit(example, (1 + np.log(tf)) * weight[term], n)
        # examples whose heaviest term is the same stand side by side
        top = np.zeros(n, np.int64)
        order = np.lexsort((term, value, example))
        top[example[order]] = term[order]  # the last of an example is its heaviest
        place = np.lexsort((np.array(ids), top))
        self.ids, self.labels = np.array(ids, np.int64)[place], np.array(labels, np.int64)[place]
        back = np.empty(n, np.int64)
        back[place] = np.arange(n)
        example = back[example]
        order = np.lexsort((example, term))
        example, term, value = example[order], term[order], value[order]
        df = np.bincount(term, minlength=len(vocabulary))
        self.blocks = -(-n // BLOCK) if n else 0
        # terms of many examples: a row each
        self.common = np.full(len(vocabulary), -1, np.int32)
        many = np.flatnonzero(df > max(32, n // 10))
        self.common[many] = np.arange(len(many))
        row = self.common[term]
        self.rows = np.zeros((len(many), self.blocks * BLOCK))
        self.rows[row[row >= 0], example[row >= 0]] = value[row >= 0]
        self.by_block = [np.ascontiguousarray(self.rows[:, b * BLOCK:(b + 1) * BLOCK]) for b in range(self.blocks)]
        self.row_max = self.rows.reshape(len(many), self.blocks, BLOCK).max(axis=2) if len(many) else np.zeros((0, self.blocks))
        self.rows = self.rows[:, :0]
        # the others: postings
        few = row < 0
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term[few], minlength=len(vocabulary)))])
        self.post, self.value = example[few].astype(np.intp), value[few]
        self.knots: list[tuple[float, float]] = []
        self.bare = 0.0
        self._terms = None

    def __getstate__(self):
        return {**self.__dict__, "_terms": None}

    def vectors(self, texts: list[str | None]):
        import numpy as np
        if self._terms is None:
            self._terms = Terms(self.vocabulary)
        text, term, tf = self._terms.counts(texts)
        term = term.astype(np.int64)
        return text, term, unit(text, (1 + np.log(tf)) * self.weight[term], len(texts))

    def _light(self, text, term, value, number: int, width: int):
        """Sums over the postings, a row per text. Text by text, so that what a
        text's postings need at a time stays small."""
        import numpy as np
        few = np.flatnonzero(self.begin[term + 1] > self.begin[term])
        few = few[np.argsort(text[few], kind="stable")]
        term, value, ends = term[few], value[few], np.searchsorted(text[few], np.arange(number + 1))
        size = self.begin[term + 1] - self.begin[term]
        upto = np.concatenate([[0], np.cumsum(size)])
        out, place = np.empty((number, width)), np.arange(int(np.diff(upto[ends]).max(initial=0)))
        start = self.begin[term] - upto[:-1]
        for d, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            at = np.repeat(start[a:z] + upto[a], size[a:z])
            at += place[:len(at)]
            weight = np.repeat(value[a:z], size[a:z])
            weight *= self.value.take(at)
            out[d] = np.bincount(self.post.take(at), weights=weight, minlength=width)
        return out

    def nearest(self, text, term, value, number: int, k: int = NEIGHBOURS, without=None) -> list[list[tuple[float, int, int]]]:
        """Per text ``(cosine, doc_id, label)`` of the k nearest examples; those
        without a shared term don't count. ``without``: an example per text that
        is left out."""
        import numpy as np
        n, width = len(self.ids), self.blocks * BLOCK
        if not number or not n:
            return [[] for _ in range(number)]
        row = self.common[term]
        heavy = np.zeros((number, len(self.rows)))
        heavy[text[row >= 0], row[row >= 0]] = value[row >= 0]
        light = self._light(text, term, value, number, width)
        # of the postings their sum in a block bounds as well as their maxima do
        bound = heavy @ self.row_max + light.reshape(number, self.blocks, BLOCK).max(axis=2)
        order = np.argsort(-bound, axis=1, kind="stable")
        score, most = np.full((number, width), -1.0), np.full((number, k), -1.0)
        least, active = np.full(number, -1.0), np.arange(number)
        skip = np.full(number, -1) if without is None else np.asarray(without)
        for wave in range(0, self.blocks, WAVE):
            nxt = bound[active, order[active, wave]]
            active = active[(nxt > 0) & (nxt >= least[active] - 1e-12)]
            if not len(active):
                break
            turn = order[active, wave:wave + WAVE]
            new = np.full((len(active), turn.shape[1], BLOCK), -1.0)
            for b in np.unique(turn).tolist():
                i, j = np.nonzero(turn == b)
                own, at = active[i], slice(b * BLOCK, (b + 1) * BLOCK)
                part = (heavy if len(own) == number else heavy[own]) @ self.by_block[b]
                part += light[own, at]
                mine = np.flatnonzero(skip[own] // BLOCK == b)
                part[mine, skip[own[mine]] % BLOCK] = -1.0
                score[own, at] = new[i, j] = part
            both = np.concatenate([most[active], new.reshape(len(active), -1)], axis=1)
            most[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[active] = most[active].min(axis=1)
        if without is not None:
            score[np.arange(number), without] = -1.0
        out = []
        for d in range(number):
            got = np.flatnonzero((score[d, :n] > 1e-12) & (score[d, :n] >= least[d] - 1e-9))
            best = sorted((-round(float(score[d, i]), 12), int(self.ids[i]), int(self.labels[i])) for i in got.tolist())[:k]
            out.append([(-s, i, y) for s, i, y in best])
        return out

    def share(self, near: list[tuple[float, int, int]]) -> float:
        vote = [(1 / (0.05 + max(0.0, 1 - s)), y) for s, _, y in near]
        return sum(w * y for w, y in vote) / sum(w for w, _ in vote)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int, int]]]]:
        found = self.nearest(*self.vectors(texts), len(texts))
        return [(self.probability(self.share(near)), near) if near else (self.bare, []) for near in found]

    def probability(self, share: float) -> float:
        xs = self.knots
        if not xs:
            return share
        if share <= xs[0][0]:
            return xs[0][1]
        for (a, p), (b, q) in zip(xs, xs[1:]):
            if share <= b:
                return p + (q - p) * (share - a) / (b - a)
        return xs[-1][1]

    def calibrate(self, near: list[list[tuple[float, int, int]]], labels: list[int], rate: float) -> None:
        """near: neighbours of the examples, their own entries left out; rate: toxic
        share of all labelled rows, to which the examples' labels are weighted back."""
        n1 = sum(labels)
        n0 = len(labels) - n1
        w = {1: rate / max(n1, 1), 0: (1 - rate) / max(n0, 1)}
        scale = len(labels)
        points, bare = [], [0.0, 0.0]
        for found, y in zip(near, labels):
            if found:
                points.append((self.share(found), y, w[y] * scale))
            else:
                bare[y] += w[y] * scale
        self.bare = (bare[1] + rate) / (sum(bare) + 1)
        pools: list[list[float]] = []  # share sum, toxic weight, weight
        for s, y, c in sorted(points):
            pools.append([s * c, y * c, c])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                x = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], x)]
        self.knots = [(a / c, (y + rate) / (c + 1)) for a, y, c in pools if c > 0]


def strength(toxic, df, share: float):
    """Factor of a term that ``df`` examples hold, ``toxic`` of them toxic: from
    1 up to 1 + BOOST by the Chernoff bound of the binomial tail, beyond what
    chance gives among so many terms."""
    import numpy as np
    q, p = toxic / df, min(max(share, 1e-6), 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(np.maximum(q, 1e-300) / p), 0.0) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-300) / (1 - p)), 0.0)
    beyond = df * kl - math.log(max(len(df), 2)) - 2
    return 1 + BOOST * np.clip(beyond / STRONG, 0.0, 1.0)


def build(ids: list[int], labels: list[int], text, term, tf, df, documents: int, rate: float, vocabulary) -> Index | None:
    """Index of examples, given their term counts (places in the vocabulary, by text) and
    the document frequencies of all terms."""
    import numpy as np
    if not ids:
        return None
    y = np.array(labels)
    own = np.bincount(term, minlength=len(vocabulary))
    toxic = np.bincount(term, weights=y[text], minlength=len(vocabulary))
    idf = np.log(1 + documents / np.maximum(df, 1))
    index = Index(vocabulary, idf * strength(toxic, np.maximum(own, 1), float(y.mean())), ids, labels, text, term, tf)
    near: list = []
    place = {i: n for n, i in enumerate(index.ids.tolist())}
    value = unit(text, (1 + np.log(tf)) * index.weight[term], len(ids))
    for a in range(0, len(ids), 256):
        b = min(len(ids), a + 256)
        lo, hi = np.searchsorted(text, [a, b])
        near += index.nearest(text[lo:hi] - a, term[lo:hi], value[lo:hi], b - a, without=[place[i] for i in ids[a:b]])
    index.calibrate(near, labels, rate)
    return index


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = EXAMPLES) -> Index | None:
    """Index from the labelled rows that satisfy ``usable`` (over doc_id)."""
    import numpy as np
    spark = docs.sparkSession
    small_batches(spark, 400, 8)
    marks = slim(labels, doc_id="doc_id", toxic="toxic").filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = [marks.filter(F.col("toxic") == y).select("doc_id", "toxic", h.alias("h")).orderBy("h", "doc_id").limit(per_label).drop("h") for y in (0, 1)]
    all_docs = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = all_docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))  # 2 * per_label rows at most

    def count_terms(batches):
        import pyarrow as pa
        own = Terms()
        for b in batches:
            text, term, tf = own.counts(b.column("text").to_pylist())
            order = np.argsort(text, kind="stable")
            text, term, tf = text[order], term[order], tf[order]
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            cells = [(term[a:z].astype("<u8").tobytes(), tf[a:z].astype("<u4").tobytes()) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["doc_id", "toxic", "term", "tf"])

    # the terms of 2 * per_label texts
    got = texts.select("doc_id", "toxic", "text").mapInArrow(count_terms, "doc_id long, toxic int, term binary, tf binary").toArrow().sort_by("doc_id")
    ids, marked = got.column("doc_id").to_pylist(), got.column("toxic").to_pylist()
    if not ids:
        return None
    parts = got.column("term").to_pylist()
    term = np.frombuffer(b"".join(parts), np.uint64)
    tf = np.frombuffer(b"".join(got.column("tf").to_pylist()), np.uint32)
    text = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 8 for x in parts])
    del got, parts
    vocabulary, term = np.unique(term, return_inverse=True)
    term = term.astype(np.int32)
    held = spark.sparkContext.broadcast(vocabulary)  # the terms of 2 * per_label examples

    def frequencies(batches):
        import pyarrow as pa
        own, df = Terms(held.value), np.zeros(len(held.value) + 1, np.int64)
        for b in batches:
            _, term, _ = own.counts(b.column("text").to_pylist())
            df += np.bincount(term.astype(np.int64), minlength=len(df))
            df[-1] += b.num_rows
        some = np.flatnonzero(df)
        for a in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a:a + 100_000]), pa.array(df[some[a:a + 100_000]])], names=["term", "df"])

    sums = all_docs.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row per term of the examples
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    held.unpersist()
    rate = count.get(1, 0) / sum(count.values())
    return build(ids, marked, text, term, tf, df[:-1], int(df[-1]), rate, vocabulary)


def score_documents(docs: DataFrame, index: Index | None) -> DataFrame:
    """``(doc_id, score, evidence)``; evidence lists the neighbours' doc_id,
    cosine and label, nearest first."""
    small_batches(docs.sparkSession, 200, 4)
    held = docs.sparkSession.sparkContext.broadcast(index)  # 2 * EXAMPLES examples

    def run(batches):
        import pyarrow as pa
        index = held.value
        near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", near_type)])
        for b in batches:
            scored = index.scores(b.column("text").to_pylist()) if index else [(0.0, [])] * b.num_rows
            near = [[{"doc_id": i, "cosine": s, "toxic": y} for s, i, y in n[:3]] for _, n in scored]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([min(1.0, max(0.0, s)) for s, _ in scored], pa.float64()), pa.array(near, near_type)], schema=schema)

    own = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
