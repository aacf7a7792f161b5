"""Language ID by a linear-chain conditional random field over words.

Words (runs of letters) carry a language label each; a document may switch
language anywhere. The emission score of a word is the sum of learned weights
of its features: affixes (up to four letters at either end), letter n-grams
(two and three letters, with word ends), and its entry in a learned lexicon
(words seen mostly in one language), all hashed into ``BUCKETS`` slots.
Transitions between labels are learned with them. Forward-backward gives each
word's label probabilities; a document's language is the one with the largest
sum of them and its score is that sum's share.

Training fits weights by gradient ascent on the log-likelihood of labelled word
sequences. Documents have one label each, so sequences are spliced from
stretches of documents of different languages (seeded), which is what
code-switched text looks like; that is where the transitions are learned from.
The sample of labelled rows is bounded by the documented parameters
``DOCS_PER_LANG`` (documents of least hash, per language) and
``WORDS_PER_DOC`` (a stretch at a hashed place), and the number of languages
by ``MAX_LANGS`` (the most frequent ones); prediction reads every word
of every text.

Long texts: words are cut into segments of ``SEGMENT`` positions. The product
of a segment's step matrices is found for all segments of a batch at once,
messages run from segment to segment, and inside all segments at once again.
The result is that of one pass over the whole document.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or
when nothing was learned (no labelled rows). Ties go to the label that sorts
first. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import slim, small_batches

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
DOCS_PER_LANG, WORDS_PER_DOC, MAX_LANGS = 150, 80, 64
SEGMENT = 32
STEPS, RATE = 40, 0.25
CACHE = 200_000


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    b = f"<{word}>"
    names = [f"p{word[:i]}" for i in range(1, min(4, len(word)) + 1)] + [f"s{word[-i:]}" for i in range(1, min(4, len(word)) + 1)]
    names += [b[i:i + n] for n in (2, 3) for i in range(len(b) - n + 1)]
    if word in lexicon:
        names.append(f"l{lexicon[word]}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


class Model:
    """Learned weights; ``langs`` in sorted order."""

    def __init__(self, langs: list[str], weights, trans, lexicon: dict[str, str]):
        import numpy as np
        self.langs, self.lexicon = langs, lexicon
        self.weights, self.trans = weights.astype(np.float32), trans.astype(np.float32)
        self._reset()

    def _reset(self) -> None:
        import numpy as np
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)), np.float32)

    def __reduce__(self):
        return Model, (self.langs, self.weights, self.trans, self.lexicon)

    def rows(self, words: list[str]):
        """Row numbers of the words' emission scores in ``table``; every
        different word is scored once."""
        import numpy as np
        if len(self.row) > CACHE:
            self._reset()
        new = list(set(words).difference(self.row))
        if new:
            ids = [features(w, self.lexicon) for w in new]
            starts = np.cumsum([0] + [len(x) for x in ids[:-1]])
            score = np.add.reduceat(self.weights[np.concatenate([np.array(x, np.int64) for x in ids])], starts, axis=0)
            n = len(self.row)
            if n + len(new) > len(self.table):
                self.table = np.vstack([self.table[:n], np.zeros((n + 2 * len(new), len(self.langs)), np.float32)])
            self.table[n:n + len(new)] = score
            self.row.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def marginals(self, scores, lengths):
        """Label probabilities of every word; ``lengths`` words per document."""
        gamma, _ = forward_backward(scores, self.trans, lengths)
        return gamma


def forward_backward(scores, trans, lengths, pairs: bool = False):
    """Word marginals ``(words, labels)`` of several chains at once and, with
    ``pairs``, the expected counts of label pairs."""
    import numpy as np
    k, step = scores.shape[1], np.exp(trans - trans.max()).astype(np.float32)
    lengths = np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    docs, segs = len(lengths), -(-lengths // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segs)[:-1]])
    start = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), segs)
    nth = np.arange(segs.sum()) - np.repeat(first, segs)
    begin = start + nth * SEGMENT
    size = np.minimum(np.repeat(lengths, segs) - nth * SEGMENT, SEGMENT)
    n = len(begin)
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    padded = np.ones((SEGMENT, n, k), np.float32)
    for t in range(SEGMENT):
        live = size > t
        padded[t, live] = e[begin[live] + t]
    # product of each segment's steps (from the label before it to its last label)
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (n, k, k)).copy()
    for t in range(SEGMENT):
        live = np.flatnonzero(size > t)
        p = (product[live].reshape(-1, k) @ step).reshape(-1, k, k) * padded[t, live][:, None, :]
        product[live] = p / p.max((1, 2), keepdims=True)
    enter, leave = np.ones((n, k), np.float32), np.ones((n, k), np.float32)
    message = np.full((docs, k), 1.0 / k, np.float32)
    for j in range(int(segs.max(initial=0))):
        on = np.flatnonzero(segs > j)
        at = first[on] + j
        enter[at] = message[on]
        m = np.einsum("ij,ijk->ik", message[on], product[at])
        message[on] = m / m.sum(1, keepdims=True)
    message = np.ones((docs, k), np.float32)
    for j in range(int(segs.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(segs > j)
        at = first[on] + j
        leave[at] = message[on]
        m = np.einsum("ijk,ik->ij", product[at], message[on])
        message[on] = m / m.sum(1, keepdims=True)
    alpha = np.empty((SEGMENT, n, k), np.float32)
    a = enter
    for t in range(SEGMENT):
        a = (a @ step) * padded[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    gamma = np.empty((len(e), k), np.float32)
    b, expected = leave.copy(), np.zeros((k, k))
    for t in range(SEGMENT - 1, -1, -1):
        live = np.flatnonzero(size > t)
        g = alpha[t, live] * b[live]
        gamma[begin[live] + t] = g / g.sum(1, keepdims=True)
        ahead = padded[t, live] * b[live]
        if pairs:
            inner = live if t else live[nth[live] > 0]
            was = alpha[t - 1, inner] if t else enter[inner]
            joint = was[:, :, None] * step[None] * (padded[t, inner] * b[inner])[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = ahead @ step.T
        b[live] = back / back.sum(1, keepdims=True)
    return gamma, expected


def train(sample: list[tuple[str, list[str]]], seed: int = 7) -> Model | None:
    """Fits the field to ``(lang, words)`` stretches of labelled documents."""
    import numpy as np
    langs = sorted({lang for lang, words in sample if words})
    if not langs:
        return None
    seen: dict[str, dict[str, int]] = {}
    for lang, words in sample:
        for w in set(words):
            by = seen.setdefault(w, {})
            by[lang] = by.get(lang, 0) + 1
    of_lang = {lang: sum(x == lang for x, _ in sample) for lang in langs}

    def entry(by: dict[str, int]) -> str | None:
        rate = {lang: c / of_lang[lang] for lang, c in by.items()}
        top = max(sorted(rate), key=rate.get)
        return top if sum(by.values()) >= 3 and rate[top] >= 0.8 * sum(rate.values()) else None

    lexicon = {w: x for w, by in seen.items() if (x := entry(by))}
    rng = np.random.default_rng(seed)
    pieces = []
    for lang, words in sample:
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 41))
            pieces.append((langs.index(lang), words[at:at + n]))
            at += n
    order = rng.permutation(len(pieces))
    words = [w for i in order for w in pieces[i][1]]
    y = np.array([pieces[i][0] for i in order for _ in pieces[i][1]], np.int64)
    k, chain = len(langs), 96
    lengths = [min(chain, len(words) - a) for a in range(0, len(words), chain)]
    inner = np.ones(len(words), bool)
    inner[::chain] = False
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = [features(w, lexicon) for w in vocabulary]
    flat, sizes = np.concatenate([np.array(x, np.int64) for x in ids]), np.array([len(x) for x in ids])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(ids)), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    row = np.array([vocabulary[w] for w in words])
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    truth = np.eye(k)[y]
    pair = np.zeros((k, k))
    np.add.at(pair, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    for _ in range(STEPS):
        table = np.add.reduceat(w[flat], starts, axis=0)
        gamma, expected = forward_backward(table[row], trans, lengths, pairs=True)
        miss = np.zeros((len(ids), k))
        np.add.at(miss, row, truth - gamma)
        grad = np.stack([np.bincount(flat, miss[owner, c], len(used)) for c in range(k)], 1) - 1e-2 * w
        gw += grad**2
        w += RATE * grad / np.sqrt(gw)
        step = pair - expected - 1e-2 * trans
        gt += step**2
        trans += RATE * step / np.sqrt(gt)
    weights = np.zeros((BUCKETS, k))
    weights[used] = w
    return Model(langs, weights, trans, lexicon)


def labelled_sample(docs: DataFrame, learn: Column, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC, max_langs: int = MAX_LANGS) -> list[tuple[str, list[str]]]:
    """The bounded training sample, at most ``max_langs * docs_per_lang`` stretches."""
    small_batches(docs.sparkSession)
    own = slim(docs.filter(learn), doc_id="doc_id", lang="lang", text="text").filter("lang is not null and text is not null")
    langs = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    h = F.xxhash64(F.lit("langid"), "doc_id")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = own.select("lang", "doc_id", h.alias("h")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= docs_per_lang).join(F.broadcast(langs), "lang")
    keys = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "h", F.col("lang").alias("_lang")).distinct())  # max_langs * docs_per_lang rows at most
    texts = own.join(keys, own["doc_id"].eqNullSafe(keys["_id"]) & (own["lang"] == keys["_lang"])).select("lang", "text", "h")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            for lang, text, h in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "h"))):
                words = WORD.findall(text.lower())
                at = (h & 0xFFFFFFFF) % max(1, len(words) - words_per_doc + 1)
                rows.append({"lang": lang, "words": words[at:at + words_per_doc]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))]))

    got = texts.mapInArrow(run, "lang string, words array<string>").collect()
    return sorted((r["lang"], list(r["words"])) for r in got if r["words"])


def label_words(model: Model, texts: list[str | None]):
    """Per text its words' label probabilities and the words."""
    import numpy as np
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = [w for x in words for w in x]
    if not flat:
        return words, [np.zeros((0, len(model.langs)), np.float32) for _ in words]
    lengths = [len(x) for x in words]
    rows = model.rows(flat)
    gamma = model.marginals(model.table[rows], lengths)
    return words, np.split(gamma, np.cumsum(lengths)[:-1])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, row, lang_pred, score, shares, switches)``: shares maps each
    language to its share of the words, switches counts changes of the likeliest label."""
    from deckflow.llm.simhash import row_key
    small_batches(docs.sparkSession, 400, 8)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # at most BUCKETS * MAX_LANGS weights

    def run(batches):
        import numpy as np
        import pyarrow as pa
        model, schema = held.value, pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64())), ("switches", pa.int64())])
        for b in batches:
            ids, keys, texts = (b.column(c).to_pylist() for c in ("doc_id", "row", "text"))
            probs = label_words(model, texts)[1] if model else [np.zeros((0, 0))] * len(texts)
            rows = []
            for i, key, p in zip(ids, keys, probs):
                if len(p):
                    share = p.astype(np.float64).mean(0)
                    share /= share.sum()
                    top, best = int(share.argmax()), p.argmax(1)
                    rows.append((i, key, model.langs[top], float(min(1.0, share[top])), list(zip(model.langs, share.tolist())), int((best[1:] != best[:-1]).sum())))
                else:
                    rows.append((i, key, "und", 0.0, [], 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    own = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.select("doc_id", row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row string, lang_pred string, score double, shares map<string,double>, switches long")


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """Runs of words with one likeliest language: ``(first word, end, lang)``."""
    import numpy as np
    p = label_words(model, [text])[1][0]
    if not len(p):
        return []
    best = p.argmax(1)
    cuts = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
    return [(int(a), int(b), model.langs[best[a]]) for a, b in zip(cuts[:-1], cuts[1:])]


def keep_identified(docs: DataFrame, model: Model | None, least_share: float) -> DataFrame:
    """The rows of ``docs`` with a language that holds ``least_share`` of the
    words, all columns as they are (``und`` goes)."""
    small_batches(docs.sparkSession, 400, 8)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        model = held.value
        for b in batches:
            probs = label_words(model, b.column(at).to_pylist())[1] if model else [np.zeros((0, 0))] * b.num_rows
            yield b.filter(pa.array([len(p) > 0 and float(p.mean(0).max()) >= least_share for p in probs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
