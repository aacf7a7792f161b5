"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Symbols are words (lower-case runs of word characters). The CGK embedding
(Chakraborty, Goldenberg, Koucky, 2016) walks over a string: at step j it emits
the symbol under the pointer and moves the pointer on if a random bit of
(j, symbol) is set. Strings at a small edit distance are emitted with few
differing places, so edit distance becomes Hamming distance. Sampling a few
places of the embedding gives a signature; equal signatures make a hit.

Windows are sized by the item: an item of 2^c to 2^(c+1) words is represented
by the windows of 2^(c-1) words at each of its positions, and every position of
every document starts a walk, so a leak needs no alignment and an edit
spoils only the windows it lies in. Walks are repeated with new random bits
until simulated leaks at the largest allowed distance are found with
probability ``RECALL`` for items of every size (measured on the benchmark's own
items, at most ``MAX_WALKS`` walks; a size that stays below ``LEAST_RECALL`` ends
the job with an error that names it); the first sampled places are near the
start, so most positions of a document leave a walk after a few steps.

A signature holds 2 + ``FAR`` places. ``HITS`` signatures at different positions
that place the item alike (within the allowed edits) make a candidate; the
simulation counts a leak as found by the same rule.

Candidates are verified exactly: the least edit distance, in words, between the
item and any stretch of the document around the candidate place (bit-parallel,
Myers 1999) must be at most ``MAX_EDITS`` = 20 % of the item's words (a similarity
of 0.8). The walks, the simulated leaks and the check all count the same edits:
words left out, put in or replaced.

The benchmark is read in blocks of about ``BLOCK_WORDS`` words, so what is
broadcast is bounded; each block passes over all documents. Documents are
never shuffled: matches, or a filter, come out of one pass per block.

Defined results: null and empty texts match nothing. Items of fewer than
``MIN_WORDS`` words are too short for windows; a document matches one that it
holds word for word. Null items and items without a word match nothing. Repeated rows each match. Items equal in text all match.
Empty tables give no matches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slim, small_batches

WORD = re.compile(r"\w+")
MAX_EDITS, RECALL, LEAST_RECALL, MIN_WORDS = 0.2, 0.97, 0.9, 8
MIN_WALKS, MAX_WALKS = 4, 24
BLOCK_WORDS = 400_000
FAR, HITS = 4, 4
SEED = 11
CACHE = 400_000
TABLE_BITS = 22

_HASHES: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def symbols(words: list[str]):
    """A random number for each word, equal in all processes."""
    import numpy as np
    import xxhash
    if len(_HASHES) > CACHE:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh64_intdigest(w) | 1
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class Walk:
    """One random walk; its sampled steps for windows of ``m`` words."""

    def __init__(self, number: int):
        import numpy as np
        rng = np.random.default_rng([SEED, number])
        self.number = number
        self.mix = (rng.integers(0, 2**63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.near = int(rng.integers(1, 6))
        self.far = {m: sorted((self.near + rng.permutation(max(FAR, int(1.4 * m) - self.near))[:FAR] + 1).tolist()) for m in (4, 8, 16, 32, 64, 128, 256)}

    def bit(self, x, step: int):
        import numpy as np
        return ((x * self.mix[step // 32]) >> np.uint64(63 - step % 32)) & np.uint64(1)

    def first(self, x, starts):
        """Pointer and signature after the near step."""
        import numpy as np
        at = starts + self.bit(x[starts], 0).astype(np.int64)
        for j in range(1, self.near):
            at = at + self.bit(x[at], j).astype(np.int64)
        return at, (x[starts] * self.mix[14]) ^ ((x[at] * self.mix[15]) >> np.uint64(1))

    def rest(self, x, at, sig, sizes):
        """``(size, signatures)`` for each window size, walking on together."""
        import numpy as np
        due = {}
        for m in sizes:
            for j in self.far[m]:
                due.setdefault(j, []).append(m)
        own, step = {m: sig + np.uint64(m) for m in sizes}, self.near
        for j in range(step, max(due) + 1):
            if j in due:
                for m in due[j]:
                    own[m] = (own[m] ^ (x[at] >> np.uint64(7))) * self.mix[13]
                    if j == self.far[m][-1]:
                        yield m, own[m]
            at = at + self.bit(x[at], j).astype(np.int64)


def window_size(words: int) -> int:
    return min(256, 1 << max(2, words.bit_length() - 2))


def reach(sizes) -> int:
    return int(1.4 * max(sizes)) + 12


def _bits(sig):
    import numpy as np
    return ((sig * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Index:
    """Signatures of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edits: float = MAX_EDITS, recall: float = RECALL, min_words: int = MIN_WORDS):
        import numpy as np
        ids: dict[tuple[str, ...], list[int]] = {}
        for i, w in items:  # items of one text are one
            ids.setdefault(tuple(w), []).append(i)
        self.short: dict[int, dict[int, list[tuple[tuple[str, ...], list[int]]]]] = {}
        for w, own in ids.items():
            if len(w) < min_words:
                self.short.setdefault(len(w), {}).setdefault(int(_run_keys(symbols(list(w)), len(w))[0]), []).append((w, own))
        self.items = [(own, w) for w, own in ids.items() if len(w) >= min_words]
        self.max_edits = max_edits
        self.sizes = sorted({window_size(len(w)) for _, w in self.items})
        self.starts = np.zeros(1 << TABLE_BITS, bool)
        self.walks, self.tables, self.recall = [], [], {}
        self.coded = [symbols(list(w)) for _, w in self.items]
        for x in self.coded:
            self.starts[_bits(x)] = True
        leaks = self.leaks()
        for r in range(MAX_WALKS if self.items else 0):
            self.add(Walk(r))
            if r + 1 >= MIN_WALKS:
                self.recall = {m: float(np.mean([n in self.candidates(x)[:, 0] for n, x in own])) for m, own in leaks.items()}
                if min(self.recall.values()) >= recall:
                    break
        del self.coded
        if low := {m: x for m, x in self.recall.items() if x < LEAST_RECALL}:
            raise ValueError(f"recall of simulated leaks by window size stays below {LEAST_RECALL}: {low}")

    def add(self, walk: Walk) -> None:
        import numpy as np
        near, by_size = np.zeros(1 << TABLE_BITS, bool), {m: ([], []) for m in self.sizes}
        for n, x in enumerate(self.coded):
            m = window_size(len(x))
            padded = np.concatenate([x, np.zeros(reach(self.sizes), np.uint64)])
            at, sig = walk.first(padded, np.arange(len(x) - m + 1))
            near[_bits(sig)] = True
            for _, own in walk.rest(padded, at, sig, [m]):
                by_size[m][0].append(own)
                by_size[m][1].extend((n, o) for o in range(len(own)))
        table = {}
        for m, (sigs, where) in by_size.items():
            flat = np.concatenate(sigs)
            order = np.argsort(flat, kind="stable")
            table[m] = flat[order], np.array(where, np.int64)[order]
        self.walks.append(walk)
        self.tables.append((near, table))

    def leaks(self):
        """Per window size ``(item, symbols)`` of leaks simulated at the largest
        distance, amid other words."""
        import numpy as np
        rng = np.random.default_rng(SEED)
        out: dict[int, list] = {}
        for m in self.sizes:
            own = [n for n, x in enumerate(self.coded) if window_size(len(x)) == m]
            pick = rng.permutation(own)[:48].tolist()
            for n in (pick * -(-144 // len(pick)))[:144]:
                x, leak = self.coded[n], rng.integers(1, 2**63, 40).tolist()
                edits = set(rng.choice(len(x), int(self.max_edits * len(x)), replace=False).tolist())
                for i, s in enumerate(x.tolist()):
                    kind = int(rng.integers(3)) if i in edits else 3  # left out, replaced, one put in front, kept
                    leak += [int(rng.integers(1, 2**63))] * (kind in (1, 2)) + [s] * (kind >= 2)
                out.setdefault(m, []).append((n, np.array(leak + rng.integers(1, 2**63, 400).tolist(), np.uint64)))
        return out

    def slack(self, words: int) -> int:
        return 2 + int(2 * self.max_edits * words)

    def hits(self, walk: Walk, near, table, padded, starts):
        """Rows ``(item, place, position)``: the item may begin at the place, by its signature at the position."""
        import numpy as np
        at, sig = walk.first(padded, starts)
        live = np.flatnonzero(near[_bits(sig)])
        at, sig, begin = at[live], sig[live], starts[live]
        for m, own in walk.rest(padded, at, sig, self.sizes):
            sigs, where = table[m]
            lo = np.searchsorted(sigs, own)
            hit = np.flatnonzero(sigs[np.minimum(lo, len(sigs) - 1)] == own)
            while len(hit):
                n, o = where[lo[hit]].T
                yield np.stack([n, begin[hit] - o, begin[hit]], 1)
                lo[hit] += 1
                hit = hit[lo[hit] < len(sigs)]
                hit = hit[sigs[lo[hit]] == own[hit]]

    def candidates(self, x):
        """``(item, first place, last place)``: places that lie within the slack
        of the next, hit at ``HITS`` different positions at least."""
        import numpy as np
        none = np.zeros((0, 3), np.int64)
        if not len(x):
            return none
        padded = np.concatenate([x, np.zeros(reach(self.sizes), np.uint64)])
        starts = np.flatnonzero(self.starts[_bits(x)])
        found = [h for walk, (near, table) in zip(self.walks, self.tables) for h in self.hits(walk, near, table, padded, starts)]
        if not found:
            return none
        h = np.concatenate(found)
        h = h[np.lexsort((h[:, 2], h[:, 1], h[:, 0]))]
        slack = np.array([self.slack(len(w)) for _, w in self.items])[h[:, 0]]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:, 0] != h[:-1, 0]) | (h[1:, 1] - h[:-1, 1] > slack[1:])
        group = np.cumsum(new) - 1
        seen = np.unique(np.stack([group, h[:, 2]], 1), axis=0)[:, 0]
        enough = np.bincount(seen, minlength=group[-1] + 1) >= HITS
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        return np.stack([h[first, 0], h[first, 1], h[last, 1]], 1)[enough]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
        """Per text ``(item_id, first word, end word, distance, similarity)``,
        the best place for each item."""
        import numpy as np
        words = [words_of(t) for t in texts]
        out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
        flat = [w for x in words for w in x]
        if not flat:
            return out
        ends = np.cumsum([len(x) for x in words])
        coded = symbols(flat)
        for d, i, at, n in self.exact(flat, coded, ends):
            out[d].append((i, at, at + n, 0, 1.0))
        if not self.items:
            return out
        found = self.candidates(coded)
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for n, low, high in found.tolist():
            length = len(self.items[n][1])
            slack = self.slack(length)
            for d in range(*np.searchsorted(ends, [max(low, 0), min(high + length, len(flat) - 1)], side="right") + [0, 1]):
                first = int(ends[d]) - len(words[d])
                lo, hi = max(0, low - first - slack), min(len(words[d]), high - first + length + slack)
                spans = regions.setdefault((d, n), [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                elif lo < hi:
                    spans.append([lo, hi])
        for (d, n), spans in regions.items():
            ids, item = self.items[n]
            best = None
            for lo, hi in spans:
                dist, a, b = fit(item, words[d][lo:hi], int(self.max_edits * len(item)))
                if dist is not None and (best is None or dist < best[0]):
                    best = dist, lo + a, lo + b
            if best:
                out[d] += [(i, best[1], best[2], best[0], 1 - best[0] / len(item)) for i in ids]
        return out

    def exact(self, flat, coded, ends):
        """``(text, item, place in it, words)`` of the first place where a text holds
        a short item word for word."""
        import numpy as np
        for n, keys in self.short.items():
            if len(coded) < n:
                continue
            seen = set()
            for at in np.flatnonzero(np.isin(_run_keys(coded, n), np.array(list(keys), np.uint64))).tolist():
                d = int(np.searchsorted(ends, at, "right"))
                for w, ids in keys.get(int(_run_keys(coded[at:at + n], n)[0]), ()):
                    if at + n <= ends[d] and (d, w) not in seen and tuple(flat[at:at + n]) == w:
                        seen.add((d, w))
                        for i in ids:
                            yield d, i, at - (int(ends[d - 1]) if d else 0), n


def _run_keys(x, n: int):
    """A number for every run of n words."""
    import numpy as np
    out = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for j in range(n):
        out = (out ^ x[j:len(x) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _ends(pattern, text, whole_start: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text`` and the
    earliest end that has it (a stretch from the start with ``whole_start``)."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (~(xh | vp) & full)
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) | (1 if whole_start else 0)
        hn <<= 1
        vp = (hn | (~(xv | hp) & full)) & full
        vn = hp & xv & full
        if score < best:
            best, end = score, j
    return best, end


def fit(item, text, most: int) -> tuple[int | None, int, int]:
    """``(distance, start, end)`` of the best stretch of ``text``, or None; both
    are strings or sequences of words."""
    dist, end = _ends(item, text)
    if dist > most:
        return None, 0, 0
    _, back = _ends(item[::-1], text[:end][::-1], True)
    return dist, end - back, end


def indexes(benchmark: DataFrame, max_edits: float = MAX_EDITS, block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS, recall: float = RECALL):
    """One index per block of the benchmark."""
    own = slim(benchmark, item_id="item_id", text="text").filter("text is not null and item_id is not null")
    own = own.withColumn("n", F.regexp_count("text", F.lit(r"\w+")))
    total = own.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()  # about block_words words
        items = sorted((r["item_id"], w) for r in rows if (w := words_of(r["text"])))
        if items:
            yield Index(items, max_edits, recall, min_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``(doc_id, item_id, first_word, end_word, distance, similarity)``."""
    spark = docs.sparkSession
    small_batches(spark, 400, 8)
    own = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    schema = "doc_id long, item_id long, first_word int, end_word int, distance int, similarity double"
    for index in indexes(benchmark, **kw):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            import pyarrow as pa
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            names = ["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"]
            for b in batches:
                found = held.value.matches(b.column("text").to_pylist())
                rows = [(i, *m) for i, ms in zip(b.column("doc_id").to_pylist(), found) for m in ms]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        got = own.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    spark = docs.sparkSession
    small_batches(spark, 400, 8)
    at = docs.columns.index("text")
    for index in indexes(benchmark, **kw):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            import pyarrow as pa
            for b in batches:
                yield b.filter(pa.array([not m for m in held.value.matches(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
