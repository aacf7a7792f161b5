"""Quality rules: base counts of a text and the perplexity of its characters.

The language model is a modified Kneser-Ney model of ``ORDER`` characters per
language, over the words of a text in lower case (A-Z), digits as 0, one space
between words. Spark counts the runs of all texts: tasks emit a run's count
once per few million characters, a shuffle adds them up. The highest order has
plain counts, each lower one the number of different characters before a run.
With the discounts D1, D2, D3 from the counts of counts,

    p(w | h) = (count - D) / total(h) + left(h) p(w | shorter h),

down to one character and the uniform distribution. Runs of two and
more characters that are counted once are not kept (their weight goes to
``left``), so a strange text is no evidence for itself.

The model is a table of (hash, value) in sorted arrays: segments of bounded size
in files of the shared folder. A scoring task takes the different runs of its
texts in order of their hashes through the segments, holding a few at a time,
so its memory doesn't grow with the model, and nothing is broadcast.

A text is kept if it passes the base rules and its mean bits per character
lie in its language's band: median -+ a multiple of the median deviation of
the texts that pass the base rules, taken among texts of about its length (a
short text's mean varies more).

Null text: no words, base rules fail. Null language: ``und``, a language of its
own. Repeated rows are scored and counted each. Other columns are left behind;
an empty table gives an empty result. Long texts are taken in slices between
words; a single word is held whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import cut, get_file, new_folder, put_file, small_batches

ORDER = 5
# What parts words, and what counts as a symbol.
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SLICE = 1 << 19          # bytes of texts taken at once
RUNS = 800_000           # different runs that a counting task holds
SLOTS = 20               # log2 of the scored runs that a scoring task remembers
SEGMENT, HELD = 1 << 20, 12   # entries of a model segment; segments a task holds
# A band reaches this many median deviations below and above the median, at least so many bits.
BELOW, ABOVE, LEAST_BITS = 8.0, 8.0, 0.1
STEP = 200               # histogram steps per bit


def _multipliers(n: int) -> list[int]:
    out, x = [], 0
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) % 2 ** 64
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
        out.append(z ^ z >> 27 | 1)
    return out


_M = _multipliers(ORDER + 1)


def run_sum(chars):
    """The linear part of the hash of runs, given as one array per place."""
    import numpy as np
    out = np.zeros(len(chars[0]) if chars else 1, np.uint64)
    for c, by in zip(chars, _M):
        out += (c.astype(np.uint64) + np.uint64(1)) * np.uint64(by)
    return out


def mixed(h, kind: int):
    """The hash of runs of a kind (its order, or 8 + length for a context)."""
    import numpy as np
    h = h + np.uint64(int(kind) * _M[ORDER] % 2 ** 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def run_hash(chars, kind: int, mark):
    return mixed(run_sum(chars) + mark, kind)


def lang_mark(name: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(name.encode(), 12)


class _Slice:
    """Characters and words of some texts, or of a slice of one long text."""

    def __init__(self, data, starts, number):
        import numpy as np

        from deckflow.llm.grams import Words
        self.w = w = Words(data, starts, BLANKS, b"")
        self.number = number  # of each text in its batch
        lead = (w.norm & 0xC0) != 0x80
        self.chars = np.frombuffer(w.norm.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        self.chars[(self.chars >= 48) & (self.chars <= 57)] = 48
        at = np.concatenate([[0], np.cumsum(lead)])  # characters before a byte
        first = np.searchsorted(w.text, np.arange(len(starts)), "left")
        last = np.searchsorted(w.text, np.arange(len(starts)), "right")
        self.words = last - first
        some = self.words > 0
        self.begin, self.end = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        self.begin[some], self.end[some] = at[w.start[first[some]]], at[w.stop[last[some] - 1]]
        self.first = first
        self.word_chars = np.bincount(w.text, weights=at[w.stop] - at[w.start], minlength=len(starts)).astype(np.int64)


def _slices(texts, wide: int):
    """``_Slice`` objects of a batch's texts (bytes): short texts together,
    a long one in slices cut between words, each after the first with the
    characters that its first runs of ``wide`` need from before."""
    import numpy as np
    blank = re.compile(rb"[ \t\n\x0b\x0c\r]")
    held, size = [], 0

    def join():
        starts = np.cumsum([0, *[len(t) for _, t in held]])[:-1]
        return _Slice(np.frombuffer(b"".join(t for _, t in held), np.uint8), starts, np.array([i for i, _ in held]))

    for i, t in enumerate(texts):
        if len(t) > SLICE:
            at, before = 0, np.zeros(0, np.uint32)
            while at < len(t):
                found = blank.search(t, at + SLICE)
                end = found.start() if found else len(t)
                s = _Slice(np.frombuffer(t[at:end], np.uint8), np.array([0]), np.array([i]))
                own = s.chars[s.begin[0]:s.end[0]]
                s.chars = np.concatenate([before, [32] if len(before) and len(own) else [], own]).astype(np.uint32)
                s.begin[0], s.end[0] = 0, len(s.chars)
                before = s.chars[-(wide - 1):]
                yield s
                at = end
            continue
        held.append((i, t))
        size += len(t)
        if size >= SLICE:
            yield join()
            held, size = [], 0
    if held:
        yield join()


def _runs(s: _Slice, marks, wide: int):
    """Hash, place and number of the text of all runs of ``wide`` characters
    that lie inside one text."""
    import numpy as np
    n = np.maximum(s.end - s.begin - wide + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(s.number, n)
    place = np.arange(total) + np.repeat(s.begin - (np.cumsum(n) - n), n)
    sums = run_sum([s.chars[j:len(s.chars) - wide + 1 + j] for j in range(wide)])
    return mixed(sums[place] + marks[text], wide), place, text


class _Counts:
    """The different runs of a task so far, by hash: characters, language, count."""

    def __init__(self, wide: int):
        import numpy as np
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chars, self.langs = np.zeros((0, wide), np.uint32), np.zeros(0, np.int32)

    def add(self, h, place, text, chars, langs):
        import numpy as np
        ordered = np.sort(h)
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        keys, counts = ordered[first], np.diff(np.append(first, len(ordered)))
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.counts[at[old]] += counts[old]
        keys, counts = keys[~old], counts[~old]
        if not len(keys):
            return
        seen = np.zeros(1 << 22, bool)  # finds the new runs' places without sorting all
        seen[keys >> np.uint64(42)] = True
        some = np.flatnonzero(seen[h >> np.uint64(42)])
        some = some[np.argsort(h[some])]
        one = some[np.searchsorted(h[some], keys)]
        wide = self.chars.shape[1]
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.concatenate([self.counts, counts])[order]
        self.chars = np.concatenate([self.chars, np.stack([chars[place[one] + j] for j in range(wide)], axis=1)])[order]
        self.langs = np.concatenate([self.langs, langs[text[one]].astype(np.int32)])[order]

    def rows(self, names: list[str]):
        import numpy as np
        import pyarrow as pa
        for at in range(0, len(self.keys), 100_000):
            block = self.chars[at:at + 100_000]
            text = block.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
            size = (1 + (block > 0x7F).astype(np.int32) + (block > 0x7FF) + (block > 0xFFFF)).sum(axis=1)
            grams = pa.StringArray.from_buffers(len(block), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(text))
            langs = pa.DictionaryArray.from_arrays(pa.array(self.langs[at:at + 100_000]), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, grams, pa.array(self.counts[at:at + 100_000])], names=["lang", "g", "c"])


def run_counts(docs: DataFrame, wide: int = ORDER) -> DataFrame:
    """``(lang, g, c)``: how often each run of ``wide`` characters occurs."""
    def run(batches):
        import numpy as np
        names: dict[str, int] = {}
        counts = _Counts(wide)
        for b in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int64)
            marks = np.array([lang_mark(x) for x in names], np.uint64)[langs]
            for s in _slices(b.column("text").cast("binary").to_pylist(), wide):
                h, place, text = _runs(s, marks, wide)
                if len(h):
                    counts.add(h, place, text, s.chars, langs)
                if len(counts.keys) >= RUNS:
                    yield from counts.rows(list(names))
                    counts = _Counts(wide)
        yield from counts.rows(list(names))

    return _texts(docs).select("lang", "text").mapInArrow(run, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def discounts(counts: DataFrame) -> DataFrame:
    """``(lang, d1, d2, d3)`` from the counts of counts; 0.5, 1 and 1.5 where
    one of them is none or a discount falls out of its range."""
    of = counts.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.expr("t1 / (t1 + 2 * t2)")
    sound = F.least("t1", "t2", "t3", "t4") > 0
    return of.select("lang", *[F.coalesce(F.when(sound & d.between(0, k), d), F.lit(k / 2)).alias(f"d{k}")
                               for k, d in ((k, F.when(sound, k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"))) for k in (1, 2, 3))])


def model_entries(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, kind, s, value)``: the discounted share of a run (kind: its
    length) and the weight left to shorter runs after a context (8 + its
    length; after none, already divided among all characters)."""
    counts, entries = cut(run_counts(docs, order)), None
    for n in range(order, 0, -1):
        by = Window.partitionBy("lang", "h")
        share = (counts.withColumn("h", F.substring("g", 1, n - 1)).withColumn("total", F.sum("c").over(by)).join(discounts(counts), "lang")
                 .withColumn("value", F.expr("(c - if(c = 1, d1, if(c = 2, d2, d3))) / total")).withColumn("kept", F.col("c") >= (2 if n > 1 else 1)))
        left = 1 - F.coalesce(F.sum(F.when(F.col("kept"), F.col("value"))), F.lit(0.0))
        rest = share.groupBy("lang", "h").agg((left if n > 1 else left / (F.count(F.lit(1)) + 1)).alias("value"))
        got = (share.filter("kept").select("lang", F.lit(n).alias("kind"), F.col("g").alias("s"), "value")
               .union(rest.select("lang", F.lit(8 + n - 1), F.col("h"), "value")))
        entries = got if entries is None else entries.union(got)
        if n > 1:
            counts = cut(counts.groupBy("lang", F.substring("g", 2, n - 1).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    return entries


def write_model(entries: DataFrame, segment: int = SEGMENT) -> list[tuple[int, str, int]]:
    """Sorted hash arrays in files; ``(first hash, path, entries)`` of each."""
    spark = entries.sparkSession
    folder = new_folder(spark, "deckflow-model")

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            kinds, value = b.column("kind").to_numpy(), b.column("value").to_numpy()
            marks = np.array([lang_mark(x) for x in b.column("lang").to_pylist()], np.uint64)
            texts = np.array(b.column("s").to_pylist(), object)
            for kind in np.unique(kinds):
                own, n = np.flatnonzero(kinds == kind), int(kind) % 8
                chars = np.frombuffer("".join(texts[own]).encode("utf-32-le"), np.uint32).reshape(len(own), n)
                h = run_hash([chars[:, j] for j in range(n)], kind, marks[own])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(value[own])], names=["h", "value"])

    table = cut(entries.mapInArrow(hashed, "h long, value double"))
    parts = max(1, -(-table.count() // segment))

    def store(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        h, value = [], []
        for b in batches:
            h.append(b.column("h").to_numpy())
            value.append(b.column("value").to_numpy())
        if sum(map(len, h)):
            path = f"{folder}/segment-{TaskContext.get().partitionId():06d}"
            put_file(path, [np.concatenate(h).tobytes(), np.concatenate(value).tobytes()])
            yield pa.RecordBatch.from_pylist([{"first": int(h[0][0]), "path": path, "n": sum(map(len, h))}])

    got = table.repartitionByRange(parts, "h").sortWithinPartitions("h").mapInArrow(store, "first long, path string, n long").collect()
    return sorted((r["first"], r["path"], r["n"]) for r in got)


class Model:
    """Values by hash. Holds the last few segments it has read."""

    def __init__(self, segments: list[tuple[int, str, int]]):
        self.segments, self.held = segments, {}

    def _segment(self, i: int):
        import numpy as np
        if i not in self.held:
            while len(self.held) >= HELD:
                self.held.pop(next(iter(self.held)))
            _, path, n = self.segments[i]
            with get_file(path) as f:
                raw = f.read()
            self.held[i] = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float64, n, 8 * n)
        return self.held[i]

    def values(self, h, missing: float):
        import numpy as np
        h = h.view(np.int64)
        order = np.argsort(h)
        sorted_h, got = h[order], np.full(len(h), missing)
        edge = np.searchsorted(sorted_h, [s[0] for s in self.segments[1:]], "left")
        for i, (a, b) in enumerate(zip([0, *edge], [*edge, len(h)])):
            if a < b:
                key, value = self._segment(i)
                at = np.minimum(np.searchsorted(key, sorted_h[a:b]), len(key) - 1)
                hit = key[at] == sorted_h[a:b]
                got[order[a:b][hit]] = value[at[hit]]
        return got

    def bits(self, chars, mark):
        """-log2 p of the last character of each run, given those before."""
        import numpy as np
        wide = len(chars)
        p = self.values(run_hash([], 8, mark), 1.0 / 0x110000)
        for n in range(1, wide + 1):
            run = chars[wide - n:]
            if n > 1:
                p = p * self.values(run_hash(run[:-1], 8 + n - 1, mark), 1.0)
            p = p + self.values(run_hash(run, n, mark), 0.0)
        return -np.log2(np.maximum(p, 1e-12))


def _repeated(words, start, size, norm, text, number: int):
    """Words per text inside runs of WINDOW words that the text holds twice or
    more. ``words``: fingerprints, of spans of ``norm``; ``text``: sorted
    numbers below ``number``. Runs of one fingerprint are compared in full."""
    import numpy as np

    from deckflow.llm.grams import same_spans
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(number, np.int64)
    at = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    key = text[at].astype(np.uint64)
    for j in range(WINDOW):
        key = (key ^ words[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    order = np.argsort(key)
    near = np.flatnonzero(key[order][1:] == key[order][:-1])
    if not len(near):
        return np.zeros(number, np.int64)
    a, b = at[order[near]], at[order[near + 1]]
    same, buffer = text[a] == text[b], np.concatenate([norm, np.zeros(8, np.uint8)])
    for j in range(WINDOW):
        same &= size[a + j] == size[b + j]
        same[same] = same_spans(buffer, start[a[same] + j], start[b[same] + j], size[a[same] + j])
    twice = np.union1d(a[same], b[same])
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    edge[twice + WINDOW] -= 1
    return np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=number)


def measures(docs: DataFrame, segments: list[tuple[int, str, int]], wide: int = ORDER) -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, bits``: bits is the mean per character, null where a text
    has fewer than ``wide`` characters."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from deckflow.llm.grams import Fingerprints, Powers
        model, powers = Model(segments), Powers()

        def dup_lines(t: bytes) -> int:
            lines = t.split(b"\n")
            if len(lines) < 2:
                return 0
            full = [x for x in lines if x.strip(BLANKS)]
            return len(full) - len(set(full))

        seen, known = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS)
        seen[0] = 1 << 63  # no hash of slot 0

        def bits_of(h, place, text, chars, marks):
            """Bits of all runs: from those scored before, else by the model."""
            slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
            out = known[slot]
            left = np.flatnonzero(seen[slot] != h)
            if len(left):
                new, one, which = np.unique(h[left], return_index=True, return_inverse=True)
                at = place[left[one]]
                b = model.bits([chars[at + j] for j in range(wide)], marks[text[left[one]]])
                out[left] = b[which]
                slot = (new >> np.uint64(64 - SLOTS)).astype(np.int64)
                seen[slot], known[slot] = new, b  # of two in one slot the last stays
            return out

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            texts = b.column("text").cast(pa.binary()).to_pylist()
            marks = np.array([lang_mark(x) for x in b.column("lang").to_pylist()], np.uint64)
            n_words, word_chars, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            total, scored, long_words = np.zeros(n), np.zeros(n, np.int64), {}
            for s in _slices(texts, wide):
                n_words[s.number] += s.words
                word_chars[s.number] += s.word_chars
                own = Fingerprints(s.w.norm, powers).of(s.w.start, s.w.stop), s.w.start, s.w.stop - s.w.start, s.w.norm
                if len(s.number) == 1:
                    long_words.setdefault(int(s.number[0]), []).append(own)
                else:
                    repeat[s.number] += _repeated(*own, s.w.text, len(s.number))
                h, place, text = _runs(s, marks, wide)
                if len(h):
                    total += np.bincount(text, weights=bits_of(h, place, text, s.chars, marks), minlength=n)
                    scored += np.bincount(text, minlength=n)
            for i, parts in long_words.items():
                before = np.cumsum([0, *[len(p[3]) for p in parts]])
                fp, start, size, norm = (np.concatenate(x) for x in zip(*[(p[0], p[1] + o, p[2], p[3]) for p, o in zip(parts, before)]))
                repeat[i] += _repeated(fp, start, size, norm, np.zeros(len(fp), np.int64), 1)[0]
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
            dups = np.array([dup_lines(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *[pa.array(x) for x in (n_words, word_chars, symbols, dups, repeat)],
                                              pa.array(total / np.maximum(scored, 1), mask=scored == 0)],
                                             names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits"])

    return _texts(docs).mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double")


def size_class(words: Column) -> Column:
    """Texts of about one length: powers of two of the words."""
    return F.floor(F.log2(F.greatest(words, F.lit(1)))).cast("int")


def bands(scored: DataFrame) -> DataFrame:
    """``(lang, size, low, high)`` in bits. Medians come from histograms, so
    what a task sees doesn't grow with the corpus."""
    by = Window.partitionBy("lang", "size")

    def median(hist: DataFrame, value: str) -> DataFrame:
        upto = hist.withColumn("upto", F.sum("n").over(by.orderBy(value))).withColumn("all", F.sum("n").over(by))
        return upto.filter("2 * upto >= all").groupBy("lang", "size").agg(F.min(value).alias("m"))

    hist = (scored.filter("not base_failed and bits is not null").groupBy("lang", "size", F.round(F.col("bits") * STEP).cast("long").alias("at"))
            .agg(F.count(F.lit(1)).alias("n")))
    middle = median(hist, "at")
    away = hist.join(middle, ["lang", "size"]).groupBy("lang", "size", F.abs(F.col("at") - F.col("m")).alias("off")).agg(F.sum("n").alias("n"))
    spread = median(away, "off").withColumnRenamed("m", "off")
    wide = lambda k: F.greatest(k * F.col("off") / STEP, F.lit(LEAST_BITS))
    return middle.join(spread, ["lang", "size"]).select("lang", "size", (F.col("m") / STEP - wide(BELOW)).alias("low"), (F.col("m") / STEP + wide(ABOVE)).alias("high"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``bits``, the band and ``kept`` per row."""
    small_batches(docs.sparkSession, 1000, 4)
    model = write_model(model_entries(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = cut(measures(docs, model).withColumn("base_failed", failed).withColumn("size", size_class(F.col("n_words"))))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return (scored.join(bands(scored), ["lang", "size"], "left")
            .withColumn("kept", ~F.col("base_failed") & inside).withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits"))))
