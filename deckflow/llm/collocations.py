"""Phrase collocations: frequent runs of 2 to 5 words by Rabin-Karp fingerprints.

Counting takes three passes: words, pairs, and runs of three to five. In each a
task reads its texts, hashes runs by prefix polynomials (``grams``) and counts
its own: runs of one fingerprint are sorted together and their bytes are
compared, so a count never mixes two texts. Fingerprints and counts are
shuffled and summed, no text. A run can only be frequent if the shorter runs in
it are, so the next pass counts those whose parts are all in the membership
filter of this one's frequent fingerprints. The filter never denies a member,
whatever its size, so nothing is lost; it is bounded, and what it lets through
in vain is only work.

A last pass meets the frequent fingerprints again. Every task emits for each its
count, a second hash of the text (XXH64) and a pointer to one occurrence; the
shuffle sums what agrees in language, fingerprint, second hash and length and
keeps the first and the last pointer. Both are read from the texts: if they
show one phrase, that is the phrase and the sum its count. If they should not,
every task's text of that fingerprint is read and counted by itself. Phrases
that share a fingerprint are so told apart, and only frequent ones are ever
read out. Scores are exact (decimals of 38 digits).

What tasks emit is shuffled in blocks: the fingerprints of a range (a bucket) that
a task has at a time, sorted, are one row with packed columns, and the task that
gets a bucket adds its blocks up. There are ``SPLIT`` buckets per shuffle
partition, so what is added up at once falls as partitions are added.

A null text is empty, a null language is ``und``; repeated rows count each;
other columns are left behind; an empty table gives no rows. Long texts are cut
between words into chunks that overlap by four words, each run counted once.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckflow.llm.common import cut, small_batches

LONGEST = 5
# What parts words, and what ends a piece of text.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
CHUNK = 1 << 16       # bytes of a text taken as one
SEGMENT = 1 << 20     # bytes hashed at once
FLUSH = 1_500_000     # runs counted at once
FOUND = 1_000_000     # groups that a task holds in the pass with pointers
SPLIT = 4             # buckets of a shuffle partition
BLOCKS = "bucket int, block binary"
POINTED = "lang string, fp long, check long, size int, cnt long, row long, off int, len int"
GROUPS = "lang string, fp long, check long, size int, a long, first struct<row:long,off:int,len:int>, last struct<row:long,off:int,len:int>"

_POINTED = ["lang", "fp", "check", "size", "cnt", "row", "off", "len"]


def _blocks(fp, columns: dict, buckets: int):
    """Rows ``(bucket, block)`` of columns sorted by fingerprint: a block is an
    Arrow stream. Fingerprints are stored as steps, a plane for each byte."""
    import numpy as np
    import pyarrow as pa
    bucket = _bucket(fp, buckets)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(int(edges[b]), int(edges[b + 1]))
        steps = np.diff(fp[at], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
        batch = pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(steps[:, i])) for i in range(8)], *[x[at] if isinstance(x, pa.Array) else pa.array(x[at]) for x in columns.values()]],
                                           names=[*map(str, range(8)), *columns])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        rows.append((b, sink.getvalue().to_pybytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])


def _bucket(fp, buckets: int):
    """Ranges of fingerprints of about one size."""
    import numpy as np
    return ((fp >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _read_block(block: bytes):
    """``(fingerprints, Arrow batch)`` of a block."""
    import numpy as np
    import pyarrow as pa
    with pa.ipc.open_stream(block) as got:
        batch = got.read_next_batch()
    steps = np.stack([batch.column(i).to_numpy() for i in range(8)], axis=1)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), batch


def _by_bucket(batches):
    """The blocks of each bucket, from rows sorted by bucket."""
    bucket, held = None, []
    for b in batches:
        for n, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist()):
            if n != bucket and held:
                yield held
                held = []
            bucket = n
            held.append(block)
    if held:
        yield held


def chunks(docs: DataFrame) -> DataFrame:
    """``(row, lang, text, upto)``: texts as bytes; runs that begin before
    ``upto`` count, what follows belongs to the next chunk of a long text."""
    gap = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
    tail = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (LONGEST - 1))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            lang, text, upto = [], [], []
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                at = 0
                while at < len(t):
                    found = gap.search(t, at + CHUNK) if len(t) - at > CHUNK else None
                    end = found.start() if found else len(t)
                    lang.append(name)
                    text.append(t[at:tail.match(t, end).end()])
                    upto.append(end - at)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.binary()), pa.array(upto, pa.int32())], names=["lang", "text", "upto"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    got = texts.filter("text <> ''").mapInArrow(run, "lang string, text binary, upto int")
    return cut(got.withColumn("row", F.monotonically_increasing_id()))


class _Tally:
    """The runs of a task so far, counted by text when ``flush`` is called. A
    run is its fingerprint, its first word and its number of words."""

    def __init__(self):
        self.found = None
        self.clear()

    def clear(self):
        self.norm, self.words, self.texts, self.runs = [], [], [], []
        self.bytes, self.size, self.held, self.pending = 0, 0, 0, 0

    def add(self, w, starts, rows, langs, runs):
        """``runs``: (fingerprints, first words, n) of the words ``w``."""
        import numpy as np
        off = w.raw - starts[w.text]
        self.words.append([x.astype(np.int32) for x in (w.start + self.bytes, w.stop + self.bytes, off, w.raw_stop - w.raw + off, w.text + self.held)])
        self.norm.append(w.norm)
        self.texts.append((rows, langs))
        for fp, at, n in runs:
            self.runs.append((fp, (at + self.size).astype(np.int32), np.full(len(at), n, np.int8)))
            self.pending += len(at)
        self.bytes, self.size, self.held = self.bytes + len(w.norm), self.size + len(w.raw), self.held + len(rows)

    def flush(self, names: list[str], pointers: bool, buckets: int):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from deckflow.llm.grams import same_spans
        if not self.pending:
            return
        buffer = np.concatenate([*self.norm, np.zeros(8, np.uint8)])
        start, stop, off, off_stop, text = (np.concatenate(x) for x in zip(*self.words))
        rows, langs = (np.concatenate(x) for x in zip(*self.texts))
        fp, word, n = (np.concatenate(x) for x in zip(*self.runs))
        self.clear()
        order = np.argsort(fp)
        fp, word, n = fp[order], word[order], n[order]
        near = np.flatnonzero(fp[1:] == fp[:-1])
        a, b = word[near], word[near + 1]
        size = stop[a + n[near] - 1] - start[a]
        alike = (size == stop[b + n[near + 1] - 1] - start[b]) & (langs[text[a]] == langs[text[b]])
        alike[alike] = same_spans(buffer, start[a[alike]], start[b[alike]], size[alike])
        first = np.ones(len(fp), bool)
        first[near[alike] + 1] = False
        first = np.flatnonzero(first)
        count = np.diff(np.append(first, len(fp))).astype(np.int64)
        one = first + (fp[first] % count.astype(np.uint64)).astype(np.int64)  # any of them, so pointers spread over the texts
        if not pointers:
            yield from _blocks(fp[one], {"cnt": count}, buckets)
            return
        w, last = word[one], word[one] + n[one] - 1
        shown = memoryview(buffer)
        check = np.array([xxhash.xxh64_intdigest(shown[i:j], 11) for i, j in zip(start[w].tolist(), stop[last].tolist())], np.uint64)
        new = langs[text[w]].astype(np.int32), fp[one], check, stop[last] - start[w], count, rows[text[w]], off[w], off_stop[last] - off[w]
        self.found = _merged([np.concatenate(x) for x in zip(self.found, new)] if self.found else list(new))
        if len(self.found[0]) > FOUND:
            yield from self.emit(names, buckets)

    def emit(self, names: list[str], buckets: int):
        """The groups found so far, for the pass with pointers."""
        import numpy as np
        import pyarrow as pa
        if not self.found:
            return
        order = np.argsort(self.found[1], kind="stable")
        lang, fp, check, *rest = (x[order] for x in self.found)
        self.found = None
        lang_names = pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(names, pa.string())).cast(pa.string())
        yield from _blocks(fp, {"lang": lang_names, "check": check, **dict(zip(_POINTED[3:], rest))}, buckets)


def _merged(groups: list):
    """Groups (lang, fp, check, size, count, pointer) that agree in the first
    four as one, with the sum of their counts and the first's pointer."""
    import numpy as np
    order = np.argsort(groups[1] ^ groups[2] * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    groups = [x[order] for x in groups]
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in groups[:4]])
    first = np.flatnonzero(first)
    return [*[x[first] for x in groups[:4]], np.add.reduceat(groups[4], first) if len(first) else groups[4], *[x[first] for x in groups[5:]]]


def runs_of(texts: DataFrame, sizes: list[int], passes, buckets: int, pointers: bool = False) -> DataFrame:
    """Blocks of each task's counts of the runs of ``sizes`` words. ``passes`` is a broadcast
    filter of frequent runs. Without ``pointers`` it holds those one word
    shorter than the least of ``sizes``, and of a run every part of that size must
    pass. With ``pointers`` the runs themselves must; a further row of bucket -1
    then has the number of all words of each language."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from deckflow.llm.grams import Fingerprints, Membership, Powers, Words
        powers, tally, names, total = Powers(), _Tally(), {}, {}
        part = sizes[0] - 1
        known = Membership(*passes.value) if passes is not None else None
        marks: list[int] = []

        def code(name):
            if name not in names:
                names[name] = len(names)
                marks.append(xxhash.xxh64_intdigest(name.encode(), 7))
            return names[name]

        def count(data, starts, upto, rows, langs):
            w = Words(data, starts, BLANKS, BREAKS)
            own = w.raw - starts[w.text] < upto[w.text]
            hashed, mark = Fingerprints(w.norm, powers), np.array(marks, np.uint64)[langs][w.text]

            def of(at, n):
                return hashed.of(w.start[at], w.stop[at + n - 1]) ^ mark[at]

            def whole(at, n):
                return at[w.piece[at] == w.piece[np.minimum(at + n - 1, len(w.piece) - 1)]]

            runs = []
            if pointers:
                for c, k in enumerate(np.bincount(langs[w.text[own]], minlength=len(marks)).tolist()):
                    total[c] = total.get(c, 0) + k
                at = np.arange(len(w.raw))
                for n in sizes:  # a run of n words is frequent only if the two of n - 1 words are
                    if n > 1:
                        good = np.zeros(len(w.raw) + 1, bool)
                        good[at] = True
                        at = whole(at[good[at + 1]], n)
                    fp = of(at, n)
                    passed = known.has(fp)
                    at = at[passed]
                    mine = own[at]
                    runs.append((fp[passed][mine], at[mine], n))
            else:
                good = np.ones(len(w.raw) + sizes[-1], bool)
                at = np.flatnonzero(own)
                if part:
                    good[:] = False
                    at = whole(np.arange(max(0, len(w.raw) - part + 1)), part)
                    at = at[known.has(of(at, part))]
                    good[at] = True
                    at = at[own[at]]
                for n in sizes:  # a run of n words needs its n - part further parts too
                    if n > 1:
                        at = whole(at[good[at + n - part]], n)
                    runs.append((of(at, n), at, n))
            tally.add(w, starts, rows, langs, runs)

        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("text")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8)
            rows, upto = b.column("row").to_numpy(), b.column("upto").to_numpy().astype(np.int64)
            langs = np.array([code(x) for x in b.column("lang").to_pylist()], np.int64)
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
                count(data[offsets[i]:offsets[j]], offsets[i:j] - offsets[i], upto[i:j], rows[i:j], langs[i:j])
                i = j
                if tally.pending >= FLUSH or tally.size >= 2 * FLUSH:
                    yield from tally.flush(list(names), pointers, buckets)
        yield from tally.flush(list(names), pointers, buckets)
        yield from tally.emit(list(names), buckets)
        if total:
            words = json.dumps({name: total.get(c, 0) for name, c in names.items()}).encode()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([words], pa.binary())], names=["bucket", "block"])

    return texts.mapInArrow(run, BLOCKS)


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    return blocks.repartition(max(1, buckets // SPLIT), "bucket").sortWithinPartitions("bucket")


def frequent(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """``fp`` of all fingerprints whose counts add up to ``least`` or more."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for held in _by_bucket(batches):
            parts = [_read_block(x) for x in held]
            fp = np.concatenate([f for f, _ in parts])
            order = np.argsort(fp)
            fp, cnt = fp[order], np.concatenate([b.column("cnt").to_numpy() for _, b in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(fp[first][np.add.reduceat(cnt, first) >= least].view(np.int64))], names=["fp"])

    return _dealt(blocks, buckets).mapInArrow(run, "fp long")


def groups_of(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """Sums of the blocks with pointers per language, fingerprint, second hash and
    length, with the first and the last pointer; rows without a fingerprint have
    the words of a language that a task counted."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        pointer = pa.struct([("row", pa.int64()), ("off", pa.int32()), ("len", pa.int32())])
        names = ["lang", "fp", "check", "size", "a", "first", "last"]
        for held in _by_bucket(batches):
            if held[0][:1] == b"{":
                for words in map(json.loads, held):
                    none = [pa.nulls(len(words), t) for t in (pa.int64(), pa.int64(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), *none, pa.array(list(words.values()), pa.int64()), *[pa.nulls(len(words), pointer)] * 2], names=names)
                continue
            parts = [_read_block(x) for x in held]
            table = pa.Table.from_batches([b for _, b in parts]).combine_chunks()
            lang = table.column("lang").combine_chunks().dictionary_encode()
            code = lang.indices.to_numpy()
            fp, (check, size, cnt, row, off, length) = np.concatenate([f for f, _ in parts]), (table.column(c).to_numpy() for c in _POINTED[2:])
            order = np.lexsort((off, row, code, size, check, fp))
            fp, check, size, code, cnt, row, off, length = (x[order] for x in (fp, check, size, code, cnt, row, off, length))
            new = np.ones(len(fp), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (fp, check, size, code)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(fp)) - 1
            total = np.add.reduceat(cnt, first)
            stay = total >= least
            first, last = first[stay], last[stay]
            at = lambda i: pa.StructArray.from_arrays([pa.array(row[i]), pa.array(off[i]), pa.array(length[i])], names=["row", "off", "len"])
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(fp[first].view(np.int64)), pa.array(check[first].view(np.int64)), pa.array(size[first]),
                                              pa.array(total[stay]), at(first), at(last)], names=names)

    return _dealt(blocks, buckets).mapInArrow(run, GROUPS)


def spread(blocks: DataFrame) -> DataFrame:
    """The rows of blocks with pointers, one by one."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for held in _by_bucket(batches):
            for fp, b in map(_read_block, held):
                columns = {"fp": pa.array(fp.view(np.int64)), "check": pa.array(b.column("check").to_numpy().view(np.int64))}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else b.column(c) for c in _POINTED], names=_POINTED)

    return blocks.filter("bucket >= 0").mapInArrow(run, POINTED)


def membership(spark: SparkSession, fps: DataFrame):
    """The broadcast filter of a column of distinct fingerprints ``fp``: Spark
    ors the tasks' bits; at most 2**LARGEST bits meet on the driver."""
    import numpy as np

    from deckflow.llm.grams import Membership
    log2 = Membership.log2_for(fps.count())

    def mark(batches):
        import pyarrow as pa
        for b in batches:
            words, bits = Membership.marks(b.column("fp").to_numpy().view(np.uint64), log2)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = fps.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << (log2 - 6), np.uint64)
    whole[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast((log2, whole))


def _read(pointers: DataFrame, texts: DataFrame) -> DataFrame:
    """The phrase that each pointer (row, off, len) shows."""
    raw = F.expr("cast(substring(text, off + 1, len) as string)")
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pointers.join(texts.select("row", "text"), "row").withColumn("phrase", F.regexp_replace(lower, "[ \t]+", " ")).drop("text")


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, n, phrase, a)`` for all runs of 1 to ``longest`` words that
    occur ``least`` times or more, and ``(lang, words)`` for all languages."""
    spark = docs.sparkSession
    small_batches(spark, 2000, 8)
    texts, known, passes = chunks(docs), None, None
    buckets = SPLIT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for sizes in [[1], [2], list(range(3, longest + 1))][:min(longest, 3)]:
        found = cut(frequent(runs_of(texts, sizes, passes, buckets), buckets, least))
        known = found if known is None else known.union(found)
        passes = membership(spark, found)
    pointed = runs_of(texts, list(range(1, longest + 1)), membership(spark, known), buckets, pointers=True)
    key = ["lang", "fp", "check", "size"]
    groups = cut(groups_of(pointed, buckets, least))
    ends = F.explode(F.array_distinct(F.array("first", "last"))).alias("p")
    shown = _read(groups.filter("fp is not null").select(*key, "a", ends).select(*key, "a", "p.row", "p.off", "p.len"), texts)
    shown = cut(shown.groupBy(*key, "a").agg(F.min("phrase").alias("phrase"), F.max("phrase").alias("other")))
    disputed = shown.filter("phrase <> other").select(key)
    counts = shown.filter("phrase = other").select("lang", "phrase", "a")
    if disputed.limit(1).count():
        every = _read(spread(pointed).join(disputed, key, "left_semi"), texts)
        counts = counts.union(every.groupBy("lang", "phrase").agg(F.sum("cnt").alias("a")))
    counts = cut(counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least).withColumn("n", F.size(F.split("phrase", " "))))
    return counts, groups.filter("fp is null").groupBy("lang").agg(F.sum("a").alias("words"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, covered_percent: int = 100, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases per
    language. ``l`` and ``r`` count the two parts of the cut that scores lowest;
    a phrase inside a longer candidate that has ``covered_percent`` of its
    count goes."""
    counts, words = frequent_phrases(docs, least, longest)
    single = counts.select("lang", "phrase", "a")
    longer = counts.filter("n >= 2")
    w = F.split("phrase", " ")

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = (longer.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
            .select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest")))
    part = lambda name, count: single.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(words.withColumnRenamed("words", "n"), "lang")
    long = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (scored.withColumn("x", F.lit(1000).cast("decimal(4,0)") * (long("a") * long("n"))).withColumn("y", long("l") * long("r"))
              .withColumn("score", F.expr("x div y")))
    best = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
            .select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score"))
    inside = (longer.filter("n >= 3").withColumn("w", w)
              .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
              .select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    open_ = best.join(inside, ["lang", "phrase"], "left").filter(F.expr(f"within is null or 100 * within < {int(covered_percent)} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
