"""SimHash near-duplicate groups by a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in
at most three bits differ in at most three bytes, so they share at least
``8 - 3 = 5`` positional bytes: that is the guaranteed minimum of the count
filter. A posting list per single byte holds a 256th of all rows whatever the
corpus size, and reading those lists pair by pair is quadratic. The index
therefore keys its postings by a *set* of byte positions and their bytes: four
positions at a time, twenty sets, so chosen that any five shared positions
contain one of them. Every pair that reaches the minimum meets in some list;
there the shared positional bytes are tallied, pairs with five or more are kept
and verified by their bit distance.

A list longer than ``LIST_LIMIT`` is split by the bytes and bits that its key
leaves free: those are cut into four parts, one of which must be equal when at
most three bits differ. This repeats until every list is short (at most
2^10 different values are left after five rounds), so no list is skipped and
none is read whole by one task when it is long.

Rows with equal fingerprints are one node, so a group of copies costs one
posting. A task returns a spanning forest of the links it verified instead of
all pairs; components join the forests.

Nulls and empty texts have fingerprint zero and link like any other. A null
doc_id takes part in links but is never a component id (a component of null
ids alone has a null id). Repeated rows give repeated result rows. An empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import components, cut, is_empty, slim, small_batches

SHINGLE_WORDS = 3
MAX_BITS = 3
LIST_LIMIT = 4096
ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def byte_sets(max_bits: int) -> list[int]:
    """Masks of four byte positions such that any ``8 - max_bits`` positions
    hold one of them (greedy; 20 masks for three bits)."""
    width = min(4, 8 - max_bits)
    need = list(combinations(range(8), 8 - max_bits))
    chosen: list[int] = []
    picks = [set(c) for c in combinations(range(8), width)]
    while need:
        best = max(picks, key=lambda s: sum(s <= set(n) for n in need))
        need = [n for n in need if not best <= set(n)]
        chosen.append(sum(0xFF << (8 * b) for b in best))
    return chosen


def split_mask(mask: int, parts: int) -> list[int]:
    """The mask, with each of ``parts`` parts of its free bits added in turn."""
    free = [b for b in range(64) if not mask >> b & 1]
    k = -(-len(free) // parts)
    return [mask | sum(1 << b for b in free[i:i + k]) for i in range(0, len(free), k)]


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text (unsigned)."""
    import numpy as np
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    start = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=start[1:])
    ones, count = np.zeros(64, np.int64), len(words) - n + 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, count, 1 << 16):  # memory stays flat for a text of any length
        hi = min(count, lo + (1 << 16))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(start[lo:hi].tolist(), (start[lo + n:hi + n] - 1).tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def row_key():
    """Names a row by its id and whole text; null and empty texts differ."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "-").otherwise(":"), F.coalesce("text", F.lit(""))))


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(row, doc_id, fp)``, fp as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = [_signed(fingerprint(t, words_per_shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fp, pa.int64())], ["row", "doc_id", "fp"])

    own = slim(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.select(row_key().alias("row"), "doc_id", "text").mapInArrow(run, "row string, doc_id long, fp long")


def _forest(mask, fp, max_bits: int):
    """Links of one task's lists, given sorted by list: (other, least) pairs
    that span each connected set of verified pairs."""
    import numpy as np
    key = fp & mask
    new = np.ones(len(fp), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(fp))
    last = np.repeat(end, end - begin) - 1
    least = np.arange(len(fp))
    at, d = np.flatnonzero(last > least), 1
    while len(at):
        x = fp[at] ^ fp[at + d]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # shared positional bytes
        hit = at[(tally >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        while len(hit):  # lower both ends' roots until they agree
            a, b = least[hit], least[hit + d]
            differ = a != b
            hit, a, b = hit[differ], a[differ], b[differ]
            lo = np.minimum(a, b)
            np.minimum.at(least, np.maximum(a, b), lo)
            np.minimum.at(least, hit, lo)
            np.minimum.at(least, hit + d, lo)
        least = least[least]
        d += 1
        at = at[last[at] - at >= d]
    while True:
        up = least[least]
        if (up == least).all():
            break
        least = up
    other = np.flatnonzero(least != np.arange(len(fp)))
    return fp[other], fp[least[other]]


def _links(postings: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links of all lists; a list lies whole in one task."""
    small_batches(postings.sparkSession, 20_000)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            m, f = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("mask", "fp"))
            if held is not None:
                m, f = np.append(held[0], m), np.append(held[1], f)
            k = m & f
            tail = int(np.flatnonzero((m == m[-1]) & (k == k[-1]))[0])  # the last list may go on in the next batch
            held = m[tail:], f[tail:]
            if tail:
                u, v = _forest(m[:tail], f[:tail], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        if held is not None:
            u, v = _forest(*held, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = postings.withColumn("key", key).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.select("mask", "fp").mapInArrow(run, "u long, v long")


def link_components(nodes: DataFrame, max_bits: int = MAX_BITS, limit: int = LIST_LIMIT) -> DataFrame:
    """``(node, root)`` for distinct fingerprints ``fp`` that have a link."""
    masks = byte_sets(max_bits)
    postings = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    found = None
    while True:
        key = F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        size = postings.groupBy("mask", key).agg(F.count("*").alias("n")).filter("n > 1")
        size = cut(size)
        short = postings.withColumn("key", key).join(size.filter(F.col("n") <= limit), ["mask", "key"], "left_semi")
        links = _links(short.select("mask", "fp"), max_bits)
        found = links if found is None else found.union(links)
        long_lists = size.filter(F.col("n") > limit).select("mask", "key")
        if is_empty(long_lists):
            return components(found)
        masks = sorted({c for m in masks for c in split_mask(m, max_bits + 1)})
        parents = {r[0] for r in long_lists.select("mask").distinct().collect()}  # at most as many as there are masks
        pairs = [F.struct(F.lit(p).cast("long").alias("mask"), F.array(*[F.lit(_signed(c)).cast("long") for c in split_mask(p & ALL, max_bits + 1)]).alias("next")) for p in sorted(parents)]
        step = postings.sparkSession.range(1).select(F.inline(F.array(*pairs)))
        postings = cut(postings.withColumn("key", key).join(long_lists, ["mask", "key"], "left_semi").join(F.broadcast(step), "mask")
                       .select("fp", F.explode("next").alias("mask")).distinct())


def simhash_groups(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, limit: int = LIST_LIMIT) -> DataFrame:
    """``(row, doc_id, fp, root, component_id)`` for every row of ``docs``;
    root is the least fingerprint of the component."""
    fp = cut(fingerprints(docs, words_per_shingle))
    nodes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = link_components(nodes, max_bits, limit).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id"))
    return fp.join(named, "fp").select("row", "doc_id", "fp", "root", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group one row stays,
    that with the least doc_id (null ids last; of rows under one id, the least
    key of id and text). All columns of ``docs`` are kept."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    winners = cut(simhash_groups(docs, **kw).groupBy("root").agg(F.min(order).alias("w"))).select(F.col("w.row").alias("row"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), row_key().alias("row"))
    once = Window.partitionBy("row").orderBy("row")
    kept = packed.join(winners, "row", "left_semi").withColumn("n", F.row_number().over(once)).filter("n = 1")
    return kept.select("doc.*")
