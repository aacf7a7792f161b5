"""Minimax contiguous partition of ordered, atomic groups into shards.

Groups (equal texts) stand in order of their first document. The shards are
contiguous runs of groups; the smallest feasible capacity is found by binary
search with a greedy check, and the cuts are set so that no shard exceeds it.

The greedy check needs the running totals at group ends, and there are as many
of those as groups. The driver holds a bounded number of them ("fences"): a
check over known fences alone proves a capacity feasible, and a check that
supposes a group end wherever one may be hidden proves one infeasible. The two
searches bracket the answer; one Spark pass then fetches finer fences only in
the stretches where a cut may fall, and this repeats until both searches agree.
Every round divides those stretches by ``FENCES`` and makes known at least one
hidden end, so it ends; even 10^12 groups take four or five rounds, and the
answer is exact.

Below the least capacity, cuts may still be chosen: each goes to the fence
nearest to an equal share of what is left, as long as the rest still fits.

Sizes are positive; a null text has size 1 and all null texts form one group.
An empty table gives no rows. Null doc_ids come first. Repeated rows belong to
one group and get a slot each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import cut, slim, total_prefix

FENCES = 4096


class Fences:
    """Known group ends; ``whole[i]``: no other end lies between i and i + 1."""

    def __init__(self, ends: list[int], whole: list[bool]):
        self.ends, self.whole = ends, whole

    def least(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy reach after each shard."""
        s, reach = 0, []
        for _ in range(shards):
            i = bisect_right(self.ends, s + capacity) - 1
            to = self.ends[i]
            if hopeful and i + 1 < len(self.ends) and not self.whole[i]:
                to = min(s + capacity, self.ends[i + 1] - 1)
            s = max(s, to)
            reach.append(s)
        return reach

    def search(self, shards: int, hopeful: bool) -> int:
        total = self.ends[-1]
        lo, hi = -(-total // shards), total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.least(mid, shards, hopeful)[-1] >= total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of all shards but the last, near equal within the capacity."""
        total, ends = self.ends[-1], self.ends
        latest = [total] * (shards + 1)
        for i in range(shards - 1, 0, -1):  # the rest from latest[i] on fits into shards - i shards
            latest[i] = ends[bisect_left(ends, max(0, latest[i + 1] - capacity))]
        s, out = 0, []
        for i in range(1, shards):
            aim = s + (total - s) / (shards - i + 1)
            j = bisect_left(ends, aim)
            near = [e for e in ends[max(0, j - 1):j + 1] if latest[i] <= e <= s + capacity]
            last = ends[bisect_right(ends, s + capacity) - 1]
            s = min(near, key=lambda e: (abs(e - aim), e)) if near else max(latest[i], min(last, aim))
            if not near and s not in (latest[i], last):
                s = ends[bisect_right(ends, s) - 1]
            out.append(s)
        return out


def _stretch(groups: DataFrame, stretches: list[tuple[int, int]], fences: int) -> list[tuple[int, bool]]:
    """For equal parts of each stretch (lo, hi], at most ``fences`` parts in
    all: the least and the largest end in the part, each with whether no other
    end lies between it and the one before."""
    each = max(2, fences // len(stretches))
    part = F.lit(None)
    for k, (lo, hi) in enumerate(stretches):
        n = min(each, hi - lo)
        inside = (F.col("upto") > lo) & (F.col("upto") <= hi)
        at = F.floor((F.col("upto") - 1 - lo).cast("decimal(38,0)") * n / F.lit(hi - lo).cast("decimal(38,0)"))
        part = F.when(inside, F.lit(k * each) + at.cast("long")).otherwise(part)
    rows = groups.select(part.alias("part"), "upto").filter("part is not null").groupBy("part").agg(F.min("upto").alias("a"), F.max("upto").alias("e"), F.count("*").alias("n")).collect()
    return sorted([(r["a"], True) for r in rows] + [(r["e"], r["n"] == 2) for r in rows if r["n"] > 1])


def least_capacity(groups: DataFrame, shards: int, fences: int = FENCES) -> tuple[int, list[int]]:
    """Least capacity and the cuts for ``groups`` with running totals ``upto``."""
    total = groups.agg(F.max("upto")).first()[0]
    if total is None:
        return 0, [0] * (shards - 1)
    ends = [(0, True)]  # (end, no hidden end since the one before)
    ends += _stretch(groups, [(0, total)], fences)
    while True:
        known = Fences([e for e, _ in ends], [w for _, w in ends[1:]] + [True])
        low, high = known.search(shards, True), known.search(shards, False)
        if low == high:
            return high, known.cuts(high, shards)
        unsure = set()
        for a, b in zip(known.least(low, shards, False), known.least(high, shards, True)):
            i = bisect_right(known.ends, a) - 1
            while i + 1 < len(known.ends) and known.ends[i] <= b:
                if not known.whole[i]:
                    unsure.add(i)
                i += 1
        stretches: list[list[int]] = []
        for i in sorted(unsure):
            lo, hi = known.ends[i], known.ends[i + 1]
            if stretches and stretches[-1][1] == lo:
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
        gone = {known.ends[i + 1] for i in unsure}
        finer = _stretch(groups, [tuple(x) for x in stretches], fences)
        ends = sorted([x for x in ends if x[0] not in gone] + finer)


def shard_documents(docs: DataFrame, shards: int = 8, fences: int = FENCES) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, group_bytes)``: every row of
    ``docs`` in one of ``shards`` contiguous shards; size is the UTF-8 bytes of
    the text plus 1, slot is gapless from 0 in a shard."""
    text = F.col("text")
    rows = cut(slim(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.md5(text), F.lit("")).alias("group"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32")))
    groups = cut(rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("group_bytes")))
    placed = cut(total_prefix(groups, ["first", "group"], "group_bytes", ["group", "group_bytes"]))
    capacity, cuts = least_capacity(placed, shards, fences)
    shard = sum((F.when(F.col("before") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = cut(rows.join(placed, "group").select("doc_id", "size", "text_crc32", "before", "group_bytes", shard.cast("int").alias("shard"), F.lit(1).alias("one")))
    count = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    starts = [sum(count.get(i, 0) for i in range(s)) for s in range(shards)]
    ranked = total_prefix(dealt, ["before", "doc_id"], "one", ["doc_id", "size", "text_crc32", "shard", "group_bytes"]).withColumnRenamed("before", "number")
    slot = F.col("number") - F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
    return ranked.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "group_bytes")
