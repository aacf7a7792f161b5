"""URL lists with dates: every capture against the entries active at its time.

A list is a log of dated entries: at a date, a list adds or removes a key. A
key is a host, matched with its subdomains (kind ``domain``) or alone (kind
``host``). Entries become validity intervals: an entry holds until the next
entry of the same list, kind and key; of entries of one date the one with the
largest ``seq`` holds (an equal ``seq``: the removal). Removals leave no interval.

Captures meet intervals in an as-of join. The names that a host can match are
its own and its parent domains, so first the *distinct* hosts are matched with
the keys, which leaves intervals per host. These are dealt to the months they
touch, and the distinct (host, day) of the captures join them on (host, month)
with ``start <= day < stop``, so a key with a long history is read a month at a
time. The answer for a (host, day) then joins all its captures; a host with a
third of them is reduced to its days before, and Spark can split the last join.

A capture is blocked if an entry of a ``block`` list is active and none of an
``allow`` list is, unless the block is more specific (its key is longer).

Defined results: a null or unusable URL has a null host and is not blocked; a
null time matches nothing; entries with a null list, key or date are ignored.
Repeated captures are each answered. Empty captures give no rows; without
entries nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import cut, slim

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
FOREVER = "9999-12-01"


def url_host(url: Column) -> Column:
    """Lower-case host without a final dot; null where there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(F.trim(url), HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, role, kind, key, start, stop)`` from entries ``(list, role,
    kind, key, action, day, seq)``."""
    e = entries.filter("list is not null and key is not null and day is not null and action is not null")
    e = e.withColumn("key", F.rtrim(F.lower(F.trim("key")), F.lit("."))).filter("key != ''")
    last = e.groupBy("list", "role", "kind", "key", "day").agg(F.max(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), (F.col("action") == "remove").alias("off"))).alias("x"))
    w = Window.partitionBy("list", "role", "kind", "key").orderBy("day")
    ran = last.withColumn("stop", F.coalesce(F.lead("day").over(w), F.lit(FOREVER).cast("date")))
    return ran.filter(~F.col("x.off")).select("list", "role", "kind", "key", F.col("day").alias("start"), "stop")


def host_intervals(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """``(key, host, list, role, kind, start, stop)`` for hosts that match a key."""
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = hosts.select("host", F.explode(names).alias("key"))
    return named.join(valid, "key").filter((F.col("kind") == "domain") | (F.col("host") == F.col("key")))


def by_month(met: DataFrame, first: Column, last: Column) -> DataFrame:
    """An interval's months, within the months that hold captures."""
    lo = F.greatest(F.trunc("start", "month"), first)
    hi = F.least(F.trunc(F.date_sub("stop", 1), "month"), last)
    return met.filter(lo <= hi).withColumn("month", F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(page_id, host, day, blocked, block_lists, allow_lists, evidence)``
    for ``captures(page_id, url, day)``; evidence is the deciding
    ``list:key@start`` (null without one)."""
    own = slim(captures, page_id="page_id", url="url", day="day")
    rows = cut(own.select("page_id", url_host(F.col("url")).alias("host"), F.col("day").cast("date").alias("day")).withColumn("month", F.trunc("day", "month")))
    span = rows.agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    hosts = rows.filter("host is not null").select("host").distinct()
    met = host_intervals(hosts, intervals(entries))
    months = by_month(met, F.lit(span["a"]).cast("date"), F.lit(span["b"]).cast("date"))
    one = F.struct(F.length("key").alias("n"), "role", "list", "key", "start")
    # for each capture the distinct answer depends on (host, day) alone
    days = rows.filter("host is not null and day is not null").select("host", "month", "day").distinct()
    hit = days.join(months, ["host", "month"]).filter("start <= day and day < stop")
    best = hit.groupBy("host", "day").agg(
        F.max(F.when(F.col("role") == "block", one)).alias("block"), F.max(F.when(F.col("role") == "allow", one)).alias("allow"),
        F.count_distinct(F.when(F.col("role") == "block", F.col("list"))).alias("block_lists"), F.count_distinct(F.when(F.col("role") == "allow", F.col("list"))).alias("allow_lists"))
    blocked = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("block.n") > F.col("allow.n")))
    decider = F.when(blocked, F.col("block")).otherwise(F.coalesce("allow", "block"))
    answer = best.select("host", "day", blocked.alias("b"), "block_lists", "allow_lists", F.concat(decider["list"], F.lit(":"), decider["key"], F.lit("@"), decider["start"].cast("string")).alias("evidence"))
    return rows.join(answer, ["host", "day"], "left").select(
        "page_id", "host", "day", F.coalesce("b", F.lit(False)).alias("blocked"), F.coalesce("block_lists", F.lit(0)).cast("long").alias("block_lists"),
        F.coalesce("allow_lists", F.lit(0)).cast("long").alias("allow_lists"), "evidence")
