"""Mixing sources to target weights by hierarchical budgeting.

Leaves are paths through a tree (domain, language, source). The total is split
from the root down: at every node the children share the node's budget by their
weights, no child beyond what its subtree can give (tokens times the most
epochs). What a child can't take goes to its siblings in the same proportion;
only when all siblings are full does the shortage show at the node itself,
which then is full and whose share the ancestor deals to *its* siblings. So
shortages move among siblings before they move among ancestors.

Budgets are whole tokens. Children in order of capacity per weight fill up
first, so the full ones are a prefix and the split has a closed form; the rest
is rounded so that the shares add up to the node's budget exactly.

A leaf with budget b and s tokens takes ``b div s`` whole epochs and, of the next epoch,
the longest prefix of documents whose tokens fit into ``b mod s``. An epoch
orders documents by md5(seed:epoch:doc_id); documents of equal order enter
together. The prefix is found without ordering a leaf: tokens are summed over
4096 buckets of the md5 value, the bucket in which the budget ends is summed
again over 4096 finer ones, and only the documents of that finest bucket (a
16-millionth of the leaf) are put in order. What remains per leaf is one
boundary, so documents are chosen by a comparison where they lie.

Everything is DataFrame expressions. Tokens are white-space separated words of
the whole text; a null text has none. Null path values are a branch of their
own, with the weight the weight rule gives to null. Repeated rows count each
time; rows with a null doc_id share one place in the order. An empty table
gives no rows; a leaf without tokens keeps its (empty) documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _match(a: DataFrame, b: DataFrame, path: list[str]) -> Column:
    """Null-safe equality of ``a``'s path with ``b``'s, whose names start with ``_``."""
    on = a[path[0]].eqNullSafe(b[f"_{path[0]}"])
    for c in path[1:]:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def _side(df: DataFrame, path: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") if c in path else F.col(c) for c in df.columns])


def split_budgets(leaves: DataFrame, path: list[str], weights: list[Column], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``(path.., budget)`` for ``leaves(path.., tokens)``, one row per leaf.

    ``path[0]`` is the root (one value). ``weights[i]`` is the weight of a node
    of level i + 1 among its siblings, an expression over the path down to it,
    a positive whole number. The total is ``share`` of all tokens, at most what
    all leaves can give."""
    tree = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(BIG))
    nodes = tree.groupBy(path[0]).agg(F.least(F.sum("cap").cast(BIG), F.expr(f"cast(sum(tokens) * {share[0]} as {BIG}) div {share[1]}").cast(BIG)).alias("budget"))
    none = F.lit(0).cast(BIG)
    for depth in range(2, len(path) + 1):
        here, above = path[:depth], path[:depth - 1]
        kids = tree.groupBy(*here).agg(F.sum("cap").cast(BIG).alias("c")).withColumn("w", weights[depth - 2].cast(BIG))
        up = _side(nodes, above)
        kids = kids.join(up, _match(kids, up, above)).drop(*[f"_{c}" for c in above])
        by = Window.partitionBy(*above)
        order = by.orderBy(F.col("c").cast("double") / F.col("w").cast("double"), F.col(here[-1]).asc_nulls_first())
        before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
        left_w = (F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), none)).cast(BIG)
        left_b = (F.col("budget") - F.coalesce(F.sum("c").over(before), none)).cast(BIG)
        kids = kids.withColumn("left_w", left_w).withColumn("left_b", left_b)
        kids = kids.withColumn("full", F.min((F.col("c") * F.col("left_w")).cast(BIG) <= (F.col("w") * F.col("left_b")).cast(BIG)).over(upto))
        open_w, full_c = F.when(F.col("full"), none).otherwise(F.col("w")), F.when(F.col("full"), F.col("c")).otherwise(none)
        kids = (kids.withColumn("sum_w", F.sum(open_w).over(by).cast(BIG)).withColumn("upto_w", F.sum(open_w).over(upto).cast(BIG))
                .withColumn("rest", (F.col("budget") - F.sum(full_c).over(by)).cast(BIG)))
        part = F.expr(f"cast(rest * upto_w as {BIG}) div sum_w - cast(rest * (upto_w - w) as {BIG}) div sum_w")
        nodes = kids.select(*here, F.when(F.col("full"), F.col("c")).otherwise(part.cast(BIG)).alias("budget"))
    return nodes.withColumn("budget", F.col("budget").cast("long"))


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(rows: DataFrame, path: list[str], weights: list[Column], share: tuple[int, int], max_epochs: int, seed: str) -> DataFrame:
    """One row per leaf of ``rows(doc_id, path.., n)``: ``path.., tokens,
    budget, whole, rest, bound``. Documents whose order key in epoch number
    ``whole`` is at most ``bound`` enter that epoch."""
    leaves = cut(rows.groupBy(*path).agg(F.sum("n").alias("tokens")))
    budgets = _side(split_budgets(leaves, path, weights, share, max_epochs), path)
    some = F.col("tokens") > 0
    leaves = cut(leaves.join(budgets, _match(leaves, budgets, path)).select(
        *path, "tokens", "budget", F.when(some, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.when(some, F.expr("budget % nullif(tokens, 0)")).otherwise(F.lit(0)).cast("long").alias("rest")))
    side = _side(leaves, path)
    keyed = rows.join(side, _match(rows, side, path)).select(*path, "n", "rest", order_key(seed, F.col("whole"), F.col("doc_id")).alias("key"))
    level, prefix = cut(keyed), None
    for digits in (3, 6):  # 4096 buckets, then 4096 within the one where the budget ends
        w = Window.partitionBy(*path).orderBy("at")
        sums = level.groupBy(*path, "rest", F.substring("key", 1, digits).alias("at")).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        edge = sums.filter("upto > rest").groupBy(*path).agg(F.min(F.struct("at", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("x"))
        prefix = cut(edge.select(*path, F.col("x.at").alias("at"), F.col("x.rest").alias("left")))
        side = _side(prefix, path)
        level = cut(level.withColumn("pre", F.substring("key", 1, digits)).join(side, _match(level, side, path) & (F.col("pre") == side["at"])).select(*path, "n", F.col("left").alias("rest"), "key"))
    w = Window.partitionBy(*path).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = _side(level.withColumn("upto", F.sum("n").over(w)).filter("upto <= rest").groupBy(*path).agg(F.max("key").alias("last")), path)
    # none of the finest bucket fits: its own prefix, which no key equals, is the bound
    edge = _side(prefix.join(fits, _match(prefix, fits, path), "left").select(*path, F.coalesce("last", "at").alias("edge")), path)
    return cut(leaves.join(edge, _match(leaves, edge, path), "left").select(*path, "tokens", "budget", "whole", "rest", F.coalesce("edge", F.lit("g")).alias("bound")))


def mix(docs: DataFrame, levels: list[Column], weights: list[Column], share: tuple[int, int] = (1, 1), max_epochs: int = 3, seed: str = "0") -> DataFrame:
    """``(doc, levels.., n_tokens, budget, epoch)``: a row for every epoch that
    a document enters. ``doc`` holds the document's columns as one struct, so
    none of them can clash; levels are named l1, l2, ..; weights are
    expressions over those names."""
    path = ["root", *[f"l{i}" for i in range(1, len(levels) + 1)]]
    placed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"], *[c.alias(p) for c, p in zip(levels, path[1:])], n_tokens(docs["text"]).alias("n")).withColumn("root", F.lit(0))
    chosen = _side(plan(cut(placed.select("doc_id", *path, "n")), path, weights, share, max_epochs, seed), path)
    key = order_key(seed, F.col("whole"), F.col("doc_id"))
    last = F.when(key <= F.col("bound"), F.array(F.col("whole"))).otherwise(F.array().cast("array<bigint>"))
    before = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    taken = placed.join(chosen, _match(placed, chosen, path)).withColumn("epoch", F.explode(F.concat(before, last)))
    return taken.select("doc", *path[1:], F.col("n").alias("n_tokens"), "budget", F.col("epoch").cast("int").alias("epoch"))
