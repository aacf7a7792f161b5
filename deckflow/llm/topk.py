"""Exact top-k inner products by block-at-a-time pruning.

Rows are cut into blocks of ``BLOCK`` rows in order of their id. A block keeps
a forward index (its rows' whole-number components) and, for each component
("term"), the largest and the least value. For a query q the summed term maxima
``sum_t max(q_t * hi_t, q_t * lo_t)`` bound the score of every row in the
block. Per query, blocks are taken in falling order of their bound and scored
through the forward index until the next bound is below the k-th best score
(an equal bound is still scored: ties go to the smaller id).

Blocks are dealt into groups of ``GROUP`` blocks. A task holds one group and
streams the packed queries past it, so memory is bounded by the two sizes.
Each query leaves k rows per group and the groups' lists are merged. The pairs
of query packs and block groups are the stated query set against all rows, in
blocks.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors are zero beyond their end. Rows repeated under one id are
different candidates; a query leaves out only its own row. Scores are exact
64-bit integers. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import cut, slim, small_batches

BLOCK, GROUP, PACK = 256, 256, 256


def _dot(rows, q):
    """Exact products: by BLAS where every partial sum is a whole number below 2^53."""
    import numpy as np
    if not rows.size or not q.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(q).max()) * len(q) < 2**53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return rows @ q


class Block:
    def __init__(self, part: int, number: int, ids: bytes, dim: int, rows: bytes):
        import numpy as np
        self.part, self.number = part, number
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(rows, np.int32 if len(rows) == 4 * dim * len(self.ids) else np.int64).reshape(len(self.ids), dim)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = slim(vectors, vec_id="vec_id", v="embedding").filter(ok)
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def build_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(part, number, n, dim, ids, rows)``; ids and rows are packed arrays."""
    small_batches(vectors.sparkSession, 2000)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part, number, held = TaskContext.get().partitionId(), 0, []

        def pack(rows):
            dim = max(len(v) for _, v in rows)
            m = np.zeros((len(rows), dim), np.int64)
            for i, (_, v) in enumerate(rows):
                m[i, :len(v)] = v
            m = m.astype(np.int32) if np.abs(m).max(initial=0) < 2**31 else m
            return {"part": part, "number": number, "n": len(rows), "dim": dim, "ids": np.array([i for i, _ in rows], np.int64).tobytes(), "rows": m.tobytes()}

        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])
        for b in batches:
            held += list(zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()))
            while len(held) >= block:
                yield pa.RecordBatch.from_pylist([pack(held[:block])], schema=schema)
                held, number = held[block:], number + 1
        if held:
            yield pa.RecordBatch.from_pylist([pack(held)], schema=schema)

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.filter("vec_id is not null").repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id", "v")
    return ordered.mapInArrow(run, "part int, number int, n int, dim int, ids binary, rows binary")


def query_packs(blocks: DataFrame, every: int, pack: int = PACK) -> DataFrame:
    """Rows whose id is divisible by ``every``, packed for the search."""
    def pick(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("place", pa.int32()), ("vec_id", pa.int64()), ("v", pa.binary())])
        for b in batches:
            for r in b.to_pylist():
                x = Block(r["part"], r["number"], r["ids"], r["dim"], r["rows"])
                at = np.flatnonzero(x.ids % every == 0)
                yield pa.RecordBatch.from_pylist([{"part": x.part, "number": x.number, "place": int(i), "vec_id": int(x.ids[i]), "v": x.rows[i].astype(np.int64).tobytes()} for i in at], schema=schema)

    queries = cut(blocks.mapInArrow(pick, "part int, number int, place int, vec_id long, v binary"))
    packs = max(1, -(-queries.count() // pack))
    own = F.pmod(F.xxhash64("part", "number", "place"), F.lit(packs)).alias("pack")
    return cut(queries.groupBy(own).agg(F.collect_list(F.struct("part", "number", "place", "vec_id", "v")).alias("queries")))


def _search(block_list: list[Block], queries: list[dict], k: int):
    """Per query its best k rows among the blocks."""
    import numpy as np
    dim = max(b.rows.shape[1] for b in block_list)
    hi, lo = (np.zeros((len(block_list), dim)) for _ in range(2))
    for i, b in enumerate(block_list):
        hi[i, :b.rows.shape[1]], lo[i, :b.rows.shape[1]] = b.rows.max(0), b.rows.min(0)
    out = []
    for q in queries:
        v = np.frombuffer(q["v"], np.int64)
        w = v[:dim].astype(np.float64)
        up, down = np.maximum(w, 0), np.minimum(w, 0)
        bound = hi[:, :len(w)] @ up + lo[:, :len(w)] @ down
        bound += np.abs(bound) * 1e-9  # covers the rounding of very large sums
        best: list[tuple] = []
        for i in np.argsort(-bound, kind="stable"):
            if len(best) == k and bound[i] < -best[-1][0]:
                break
            b = block_list[i]
            width = min(len(v), b.rows.shape[1])
            score = _dot(b.rows[:, :width], v[:width])
            at = np.arange(len(score))
            if (b.part, b.number) == (q["part"], q["number"]):
                at = np.delete(at, q["place"])
            if len(best) == k:
                at = at[score[at] >= -best[-1][0]]
            if len(at) > k:
                at = at[np.lexsort((at, b.ids[at], -score[at]))[:k]]
            best = sorted(best + [(-int(score[j]), int(b.ids[j]), b.part, b.number, int(j)) for j in at])[:k]
        out += [(q["part"], q["number"], q["place"], q["vec_id"], -s, i, p, n, j) for s, i, p, n, j in best]
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of every query."""
    spark = vectors.sparkSession
    blocks = cut(build_blocks(quantized(vectors), block))
    groups = max(1, -(-blocks.count() // group))
    packs = query_packs(blocks, every)
    small_batches(spark, 8)
    blank = F.lit(None)
    left = blocks.select(F.pmod(F.xxhash64("part", "number"), F.lit(groups)).alias("grp"), F.struct("part", "number", "dim", "ids", "rows").alias("block"), blank.cast(packs.schema["queries"].dataType).alias("queries"))
    right = packs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), blank.cast(left.schema["block"].dataType).alias("block"), "queries")
    names = ["qpart", "qnumber", "qplace", "query_id", "score", "vec_id", "part", "number", "place"]

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([(n, pa.int64()) for n in names])
        grp, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["grp"] != grp:
                    grp, held = r["grp"], []
                if r["block"]:
                    x = r["block"]
                    held.append(Block(x["part"], x["number"], x["ids"], x["dim"], x["rows"]))
                elif held and (found := _search(held, r["queries"], k)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    n = min(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = left.union(right).repartition(n, "grp").sortWithinPartitions("grp", F.col("block").isNull())
    found = cut(dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names)))
    w = Window.partitionBy("qpart", "qnumber", "qplace").orderBy(F.desc("score"), "vec_id", "part", "number", "place")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
