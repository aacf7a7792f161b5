"""Centroid clustering by exact Lloyd rounds with geometric drift tightening.

Vectors are integers (``floor(scale * x)``), distances squared Euclidean and
exact, centroids ``floor(sum / count)`` per component. A vector carries its
cluster and a lower bound of its distance to every other centroid. When
centroids move, a bound needn't shrink by the centroid's whole drift: all
members of cluster j lie in a sphere round its old centroid, and for them the
distance to centroid i, moving from p to q, falls by at most

    max over the sphere of  d(x, p) - d(x, q).

That difference is constant on hyperbolas with the foci p and q, so the problem
is planar: the sphere is a disc in the half plane through p, q and its centre.
The hyperbola of difference t lies inside the cone of its asymptotes (apex
midway, half angle ``acos(t / drift)``), so a disc outside a cone has less;
for negative t the cone moved to the apex p lies inside the hyperbola, so a
disc inside it has less too (``loosening``). A vector whose own distance,
taken anew exactly, is below all its loosened bounds keeps its cluster; the
others are scanned against all centroids exactly.

One round is one pass over the written vectors, without a shuffle of them; what
meets on the driver is k x dimensions sums. Each round's table replaces the
last one, so a lost executor costs a round at most.

Taken are vectors of exactly ``dim`` components, none null or non-finite, also
those with a null ``vec_id`` (which can't start a centroid) and repeated rows.
With fewer than k usable starts there are fewer clusters; without any vector the
result is empty. Components beyond +-2**26 after scaling end the job with an
error, as their distances may not fit a long.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.llm.common import cut, drop, small_batches

STATE = "vec_id long, v binary, cluster int, distance long, bounds binary, part binary"
LARGEST = 2 ** 26
SAFE = 1e-9  # relative room for rounding in the bounds


def usable(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """``(vec_id, v)``: the integer vectors that take part."""
    x = F.col("embedding")
    ok = (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return (vectors.select("vec_id", "embedding").filter(x.isNotNull()).filter(ok)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")))


def starts(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id`` (rows of one
    id in the order of their components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in kept.filter("vec_id is not null").select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()]


def loosening(centre, radius: float, p, q) -> float:
    """Upper bound of ``d(x, p) - d(x, q)`` over the sphere round ``centre``."""
    import numpy as np
    drift = float(np.linalg.norm(q - p))
    if drift == 0.0:
        return 0.0
    axis = (q - p) / drift

    def angle(apex, direction):
        """Angle of the centre seen from the apex, and the disc's half angle."""
        to = centre - apex
        far = float(np.linalg.norm(to))
        if far <= radius * (1 + SAFE) or far == 0.0:
            return None, None
        along = float(to @ direction)
        across = math.sqrt(max(far * far - along * along, 0.0))
        return math.atan2(across, along), math.asin(min(1.0, radius / far))

    behind, spread = angle(p, -axis)
    if behind is not None and behind + spread < math.pi / 2 - 1e-6:
        return -drift * math.cos(behind + spread) + SAFE * drift
    ahead, spread = angle((p + q) / 2, axis)
    if ahead is None or ahead - spread <= 0:
        return drift
    return max(0.0, drift * math.cos(ahead - spread)) + SAFE * drift


def loosenings(old, new, radii):
    """Matrix [own cluster, other centroid] of what a bound loses in a round."""
    import numpy as np
    k = len(old)
    out = np.zeros((k, k))
    for j in range(k):
        for i in range(k):
            out[j, i] = 0.0 if i == j else loosening(old[j], radii[j], old[i], new[i])
    return out


def _distances(v, c):
    """Exact squared distances of all rows to one centroid."""
    import numpy as np
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _scan(v, centroids):
    """Nearest centroid of every row (ties: smaller number), its squared
    distance, and the distances to all."""
    import numpy as np
    all_d = np.stack([_distances(v, c) for c in centroids], axis=1)
    near = np.argmin(all_d, axis=1)
    return near, all_d[np.arange(len(v)), near], np.sqrt(all_d.astype(np.float64))


def _round(rows: DataFrame, centroids: list[list[int]], loss, dim: int) -> DataFrame:
    """One assignment of all rows: rows of kind ``part is null`` are vectors,
    one further row per cluster and task holds the sums of its members.
    Without ``loss`` every vector is scanned (the first round)."""
    k = len(centroids)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        c = np.array(centroids, np.int64).reshape(k, dim)
        sums, counts, farthest, scanned = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k, object), 0
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("bounds", pa.binary()), ("part", pa.binary())])

        def packed(a):
            width = a.shape[1] * a.itemsize
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())

        def fixed(column, dtype, width):
            return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if loss is None:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
                if v.max(initial=0) > LARGEST or v.min(initial=0) < -LARGEST:
                    raise ArithmeticError(f"a component is beyond +-{LARGEST} after scaling")
                near, dist, low = _scan(v, c)
                scanned += n
                stored = packed(v.astype(np.int32))
            else:
                stored = b.column("v")
                v = fixed(stored, np.int32, dim).astype(np.int64)
                near = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                low = fixed(b.column("bounds"), np.float64, k)
                low = low - loss[near] - SAFE * np.abs(low)
                d = v - c[near]
                dist = np.einsum("ij,ij->i", d, d)
                low[np.arange(n), near] = np.inf
                unsure = np.sqrt(dist.astype(np.float64)) * (1 + SAFE) >= low.min(axis=1) * (1 - SAFE)
                low[np.arange(n), near] = np.sqrt(dist.astype(np.float64))
                if unsure.any():
                    near, low = near.copy(), low.copy()
                    near[unsure], dist[unsure], low[unsure] = _scan(v[unsure], c)
                    scanned += int(unsure.sum())
            for j in np.unique(near):
                own = near == j
                sums[j] += v[own].sum(axis=0).astype(object)
                counts[j] += int(own.sum())
                farthest[j] = max(farthest[j], int(dist[own].max()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), stored, pa.array(near, pa.int32()), pa.array(dist, pa.int64()), packed(low), pa.nulls(n, pa.binary())], schema=schema)
        kept = [j for j in range(k) if counts[j]] or ([0] if scanned else [])
        if kept:
            yield pa.RecordBatch.from_arrays([
                pa.array([int(counts[j]) for j in kept], pa.int64()), pa.nulls(len(kept), pa.binary()), pa.array(kept, pa.int32()), pa.array([int(farthest[j]) for j in kept], pa.int64()),
                pa.array([int(scanned if j == kept[0] else 0).to_bytes(8, "little") for j in kept], pa.binary()), pa.array([np.array(sums[j], np.int64).tobytes() for j in kept], pa.binary())], schema=schema)

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, dim: int):
    """Per cluster: exact component sums, count and greatest distance; and how
    many vectors were scanned. Spark adds the tasks' parts; k x dim rows meet here."""
    import numpy as np
    parts = state.filter("part is not null").select("cluster", F.col("vec_id").alias("n"), "distance", "bounds", "part")

    def spread(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            comp = np.frombuffer(b"".join(b.column("part").to_pylist()), np.int64)
            scanned = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.int64)
            each = lambda a: pa.array(np.repeat(a, dim + 1))
            value = np.concatenate([comp.reshape(m, dim), b.column("n").to_numpy().reshape(m, 1)], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([each(b.column("cluster").to_numpy()), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), m)), pa.array(value), each(b.column("distance").to_numpy()),
                                              pa.array(np.where(np.tile(np.arange(dim + 1), m) == dim, np.repeat(scanned, dim + 1), 0))], names=["cluster", "at", "value", "far", "scanned"])

    got = (parts.mapInArrow(spread, "cluster int, at int, value long, far long, scanned long").groupBy("cluster", "at")
           .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.max("far").alias("far"), F.sum("scanned").alias("scanned")).collect())
    sums, counts, far, scanned = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k), 0
    for r in got:
        if r["at"] == dim:
            counts[r["cluster"]] = int(r["s"])
            far[r["cluster"]] = math.sqrt(r["far"]) * (1 + SAFE)
            scanned += r["scanned"]
        else:
            sums[r["cluster"]][r["at"]] = int(r["s"])
    return sums, counts, far, scanned


class Clusters:
    """Centroids, the written vectors with their cluster and distance, and how
    many of them each round scanned against all centroids."""

    def __init__(self, rows: DataFrame, centroids: list[list[int]], scanned: list[int]):
        self.rows, self.centroids, self.scanned = rows, centroids, scanned


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> Clusters:
    """Lloyd's rounds and one last assignment."""
    import numpy as np
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    kept = cut(usable(vectors, dim, scale))
    centroids = starts(kept, k, seed)
    k = len(centroids)
    if not k:
        if kept.limit(1).count():
            raise ValueError("no vector has an id to start a centroid with")
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    tasks = spark.sparkContext.defaultParallelism
    state = cut(_round(kept if kept.rdd.getNumPartitions() >= tasks else kept.repartition(tasks), centroids, None, dim))
    seen = []
    for _ in range(rounds):
        sums, counts, far, scanned = _sums(state, k, dim)
        seen.append(scanned)
        moved = [[int(s) // int(counts[j]) for s in sums[j]] if counts[j] else centroids[j] for j in range(k)]
        loss = loosenings(np.array(centroids, np.float64), np.array(moved, np.float64), far)
        before, state = state, cut(_round(state.filter("part is null"), moved, loss, dim))
        drop(before)
        centroids = moved
    seen.append(_sums(state, k, dim)[3])
    return Clusters(state.filter("part is null").select("vec_id", "cluster", "distance"), centroids, seen)


def with_inertia(found: Clusters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    rows = found.rows
    per = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def pick(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return rows.select("vec_id", "cluster", "distance", pick([per.get(j, 0) for j in range(len(digest))], "long").alias("cluster_inertia"),
                       F.lit(sum(per.values())).cast("long").alias("inertia"), pick(digest, "string").alias("centroid_sha256"))
