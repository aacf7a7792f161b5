"""Operator 13 against brute force."""

import hashlib
import math

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, v binary, cluster int, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, 99, "x") for i, v in rows], SCHEMA)


def naive(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                cents[j] = [sum(col) // len(members) for col in zip(*members)]
    return cents, sorted(((i is None, i or 0), *reversed(near(v))) for i, v in kept)


def check(spark, rows, k=8, rounds=10, dim=6, scale=64):
    from deckflow.llm.clusters import cluster, with_inertia
    found = cluster(table(spark, rows), k, rounds, dim, scale, "3")
    cents, want = naive(rows, k, rounds, dim, scale, "3")
    got = with_inertia(found).collect()
    assert [list(map(int, c)) for c in found.centroids] == cents
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} <= {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
    return found


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 6)) * 3
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(size=6) * 0.4]) for i in range(600)]
    found = check(spark, rows)
    assert sum(found.scanned[1:]) < 0.6 * 600 * 10  # the bounds spare most scans


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0, 0.0, 2.0, -3.0]
    rows = [(1, v), (1, v), (2, v), (None, [9.0] * 6), (3, None), (4, v[:5]), (5, [None, *v[1:]]), (6, [float("nan"), *v[1:]]), (7, [float("inf"), *v[1:]]),
            (8, [-0.001] * 6), (9, []), (10, [30000.0] * 6)]
    check(spark, rows)  # fewer different vectors than clusters: equal centroids, ties to the smaller
    check(spark, rows[:1], k=8)


def test_no_vectors(spark):
    from deckflow.llm.clusters import cluster, with_inertia
    assert with_inertia(cluster(table(spark, []).limit(0), 8, 2, 6, 64, "3")).collect() == []


def test_loosening_bounds_every_point_of_the_sphere():
    from deckflow.llm.clusters import loosening
    rng = np.random.default_rng(2)
    less = 0
    for _ in range(400):
        dim = int(rng.integers(2, 6))
        c, p = rng.normal(size=(2, dim)) * 4
        q = p + rng.normal(size=dim) * rng.choice([0.01, 0.3, 3])
        radius = float(rng.choice([0.0, 0.1, 1, 4]))
        x = rng.normal(size=(500, dim))
        x = c + radius * rng.random((500, 1)) ** 0.3 * x / np.linalg.norm(x, axis=1, keepdims=True)
        worst = (np.linalg.norm(x - p, axis=1) - np.linalg.norm(x - q, axis=1)).max()
        bound, drift = loosening(c, radius, p, q), np.linalg.norm(q - p)
        assert worst <= bound + 1e-9
        assert bound <= drift * (1 + 1e-8)
        less += bound < 0.9 * drift
    assert less > 200
