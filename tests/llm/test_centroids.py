"""Annulus search against comparing all: ties, equal norms, large numbers, odd rows; whole clusterings against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from marlstone import storage
from marlstone.llm import centroids


@pytest.mark.parametrize(("seed", "spread"), [(1, 3), (2, 400), (3, centroids.LIMIT)])
def test_assignment_equals_comparing_all(seed, spread):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread + 1, (500, 8)), rng.integers(-spread, spread + 1, (30, 8))
    c[3], c[7], c[9] = c[20], -c[20], 0  # the same, the same norm, the origin
    x[:30], x[30:40] = c, 0
    number, distance = centroids.Annulus(c).assign(x)
    for row, n, away in zip(x.tolist(), number.tolist(), distance.tolist(), strict=True):
        all_ = [sum((a - b) ** 2 for a, b in zip(row, other, strict=True)) for other in c.tolist()]
        assert (away, n) == (min(all_), all_.index(min(all_)))


def test_most_centroids_are_left_out_where_norms_differ():
    rng = np.random.default_rng(4)
    c = np.arange(1, 201)[:, None] * rng.integers(-9, 10, (200, 8))
    near = centroids.Annulus(c)
    x = c[rng.integers(0, 200, 300)] + rng.integers(-2, 3, (300, 8))
    number, distance = near.assign(x)
    norm, bound = np.sqrt((x**2).sum(1)), np.sqrt(distance)
    within = np.abs(near.norm[None, :] - norm[:, None]) <= bound[:, None] + 1e-6
    assert within.sum(1).mean() < 10
    assert all(within[i, list(near.order).index(n)] for i, n in enumerate(number))


def brute(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == d and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None)[:k]
    centers = [e for _, e in start]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, e in kept:
            groups.setdefault(nearest(e)[1], []).append(e)
        centers = [[sum(v) // len(groups[n]) for v in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    out = [(i, nearest(e)[1], nearest(e)[0]) for i, e in kept] if centers else []
    own = {}
    for _, n, away in out:
        own[n] = own.get(n, 0) + away
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(map(str, ((i, n, away, own[n], sum(own.values()), digest[n]) for i, n, away in out)))


def odd_rows(rng, n):
    rows = [(k, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for k in range(n)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.0] * 4)]
    return rows + [(3, [1.0, 1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0, 1.0]), (None, [0.5, 0.0, 0.0, -0.5])] + [(1000 + k, [0.25, 0.0, 0.0, 0.0]) for k in range(60)]


@pytest.mark.parametrize("n", [0, 5, 120])
def test_clusters_equal_brute_force(spark, n):
    rows = odd_rows(random.Random(n), n)
    table = spark.createDataFrame([(i, e, "x", 5) for i, e in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    got = centroids.cluster(table, k=9, rounds=3, dimensions=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 9, 3, 4)
    storage.sweep(spark)


def test_nothing_kept_and_bounds(spark):
    empty = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).count() == 0 and centroids.cluster(empty.limit(0)).columns[-1] == "centroid_sha256"
    with pytest.raises(ValueError):
        centroids.cluster(empty, k=1 << 20)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), dimensions=1).collect()
