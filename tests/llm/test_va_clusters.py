"""Centroid clustering against plain rounds over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from citegrain.llm import va_clusters

ROW = "id string, v array<double>, cluster int"


def brute(rows, dims, k, rounds, scale=256):
    kept = [(i, [math.floor(min(max(scale * x, -va_clusters.LIMIT), va_clusters.LIMIT)) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((str(i), c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in out), key=repr)


def got(df):
    return sorted(((str(r["id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


def vectors(seed, n, dims, groups=6):
    r = random.Random(seed)
    middles = [[r.uniform(-2, 2) for _ in range(dims)] for _ in range(groups)]
    return [(f"v{i}", [x + r.gauss(0, 0.2) for x in middles[i % groups]], 9) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_any_number_of_bits(spark, bits):
    rows = vectors(1, 300, 5)
    df = va_clusters.clustered(spark.createDataFrame(rows, ROW), "id", "v", dims=5, k=7, rounds=4, bits=bits)
    assert got(df) == brute(rows, 5, 7, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 0.125]
    rows = vectors(2, 40, 3) + [
        ("a", None, 1), ("b", [], 1), ("c", [1.0, 2.0], 1), ("d", [1.0, None, 2.0], 1), ("e", [1.0, nan, 2.0], 1), ("f", [inf, 0.0, 1.0], 1),
        (None, [1.0, 1.0, 1.0], 1), ("big", [1e300, -1e300, 0.0], 1), ("v0", [9.0, 9.0, 9.0], 1), ("v0", [9.0, 9.0, 9.0], 1),
    ] + [(f"s{i}", same, 1) for i in range(60)]
    df = va_clusters.clustered(spark.createDataFrame(rows, ROW), "id", "v", dims=3, k=9, rounds=3)
    assert got(df) == brute(rows, 3, 9, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3, 4, 2)
    df = va_clusters.clustered(spark.createDataFrame(rows, ROW), "id", "v", dims=2, k=40, rounds=2)
    assert got(df) == brute(rows, 2, 40, 2)
    none = va_clusters.clustered(spark.createDataFrame([("a", None, 1)], ROW), "id", "v", dims=2)
    assert none.count() == 0 and none.columns == df.columns


def test_full_vectors_are_fetched_only_where_intervals_overlap(spark):
    rows = vectors(4, 400, 8)
    df = va_clusters.clustered(spark.createDataFrame(rows, ROW), "id", "v", dims=8, k=3, rounds=3)
    assert 0 < df.filter("not fetched").count()
    assert df.filter("fetched").count() < 200
    more = va_clusters.clustered(spark.createDataFrame(rows, ROW), "id", "v", dims=8, k=3, rounds=3, bits=2)
    assert more.filter("fetched").count() > df.filter("fetched").count()


def test_intervals_hold_the_distance():
    r = np.random.default_rng(0)
    x, centroids = r.integers(-300, 300, (200, 4)), r.integers(-300, 300, (5, 4))
    edges = [np.array([-300, -50, 0, 80, 300])] * 4
    cells = np.stack([np.searchsorted(e, x[:, d], side="right") - 1 for d, e in enumerate(edges)], axis=1)
    length2 = (x**2).sum(axis=1)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    low, high = (length2[:, None] + sum(t[i][cells[:, d]] for d, t in enumerate(va_clusters._tables(centroids, edges))) for i in (0, 1))
    assert (low <= exact).all() and (exact <= high).all()
    cluster, distance, fetched = va_clusters.nearest(length2, cells, x, centroids, va_clusters._tables(centroids, edges))
    assert (cluster == exact.argmin(axis=1)).all() and fetched == (distance >= 0).sum()
