import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.llm import centroids


def brute_force(rows, how):
    """vec_id, v -> {vec_id: (cluster, distance, cluster_inertia, inertia, digest)}, with whole numbers of any size."""
    x = [(i, [int(np.floor(how.scale * float(e))) for e in v]) for i, v in rows]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"{how.salt}{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in first[: how.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(how.rounds):
        held = [[] for _ in points]
        for _, v in x:
            held[nearest(v)[1]].append(v)
        points = [[sum(c) // len(m) for c in zip(*m)] if m else p for m, p in zip(held, points)]
    near = [(i, *nearest(v)) for i, v in x]
    total = sum(d for _, d, _ in near)
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((i, c, d, sum(e for _, e, g in near if g == c), total, digest[c]) for i, d, c in near)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(3) for c in ("v", "cluster", "distance", "joined", "sums", "label")}
    )


@pytest.mark.parametrize("seed,spread", [(1, 0.02), (2, 1.0), (3, 20_000.0)])
def test_clusters_equal_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread * 10, (5, 4))
    rows = [(i, [float(np.float32(e)) for e in middles[i % 5] + rng.normal(0, spread, 4)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(5, rows[5][1])] * 3
    how = centroids.Clustering(k=12, size=4, rounds=4)
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows), how).collect())) == brute_force(rows, how)


def test_equal_distances_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(100)]
    how = centroids.Clustering(k=9, size=2, rounds=5, scale=2)
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows), how).collect())) == brute_force(rows, how)


def test_odd_vectors(spark):
    good = [(i, [0.5 * i, -1.25]) for i in range(4)]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [1.0, None]), (14, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (16, [1.0, 2.0, 3.0])]
    how = centroids.Clustering(k=6, size=2, rounds=2)
    got = centroids.clusters(frame(spark, good + bad + [(None, [7.0, 7.0])]), how).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 5
    assert centroids.clusters(frame(spark, bad), how).columns == centroids.clusters(frame(spark, good), how).columns
    assert centroids.clusters(frame(spark, bad), how).count() == 0


def test_one_centroid_and_distances_too_large(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    how = centroids.Clustering(k=1, size=2, rounds=2)
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows), how).collect())) == brute_force(rows, how)
    with pytest.raises(Exception, match="no longs"):
        centroids.clusters(frame(spark, [(1, [1e30, 0.0])]), how).collect()


def test_bounds_hold_and_few_centroids_are_looked_at():
    """Every bound stays true while centroids move, and the ball spares most distances."""
    rng = np.random.default_rng(4)
    v = (rng.integers(0, 20, (4000, 1)) * 1000 + rng.integers(-200, 200, (4000, 8))).astype(np.int64)
    points = v[rng.choice(4000, 40, replace=False)]
    now = centroids.Centroids(points)
    cluster, least, second = now.nearest(v, np.arange(4000), np.arange(40))
    above, below = np.sqrt(least.astype(float)) * (1 + 1e-9), second * (1 - 1e-9)
    looked = 0
    for _ in range(6):
        before = now.points
        after = np.array([v[cluster == c].mean(axis=0) if (cluster == c).any() else before[c] for c in range(40)]).astype(np.int64)
        now = centroids.Centroids(after, before)
        looked += now.assign(v, cluster, above, below)
        d = centroids.squared(v, after)
        assert (cluster == d.argmin(axis=1)).all()
        roots = np.sqrt(d.astype(float))
        own = np.take_along_axis(roots, cluster[:, None], axis=1)[:, 0]
        np.put_along_axis(roots, cluster[:, None], np.inf, axis=1)
        assert (above >= own).all() and (below <= roots.min(axis=1)).all()
    assert looked < 6 * 4000 * 40 / 5
