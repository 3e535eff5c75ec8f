import hashlib

import numpy as np
import pytest

from shardloom.llm import clustering
from shardloom.llm.clustering import clusters

from .helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, vec string, lower string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", "y") for i, v in vectors], SCHEMA)


def brute(vectors, k, rounds, dimension=64, scale=256, seed=2):
    """Every distance of every round, in whole numbers of Python."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in vectors if v is not None and len(v) == dimension and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in first[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia), digests[c]) for (i, _), (d, c) in zip(kept, near, strict=True)], key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(0, 0.2, (9, 64))
    vectors = [(k, (near[k % 9] + rng.normal(0, 0.05, 64)).tolist()) for k in range(300)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(40)]  # ties: copies take part in the first centroids
    vectors += [(7, vectors[3][1]), (7, vectors[3][1]), (None, vectors[5][1]), (2000, None), (2001, [0.5] * 63), (2002, []), (2003, [0.1] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64), (2007, [300.25] * 64)]
    df = table(spark, vectors)
    assert rows(clusters(df.repartition(5), k=12)) == brute(vectors, 12, 5)
    assert rows(clusters(df, k=12, rounds=0)) == brute(vectors, 12, 0)
    assert rows(clusters(df.limit(3), k=40, rounds=2)) == brute([tuple(r)[:2] for r in df.limit(3).collect()], 40, 2)
    assert clusters(table(spark, [])).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    grid = [(k, [float(x), float(y)]) for k, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))]
    got = rows(clusters(table(spark, grid), k=8, rounds=4, dimension=2, scale=2))
    assert got == brute(grid, 8, 4, 2, 2)


def test_bounds_skip_distances_and_hold():
    rng = np.random.default_rng(9)
    at = rng.integers(-3000, 3000, (20, 16))
    x = (at[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    c = (at + rng.integers(-60, 60, at.shape)).astype(np.int64)
    cluster, upper, lower, taken = clustering.nearest(x, c, np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 20), np.float32), clustering.between(c))
    d = clustering.squared(x[:, None], c[None])
    assert (cluster == d.argmin(axis=1)).all() and (upper**2 >= d.min(axis=1)).all() and (lower.astype(float) ** 2 <= d).all()
    moved = c + rng.integers(-5, 5, c.shape)
    went = clustering._up(np.sqrt(clustering.squared(c, moved).astype(float)))
    again, _, _, second = clustering.nearest(x, moved, cluster, clustering._up(upper + went[cluster]), clustering._down32(lower.astype(float) - went), clustering.between(moved))
    assert (again == clustering.squared(x[:, None], moved[None]).argmin(axis=1)).all()
    assert taken < 0.75 * d.size and second < 0.05 * d.size


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters(table(spark, [(1, [1e30] * 64)])).collect()
