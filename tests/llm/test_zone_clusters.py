import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcast.llm.zone_clusters import candidates, cluster_vectors, hilbert_keys, nearest, whole_vectors, zone_blocks


def plain(rows, dims, k, rounds, scale=256, seed=2):
    """Every vector against every centroid, in whole numbers without bounds."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def closest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[::-1]

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(closest(v)[0], []).append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else centroids[n] for n in range(len(centroids))]
    found = [(i, *closest(v)) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    return sorted(((i, n, d, inertia[n], sum(inertia.values())) for i, n, d in found), key=str), centroids


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("mine") for c in ("id", "v", "key", "tie", "cluster", "ids", "total")}).repartition(3)


def result(found):
    return sorted((tuple(r) for r in found.members.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia").collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_equals_plain_k_means(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(8, 5)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + rng.normal(size=5) * 0.3)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(2000, None), (2001, [1.0] * 4), (2002, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(2003, [float("nan")] * 5), (2004, [float("inf")] + [0.0] * 4), (None, rows[5][1]), rows[7], (2005, [0.0] * 5)]
    found = cluster_vectors(vectors(spark, rows), dims=5, k=9, rounds=3, block=block)
    expected, centroids = plain(rows, 5, 9, 3)
    assert result(found) == expected and found.centroids.tolist() == centroids
    assert found.centroid_digests()[0] == hashlib.sha256(",".join(map(str, centroids[0])).encode()).hexdigest()


def test_ties_few_vectors_and_empty_tables(spark):
    rows = [(i, [float(i % 2), 0.0, -1.5]) for i in range(6)]
    found = cluster_vectors(vectors(spark, rows), dims=3, k=40, rounds=2)
    assert result(found) == plain(rows, 3, 40, 2)[0]
    for empty in ([], [(1, None)], [(None, [1.0, 2.0, 3.0])]):
        none = cluster_vectors(vectors(spark, empty), dims=3)
        assert none.members.count() == 0 and none.centroid_digests() == []
        assert none.members.columns == found.members.columns


def test_negative_means_are_floored_and_large_components_left_out(spark):
    rows = [(1, [-0.01, 0.0]), (2, [-0.5, 0.3]), (3, [3e38, 0.0]), (4, [100000.0, -100000.0])]
    found = cluster_vectors(vectors(spark, rows), dims=2, k=1, rounds=1)
    assert [r[0] for r in result(found)] == [1, 2, 4]
    assert result(found) == plain([r for r in rows if r[0] != 3], 2, 1, 1)[0]


def test_the_curve_visits_every_cell_in_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_candidates_hold_the_nearest_of_every_point():
    rng = np.random.default_rng(3)
    pruned = 0
    for _ in range(300):
        v = rng.integers(-20, 20, (12, 3)) // rng.integers(1, 8)
        centroids = rng.integers(-20, 20, (9, 3))
        numbers = candidates(v.min(axis=0), v.max(axis=0), centroids)
        pruned += len(numbers) < 9
        every = nearest(v, centroids, np.arange(9))
        some = nearest(v, centroids, numbers)
        assert (every[0] == some[0]).all() and (every[1] == some[1]).all()
    assert pruned > 100


def test_blocks_are_narrower_than_the_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 4)]) for i in range(2000)]
    whole = whole_vectors(vectors(spark, rows), "vec_id", "embedding", 4, 256)
    sizes = []
    for r in zone_blocks(whole, 4, 50).collect():
        low, high = (np.frombuffer(r[c], np.int64) for c in ("low", "high"))
        sizes.append((len(r["ids"]), np.prod((high - low) / 512)))
    assert sum(n for n, _ in sizes) == 2000 and np.median([s for _, s in sizes]) < 0.2
