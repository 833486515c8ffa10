"""Centroid clustering against plain rounds over all distances, and the bounds' geometry."""

import hashlib
import math

import numpy as np
import pytest

from statweave.llm import centroid_clusters as cc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters, rounds, dimensions):
    """Assignments by scanning everything, in Python's whole numbers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e, _ in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for turn in range(rounds + 1):
        found = [(i, nearest(v)) for i, v in kept]
        if turn < rounds:
            groups = {}
            for (_, v), (_, (_, k)) in zip(kept, found, strict=True):
                groups.setdefault(k, []).append(v)
            centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    return sorted(((i, k, d) for i, (d, k) in found), key=str), centroids


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (9, 8))
    out = [(i, [float(x) for x in centres[i % 9] + rng.normal(0, 0.06, 8)], i) for i in range(700)]
    out += [(1000 + i, out[5][1], 0) for i in range(300)]  # a hot vector
    out += [(2000, None, 0), (2001, [0.1] * 7, 0), (2002, [float("nan")] * 8, 0), (2003, [float("inf")] + [0.0] * 7, 0), (2004, [None] + [0.0] * 7, 0), (2005, [], 0)]
    out += [(3, out[3][1], 9), (3, out[3][1], 9), (None, [0.25] * 8, 0), (None, [-0.25] * 8, None)]
    out += [(4000 + i, [0.5 if j == i else 0.0 for j in range(8)], 0) for i in range(8)]  # ties
    return out


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (5, 6), (1, 2), (5000, 1)])
def test_agrees_with_a_full_scan(spark, rows, clusters, rounds):
    report = []
    assigned, centroids = cc.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), clusters, rounds, dimensions=8, report=report)
    wanted, final = brute(rows, clusters, rounds, 8)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in assigned.collect()), key=str) == wanted
    assert centroids.tolist() == final
    assert len(report) == rounds + 1 and report[0] == len(wanted)
    if clusters == 5:
        assert report[-1] < 0.5 * len(wanted)  # most vectors keep their cluster without a scan


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-(2**20), 2**20, 4)], 0) for i in range(200)]
    assigned, _ = cc.cluster(spark.createDataFrame(rows, SCHEMA), 6, 3, dimensions=4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in assigned.collect()), key=str) == brute(rows, 6, 3, 4)[0]
    with pytest.raises(Exception, match="beyond"):
        cc.cluster(spark.createDataFrame([(1, [3e37] * 4, 0)], SCHEMA), 6, 3, dimensions=4)


def test_loosening_covers_every_point_and_is_less_than_the_drift():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(60):
        d, k = int(rng.integers(2, 6)), 5
        old = rng.integers(-60, 60, (k, d))
        new = old + rng.integers(-25, 25, (k, d)) * rng.integers(0, 2, (k, 1))
        radius = rng.uniform(0, 50, k)
        loose = cc.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            others = [j for j in range(k) if j != i]
            steps = rng.normal(size=(4000, d))
            steps *= (radius[i] * rng.uniform(0.5, 1, 4000) ** 0.2 / np.sqrt((steps**2).sum(1)))[:, None]
            points = old[i] + steps
            closer = max((np.sqrt(((points - old[j]) ** 2).sum(1)) - np.sqrt(((points - new[j]) ** 2).sum(1))).max() for j in others)
            assert closer <= loose[i] + 1e-9
            assert loose[i] <= max(drift[j] for j in others) * (1 + 1e-8)
            tighter += loose[i] < 0.95 * max(drift[j] for j in others)
    assert tighter > 50


def test_empty_tables_and_clashing_columns(spark, rows):
    for nothing in ([], [(1, None, 0), (2, [1.0], 0)]):
        assigned, centroids = cc.cluster(spark.createDataFrame(nothing, SCHEMA))
        assert assigned.collect() == [] and len(centroids) == 0
        assert cc.summary(assigned, centroids).collect() == []
    clash = spark.createDataFrame([(i, e, 7, [1], 2.0) for i, e, _ in rows], "vec_id long, embedding array<float>, cluster int, v array<int>, lower double")
    assigned, centroids = cc.cluster(clash, 5, 2, dimensions=8)
    out = cc.summary(assigned, centroids).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == brute(rows, 5, 2, 8)[0]
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    assert all(r.centroid_sha256 == cc.digest(centroids[r.cluster]) for r in out)
