"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from logloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, dim, seed=2, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        for c, vs in of.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), means


def check(spark, rows, k=5, rounds=3, dim=4):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got, means = centroids.cluster(df, "vec_id", "embedding", k=k, rounds=rounds, dim=dim)
    want, plain_means = plain(rows, k, rounds, dim)
    fit = [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(fit, key=repr)
    assert means == plain_means
    return got, means


def test_equals_plain_integers(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += rows[:20] + [(None, rows[0][1]), (None, None), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [math.nan, 0, 0, 0]), (505, [math.inf, 0, 0, 0]), (506, [-0.0] * 4)]
    check(spark, [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows])


def test_ties_go_to_the_lower_number(spark):
    """Vectors of a small grid: most have several nearest centroids, and copies make equal centroids."""
    r = random.Random(5)
    rows = [(i, [r.randrange(3) / 256 for _ in range(4)]) for i in range(200)] + [(1000 + i, [0.0] * 4) for i in range(30)]
    check(spark, rows, k=12)


@pytest.mark.parametrize("size", [1e5, 1e12, 1e20, 3e38])
def test_any_finite_size(spark, size):
    """Beyond 64 bits everything stays exact; a distance that no long holds is null."""
    r = random.Random(7)
    rows = [(i, [float(np.float32(r.uniform(-size, size))) for _ in range(4)]) for i in range(40)] + [(100 + i, [r.random() for _ in range(4)]) for i in range(20)]
    got, means = check(spark, rows, k=6, rounds=2)
    out = centroids.with_inertia(got, means).collect()
    assert len(out) == 60
    if size == 1e5:
        assert out[0]["inertia"] == sum(x["distance"] for x in out)
    else:
        assert {x["inertia"] for x in out} == {None} or size == 1e12


def test_few_or_no_vectors(spark):
    got, means = check(spark, [(1, [0.5] * 4), (1, [0.25] * 4)], k=5)
    assert len(means) == 2
    none = spark.createDataFrame([], SCHEMA)
    got, means = centroids.cluster(none, "vec_id", "embedding")
    assert means == [] and centroids.with_inertia(got, means).collect() == []


def test_intervals_hold_and_screen_decides_most():
    """The exact value lies in each interval, cancellation included, and few vectors are left open."""
    r = np.random.default_rng(11)
    for scale in (1, 300, 1e6, 1e9):
        means = [[int(v) for v in row] for row in np.floor(r.normal(0, scale, (40, 64)))]
        x = np.concatenate([np.floor(r.normal(0, scale, (200, 64))), np.array(means, float) + r.integers(-1, 2, (40, 64))])
        s = centroids.Screen(means)
        low, high = s.intervals(x)
        for i, row in enumerate(x):
            v = [int(a) for a in row]
            for c, m in enumerate(means):
                exact = sum(b * b for b in m) - 2 * sum(a * b for a, b in zip(v, m, strict=True))
                assert low[i, c] <= exact <= high[i, c]
        if scale >= 300:
            assert s.nearest(x)[2] < 20


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 1.0, 2.0], 7, 8) for i in range(9)], "vec_id long, embedding array<float>, `_v` int, `cluster` int")
    got, _ = centroids.cluster(df, "vec_id", "embedding", k=2, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 9
