import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterflow.llm import centroids as C

KIND = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    order = sorted(kept, key=lambda r: (*name(r[0]), r[1]))
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return [(i, v, near(v)[1], near(v)[0]) for i, v in kept], cents


def vectors(n, groups, spread, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, 64))
    return [(i, (middle[i % groups] + rng.normal(0, spread, 64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "groups", "spread"), [(400, 16, 0.05), (300, 5, 0.6), (9, 3, 0.2)])
def test_rounds_equal_plain_ones(spark, n, groups, spread):
    rows = vectors(n, groups, spread)
    rows += [rows[1]] * 30 + [(7, rows[2][1]), (None, rows[0][1]), (None, rows[3][1])]
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [float("nan")] + [0.0] * 63), (1005, [float("-inf")] + [0.0] * 63), (1006, [None] + [0.0] * 63)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    for c in ("cluster", "v", "lower", "distance", "label", "n"):
        df = df.withColumn(c, F.lit("x"))
    got = C.cluster(df).collect()
    want, cents = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.v, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    own = {}
    for _, _, c, d in want:
        own[c] = own.get(c, 0) + d
    assert all(r.cluster_inertia == own[r.cluster] and r.inertia == sum(own.values()) and r.centroid == cents[r.cluster] for r in got)


def test_bounds_spare_scans(spark):
    got = C.cluster(spark.createDataFrame(vectors(2000, 16, 0.05, 3), KIND)).collect()
    # the first assignment scans all; of the three others' scans most are spared
    assert sum(r.scans - 1 for r in got) < 0.6 * 3 * len(got)


def test_loosening_holds_and_is_below_the_drift():
    rng = np.random.default_rng(5)
    spared = 0
    for _ in range(200):
        before = rng.integers(-50, 50, (4, 6))
        after = before + rng.integers(-12, 12, (4, 6)) * rng.integers(0, 2, (4, 1))
        radius = rng.uniform(0, 40, 4)
        loose = C.loosening(before, after, radius)
        drift = np.linalg.norm(after - before, axis=1)
        for i in range(4):
            away = rng.normal(size=(300, 6))
            x = before[i] + away / np.linalg.norm(away, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in set(range(4)) - {i}:
                closer = np.linalg.norm(x - before[j], axis=1) - np.linalg.norm(x - after[j], axis=1)
                assert closer.max() <= loose[i] + 1e-9
            most = max((drift[j] for j in range(4) if j != i), default=0)
            assert loose[i] <= most * (1 + 1e-6) + 1e-4
            spared += loose[i] < 0.9 * most
    assert spared > 100


def test_nothing_and_huge(spark):
    assert C.cluster(spark.createDataFrame([], KIND)).collect() == []
    assert C.cluster(spark.createDataFrame([(1, [0.0] * 3)], KIND)).collect() == []
    got = C.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], KIND), k=2).collect()
    assert len(got) == 3 and all(0 <= r.distance < 1 << 63 for r in got)
