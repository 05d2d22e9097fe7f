"""Vector joins cut by pivots: equal to brute force, and what is pruned is never copied."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import pairs

LEAST = 0.85


def clustered(n, centres, dim=12, spread=0.12, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(centres, size=n)] / 3 + rng.normal(size=(n, dim)) * spread / 3


def table(spark, x, groups=None, first=0):
    rows = [(f"n{i + first:05d}", groups[i] if groups else "hot", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, user_name string, embedding array<double>").repartition(6)


def cosines(x, y):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    return unit(x) @ unit(y).T


@pytest.fixture(scope="module")
def kinds(spark):
    rng = np.random.default_rng(1)
    x = clustered(600, 9)
    same = np.repeat(clustered(3, 3), 60, axis=0)  # many equal rows: one angle bucket
    return {"clusters": x, "random": rng.normal(size=(400, 12)), "equal": np.vstack([same, x[:200], np.zeros((5, 12))])}


@pytest.mark.parametrize("kind", ["clusters", "random", "equal"])
@pytest.mark.parametrize("least", [LEAST, 0.2])
def test_pairs_equal_brute_force(spark, kinds, kind, least):
    x = kinds[kind]
    groups = ["hot"] * (len(x) - 40) + ["small"] * 40
    got = {(r.a, r.b) for r in pairs.pairs_above(table(spark, x, groups), least, "user_name", block=32).collect()}
    s = cosines(x, x)
    want = {(f"n{i:05d}", f"n{j:05d}") for i in range(len(x)) for j in range(i + 1, len(x)) if groups[i] == groups[j] and s[i, j] >= least}
    assert got == want and got


def test_rows_without_direction_meet_all_below_zero(spark):
    x = np.vstack([clustered(120, 4), np.zeros((3, 12))])
    got = pairs.pairs_above(table(spark, x), -0.1, block=16)
    s = cosines(x, x)
    assert got.count() == sum(s[i, j] >= -0.1 for i in range(len(x)) for j in range(i + 1, len(x)))


@pytest.mark.parametrize("kind", ["clusters", "random", "equal"])
def test_neighbours_equal_brute_force(spark, kinds, kind):
    x, k = kinds[kind][:300], 4
    for least in (-1.0, 0.5):
        got = {(r.from_id, r.rank): (r.to_id, round(r.score, 7)) for r in pairs.top_neighbours(table(spark, x), k, least, "user_name", block=32).collect()}
        s = cosines(x, x)
        want = {}
        for i in range(len(x)):
            near = sorted((-round(float(s[i, j]), 9), f"n{j:05d}", float(s[i, j])) for j in range(len(x)) if j != i and s[i, j] >= least)[:k]
            want |= {(f"n{i:05d}", r + 1): (o, round(c, 7)) for r, (_, o, c) in enumerate(near)}
        assert {key: c for key, (_, c) in got.items()} == {key: c for key, (_, c) in want.items()}
        if kind != "equal":  # equal rows tie beyond nine digits
            assert got == want


def test_touching_and_nearest_equal_brute_force(spark, kinds):
    x = kinds["clusters"]
    t = table(spark, x)
    some = t.where(F.substring("id", -1, 1) == "7")
    got = {(r.a, r.b) for r in pairs.pairs_touching(t, some, LEAST, "user_name", block=32).collect()}
    s = cosines(x, x)
    assert got == {(f"n{i:05d}", f"n{j:05d}") for i in range(600) for j in range(i + 1, 600) if (i % 10 == 7 or j % 10 == 7) and s[i, j] >= LEAST}

    new = clustered(90, 9, seed=5)
    sides = [d.select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v")) for d in (table(spark, new, first=9000), t)]
    near = {r.id: (r.other, round(r.score, 7)) for r in pairs.nearest(*sides, 0.5, block=32).collect()}
    m = cosines(new, x)
    want = {}
    for i in range(len(new)):
        best = max((round(float(m[i, j]), 9), f"n{j:05d}", float(m[i, j])) for j in range(600))
        if best[2] >= 0.5:
            want[f"n{9000 + i:05d}"] = (best[1], round(best[2], 7))
    assert near == want and near


def test_far_rings_are_never_copied(spark):
    """On clusters a row meets its own cluster's rings only: the copies grow with the rows, not with their square."""
    copies = {}
    for n in (600, 2400):
        t = table(spark, clustered(n, n // 60, dim=24, spread=0.06))  # more rows in more clusters of one size
        found = pairs.pair_copies(t, LEAST, "user_name", block=32, pivots=n // 60)
        copies[n] = found.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    every = {n: n * (n / 32) for n in copies}  # all pairs of blocks
    assert copies[2400] < 0.2 * every[2400]
    assert copies[2400] / copies[600] < 4**1.3
