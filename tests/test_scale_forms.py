"""Graph, pair and id operators in their scalable forms against brute force, and the size of their plans."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from engram.operators import graph, maintain, pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_ids_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randint(0, 9)))
    known, given = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    want = {}
    for g in given:
        near = [k for k in known if distance(g.lower(), k.lower()) <= 2]
        same = [k for k in near if k.lower() == g.lower()]
        if len(near) == 1 or same:
            want[g] = max(same) if same else near[0]
    got = maintain.resolve_ids(spark.createDataFrame([(g,) for g in given], "id string"), spark.createDataFrame([(k,) for k in known], "id string"))
    assert {r.given: r.id for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_hops_equal_brute_force(spark):
    rng = random.Random(2)
    e = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(20)]
    seeds, near = ["n1", "n7", "hub"], {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best = {}
    for s in seeds:
        front = {s}
        for hop in (1, 2, 3):
            front = set().union(*(near.get(x, set()) for x in front))
            for x in front - set(seeds):
                best[x] = min(best.get(x, (9, "")), (hop, s))
    got = graph.k_hop(spark.createDataFrame(e, "from_id string, to_id string"), spark.createDataFrame([(s,) for s in seeds], "id string"), 3)
    assert {r.id: (r.hop, r.seed) for r in got.collect()} == best


def test_pagerank_equals_power_iteration_and_its_plan_does_not_grow(spark):
    rng = random.Random(3)
    e = [(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 19)}", rng.random()) for _ in range(60)]
    df = spark.createDataFrame(e, "from_id string, to_id string, weight double")
    nodes = sorted({x for a, b, _ in e if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in e:
        if a != b:
            m[at[b], at[a]] += w
    out = m.sum(0)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(4):
        spread = (m / np.where(out > 0, out, 1)) @ rank
        rank = 0.15 / len(nodes) + 0.85 * (spread + rank[out == 0].sum() / len(nodes))
    got = graph.pagerank(df, 4)
    assert got._jdf.queryExecution().toString().count("FileScan") <= 1
    found = {r.id: r.pagerank for r in got.collect()}
    assert np.allclose([found[x] for x in nodes], rank)


def test_touching_pairs_and_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 4))
    v[10] = v[11] = v[12]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    rows = spark.createDataFrame([(f"r{i:02d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>")
    ids = rows.where(F.col("id") < "r13").select("id")
    got = {(r.a, r.b) for r in pairs.pairs_touching(rows, ids, 0.5, block=16).collect()}
    assert got == {(f"r{i:02d}", f"r{j:02d}") for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5 and i < 13}
    for least in (-1.0, 0.3):
        found = pairs.top_neighbours(rows, 10, least, block=25).collect()
        for i in range(60):
            want = sorted((-round(float(s[i, j]), 9), f"r{j:02d}") for j in range(60) if j != i and s[i, j] >= least)[:10]
            assert [r.to_id for r in sorted((r for r in found if r.from_id == f"r{i:02d}"), key=lambda r: r.rank)] == [x for _, x in want]
