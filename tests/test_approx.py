"""The inverted-list index against brute force, and answer scores against known values."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import approx, evalkit, search
from engram.plans.adapter import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(spark, vectors):
    return spark.createDataFrame([(f"r{i:05}", [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)], "id string, embedding array<float>")


def test_recall_on_clustered_vectors_with_few_lists(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    rows = rows_of(spark, v).cache()
    c = approx.fit(rows, 20)
    index = approx.indexed(rows, c).cache()
    assert index.count() == 2000
    hit = 0
    for q in v[::200].tolist():
        got = approx.knn(index, c, q, F.lit(True), 10, 3).collect()
        want = search.knn(rows, q, F.lit(True), 10).collect()
        hit += len({r.id for r in got} & {r.id for r in want})
    assert hit >= 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_of_the_registered_probes(spark):
    """Each row whose id is divisible by 20 is a query."""
    t = Tables(spark, SF)
    rows = t.memory.select("id", "doc_id", "embedding").where("embedding IS NOT NULL").cache()
    c = approx.fit(rows)
    index = approx.indexed(rows, c).cache()
    hit = total = 0
    for r in rows.where("doc_id % 20 = 0").collect():
        want = {x.id for x in search.knn(rows, r.embedding, F.lit(True), 10).collect()}
        hit += len(want & {x.id for x in approx.knn(index, c, r.embedding, F.lit(True), 10, 20).collect()})
        total += len(want)
    assert total and hit / total >= 0.9


def test_all_lists_are_exact_and_odd_rows_are_indexed(spark):
    rows = rows_of(spark, [[0, 0], [1, 0], [1, 0], None, [0, 1], [-1, 0]])
    c = approx.fit(rows, 8)
    index = approx.indexed(rows, c)
    assert index.count() == 5
    got = [tuple(r) for r in approx.knn(index, c, [1.0, 0.0], F.lit(True), 10, 8).collect()]
    assert got == [tuple(r) for r in search.knn(rows, [1.0, 0.0], F.lit(True), 10).collect()]
    none = rows.where("embedding IS NULL")
    assert approx.fit(none).size == 0 and approx.indexed(none, approx.fit(none)).count() == 0


def test_meteor_and_similarity(spark):
    rows = spark.createDataFrame([("cat sat on mat", "cat sat on mat"), ("on mat cat sat", "cat sat on mat"), ("dog", "cat"), ("", "cat"), ("cat", None)], "p string, g string")
    got = [r[0] for r in rows.select(evalkit.meteor(F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([1 - 0.5 / 64, 1 - 0.5 / 8, 0, 0, 0])
    sim = [r[0] for r in evalkit.embedding_similarity(rows, "p", "g").select("similarity").collect()]
    assert sim == pytest.approx([1, 1, sim[2], 0, 0], abs=1e-6) and abs(sim[2]) < 1
