"""The stored text index: equal to a full scan through inserts, updates and deletions, with fewer blocks read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import search, textindex


def rows_of_texts(n, seed=1, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["rare", "Mixed", "слово", "the"]
    out = []
    for i in range(n):
        size = rng.choice([0, 3, 8, 30, 120])
        out.append((f"d{first + i:04d}", rng.choice(["a", "b", None]), " ".join(rng.choices(words, [64 - k for k in range(len(words))], k=size)), rng.choice(["activated", "archived"])))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, user_name string, memory string, status string")


def same(index, memory, tokens, k, where=None, cubes=None):
    got = [(r.id, r.score) for r in index.search(tokens, k, memory, where, cubes).collect()]
    want = [(r.id, r.score) for r in search.full_text(memory, tokens, where if where is not None else F.lit(True), k).collect()]
    assert got == want
    return got


def test_search_equals_full_text_through_changes(spark, tmp_path):
    index = textindex.TextIndex(spark, str(tmp_path / "index"), block=20)
    assert index.search(["w1"], 5).count() == 0
    rows = rows_of_texts(200) + [("empty", "a", "", "activated"), ("null", "a", None, "activated")]
    m = table(spark, rows)
    index.append(m)
    active = F.col("status") == "activated"
    assert same(index, m, ["w1", "rare", "w1"], 10)
    assert same(index, m, ["w40", "слово", "mixed"], 7, active)
    assert same(index, m, ["the", "w3"], 10, active & (F.col("user_name") == "b"), ["b"])
    assert same(index, m, ["nothere"], 5) == [] and index.search([], 5).count() == 0
    more = table(spark, rows_of_texts(50, 2, 500))
    index.append(more)
    m = m.unionByName(more)
    assert same(index, m, ["w1", "w2"], 12)
    new = table(spark, [("d0003", "a", "rare rare rare w1", "activated"), ("d0501", "b", "", "activated"), ("d9999", "b", "rare the", "activated")])
    index.upsert(new)
    m = m.join(new.select("id"), "id", "left_anti").unionByName(new)
    assert ("d0003" in dict(same(index, m, ["rare"], 10))) and same(index, m, ["w1", "the"], 10)
    index.delete(m.where("id LIKE '%7'").select("id"))
    m = m.where("id NOT LIKE '%7'")
    assert same(index, m, ["w1", "w2", "rare"], 10)
    assert [r.id for r in index.search(["rare"], 300).collect() if r.id.endswith("7")] == []
    back = table(spark, [("d0007", "a", "rare rare", "activated")])
    index.append(back)  # an id that was deleted comes again
    m = m.unionByName(back)
    assert "d0007" in dict(same(index, m, ["rare"], 10))
    index.compact(m)
    assert same(index, m, ["w1", "w2", "rare"], 10) and len(index._manifest()) == 1


def test_blocks_that_cannot_enter_are_not_read(spark, tmp_path):
    index = textindex.TextIndex(spark, str(tmp_path / "index"), block=20)
    m = table(spark, rows_of_texts(600, 5))
    index.append(m)
    table_read, n, total = index.read_blocks(["w1", "w2"], 5, m)
    assert n < 0.6 * total
    plan = table_read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "In(block" in plan and "In(term" in plan or "PushedFilters" in plan
    assert same(index, m, ["w1", "w2"], 5)


def test_many_blocks_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "NAMED", 3)
    index = textindex.TextIndex(spark, str(tmp_path / "index"), block=5)
    m = table(spark, rows_of_texts(120, 6))
    index.append(m)
    assert same(index, m, ["w5", "w9"], 20)


def test_of_two_writers_one_fails(spark, tmp_path):
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    m = table(spark, rows_of_texts(20))
    index.append(m)
    base = index.versions.version()
    index.delete(m.limit(1))
    with pytest.raises(FileExistsError):
        index._commit([("segment", 9, "nowhere", 1)], base)
    assert index.search(["w1"], 3, m).count() == 3
