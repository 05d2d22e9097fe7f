"""Many searches in one plan: equal to one by one, lazy, bounded; stages and outer rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import manysearch, search
from engram.schema import EDGES, MEMORY


def at():
    return F.timestamp_seconds(F.lit(1_700_000_000))


@pytest.fixture(scope="module")
def world(spark):
    rng, r = np.random.default_rng(3), random.Random(3)
    rows = []
    for i in range(240):
        words = " ".join(r.choice("river stone bridge mill paris trip".split()) for _ in range(r.randrange(1, 12)))
        v = [float(x) for x in rng.normal(size=6)] if i % 9 else None
        kind = ["LongTermMemory", "UserMemory", "EpisodicMemory", "SkillMemory", "PreferenceMemory", "WorkingMemory"][i % 6]
        rows.append((f"m{i:03d}", ["hot", "hot", "hot", "b", "c"][i % 5], words if i % 13 else "river  ", kind, "activated" if i % 7 else "archived", "paris" if i % 31 == 0 else None, ["river", "mill", "x"][: i % 4], v))
    m = spark.createDataFrame(rows, "id string, user_name string, memory string, memory_type string, status string, key string, tags array<string>, embedding array<float>")
    m = spark.createDataFrame([], MEMORY).unionByName(m, allowMissingColumns=True).withColumn("updated_at", F.timestamp_seconds(1_690_000_000 + 86_400 * F.substring("id", 2, 3).cast("int")))
    e = [(f"m{i:03d}", f"m{(i * 7 + 3) % 240:03d}", "RELATED") for i in range(0, 240, 3)] + [(f"m{i:03d}", f"m{(i + 5) % 240:03d}", "CONTRADICTS") for i in range(0, 240, 4)] + [(f"m{i:03d}", "paris", "MENTIONS_ENTITY") for i in range(0, 240, 17)]
    edges = spark.createDataFrame([], EDGES).unionByName(spark.createDataFrame(e, "from_id string, to_id string, relation string"), allowMissingColumns=True)
    requests = [{"query": q, "vector": tuple(float(x) for x in rng.normal(size=6)) if k != 2 else (), "cubes": c} for k, (q, c) in enumerate([("the river and the mill", ("hot",)), ("paris trip", ("hot", "b")), ("stone bridge", ("b", "c")), ("", ("c",)), ("nothing known", ("nowhere",))])]
    return m, edges, requests


def rows_of(df):
    return sorted((r.bucket, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"dedup": "mmr", "top_k": 3}, {"dedup": "sim", "importance": True}, {"level": "l1"}, {"level": "l2"}, {"llm_rerank": True, "num_stages": 2}])
def test_many_equal_one_by_one(spark, world, how):
    m, e, requests = world
    p = search.resolve_params(how)
    many = manysearch.search_many(m, e, manysearch.request_rows(spark, requests), p, at()).collect()
    for i, r in enumerate(requests):
        one = rows_of(search.search(m, e, search.resolve_params(r | how), at()))
        assert sorted((x.bucket, x["rank"], x.id, round(x.score, 9)) for x in many if x.query_id == i) == one
    assert len({x.query_id for x in many}) >= (3 if how.get("level") != "l2" else 2)


def test_nothing_runs_before_the_result_is_asked_for(spark, world):
    m, e, requests = world
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "search")
    q = manysearch.request_rows(spark, [requests[i % 3] for i in range(1000)])
    found = manysearch.search_many(m, e, q, search.resolve_params({}), at())
    assert list(sc.statusTracker().getJobIdsForGroup("lazy")) == []
    got = found.groupBy("query_id").count().collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1000 and len({r["count"] for r in got if r.query_id % 3 == 0}) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_stages_shortlist_and_scorer(spark, world):
    m, e, requests = world
    seen = []

    def scorer(query, texts):
        return [1.0 if "mill" in t else 0.0 for t in texts]

    p = search.resolve_params(requests[0] | {"llm_rerank": True, "num_stages": 2, "top_k": 30})
    rows = search.search(m, e, p, at(), scorer).collect()
    assert 0 < len(rows) <= manysearch.STAGE_SHORTLIST and {r.score for r in rows} <= {0.0, 1.0}
    none = search.search(m, e, search.resolve_params(requests[0] | {"llm_rerank": True}), at(), lambda q, t: [0.0] * len(t)).collect()
    assert none and {r.score for r in none} == {0.0} and not seen  # all irrelevant: their order is by id


def test_few_rows_are_not_staged(spark, world):
    m, e, requests = world
    few = m.where("id IN ('m005', 'm011', 'm017', 'm023') OR id = 'm000'").withColumn("memory_type", F.lit("UserMemory")).withColumn("status", F.lit("activated")).limit(4)
    p = search.resolve_params(requests[0] | {"llm_rerank": True, "num_stages": 2, "cubes": ("hot", "b", "c")})
    assert search.search(few, e, p, at()).count() == search.search(few, e, search.resolve_params({**p.__dict__, "num_stages": 0}), at()).count()


def test_outer_rows_only_when_asked(spark, world):
    m, e, requests = world
    web = spark.createDataFrame([("w1", "from outside", 0.99)], "id string, memory string, score double")
    many = lambda **kw: {r.query_id for r in manysearch.search_many(m, e, manysearch.request_rows(spark, requests), search.resolve_params(kw), at(), web=web).where("id = 'w1'").collect()}
    assert many() == set() and many(internet=True) == {0, 1, 2, 3, 4}
