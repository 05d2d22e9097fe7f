"""The engine's routes: every step of a search wired, edges on add, upkeep by tunables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from engram import api, models, tuning
from engram.schema import EDGES, MEMORY


def at():
    return F.timestamp_seconds(F.lit(1_700_000_000))


@pytest.fixture(scope="module")
def engine(spark):
    e = models.HashEmbedder()
    texts = [("the river mill is old", "LongTermMemory"), ("the river bridge is older still", "UserMemory"), ("paris trip in may", "LongTermMemory"), ("a mill by the river grinds corn", "EpisodicMemory"), ("river notes", "WorkingMemory"), ("user likes the river more than any mill there is", "PreferenceMemory"), ("short", "PreferenceMemory")]
    rows = [(f"{c}{i}", c, t if c == "a" else f"{t} again", k, "activated", [float(x) for x in e.embed([t])[0]]) for c in "ab" for i, (t, k) in enumerate(texts)]
    m = spark.createDataFrame(rows, "id string, user_name string, memory string, memory_type string, status string, embedding array<float>")
    m = spark.createDataFrame([], MEMORY).unionByName(m, allowMissingColumns=True)
    profiles = spark.createDataFrame([("a", "u", "work", "title", "chief", None), ("a", "u", "work", "old", "gone", "x")], "cube_id string, user_id string, topic string, sub_topic string, memo string, e string")
    profiles = profiles.withColumn("updated_at", at()).withColumn("expired_at", F.when(F.col("e").isNotNull(), at()))
    return api.Engine(spark, m, spark.createDataFrame([], EDGES), at(), profiles)


def ask(**kw):
    return {"query": "the old river mill", "vector": tuple(float(x) for x in models.HashEmbedder().embed(["the old river mill"])[0]), "cubes": ("a",)} | kw


def test_a_response_has_all_its_parts(engine):
    got = engine.respond(ask(include_working=True, include_preferences=True, relativity=0.3))
    assert {r.id for r in got["results"].collect()} >= {"a0", "a3"}
    assert [r.id for r in got["working"].collect()] == ["a4"]
    assert [r.id for r in got["preferences"].collect()] == ["a5"]  # 'short' is no preference
    assert [(r.user_name, r.profile) for r in got["profile"].collect()] == [("a", "- work::title: chief")]


def test_rewritten_query_and_judged_rows(engine):
    engine.rewriter = lambda q: json.dumps({"query": "paris trip", "confidence": 0.9})
    try:
        assert engine.params(ask(query="where did we all go in may")).query == "paris trip"
        assert engine.params(ask(query="short one")).query == "short one"  # too few words to rewrite
    finally:
        engine.rewriter = None
    engine.judge = lambda q, t: "keep" if "mill" in t else "drop"
    try:
        fine = engine.search(ask(mode="fine", top_k=4)).where("bucket = 'text'").orderBy("rank").collect()
        fast = engine.search(ask(top_k=4)).where("bucket = 'text'").collect()
    finally:
        engine.judge = None
    first = [r.memory for r in fine if "mill" in r.memory]
    assert [r.memory for r in fine][: len(first)] == first and len(fast) == 4


def test_cubes_speakers_and_context(spark, engine):
    both = engine.search_cubes(ask(cubes=("a", "b"), top_k=3)).where("bucket = 'text'").orderBy("rank").collect()
    assert len(both) == 3 and [r["rank"] for r in both] == [1, 2, 3] and {r.id[0] for r in both} == {"a", "b"}
    said = {r.id: r.speaker for r in engine.search_speakers(ask(top_k=8), ("a", "b"), ("Ann", "Bo")).collect()}
    assert said["a0"] == "Ann" and said["b0"] == "Bo"
    engine.web = spark.createDataFrame([("w1", "from outside", 0.99)], "id string, memory string, score double")
    try:
        new = spark.createDataFrame([("a0", "another text")], "id string, memory string")
        rows = {r.id: r.memory for r in engine.context(ask(), texts=new).collect()}
        assert rows["a0"] == "another text" and "w1" not in rows
        assert "w1" in {r.id for r in engine.context(ask(internet=True)).collect()}
    finally:
        engine.web = None


def test_tunables_reach_the_search(spark, engine):
    own = api.Engine(spark, engine.memory, engine.edges, at(), tunables=tuning.tunables({"ENGRAM_DECAY_ALPHA": "0.5", "ENGRAM_MMR_LAMBDA": "0.2"}))
    assert (own.params(ask()).decay_alpha, own.params(ask()).mmr_lambda) == (0.5, 0.2)
    assert own.params(ask(decay_alpha=0.1)).decay_alpha == 0.1 and own.params(ask(), "inject").decay_alpha == 0.01


def test_added_rows_are_linked(spark, engine):
    own = api.Engine(spark, engine.memory, engine.edges, at())
    said = [(1, i, "user" if i % 2 else "assistant", f"{w} number {i} about the harvest of apples and of many other things", None) for i, w in enumerate(["first line", "second line", "third line"])]
    m = spark.createDataFrame(said, "conv_id long, turn int, role string, content string, chat_time timestamp")
    own.add(m, "a", "raw")
    new = {r.id: r for r in own.memory.where("session_id = '1' AND memory_type <> 'WorkingMemory'").collect()}
    assert len(new) == 3
    edges = own.edges.collect()
    order = sorted(new.values(), key=lambda r: r.created_at)
    assert {(r.from_id, r.to_id) for r in edges if r.relation == "TIMELINE_NEXT"} == {(b.id, a.id) for a, b in zip(order, order[1:])}
    assert all(r.from_id in new and r.to_id in new for r in edges if r.relation == "SIMILAR_COSINE_HIGH")
    before = len(edges)
    own.add(m, "a", "raw")  # the same messages add nothing
    assert own.edges.count() == before
