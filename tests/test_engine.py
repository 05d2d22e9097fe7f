"""Literal cases of the engine's operators, and properties."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import scoring, text, vector
from engram.operators import dedup, filters, graph, ingest, pairs, search, store
from engram.sources import tables
from engram.streaming import tasks


def test_rrf_sums_ranks(spark):
    c = spark.createDataFrame([("v", "a", 0.9), ("v", "b", 0.8), ("t", "a", 0.7), ("t", "c", 0.6)], "source string, id string, score double")
    got = {r.id: r.score for r in search.rrf(search.ranked(c)).collect()}
    assert got == pytest.approx({"a": 2 / 61, "b": 1 / 62, "c": 1 / 62})


def test_graph_tag_score_is_capped(spark):
    assert spark.range(1).select(scoring.tag_score(F.lit(3)).alias("s")).first().s == pytest.approx(0.85)


def test_contradicted_rows_lose_score(spark):
    r = spark.createDataFrame([("w", 0.9), ("l", 0.85), ("n", 0.7)], "id string, score double")
    e = spark.createDataFrame([("w", "l", "CONTRADICTS", None)], "from_id string, to_id string, relation string, invalid_at timestamp")
    assert {x.id: round(x.score, 2) for x in search.contradiction_penalty(r, e).collect()} == {"w": 0.9, "l": 0.55, "n": 0.7}


def test_pagerank_of_a_chain(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("A", "A", 5.0), ("", "B", 1.0)], "from_id string, to_id string, weight double")
    got = {r.id: r.pagerank for r in graph.pagerank(e, 30).collect()}
    assert got == pytest.approx({"A": 0.116156, "B": 0.214888, "C": 0.298811, "D": 0.370145}, abs=1e-4)
    assert sum(got.values()) == pytest.approx(1)


def test_components_are_the_transitive_closure(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}


def test_greedy_similarity_and_mmr():
    rows = pd.DataFrame({"id": ["a", "b", "c"], "score": [0.9, 0.8, 0.7], "embedding": [[1.0, 0, 0], [1.0, 0, 0], [0, 1.0, 0]]})
    assert dedup.greedy_similarity(rows, 5)["id"].tolist() == ["a", "c"]
    m = pd.DataFrame({"id": ["i1", "i2"], "memory": ["x", "y"], "kind": "text", "bucket": 0, "score": [0.95, 0.60], "embedding": [[0.0, 1.0], [1.0, 0.0]]})
    assert dedup.mmr(m, 1, 0, [1.0, 0.0])["id"].tolist() == ["i2"]
    six = pd.DataFrame({"id": list("abcdef"), "memory": list("abcdef"), "kind": ["text"] * 4 + ["pref"] * 2, "bucket": 0, "score": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4], "embedding": [[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.0], [0, 0, 0, 1.0], [1, 1, 0, 0.0], [0, 1, 1, 0.0]]})
    out = dedup.mmr(six, 2, 1, [1.0, 0, 0, 0])
    assert (out["kind"] == "text").sum() == 2 and (out["kind"] == "pref").sum() == 1


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(max_size=300)), max_size=30), st.integers(128, 600))
def test_windows_cover_all_lines_in_order(lines, size):
    w = ingest.windows_of(lines, size)
    assert (w[0][0], w[-1][1]) == (0, len(lines)) if lines else w == []
    for (a, b, *_), (c, d, *_) in zip(w, w[1:]):
        assert a < c <= b < d or (a < c <= b and d == b)


@pytest.mark.parametrize(
    "bad",
    [{"nope": 1}, {"a b": 1}, {"or": [], "and": []}, {"or": [], "id": "x"}, {"id": {"near": 1}}, {"id": {"gt": 1, "lt": 2}}, {"and": [{"or": []}]}, {"id": None}, {"id": [1]}, "{", "[1]", {"id'; DROP": 1}],
)
def test_filters_reject(bad):
    with pytest.raises(filters.FilterError):
        filters.parse(bad)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text() | st.sampled_from(["id", "or", "and", "tags", "in"]), x), max_leaves=8))
def test_filter_parser_only_raises_its_own_error(raw):
    try:
        filters.parse(raw)
    except filters.FilterError:
        pass


def test_profiles_and_levels():
    assert search.resolve_params({"top_k": 3}, "inject").top_k == 3 and search.resolve_params({}, "inject").relativity == 0.93
    with pytest.raises(ValueError):
        search.resolve_params({"level": "l9"})
    assert search.should_decompose("What did Alice do after Bob moved away from Paris last year") and not search.should_decompose("short question")
    assert search.normalize_subqueries("A b", ["a B", " ", "c"]) == ["A b", "c"]
    assert ingest.route(ingest.AddRequest(3, mode="raw")) == "raw" and ingest.route(ingest.AddRequest(1, is_async=True, mode="raw")) == "async"


def test_keywords_by_language(spark):
    rows = ["Hello World!", "the is a", "Привет мир, как дела?", "v2 deployment 42"]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.keywords(F.col("t")).alias("k")).collect()]
    assert got == [["hello", "world"], [], ["привет", "мир", "дела"], ["v2", "deployment"]]


def test_cosine_edge_cases(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r.c if r.c is None else round(r.c, 6) for r in d.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, None, 1.0]


def test_pairs_in_blocks_equal_one_block(spark):
    rng = random.Random(3)
    rows = [(f"i{k:03d}", "hot" if k % 3 else "cold", [rng.gauss(0, 1) for _ in range(4)]) for k in range(120)]
    d = spark.createDataFrame(rows, "id string, g string, embedding array<double>")
    one = {(r.a, r.b) for r in pairs.pairs_above(d, 0.8, group="g").collect()}
    many = {(r.a, r.b) for r in pairs.pairs_above(d, 0.8, group="g", block=10).collect()}
    assert one == many and one
    near = {(r.from_id, r.to_id) for r in pairs.top_neighbours(d, 2, group="g").collect()}
    assert near == {(r.from_id, r.to_id) for r in pairs.top_neighbours(d, 2, group="g", block=10).collect()} and len(near) == 240


def test_profile_scd2(spark):
    at = F.timestamp_seconds(F.lit(1000))
    p = spark.createDataFrame([("c", "u", "t", "s", "old", None)], "cube_id string, user_id string, topic string, sub_topic string, memo string, expired_at timestamp").withColumn("updated_at", at)
    b = spark.createDataFrame([("c", "u", "t", "s", "new"), ("c", "u", "t", "", "x"), ("c", "u", "t", "z", "first")], "cube_id string, user_id string, topic string, sub_topic string, memo string")
    once = store.profile_upsert(p, b, at)
    assert sorted((r.sub_topic, r.memo, r.expired_at is None) for r in once.collect()) == [("s", "new", True), ("s", "old", False), ("z", "first", True)]
    assert store.profile_upsert(once, b, at).count() == 3


def test_snapshots_move_a_pointer(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/t")
    assert s.version() == -1
    s.write(spark.range(3).toDF("id"))
    s.write(s.read().where("id > 0"))
    assert s.version() == 1 and sorted(r.id for r in s.read().collect()) == [1, 2]


def test_result_cache_expires(spark):
    now = [0.0]
    c = tables.ResultCache(30, lambda: now[0])
    a = c.get("k1", lambda: spark.range(1))
    assert c.get("k1", lambda: spark.range(2)) is a
    now[0] = 31
    assert c.get("k1", lambda: spark.range(2)).count() == 2 and c.invalidate("k*") == 1


def test_conversation_loader(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('[{"sample_id":"s1","conversation":{"session_1_date_time":"1:56 pm on 8 May, 2023","session_1":[{"speaker":"A","dia_id":"D1:1","text":"hi"}]}}]')
    (r,) = tables.load_conversations(spark, str(p)).collect()
    assert (r.sample_id, r.session, r.speaker, r.text, str(r.at)) == ("s1", "session_1", "A", "hi", "2023-05-08 13:56:00")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "abc"[i % 3], f"2024-01-01 0{i % 4}:10:00", float(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    batch = {(r.start_s, r.event_type, r.n) for r in tasks.windowed_counts(d).collect()}
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = tasks.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start_s, r.event_type, r.n) for r in spark.sql("SELECT * FROM w").collect()} == batch


def test_buffer_stream_flushes_by_size(spark, tmp_path):
    d = spark.createDataFrame([("u", "c", str(i)) for i in range(12)], "user_id string, cube_id string, content string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    stream = tasks.buffer_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 5, 3600)
    tasks.run_available(stream, lambda b, _: out.extend(b.collect()), str(tmp_path / "cp"), timers=True)
    assert [r.n for r in out] == [5, 5] and out[0].content.split("\n---\n") == ["0", "1", "2", "3", "4"]
