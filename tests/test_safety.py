"""Rows with nulls survive deletions, snapshots survive crashes, and searches use what they are asked for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engram import api, session
from engram.operators import manysearch, search, store

DDL = "id string, user_name string, memory string, memory_type string, status string, embedding array<float>, updated_at timestamp, created_at timestamp, key string, tags array<string>, user_id string, agent_id string, access_count int, hierarchy_level string, pagerank double, info map<string,string>, importance_score double, retrieval_count int"


def row(i, cube, text, kind="LongTermMemory", status="activated", vec=(1.0, 0.0), tags=("a",)):
    return (i, cube, text, kind, status, [float(x) for x in vec], None, None, "k", list(tags), "u", "", 0, "raw", 0.0, {}, 1.0, 0)


@pytest.fixture(scope="module")
def memory(spark):
    rows = [row("1", "c1", "x"), row("2", None, "y"), row("3", "c2", "z", status=None), row("4", "c1", "w", kind=None), row("5", "c1", "v", status=None)]
    return spark.createDataFrame(rows, DDL)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_rows_with_nulls_survive_deletions(spark, memory):
    assert ids(store.delete_cube(memory, "c1")) == ["2", "3", "5"]
    assert ids(store.purge({"m": memory}, "c1")["m"]) == ["2", "3"]
    cubes = spark.createDataFrame([("c1", True)], "cube_id string, is_active boolean")
    assert ids(store.cubes_delete(cubes, memory, "c1", hard=True)[1]) == ["2", "3"]
    assert ids(store.keep_newest(memory, default=0)) == ["1", "2", "3", "4", "5"]
    gone = spark.createDataFrame([("2",), ("1",)], "id string")
    assert ids(store.delete_ids(memory, gone, ["c1"])) == ["2", "3", "4", "5"]


def test_snapshots_survive_a_crash_before_the_marker(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "t"))
    assert s.version() == -1
    assert s.write(spark.range(3)) == 0 and s.write(spark.range(5)) == 1
    spark.range(9).write.parquet(str(tmp_path / "t" / "v2"))  # a writer that died before its marker
    assert s.version() == 1 and s.read().count() == 5 and s.read(0).count() == 3
    assert s.write(spark.range(7)) == 2 and s.read().count() == 7


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Other:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Other, Conf

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            session.shared_dir(Session)


def test_search_uses_the_querys_words_and_parameters(spark):
    rows = [row("1", "c", "Paris in spring", vec=(1, 0)), row("2", "c", "notes on paris and rome", vec=(0, 1)), row("3", "c", "nothing here", vec=(0.9, 0.1)), row("4", "c", "nothing here at all", vec=(0.9, 0.11)), row("5", "c", "keyed", vec=(-1, 0))]
    m = spark.createDataFrame(rows, DDL).withColumn("key", F.when(F.col("id") == "5", "paris").otherwise("k")).withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    e = spark.createDataFrame([], "from_id string, to_id string, relation string, confidence double, invalid_at timestamp")
    (q,) = manysearch._queries(manysearch.request_rows(spark, [{"query": "The Paris trip, the PARIS trip"}])).collect()
    assert q.tokens == ["paris", "trip"]
    ask = {"query": "Where is Paris", "vector": (1.0, 0.0), "cubes": ("c",), "top_k": 2}
    run = lambda **kw: [r.id for r in search.search(m, e, search.resolve_params(ask | kw), F.timestamp_seconds(F.lit(0))).orderBy("rank").collect()]
    assert {"1", "3"} == set(run())
    assert "5" in run(top_k=5) and "2" in run(top_k=5)
    assert not {"3", "4"} <= set(run(top_k=3, dedup="sim"))
    assert run(llm_rerank=True, top_k=5)[0] in ("1", "2")
    web = spark.createDataFrame([("w", "from the web", 5.0)], "id string, memory string, score double")
    got = search.search(m, e, search.resolve_params(ask | {"internet": True}), F.timestamp_seconds(F.lit(0)), web=web).orderBy("rank").collect()
    assert got[0].id == "w"
    assert "w" not in [r.id for r in search.search(m, e, search.resolve_params(ask), F.timestamp_seconds(F.lit(0)), web=web).collect()]


def test_adding_twice_stores_once(spark):
    m = spark.createDataFrame([], DDL)
    e = spark.createDataFrame([], "from_id string, to_id string, relation string, confidence double, invalid_at timestamp")
    engine = api.Engine(spark, m, e, F.timestamp_seconds(F.lit(0)))
    says = spark.createDataFrame([(1, 0, "user", "my cat is called Tom", None), (1, 1, "user", "and the dog is Rex", None)], "conv_id long, turn int, role string, content string, chat_time timestamp")
    assert engine.add(says, "c", "raw").count() == 4 and engine.add(says, "c", "raw").count() == 0
    assert engine.add(says.where("turn = 9"), "c", "async").count() == 0
    assert engine.memory.count() == 4
    with pytest.raises(ValueError):
        engine.add(says, "c", "fine")
