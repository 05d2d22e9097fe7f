"""Model steps, periodic jobs, tunables and the web source on fixtures."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from engram import api, models, tuning
from engram.operators import ingest, modes, search
from engram.plans.adapter import AS_OF, CUBE, Tables
from engram.sources import web
from engram.streaming import loops

DDL = (
    "id string, user_name string, user_id string, memory string, memory_type string, status string, background string, tags array<string>, "
    "created_at timestamp, updated_at timestamp, embedding array<float>"
)
EDGES = "from_id string, to_id string, relation string, confidence double, invalid_at timestamp"
AT = lambda: F.timestamp_seconds(F.lit(10))
SAYS = "conv_id long, turn int, role string, content string, chat_time timestamp"


def memory(spark, *rows):
    """(id, cube, text) as active long-term rows with vectors."""
    e = models.HashEmbedder()
    full = [(i, c, "u", t, k, "activated", "", [], None, None, [float(x) for x in e.embed([t])[0]]) for i, c, t, k in rows]
    return spark.createDataFrame(full, DDL)


def test_ask_asks_each_row_once_and_goes_on_without_a_reply(spark, tmp_path):
    def call(x):
        open(f"{tmp_path}/{x}", "a").write("1")
        if x == "b":
            raise OSError("down")
        return x.upper()

    t = modes.ask(spark.createDataFrame([("a",), ("b",), (None,)], "x string").where("x IS NOT NULL"), ["x"], call)
    assert sorted(t.collect()) == [("a", "A"), ("b", None)] == sorted(t.collect())
    assert [open(f"{tmp_path}/{x}").read() for x in "ab"] == ["1", "1"]


def test_a_callable_that_always_fails_is_an_error(spark):
    t = spark.createDataFrame([(str(i),) for i in range(8)], "x string")
    with pytest.raises(RuntimeError, match="8 of 8 calls failed: TypeError"):
        modes.ask(t, ["x"], lambda: "takes nothing")


def test_fine_with_few_rows_no_kept_rows_and_no_rows(spark):
    r = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), *[(2, c, 0.5) for c in "cde"]], "query_id int, id string, score double")
    none = spark.createDataFrame([(1, "a", False), (2, "c", False)], "query_id int, id string, keep boolean")
    out = modes.fine(r, none, r, 10)
    assert sorted((x.query_id, x.id) for x in out.collect()) == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e")]
    one = spark.createDataFrame([(2, "d", True)], "query_id int, id string, keep boolean")
    more = spark.createDataFrame([(2, "z", 0.1), (2, "d", 0.9), (1, "y", 0.9)], "query_id int, id string, score double")
    assert [x.id for x in modes.fine(r, one, more, 10).where("query_id = 2").orderBy("rank").collect()] == ["d", "z"]
    assert modes.fine(r.limit(0), one, more, 3).count() == 0


def test_iterate_stops_without_phrases_and_keeps_the_first_row_of_an_id(spark):
    seen = []

    def phrases(rows, stage):
        seen.append((stage, rows.count()))
        return {1: ["x", " "], 2: ["y"]}.get(stage, [])

    found = {"x": [("a", 0.99), ("b", 0.5)], "y": [("b", 0.98), ("c", 0.7)]}
    fetch = lambda p: spark.createDataFrame(found[p], "id string, score double")
    out = modes.iterate(spark.createDataFrame([("a", 0.6)], "id string, score double"), phrases, fetch, 5)
    assert [tuple(r) for r in out.collect()] == [("c", 0.7, 2, "y"), ("a", 0.6, 0, None), ("b", 0.5, 1, "x")]
    assert seen == [(1, 1), (2, 2), (3, 3)]


def test_fine_add_extracts_skips_known_and_applies_actions(spark):
    m = memory(spark, ("m1", "c", "the old fact of the cube", "LongTermMemory"), ("m2", "c", "to be deleted", "LongTermMemory"), ("m3", "d", "of another cube", "LongTermMemory"), ("m4", "c", "known already", "LongTermMemory"))
    e = spark.createDataFrame([("m2", "m1", "RELATED", 1.0, None)], EDGES)
    facts = [
        {"raw_text": "a new fact", "confidence": 0.9},
        {"raw_text": "Known already", "confidence": 0.9},
        {"raw_text": "the new fact of the cube", "action": "update", "target_id": "m1", "confidence": 0.9},
        {"action": "delete", "target_id": "m2"},
        {"action": "delete", "target_id": "m3"},
        {"raw_text": "weak", "confidence": 0.1},
    ]
    says = spark.createDataFrame([(1, 0, "user", "please remember all of the things that I say", None), (2, 0, "user", "ok", None)], SAYS)
    engine = api.Engine(spark, m, e, AT())
    new = engine.add_fine(says, "c", lambda text: "```json\n" + json.dumps(facts) + "\n```")
    assert sorted((r.memory, r.memory_type) for r in new.collect()) == [("a new fact", "LongTermMemory"), ("a new fact", "WorkingMemory")]
    kept = {r.id: r.memory for r in engine.memory.collect()}
    assert kept["m1"] == "the new fact of the cube" and "m2" not in kept and kept["m3"] == "of another cube" and len(kept) == 5
    assert engine.edges.where("invalid_at IS NOT NULL").count() == 1
    # a request that the cube holds as a whole is not read again
    known = memory(spark, ("k", "c", "user: please remember all of the things that I say", "LongTermMemory"))
    assert api.Engine(spark, known, e, AT()).add_fine(says, "c", lambda text: json.dumps(facts)).count() == 0


def test_fine_add_by_rule_with_verdicts_and_async_tasks(spark):
    e = spark.createDataFrame([], EDGES)
    lines = [f"I would like to tell you about the thing number {i}" for i in range(3)]
    says = spark.createDataFrame([(1, i, "user", t, None) for i, t in enumerate(lines)], SAYS)
    no = spark.createDataFrame([(lines[1], False)], "memory string, keep boolean")
    engine = api.Engine(spark, memory(spark), e, AT())
    assert {r.memory for r in engine.add_fine(says, "c", verdicts=no).collect()} == {lines[0], lines[2]}
    engine = api.Engine(spark, memory(spark), e, AT())
    (row,) = engine.add(says, "c", "async").collect()
    assert set(row.embedding) == {0.0} and json.loads(engine.queued.first().content) == {"memory_ids": [row.id]}


def test_preferences_lose_what_the_cube_holds(spark):
    m = memory(spark, ("a", "c", "prefers green tea in the morning", "UserMemory"), ("b", "c", "prefers red wine", "LongTermMemory"))
    rows = [("c", "u", "prefers green tea in the morning"), ("c", "u", "prefers red wine"), ("d", "u", "prefers green tea in the morning"), ("c", "u", " "), ("c", "u", "prefers red wine ")]
    found = modes.new_preferences(spark.createDataFrame(rows, "user_name string, user_id string, memory string"), m, AT())
    assert sorted((r.user_name, r.memory) for r in found.collect()) == [("c", "prefers red wine"), ("d", "prefers green tea in the morning")]


def test_the_judge_is_asked_once_a_key_and_a_failure_is_0(spark, tmp_path):
    def judge(q, g, p):
        open(f"{tmp_path}/{q}", "a").write("1")
        if q == "bad":
            raise OSError("down")
        return 1

    a = spark.createDataFrame([("q", "g", "p"), ("q", " g", "p"), ("bad", "g", None), ("held", "g", "p")], "question string, gold string, prediction string")
    cache = a.where("question = 'held'").select(modes.judge_key(F.col("question"), F.col("gold"), F.col("prediction")).alias("key"), F.lit(1).alias("correct"))
    out, held = modes.judged(a, cache, judge)
    assert sorted((r.question, r.correct) for r in out.collect()) == [("bad", 0), ("held", 1), ("q", 1), ("q", 1)]
    assert held.count() == 3 and not (tmp_path / "held").exists() and (tmp_path / "q").read_text() == "1"


def test_one_driver_claims_a_period(spark, tmp_path):
    ran = []
    jobs = {"rank": (100, lambda: ran.append("rank")), "tidy": (250, lambda: ran.append("tidy"))}
    root = str(tmp_path)
    assert [loops.run_due(spark, jobs, root, now) for now in (0, 50, 120, 260)] == [["rank", "tidy"], [], ["rank"], ["rank", "tidy"]]
    assert ran == ["rank", "tidy", "rank", "rank", "tidy"]
    (tmp_path / "taken-000000000003").touch()  # by another driver
    assert loops.run_due(spark, {"taken": (100, lambda: ran.append("x"))}, root, 350) == [] and "x" not in ran


def test_wait_events():
    now, left = [0.0], iter([2, 2, 2, 1, 0])
    sleep = lambda s: now.__setitem__(0, now[0] + 10)
    events = [e["event"] for e in loops.wait(lambda: next(left), clock=lambda: now[0], sleep=sleep)]
    assert events == ["progress", "heartbeat", "progress", "done"]
    now[0] = 0.0
    assert [e["event"] for e in loops.wait(lambda: 1, 5000, clock=lambda: now[0], sleep=sleep)][-1] == "timeout" and now[0] == loops.WAIT_MOST


def test_progress_rows_of_a_stream(spark, tmp_path):
    spark.range(3).write.json(f"{tmp_path}/in")
    q = spark.readStream.schema("id long").json(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert loops.progress(q).agg(F.sum("rows")).first()[0] == 3


def test_status_and_wait_of_the_engine(spark):
    engine = api.Engine(spark, memory(spark), spark.createDataFrame([], EDGES), AT())
    engine.events = spark.createDataFrame([("u", "1", "waiting", 1), ("u", "1", "completed", 2), ("v", "2", "waiting", 1)], "user_id string, item_id string, status string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.user_id, r.completed, r.active) for r in engine.status("u").collect()] == [("u", 1, 0)]
    assert list(engine.wait("u")) == [{"event": "done", "active": 0}]


@pytest.mark.parametrize("value,want", [("0.5", 0.5), ("1.5", 0.0039), ("nan", 0.0039), ("x", 0.0039), ("", 0.0039)])
def test_tunables_out_of_range_fall_back(value, want):
    assert tuning.tunables({"ENGRAM_DECAY_ALPHA": value}).alpha == want
    assert tuning.tunables({"ENGRAM_HALF_LIFE_DAYS": "1"}).alpha == pytest.approx(0.693147, abs=1e-6)


def test_web_rows_without_the_engine_that_fails(spark):
    def down(q):
        raise OSError

    one = [("u1", "title", "text"), ("u2", "", " "), ("u3", "", "only text")]
    rows = web.web_rows(spark, "what", {"meta": lambda q: one, "direct": lambda q: [("u3", "t", "c")], "other": down}).orderBy(F.desc("score")).collect()
    assert [(r.id, r.memory) for r in rows] == [("u3", "t\nc"), ("u1", "title\ntext")]
    assert rows[0].score == pytest.approx(1 / 63 + 1.2 / 61)


def test_read_later_names_working_rows_only(spark):
    rows = ingest.node_pairs(spark.createDataFrame([("c", "a", "UserMemory")], "user_name string, memory string, memory_type string"))
    assert [r.item_id[:6] for r in ingest.read_later(rows).collect()] == ["read-w"]


def test_backfill_of_each_list_and_context_order(spark):
    items = spark.createDataFrame([(q, f"{q}{i}", 0.9 if (q, i) == (1, 0) else 0.1, False, i) for q in (1, 2) for i in range(5)], "q int, id string, score double, outer boolean, ord int")
    both = search.chat_backfill(items, by=("q",))
    assert sorted((r.q, r.id) for r in both.collect()) == [(q, f"{q}{i}") for q in (1, 2) for i in range(3)]
    one = search.chat_backfill(items.where("q = 1").drop("q"))
    assert sorted(r.id for r in one.collect()) == ["10", "11", "12"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_context_takes_the_best_rows_of_all_buckets(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    engine = api.Engine(spark, t.memory, t.edges, F.timestamp_seconds(F.lit(AS_OF)))
    request = {"query": "the thing", "vector": tuple(t.vector()), "cubes": (CUBE,), "top_k": 4}
    found = sorted(((-r.score, r.id) for r in engine.search(request).collect()))
    assert [r.id for r in engine.context(request, 2.0).orderBy("ord").collect()] == [i for _, i in found[:3]]
    assert engine.context(request, -1.0).count() == len(found)
