"""Mutations, feedback and task queries beside those of ``queries_graph``."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import hierarchy, maintain, pairs, store, tablelog
from engram.plans.adapter import AS_OF, CUBE, cte
from engram.plans.queries_graph import COMPONENTS_SQL, NEAR, PAIRS_SQL
from engram.plans.registry import query
from engram.schema import FEEDBACK_LABELS, HIGH_PRIORITY
from engram.session import scratch_path
from engram.streaming import tasks

M, ME = cte("memory"), cte("memory", "edges")


def _d():
    return F.col("doc_id")


def _at():
    return F.timestamp_seconds(F.lit(AS_OF))


def _m(n):
    return F.concat(F.lit("m"), n)


@query("j09_score_writeback", M + "SELECT id, CASE WHEN doc_id % 3 = 0 THEN least(greatest((doc_id - 10) / 50.0, 0), 1) ELSE pagerank END::DOUBLE AS pagerank FROM memory")
def _(t):
    ranks = t.memory.where(_d() % 3 == 0).select("id", ((_d() - 10) / 50.0).alias("pagerank"))
    return maintain.write_pagerank(t.memory, ranks).select("id", "pagerank")


@query("a10_cluster_scores", M + PAIRS_SQL + ", b AS (SELECT id, max(score) AS best FROM (SELECT a AS id, score FROM p UNION ALL SELECT b, score FROM p) GROUP BY id) SELECT 'c' || (doc_id % 10) AS cluster, round(min(best), 6) AS min_score FROM memory JOIN b USING (id) GROUP BY ALL")
def _(t):
    found = pairs.links(t.memory.where("status = 'activated' AND embedding IS NOT NULL"), NEAR)
    members = t.memory.select("id", F.concat(F.lit("c"), _d() % 10).alias("cluster"))
    return maintain.least_best(found, members).select("cluster", F.round("min_score", 6).alias("min_score"))


@query("m04_set_hierarchy", M + "SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'semantic' ELSE hierarchy_level END AS hierarchy_level, CASE WHEN doc_id % 4 = 0 THEN 'm' || (doc_id % 7) END AS parent_memory_id FROM memory")
def _(t):
    levels = t.memory.where(_d() % 4 == 0).select("id", F.lit("semantic").alias("level"), _m(_d() % 7).alias("parent_id"))
    return store.set_hierarchy(t.memory, levels).select("id", "hierarchy_level", "parent_memory_id")


@query("m05_stored_scores", M + "SELECT id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 9 NOT IN (3, 4) THEN 'm' || (doc_id % 9) END AS neighbour FROM memory")
def _(t):
    entry = F.array(F.struct(_m(_d() % 9).alias("neighbor_id"), F.lit(0.5).cast("float").alias("score")))
    m = store.set_ce_scores(t.memory, t.memory.where(_d() % 5 != 0).select("id", entry.alias("ce_score_topk")))
    return store.clear_neighbour(m, ["m3", "m4"]).select("id", F.get("ce_score_topk", F.lit(0))["neighbor_id"].alias("neighbour"))


LABEL_SQL = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FEEDBACK_LABELS)) + " END"


@query("m10_feedback", f"SELECT event_id, {LABEL_SQL} AS label FROM events")
def _(t):
    label = F.get(F.array(*[F.lit(x) for x in FEEDBACK_LABELS]), (F.col("event_id") % 4).cast("int"))
    e = t.raw("events").select("event_id", label.alias("label"))
    return store.append_feedback(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), FEEDBACK_LABELS)


@query("m13_feedback_ops", M + """SELECT id, user_name, CASE WHEN doc_id % 5 = 0 AND status = 'activated' THEN 'new ' || id ELSE memory END AS memory FROM memory
 UNION ALL SELECT 'f' || substr(sha256(user_name || chr(10) || 'added ' || id), 1, 16), user_name, 'added ' || id FROM memory WHERE doc_id % 5 = 1""")
def _(t):
    op = F.when(_d() % 5 == 0, "update").when(_d() % 5 == 1, "ADD").otherwise("NONE")
    text = F.concat(F.when(_d() % 5 == 1, "added ").otherwise("new "), "id")
    ops = t.memory.select("id", "user_name", op.alias("op"), text.alias("memory"))
    ops = ops.unionByName(ops.where("op = 'update'").withColumn("memory", F.lit("an older text")))  # the greatest wins
    ops = ops.unionByName(ops.where("op = 'ADD'"))
    unknown = ops.select(F.concat(F.lit("x"), "id").alias("id"), "user_name", F.lit("UPDATE").alias("op"), "memory")
    return store.feedback_ops(t.memory, ops.unionByName(unknown), _at()).select("id", "user_name", "memory")


def _facts(t):
    action = F.when(_d() % 6 == 0, "delete").when(_d() % 6 == 1, "update").otherwise("add")
    return t.memory.select(action.alias("action"), F.col("id").alias("target_id"), F.concat(F.lit("now "), "id").alias("memory"))


@query("m14_fact_actions", M + "SELECT id, CASE WHEN doc_id % 6 = 1 AND status = 'activated' THEN 'now ' || id ELSE memory END AS memory FROM memory WHERE doc_id % 6 <> 0")
def _(t):
    return store.apply_fact_actions(t.memory, t.edges, _facts(t), _at())[0].select("id", "memory")


@query("m14_fact_edges", ME + "SELECT relation, count(*) AS n, count(*) FILTER (dead OR from_id IN (SELECT id FROM memory WHERE doc_id % 6 < 2)) AS ended FROM edges GROUP BY relation")
def _(t):
    e = store.apply_fact_actions(t.memory, t.edges, _facts(t), _at())[1]
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.count("invalid_at").alias("ended"))


@query("m15_purge", cte("memory", "profiles") + f"SELECT 'memory' AS name, user_name AS cube, count(*) AS n FROM memory WHERE user_name <> '{CUBE}' GROUP BY ALL UNION ALL SELECT 'profiles', cube_id, count(*) FROM profiles WHERE cube_id <> '{CUBE}' GROUP BY ALL")
def _(t):
    left = store.purge({"memory": t.memory, "profiles": t.profiles}, CUBE)
    count = lambda name, c: left[name].groupBy(F.lit(name).alias("name"), F.col(c).alias("cube")).agg(F.count("*").alias("n"))
    return count("memory", "user_name").unionByName(count("profiles", "cube_id"))


@query("b03_contradicted", ME + """, f AS (SELECT 'm' || doc_id AS keep_id, 'm' || (doc_id + 1) AS bad_id FROM memory WHERE doc_id % 10 = 0),
 e AS (SELECT from_id, to_id, relation, NOT dead AND from_id NOT IN (SELECT bad_id FROM f) AS live FROM edges UNION ALL SELECT keep_id, bad_id, 'CONTRADICTS', true FROM f WHERE (keep_id, bad_id) NOT IN (SELECT (from_id, to_id) FROM edges WHERE relation = 'CONTRADICTS'))
 SELECT relation, count(*) AS n, count(*) FILTER (live) AS live, (SELECT count(*) FROM memory WHERE id NOT IN (SELECT bad_id FROM f)) AS memories FROM e GROUP BY relation""")
def _(t):
    found = t.memory.where(_d() % 10 == 0).select(_m(_d()).alias("keep_id"), _m(_d() + 1).alias("bad_id"))
    m, e = maintain.remove_contradicted(t.memory, t.edges, found, _at())
    left = m.agg(F.count("*").alias("memories"))
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("invalid_at").isNull()).alias("live")).join(F.broadcast(left), F.lit(True))


@query("b09_active_cubes", M + "SELECT DISTINCT user_name FROM memory WHERE status = 'activated'")
def _(t):
    return maintain.active_cubes(t.memory)


HIGH_SQL = "label IN (" + ", ".join(f"'{x}'" for x in HIGH_PRIORITY) + ")"


# the low-priority channel holds 128 tasks
@query("st05_priority", cte("tasks") + f"SELECT item_id FROM tasks ORDER BY {HIGH_SQL} DESC, ts, item_id LIMIT 128")
def _(t):
    return tasks.prioritized(t.tasks.withColumn("high_priority", F.col("label").isin(*HIGH_PRIORITY))).limit(128).select("item_id")


@query("st07_dead_letters", cte("tasks") + "SELECT item_id FROM tasks WHERE retry_count >= 3 ORDER BY ts DESC, item_id LIMIT 1000")
def _(t):
    return tasks.cap_dead_letters(tasks.retries(t.tasks)[1]).select("item_id")


@query("st13_user_status", "SELECT user_id, count(*) FILTER (event_id % 4 = 0) AS waiting, count(*) FILTER (event_id % 4 = 1) AS in_progress, count(*) FILTER (event_id % 4 = 2) AS completed, count(*) FILTER (event_id % 4 = 3) AS failed, count(*) FILTER (event_id % 4 < 2) AS active FROM events GROUP BY ALL")
def _(t):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END")
    e = t.raw("events").select("user_id", F.col("event_id").alias("item_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return tasks.status_counts(tasks.lifecycle(e), ("user_id",))


TREE_SQL = COMPONENTS_SQL.replace("b.status = 'activated'", "b.status = 'activated' AND a.hierarchy_level = 'raw' AND b.hierarchy_level = 'raw' AND NOT contains(a.memory_type, 'Tool') AND NOT contains(b.memory_type, 'Tool') AND a.memory_type NOT IN ('SkillMemory', 'PreferenceMemory') AND b.memory_type NOT IN ('SkillMemory', 'PreferenceMemory')")


# two rounds of a tier: the second must change nothing, and every edge's parent is a row
@query("b13_cycle_twice", TREE_SQL.replace(" SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM w",
       """, k AS (SELECT id, 'p' || substr(sha256('raw:' || cluster), 1, 16) AS parent FROM w)
 SELECT id, status, hierarchy_level, parent AS parent_memory_id, parent AS edge FROM memory LEFT JOIN k USING (id) UNION ALL SELECT DISTINCT parent, 'activated', 'episodic', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM k"""))
def _(t):
    m, e = t.memory.withColumn("user_name", F.lit("one")), t.edges
    for _ in range(2):
        m, e, _audit = hierarchy.grow(m, e, _at(), "raw", NEAR, 2)
    links = e.where(F.col("relation") == hierarchy.RELATION).where("invalid_at IS NULL").select(F.col("from_id").alias("id"), F.col("to_id").alias("edge"))
    return m.join(links, "id", "left").select("id", "status", "hierarchy_level", "parent_memory_id", "edge")


# the table as a log: appended, every fourth row rewritten, every ninth deleted, compacted, and two thirds of those put back
@query("src16_table_log", M + """SELECT id, user_name, CASE WHEN doc_id % 9 = 0 AND doc_id % 3 = 0 THEN 'back ' || id WHEN doc_id % 4 = 0 THEN 'new ' || id ELSE memory END AS memory FROM memory WHERE doc_id % 9 <> 0 OR doc_id % 27 <> 0""")
def _(t):
    log = tablelog.TableLog(t.spark, scratch_path(t.spark, "table-log"))
    m = t.memory.select("id", "user_name", "memory", "doc_id")
    log.append(m)
    log.change(lambda now: now.where("doc_id % 4 = 0").withColumn("memory", F.concat(F.lit("new "), "id")))
    log.delete(m.where("doc_id % 9 = 0"))
    log.compact()
    log.upsert(m.where("doc_id % 9 = 0 AND doc_id % 27 <> 0").withColumn("memory", F.concat(F.lit("back "), "id")))
    return log.read().select("id", "user_name", "memory")
