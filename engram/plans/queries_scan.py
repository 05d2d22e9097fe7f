"""Scans, filters, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text
from engram.operators import filters, graph, search, store
from engram.plans.adapter import AS_OF, CUBE, EPOCH, cte
from engram.plans.registry import query
from engram.sources import tables

M = cte("memory")
ME = cte("memory", "edges")
ACTIVE = f"user_name = '{CUBE}' AND status = 'activated'"
NINE = "user_name = 'src9' AND status = 'activated'"


@query("src01_memory_scan", M + f"SELECT id, user_name, memory_type, length(memory)::INTEGER AS n FROM memory WHERE {ACTIVE}")
def _(t):
    return t.memory.where(filters.scope(CUBE)).select("id", "user_name", "memory_type", F.length("memory").alias("n"))


@query("src02_point_lookup", M + "SELECT id, memory FROM memory WHERE id = 'm7' AND status = 'activated' LIMIT 1")
def _(t):
    return store.point(t.memory, "m7").select("id", "memory")


@query("src03_multi_get", M + "SELECT id, user_name, memory FROM memory WHERE id IN ('m3', 'm5', 'm8', 'zz')")
def _(t):
    ids = t.spark.createDataFrame([("m3",), ("m5",), ("m8",), ("zz",), ("m3",)], "id string")
    return tables.multi_get(t.memory, ids).select("id", "user_name", "memory")


@query("src04_request_order", M + "SELECT pos::INTEGER AS pos, id, user_name FROM (VALUES (0, 'm9'), (1, 'zz'), (2, 'm1'), (3, 'm4')) AS v(pos, want), memory WHERE id = want")
def _(t):
    return tables.get_in_order(t.memory, t.spark, ["m9", "zz", "m1", "m4"]).select("pos", "id", "user_name")


@query("src05_by_key", M + f"SELECT id, key FROM memory WHERE {ACTIVE} AND key = 'en/{CUBE}' ORDER BY id LIMIT 1")
def _(t):
    return tables.by_key(t.memory, CUBE, f"en/{CUBE}").select("id", "key")


@query("src06_list_prefix", M + f"SELECT id, key, length(memory)::INTEGER AS n_chars FROM memory WHERE {ACTIVE} AND key LIKE 'e%' ORDER BY key, id LIMIT 20 OFFSET 5")
def _(t):
    return tables.list_prefix(t.memory, CUBE, "e", 20, 5)


@query("src07_paged_scan", M + f"SELECT id, created_s FROM memory WHERE {ACTIVE} AND memory_type IN ('LongTermMemory', 'UserMemory', 'SkillMemory') ORDER BY created_s DESC, id DESC LIMIT 10 OFFSET 10")
def _(t):
    p, _ = tables.page(t.memory, CUBE, ["LongTermMemory", "UserMemory", "SkillMemory"], 1, 10)
    return p.select("id", F.unix_timestamp("created_at").alias("created_s"))


@query("src07_page_total", M + f"SELECT count(*) AS total FROM memory WHERE {ACTIVE} AND memory_type IN ('LongTermMemory', 'UserMemory')")
def _(t):
    return tables.page(t.memory, CUBE, ["LongTermMemory", "UserMemory"])[1]


@query("src09_working_newest", M + "SELECT id, updated_s AS ts FROM memory WHERE user_name = 'src3' AND status = 'activated' AND memory_type = 'WorkingMemory' ORDER BY updated_s DESC, id LIMIT 5")
def _(t):
    return tables.working(t.memory, "src3", 5).select("id", "ts")


@query("src10_tier_scan", M + "SELECT id, user_name FROM memory WHERE hierarchy_level = 'episodic' AND embedding IS NOT NULL AND status = 'activated' AND user_name = 'src1' ORDER BY created_s DESC, id LIMIT 10")
def _(t):
    return tables.tier(t.memory, "src1", "episodic", 10).select("id", "user_name")


@query("src11_session_neighbours", M + "SELECT id, session_id FROM memory WHERE user_name = 'src1' AND session_id = 's0' AND memory_type IN ('LongTermMemory', 'UserMemory') ORDER BY created_s DESC, id LIMIT 20")
def _(t):
    return tables.session_neighbours(t.memory, "src1", "s0", 20).select("id", "session_id")


@query("src12_filtered_scan", M + f"SELECT id FROM memory WHERE status = 'activated' AND user_name IN ('{CUBE}', 'src1') AND list_contains(tags, 'en') AND created_s > {EPOCH + 36000} ORDER BY id LIMIT 100")
def _(t):
    f = {"and": [{"tags": {"contains": "en"}}, {"created_at": {"gt": "2023-01-01 10:00:00"}}]}
    return tables.filtered(t.memory, [CUBE, "src1"], f).select("id")


@query("src14_vector_cache", M + """SELECT user_name, id, updated_s AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY updated_s DESC, id) AS r FROM memory
 WHERE memory_type = 'WorkingMemory' AND status = 'activated' AND embedding IS NOT NULL) WHERE r <= 2""")
def _(t):
    return tables.vector_cache(t.memory, 2).select("user_name", "id", "ts")


@query("src16_bulk_upsert", M + "SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE user_name END AS user_name FROM memory UNION ALL SELECT 'n1', 'new'")
def _(t):
    m = t.memory.select("doc_id", "id", "user_name")
    new = m.where("doc_id % 10 = 0").select("id", F.lit("new").alias("user_name")).unionByName(t.spark.createDataFrame([("n1", "new")], "id string, user_name string"))
    return store.upsert(m.select("id", "user_name"), new, ["id"])


@query("src17_bulk_edges", ME + """SELECT relation, count(*) AS n, sum(confidence) AS total FROM (SELECT from_id, to_id, relation, round(confidence, 6) AS confidence FROM edges
 UNION ALL SELECT DISTINCT 'm' || doc_id, 'm' || (doc_id % 5), 'SUPPORTS', 1.0::DOUBLE FROM memory WHERE doc_id >= 5) GROUP BY relation""")
def _(t):
    i = F.col("doc_id")
    new = t.raw("documents").select(F.concat(F.lit("m"), i).alias("from_id"), F.concat(F.lit("m"), i % 5).alias("to_id"), F.lit("SUPPORTS").alias("relation"), (i + 2.0).alias("confidence"))
    out = graph.upsert_edges(t.edges, new.unionByName(t.edges.select("from_id", "to_id", "relation", "confidence").where("relation = 'RELATED'").where("from_id <> to_id")))
    return out.groupBy("relation").agg(F.count("*").alias("n"), F.sum(F.round("confidence", 6)).alias("total"))


F_CASES = {
    "f01_equals": ({"user_id": "u1"}, "user_id = 'u1'"),
    "f03_compare": ({"confidence": {"gte": 0.5}, "created_at": {"lt": "2023-01-05"}}, f"confidence >= 0.5 AND created_s < {EPOCH + 4 * 86400}"),
    "f04_contains": ({"tags": {"contains": "b3"}}, "list_contains(tags, 'b3')"),
    "f05_in": ({"tags": {"in": ["de", "b1"]}}, "list_has_any(tags, ['de', 'b1'])"),
    "f05_in_scalar": ({"user_id": {"in": ["u0", "u2"]}}, "user_id IN ('u0', 'u2')"),
    "f05_in_empty": ({"user_id": {"in": []}}, "false"),
    "f06_like": ({"key": {"like": "n/src1"}}, "contains(key, 'n/src1')"),
    "f07_or": ({"or": [{"type": "UserMemory", "user_id": "u1"}, {"key": "fr/src7"}]}, "memory_type = 'UserMemory' OR user_id = 'u1' OR key = 'fr/src7'"),
    "f07_and": ({"and": [{"type": "UserMemory"}, {"user_id": "u1"}]}, "memory_type = 'UserMemory' AND user_id = 'u1'"),
    "f08_info": ({"info.lang": "es", "info.size": {"gt": 500}}, "info_lang = 'es' AND info_size > 500"),
}
for _name, (_filter, _sql) in F_CASES.items():
    query(_name, M + f"SELECT id FROM memory WHERE coalesce({_sql}, false)")(lambda t, f=_filter: t.memory.where(filters.compile_filter(f)).select("id"))


@query("f09_scope", M + f"SELECT id FROM memory WHERE {ACTIVE} AND user_id = 'u0' AND memory_type IN ('LongTermMemory', 'WorkingMemory', 'UserMemory') AND agent_id = 'a0' AND embedding IS NOT NULL")
def _(t):
    return t.memory.where(filters.scope(CUBE, "u0", ["LongTermMemory", "WorkingMemory", "UserMemory"], "a0", True)).select("id")


PHRASES = ["what did I do today", "last week plans", "this month", "last quarter", "seen recently", "nothing here", "что было вчера", "план на прошлой неделе"]
DAYS = [1, 7, 30, 90, 30, 0, 1, 7]


@query("f02_array_equals", M + "SELECT id FROM memory WHERE CASE WHEN doc_id % 2 = 0 THEN [tags[1]] ELSE tags END = ['en']")
def _(t):
    one = F.when(F.col("doc_id") % 2 == 0, F.slice("tags", 1, 1)).otherwise(F.col("tags"))
    return t.memory.withColumn("tags", one).where(filters.compile_filter({"tags": "en"})).select("id")


@query("f10_temporal", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {d}" for i, d in enumerate(DAYS)) + " END::INTEGER AS days FROM documents")
def _(t):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 8).cast("int"))
    return t.raw("documents").select("doc_id", text.temporal_days(F.concat("text", F.lit(" "), phrase)).alias("days"))


@query("f10_cutoff", M + f"SELECT id FROM memory WHERE {ACTIVE} AND created_s >= {EPOCH + 40 * 86400} - 30 * 86400")
def _(t):
    import datetime as dt

    at = dt.datetime.fromtimestamp(EPOCH + 40 * 86400, dt.timezone.utc)
    return t.memory.where(filters.scope(CUBE, as_of=at, days=30)).select("id")


@query("f12_preference_quality", M + "SELECT id FROM memory WHERE memory_type = 'PreferenceMemory' AND strlen(trim(memory)) >= 30 AND NOT regexp_matches(trim(memory), '(?i)^(user|assistant|system):')")
def _(t):
    return t.memory.where("memory_type = 'PreferenceMemory'").where(search.preference_quality(F.col("memory"))).select("id")


@query("f13_chat_backfill", M + f"""SELECT id, score, outer_ AS outer FROM (SELECT *, count(*) FILTER (score >= 0.95) OVER () AS n_ok, count(*) FILTER (score >= 0.95 AND NOT outer_) OVER () AS n_p,
  row_number() OVER (PARTITION BY outer_ ORDER BY ord) AS place FROM (SELECT id, ((doc_id * 37) % 100) / 100.0::DOUBLE AS score, doc_id % 3 = 0 AS outer_, doc_id AS ord FROM memory WHERE {ACTIVE}))
 WHERE CASE WHEN n_ok < 3 THEN place <= 3 WHEN n_p < 3 THEN score >= 0.95 OR (NOT outer_ AND place > n_p AND place <= 3) ELSE score >= 0.95 END""")
def _(t):
    i = F.col("doc_id")
    items = t.memory.where(filters.scope(CUBE)).select("id", (((i * 37) % 100) / 100.0).alias("score"), (i % 3 == 0).alias("outer"), i.alias("ord"))
    return search.chat_backfill(items, 0.95).drop("ord")


@query("f16_item_projection", M + f"SELECT id, '[' || split_part(id, '-', 1) || ']' AS ref_id, CASE WHEN memory_type = 'SkillMemory' THEN 'skill' WHEN memory_type LIKE 'Tool%' THEN 'tool' WHEN memory_type = 'PreferenceMemory' THEN 'pref' ELSE 'text' END AS bucket, access_count FROM memory WHERE {ACTIVE}")
def _(t):
    return search.item_projection(t.memory.where(filters.scope(CUBE))).drop("memory")


# -- joins ---------------------------------------------------------------------


@query("j01_relation_recall", ME + "SELECT e.from_id, m.id, m.user_name FROM edges e JOIN memory m ON e.to_id = m.id WHERE e.relation = 'RELATED' AND NOT e.dead AND e.from_id IN ('m1', 'm2', 'm3', 'm13')")
def _(t):
    e = graph.live(t.edges).where("relation = 'RELATED'").where(F.col("from_id").isin("m1", "m2", "m3", "m13"))
    return e.join(t.memory, e.to_id == F.col("id")).select("from_id", "id", "user_name")


@query("j02_entity_recall", ME + f"SELECT m.id, e.to_id AS entity_id FROM edges e JOIN memory m ON e.from_id = m.id WHERE e.relation = 'MENTIONS_ENTITY' AND e.to_id IN ('e0', 'e3') AND {ACTIVE}")
def _(t):
    return search.entity_recall(t.edges, t.memory, ["e0", "e3"], filters.scope(CUBE))


@query("j08_tenant_edges", ME + f"SELECT e.from_id, e.to_id, e.relation FROM edges e WHERE NOT dead AND EXISTS (SELECT 1 FROM memory m WHERE m.id = e.from_id AND {NINE}) AND EXISTS (SELECT 1 FROM memory m WHERE m.id = e.to_id AND {NINE})")
def _(t):
    return graph.tenant_edges(t.edges, t.memory, "src9").select("from_id", "to_id", "relation")


@query("j10_keep_newest", M + """SELECT id, user_name FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY updated_s DESC, id) AS r FROM memory WHERE memory_type = 'WorkingMemory') WHERE r <= 3
 UNION ALL SELECT id, user_name FROM memory WHERE memory_type <> 'WorkingMemory'""")
def _(t):
    return store.keep_newest(t.memory, default=3).select("id", "user_name")


@query("j11_hash_exists", M + "SELECT id FROM memory WHERE substr(sha256(lower(trim(memory))), 1, 32) IN (SELECT substr(sha256(lower(trim(memory))), 1, 32) FROM memory WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def _(t):
    h = t.memory.select("doc_id", "id", text.content_hash(F.col("memory")).alias("h"))
    return h.where("doc_id % 2 = 1").join(h.where("doc_id % 2 = 0").select("h"), "h", "left_semi").select("id")


@query("j12_entity_lookup", M + "SELECT DISTINCT 'E' || (doc_id % 20) AS name, user_name FROM memory WHERE lower(trim('E' || (doc_id % 20))) IN ('e1', 'e7')")
def _(t):
    e = t.memory.select(F.concat(F.lit("E"), F.col("doc_id") % 20).alias("name"), "user_name").distinct()
    want = t.spark.createDataFrame([("e1",), ("e7",)], "token string")
    return e.join(F.broadcast(want), F.lower(F.trim("name")) == F.col("token"), "left_semi")


@query("j15_owner_lookup", M + "SELECT id, user_name FROM memory WHERE id IN ('m10', 'm11')")
def _(t):
    return t.memory.where(F.col("id").isin("m10", "m11")).select("id", "user_name")


# -- aggregations --------------------------------------------------------------


@query("a01_count_by_type", M + "SELECT user_name, memory_type, count(*) AS n FROM memory WHERE status = 'activated' GROUP BY ALL")
def _(t):
    return t.memory.where("status = 'activated'").groupBy("user_name", "memory_type").agg(F.count("*").alias("n"))


@query("a02_distinct_cubes", M + "SELECT count(DISTINCT user_name) AS n FROM memory")
def _(t):
    return t.memory.agg(F.countDistinct("user_name").alias("n"))


@query("a03_cubes", M + "SELECT DISTINCT user_name FROM memory ORDER BY 1")
def _(t):
    return t.memory.select("user_name").distinct().orderBy("user_name")


@query("a04_first_seen", M + "SELECT user_id, min(created_s) AS first_s FROM memory GROUP BY user_id")
def _(t):
    return t.memory.groupBy("user_id").agg(F.unix_timestamp(F.min("created_at")).alias("first_s"))


@query("a05_exists", M + f"SELECT count(*) > 0 AS found FROM memory WHERE user_name = '{CUBE}'")
def _(t):
    return t.memory.where(F.col("user_name") == CUBE).limit(1).agg((F.count("*") > 0).alias("found"))


@query("a06_cubes_by_tag", M + "SELECT DISTINCT user_name FROM memory WHERE list_contains(tags, 'b2')")
def _(t):
    return t.memory.where(F.array_contains("tags", "b2")).select("user_name").distinct()


@query("a08_cube_span", M + "SELECT user_name, min(created_s) AS first_s, max(updated_s) AS last_s FROM memory GROUP BY user_name")
def _(t):
    return t.memory.groupBy("user_name").agg(F.unix_timestamp(F.min("created_at")).alias("first_s"), F.unix_timestamp(F.max("updated_at")).alias("last_s"))


@query("a13_edges_by_relation", ME + "SELECT relation, count(*) AS n, count(*) FILTER (dead) AS dead FROM edges GROUP BY relation")
def _(t):
    return t.edges.groupBy("relation").agg(F.count("*").alias("n"), F.count("invalid_at").alias("dead"))


# -- windows, sorts, sets --------------------------------------------------------


@query("w01_list_rank", M + "SELECT id, user_name, row_number() OVER (PARTITION BY user_name ORDER BY importance_score DESC, id)::INTEGER AS rank FROM memory")
def _(t):
    return search.ranked(t.memory.select("id", "user_name", F.col("importance_score").alias("score")), ("user_name",), True).drop("score")


@query("w02_timeline", M + """SELECT from_id, to_id, dt FROM (SELECT id AS from_id, lag(id) OVER w AS to_id, created_s - lag(created_s) OVER w AS dt, doc_id >= 500 OR coalesce(lag(doc_id) OVER w >= 500, false) AS fresh
 FROM memory WINDOW w AS (PARTITION BY session_id ORDER BY created_s, id)) WHERE to_id IS NOT NULL AND fresh""")
def _(t):
    return graph.timeline_edges(t.memory.withColumn("user_name", F.lit("all")), F.col("doc_id") >= 500).select("from_id", "to_id", "dt")


@query("w03_session_partners", M + """SELECT n.id AS from_id, o.id AS to_id FROM (SELECT * FROM memory WHERE doc_id % 10 >= 8) n JOIN (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY created_s DESC, id) AS r
 FROM (SELECT *, 's' || (doc_id // 10) AS sid FROM memory) WHERE doc_id % 10 < 8) o ON o.sid = 's' || (n.doc_id // 10) WHERE o.r <= 3""")
def _(t):
    one = t.memory.withColumn("user_name", F.lit("all"))
    return graph.same_session_edges(one, F.col("doc_id") % 10 >= 8, 3).select("from_id", "to_id")


@query("w09_first_text", M + "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(memory)) ORDER BY importance_score DESC, id) AS r FROM memory WHERE trim(memory) <> '') WHERE r = 1")
def _(t):
    return search.first_by_text(t.memory.withColumn("score", F.col("importance_score")), F.lit(0)).select("id")


@query("w10_last_wins", cte("profiles") + "SELECT cube_id, user_id, topic, sub_topic, arg_max(memo, doc_id) AS memo, min(doc_id) AS pos FROM profiles GROUP BY ALL")
def _(t):
    return store.profile_batch(t.profiles.withColumn("pos", F.col("doc_id")))


@query("t06_nulls_last_offset", M + "SELECT id, updated_s FROM memory ORDER BY updated_s DESC NULLS LAST, id LIMIT 7 OFFSET 3")
def _(t):
    return t.memory.orderBy(F.col("updated_at").desc_nulls_last(), "id").offset(3).limit(7).select("id", F.unix_timestamp("updated_at").alias("updated_s"))


@query("t08_cluster_slices", M + "SELECT id, user_name AS cluster, ((row_number() OVER (PARTITION BY user_name ORDER BY id) - 1) // 6)::INTEGER AS part FROM memory")
def _(t):
    from engram.operators import maintain

    return maintain.split_clusters(t.memory.select("id", F.col("user_name").alias("cluster")))


@query("u01_tag_overlap", M + "SELECT id, len(list_intersect(tags, ['en', 'src1', 'q1', 'b0']))::INTEGER AS overlap FROM memory WHERE status = 'activated' AND len(list_intersect(tags, ['en', 'src1', 'q1', 'b0'])) >= 2")
def _(t):
    return search.tag_recall(t.memory, ["en", "src1", "q1", "b0"], F.col("status") == "activated").select("id", "overlap")


@query("u03_union_max", M + "SELECT id, max(s) AS score, min(o)::INTEGER AS ord FROM (SELECT id, importance_score AS s, 0 AS o FROM memory WHERE doc_id % 2 = 0 UNION ALL SELECT id, pagerank, 1 FROM memory WHERE doc_id % 3 = 0) GROUP BY id")
def _(t):
    a = t.memory.where("doc_id % 2 = 0").select("id", F.col("importance_score").alias("score"))
    b = t.memory.where("doc_id % 3 = 0").select("id", F.col("pagerank").alias("score"))
    return search.union_max(a, b)


@query("u07_exclude", M + "SELECT id FROM memory WHERE doc_id % 3 <> 0")
def _(t):
    return t.memory.select("id").join(t.memory.where("doc_id % 3 = 0").select("id"), "id", "left_anti")


@query("u08_fill_up", M + f"SELECT id, score FROM (SELECT id, pagerank AS score, 0 AS o FROM memory WHERE {ACTIVE} AND doc_id % 3 = 0 UNION ALL SELECT id, pagerank, 1 FROM memory WHERE {ACTIVE} AND doc_id % 3 <> 0) ORDER BY o, score DESC, id LIMIT 10")
def _(t):
    m = t.memory.where(filters.scope(CUBE)).select("doc_id", "id", F.col("pagerank").alias("score"))
    return search.fill_up(m.where("doc_id % 3 = 0").drop("doc_id"), m.drop("doc_id"), 10)


@query("x16_canary", M + "SELECT DISTINCT user_id, ('0x' || substr(sha256(user_id), 1, 8))::BIGINT % 100 AS bucket FROM memory")
def _(t):
    return t.memory.select("user_id").distinct().select("user_id", text.canary_bucket(F.col("user_id")).alias("bucket"))


@query("relational_pricing", """SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def _(t):
    lines = t.raw("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("relational_top_orders", """SELECT n_name, o_orderkey, o_totalprice FROM (SELECT n_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS r
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3""")
def _(t):
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 3").select("n_name", "o_orderkey", "o_totalprice")
