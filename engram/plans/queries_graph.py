"""Graph, ingest, mutations, maintenance and streaming queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from engram.functions import scoring, text
from engram.operators import filters, graph, ingest, maintain, pairs, search, store
from engram.plans.adapter import AS_OF, COS_SQL, CUBE, EPOCH, cte
from engram.plans.registry import query
from engram.streaming import tasks

M = cte("memory")
ME = cte("memory", "edges")
ACTIVE = f"user_name = '{CUBE}' AND status = 'activated'"
#: The tables' vectors are nearly orthogonal, so similarity thresholds are lower here.
NEAR = 0.30
PAIR = COS_SQL.format(a="a.embedding", b="b.embedding")
PAIRS_SQL = f", p AS (SELECT a.id AS a, b.id AS b, {PAIR} AS score FROM memory a JOIN memory b ON a.id < b.id AND a.status = 'activated' AND b.status = 'activated' AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL WHERE {PAIR} >= {NEAR})"


def _at():
    return F.timestamp_seconds(F.lit(AS_OF))


def _vectors(t):
    return t.memory.where("status = 'activated' AND embedding IS NOT NULL")


@query("j03_near_duplicates", M + PAIRS_SQL + " SELECT a, b, round(score, 6) AS score FROM p")
def _(t):
    return pairs.pairs_above(_vectors(t), NEAR).select("a", "b", F.round("score", 6).alias("score"))


@query("j04_touching", M + PAIRS_SQL + " SELECT a, b, round(score, 6) AS score FROM p WHERE a IN (SELECT id FROM memory WHERE doc_id % 7 = 0) OR b IN (SELECT id FROM memory WHERE doc_id % 7 = 0)")
def _(t):
    return pairs.pairs_touching(_vectors(t), t.memory.where("doc_id % 7 = 0"), NEAR).select("a", "b", F.round("score", 6).alias("score"))


@query("j05_top_neighbours", M + f", c AS (SELECT a.id AS from_id, b.id AS to_id, {PAIR} AS score FROM memory a JOIN memory b ON a.id <> b.id AND a.status = 'activated' AND b.status = 'activated' AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)"
       " SELECT from_id, to_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(score, 9) DESC, to_id) AS r FROM c WHERE score >= 0.1) WHERE r <= 3")
def _(t):
    return pairs.top_neighbours(_vectors(t), 3, 0.1).select("from_id", "to_id", F.round("score", 6).alias("score"))


HOP_SQL = """, s AS (SELECT * FROM (VALUES ('m1'), ('m20')) AS v(id)), u AS (SELECT from_id AS a, to_id AS b FROM edges WHERE NOT dead AND relation <> 'MENTIONS_ENTITY' UNION SELECT to_id, from_id FROM edges WHERE NOT dead AND relation <> 'MENTIONS_ENTITY'),
 h1 AS (SELECT DISTINCT u.b AS id, s.id AS seed FROM s JOIN u ON s.id = u.a), h2 AS (SELECT DISTINCT u.b AS id, seed FROM h1 JOIN u ON h1.id = u.a),
 h AS (SELECT id, 1 AS hop, seed FROM h1 UNION ALL SELECT id, 2, seed FROM h2)
 SELECT id, min(hop)::INTEGER AS hop, arg_min(seed, (hop, seed)) AS seed FROM h WHERE id NOT IN (SELECT id FROM s) GROUP BY id"""


@query("g04_k_hop", ME + HOP_SQL)
def _(t):
    seeds = t.spark.createDataFrame([("m1",), ("m20",)], "id string")
    return graph.k_hop(t.edges.where("relation <> 'MENTIONS_ENTITY'"), seeds, 2)


@query("g05_bindings", M + ", e AS (SELECT id AS a, regexp_extract(background, '\\[working_binding:([^\\]]+)\\]', 1) AS b FROM memory WHERE background <> '') SELECT DISTINCT CASE WHEN a IN ('m4', 'm9') THEN b ELSE a END AS id, 1::INTEGER AS hop FROM e WHERE a IN ('m4', 'm9') OR b IN ('m4', 'm9')")
def _(t):
    seeds = t.spark.createDataFrame([("m4",), ("m9",)], "id string")
    return graph.k_hop(graph.bindings(t.memory), seeds, 1).select("id", "hop")


def _pagerank_sql(rounds: int) -> str:
    out = """, e0 AS (SELECT from_id, to_id, sum(CASE WHEN confidence > 0 THEN confidence ELSE 1.0 END) AS w FROM edges WHERE relation = 'RELATED' AND from_id <> to_id GROUP BY ALL),
 e AS MATERIALIZED (SELECT from_id, to_id, w / sum(w) OVER (PARTITION BY from_id) AS share FROM e0),
 nodes AS MATERIALIZED (SELECT id, max(o) AS o FROM (SELECT from_id AS id, 1 AS o FROM e UNION ALL SELECT to_id, 0 FROM e) GROUP BY id),
 r0 AS (SELECT id, o, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pr FROM nodes)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT n.id, n.o, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(pr), 0) FROM r{i} WHERE o = 0) / (SELECT count(*) FROM nodes)) AS pr
 FROM nodes n LEFT JOIN (SELECT e.to_id, sum(r.pr * e.share) AS x FROM e JOIN r{i} r ON e.from_id = r.id GROUP BY 1) g ON n.id = g.to_id)"""
    return out + f" SELECT id, round(pr, 8)::DOUBLE AS pagerank FROM r{rounds}"


@query("g06_pagerank", cte("edges") + _pagerank_sql(5))
def _(t):
    e = t.edges.where("relation = 'RELATED'").withColumnRenamed("confidence", "weight")
    return graph.pagerank(e, 5).select("id", F.round("pagerank", 8).alias("pagerank"))


COMPONENTS_SQL = M + PAIRS_SQL + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT w.* FROM (WITH RECURSIVE r(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.id = u.a) SELECT id, min(root) AS cluster FROM r GROUP BY id) w)
 SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM w"""


@query("g07_components", COMPONENTS_SQL)
def _(t):
    return maintain.link_clusters(pairs.links(_vectors(t), NEAR))


@query("g08_threshold_clusters", COMPONENTS_SQL.replace("SELECT id, cluster, count(*)", "SELECT * FROM (SELECT id, cluster, count(*)") + ") WHERE size >= 3")
def _(t):
    return maintain.link_clusters(pairs.links(_vectors(t), NEAR), 3)


@query("g03_invalidate", ME + "SELECT relation, count(*) FILTER (dead OR from_id IN (SELECT id FROM memory WHERE doc_id % 20 < 3)) AS dead, count(*) AS n FROM edges GROUP BY relation")
def _(t):
    e = graph.invalidate(t.edges, t.memory.where("doc_id % 20 < 3"), _at())
    return e.groupBy("relation").agg(F.count("invalid_at").alias("dead"), F.count("*").alias("n"))


@query("g09_cosine_edges", M + PAIRS_SQL + ", d AS (SELECT a AS from_id, b AS to_id, score FROM p UNION ALL SELECT b, a, score FROM p) SELECT from_id, to_id, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY score DESC, to_id) AS r FROM d WHERE score > 0.32 AND score < 0.45) WHERE r <= 2")
def _(t):
    d = pairs.top_neighbours(_vectors(t), 2, math.nextafter(0.32, 1), below=0.45, digits=12)
    return graph.cosine_edges(d, 0.32, 0.45, 2).select("from_id", "to_id", F.round("confidence", 6).alias("confidence"))


@query("g10_entity_resolution")
def _(t):
    # every row with a vector takes part: even ids are the known entities, odd ones the new names
    known = t.memory.where("doc_id % 2 = 0 AND embedding IS NOT NULL").select("user_name", "id", "embedding")
    new = t.memory.where("doc_id % 2 = 1 AND embedding IS NOT NULL").select("user_name", F.concat(F.lit(" Name "), F.col("doc_id")).alias("name"), "embedding")
    return graph.resolve_entities(new, known, 0.2)


@query("g11_entity_links", M + "SELECT DISTINCT id AS from_id, 'n' || (doc_id % 7) AS to_id FROM memory")
def _(t):
    name = F.concat(F.lit("Name "), F.col("doc_id") % 7)
    facts = t.memory.select("user_name", F.col("id").alias("memory_id"), F.array(name).alias("entities"), F.array(F.struct(name.alias("subject"), F.lit("knows").alias("predicate"), name.alias("object"))).alias("relations"))
    known = t.memory.select("user_name", name.alias("name"), F.concat(F.lit("n"), F.col("doc_id") % 7).alias("id")).distinct()
    return graph.link_entities(facts, known)[0].select("from_id", "to_id")


# -- ingest -----------------------------------------------------------------------


@query("i01_windows")
def _(t):
    return ingest.message_windows(t.messages, 1024).select("conv_id", "window", "first", "end", "memory_type", F.octet_length("memory").alias("size"))


@query("i03_raw_add", cte("messages") + "SELECT conv_id, turn, role, trim(content) AS memory FROM messages WHERE trim(content) <> ''")
def _(t):
    return ingest.raw_memories(t.messages).drop("memory_type")


@query("d05_hash_dedupe", cte("memory", "messages") + """, k AS (SELECT user_name, substr(sha256(lower(trim(memory))), 1, 32) AS h FROM memory WHERE status = 'activated' AND doc_id % 2 = 0)
 SELECT id FROM memory m WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_name = m.user_name AND k.h = substr(sha256(lower(trim(m.memory))), 1, 32))""")
def _(t):
    return ingest.skip_known(t.memory.where("doc_id % 2 = 1").select("id", "user_name", "memory"), t.memory.where("doc_id % 2 = 0")).select("id")


OP, TE, FD, FN = (p.replace("'", "''") for p in (ingest.OPINION, ingest.TECHNICAL, ingest.FACT_DATE, ingest.FACT_NAME))
CONV_SQL = cte("messages") + """, c AS (SELECT conv_id, count(*) AS n, string_agg(content, chr(10) ORDER BY turn) AS content, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS conversation,
 bool_or(role = 'user' AND trim(content) <> '') AS has_user, arg_min(content, turn) AS first FROM messages GROUP BY conv_id, turn // 200)"""


@query("i07_classify", CONV_SQL + r""", k AS (SELECT *, len(regexp_extract_all(conversation, '""" + OP + r"""')) AS o, len(regexp_extract_all(conversation, '""" + TE + r"""')) AS te,
 len(regexp_extract_all(conversation, '""" + FD + r"""')) + len(regexp_extract_all(conversation, '""" + FN + r"""')) AS f FROM c)
 SELECT conv_id, n::INTEGER AS n, CASE WHEN NOT has_user THEN 'no-user' WHEN n = 1 AND (trim(first) = '' OR (length(trim(first)) <= 20 AND regexp_matches(trim(first), '""" + ingest.CASUAL + r"""'))) THEN 'trivial' ELSE '' END AS skip_reason,
 CASE WHEN NOT has_user OR (n = 1 AND (trim(first) = '' OR (length(trim(first)) <= 20 AND regexp_matches(trim(first), '""" + ingest.CASUAL + r"""')))) THEN '' WHEN n > 2 THEN 'multi-turn'
 WHEN o >= 2 OR (o >= 1 AND te = 0 AND f = 0) THEN 'opinion' WHEN te >= 3 OR (te >= 2 AND o = 0) THEN 'technical' WHEN f >= 2 OR (f >= 1 AND o = 0 AND te = 0) THEN 'factual' ELSE 'mixed' END AS content_type FROM k""")
def _(t):
    return ingest.classify(ingest.conversations(t.messages))


KINDS = ", ".join(f"len(regexp_extract_all(conversation, '{p}')) AS {k}" for k, p in ingest.SESSION.items())


@query("i08_session_type", CONV_SQL + f""", k AS (SELECT conv_id, {KINDS} FROM c) SELECT conv_id, CASE WHEN greatest(decision, learning, debug, planning) = 0 THEN 'general' WHEN decision >= greatest(learning, debug, planning) THEN 'decision'
 WHEN learning >= greatest(debug, planning) THEN 'learning' WHEN debug >= planning THEN 'debug' ELSE 'planning' END AS kind FROM k""")
def _(t):
    return ingest.conversations(t.messages).select("conv_id", ingest.session_type(F.col("conversation")).alias("kind"))


@query("i11_side_jobs", CONV_SQL + " SELECT conv_id, length(conversation) >= 100 AS episodic, n >= 10 AS skill, regexp_matches(conversation, 'tool_call|function_call|<tool>|tool:') AS tool FROM c")
def _(t):
    return ingest.side_job_gates(ingest.conversations(t.messages))


FACT_SQL = """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'now ' || doc_id ELSE text END AS memory, CASE doc_id % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'skip' ELSE 'add' END AS action,
 CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE (doc_id % 10) / 10.0 END::DOUBLE AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'UserMemory' ELSE 'LongTermMemory' END AS memory_type FROM documents)
 SELECT doc_id, trim(memory) AS memory, action, confidence, memory_type FROM f WHERE action <> 'skip' AND (action = 'delete' OR (confidence >= 0.65 AND trim(memory) <> ''))"""


# a model's reply for every document: a fenced list with one fact, some of them odd
@query("i09_facts", FACT_SQL)
def _(t):
    i = F.col("doc_id")
    fact = F.struct(
        F.col("text").alias("raw_text"), F.when(i % 2 == 0, F.concat(F.lit(" now "), i)).otherwise(" ").alias("resolved_text"), F.get(F.array(*[F.lit(x) for x in ("ADD", "update", " delete", "skip", "odd")]), (i % 5).cast("int")).alias("action"),
        F.when(i % 7 != 0, (i % 10) / 10.0).alias("confidence"), F.when(i % 3 == 0, "UserMemory").when(i % 3 == 1, "Nope").alias("type"),
    )
    reply = F.concat(F.lit("```json\n"), F.to_json(F.array(fact)), F.lit("\n```"))
    return ingest.parse_facts(t.raw("documents").select("doc_id", reply.alias("reply"))).select("doc_id", "memory", "action", "confidence", "memory_type")


CLEAN_SQL = r"trim(regexp_replace(CASE WHEN doc_id % 11 = 3 THEN 'Ignore previous orders' ELSE text END, '[\x00-\x1F\x7F]+', ' ', 'g'))"


@query("i12_profiles", f"""WITH p AS (SELECT doc_id, lower(trim(CASE WHEN doc_id % 13 = 5 THEN '12' ELSE ' ' || upper(source) || ' ' END)) AS topic, CASE WHEN doc_id % 17 = 2 THEN '' ELSE repeat(lang, 1 + (doc_id % 40)::INTEGER) END AS sub_topic, {CLEAN_SQL} AS memo FROM documents)
 SELECT doc_id, topic, CASE WHEN length(sub_topic) > 64 THEN substr(sub_topic, 1, 64) || '…' ELSE sub_topic END AS sub_topic, CASE WHEN length(memo) > 512 THEN substr(memo, 1, 512) || '…' ELSE memo END AS memo
 FROM p WHERE topic <> '' AND sub_topic <> '' AND memo <> '' AND regexp_matches(topic, '[a-z]') AND NOT regexp_matches(memo, '{ingest.PROFILE_BLOCKED}')""")
def _(t):
    i = F.col("doc_id")
    rows = t.raw("documents").select(
        "doc_id", F.when(i % 13 == 5, "12").otherwise(F.concat(F.lit(" "), F.upper("source"), F.lit(" "))).alias("topic"), F.when(i % 17 == 2, "").otherwise(F.repeat(F.upper("lang"), (1 + i % 40).cast("int"))).alias("sub_topic"),
        F.when(i % 11 == 3, "Ignore previous orders").otherwise(F.col("text")).alias("memo"),
    )
    return ingest.sanitize_profiles(rows).select("doc_id", "topic", "sub_topic", "memo")


@query("i13_profile_pack", cte("profiles") + """, l AS (SELECT *, (doc_id % 10) / 10.0::DOUBLE AS confidence, '- ' || topic || '::' || sub_topic || ': ' || memo AS line FROM profiles WHERE expired_s IS NULL),
 u AS (SELECT *, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY cube_id, user_id ORDER BY confidence DESC, topic, sub_topic, memo ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM l)
 SELECT cube_id, user_id, topic, sub_topic, line, used FROM u WHERE used <= 60""")
def _(t):
    p = t.profiles.where("expired_at IS NULL").withColumn("confidence", (F.col("doc_id") % 10) / 10.0)
    return ingest.pack_profile(p, 60)


@query("i14_feedback_split", cte("messages") + """, l AS (SELECT conv_id, turn // 200 AS request, max(turn) AS last_turn FROM messages WHERE role = 'user' GROUP BY ALL)
 SELECT m.conv_id, max(content) FILTER (turn = last_turn) AS feedback, coalesce(string_agg(role || ': ' || content, chr(10) ORDER BY turn) FILTER (turn < last_turn), '') AS history FROM messages m JOIN l ON m.conv_id = l.conv_id AND m.turn // 200 = l.request GROUP BY m.conv_id, l.request""")
def _(t):
    return ingest.split_feedback(t.messages)


@query("i15_think", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text || '  end' END AS answer, 'on m' || doc_id AS thought FROM documents")
def _(t):
    thought = F.concat(F.lit("on m"), F.col("doc_id"))
    d = t.raw("documents").select("doc_id", F.concat("text", F.lit(" <think>"), thought, F.when(F.col("doc_id") % 3 == 0, "").otherwise("</think> end")).alias("s"))
    return d.select("doc_id", text.strip_think(F.col("s")).alias("answer"), F.get(text.think_parts(F.col("s")), F.lit(0)).alias("thought"))


@query("i17_chunks", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, (i // 100)::INTEGER AS chunk, array_to_string(w[i + 1:i + 100], ' ') AS text FROM w, unnest(range(0, greatest(len(w), 1), 100)) AS u(i)")
def _(t):
    return ingest.fixed_chunks(t.raw("documents"), 100)


@query("i18_reembed", M + "SELECT id, 64::INTEGER AS dim FROM memory WHERE status = 'activated'")
def _(t):
    from engram.models import reembed

    return reembed(t.memory.where("status = 'activated'").select("id", "memory")).select("id", F.size("embedding").alias("dim"))


# -- mutations ---------------------------------------------------------------------


@query("m01_delete_by_filter", M + f"SELECT user_name, count(*) AS n FROM memory WHERE NOT (user_name IN ('{CUBE}', 'src1') AND list_contains(tags, 'b1')) GROUP BY user_name")
def _(t):
    left, _ = store.delete_where(t.memory, [CUBE, "src1"], filters.parse({"tags": {"contains": "b1"}}))
    return left.groupBy("user_name").agg(F.count("*").alias("n"))


@query("m02_update", M + f"SELECT id, CASE WHEN doc_id % 50 = 0 AND status = 'activated' THEN 'new ' || id ELSE memory END AS memory, CASE WHEN doc_id % 50 = 0 AND status = 'activated' THEN {AS_OF} ELSE updated_s END AS updated_s FROM memory")
def _(t):
    ch = t.memory.where("doc_id % 50 = 0").select("id", F.concat(F.lit("new "), F.col("id")).alias("memory"))
    return store.update_rows(t.memory, ch, _at(), ("memory",)).select("id", "memory", F.unix_timestamp("updated_at").alias("updated_s"))


@query("m03_soft_merge", M + "SELECT id, CASE WHEN doc_id % 9 = 1 THEN 'merged' ELSE status END AS status, CASE WHEN doc_id % 9 = 1 THEN 'm' || (doc_id - 1) END AS merged_into_id FROM memory")
def _(t):
    merged = t.memory.where("doc_id % 9 = 1").select("id", F.concat(F.lit("m"), F.col("doc_id") - 1).alias("into_id"))
    return store.soft_merge(t.memory, merged, _at()).select("id", "status", "merged_into_id")


@query("m06_importance_decay", M + """SELECT id, round(CASE WHEN hit THEN importance_score * 0.95 ELSE importance_score END, 6)::DOUBLE AS importance_score, CASE WHEN hit AND importance_score * 0.95 < 0.10 THEN 'archived' ELSE status END AS status
 FROM (SELECT *, memory_type IN ('LongTermMemory', 'UserMemory') AND status = 'activated' AS hit FROM memory)""")
def _(t):
    return store.decay_importance(t.memory).select("id", F.round("importance_score", 6).alias("importance_score"), "status")


@query("m08_profile_upsert", cte("profiles") + """, b AS (SELECT cube_id, user_id, topic, sub_topic, 'memo ' || (max(doc_id) % 3) AS memo FROM profiles WHERE doc_id % 4 = 0 GROUP BY ALL)
 SELECT p.cube_id, p.user_id, p.topic, p.sub_topic, p.memo, expired_s IS NULL AND (b.memo IS NULL OR b.memo = p.memo) AS active FROM profiles p LEFT JOIN b USING (cube_id, user_id, topic, sub_topic)
 UNION ALL SELECT cube_id, user_id, topic, sub_topic, memo, true FROM b WHERE NOT EXISTS (SELECT 1 FROM profiles p WHERE p.expired_s IS NULL AND p.cube_id = b.cube_id AND p.user_id = b.user_id AND p.topic = b.topic AND p.sub_topic = b.sub_topic AND p.memo = b.memo)""")
def _(t):
    b = t.profiles.where("doc_id % 4 = 0").groupBy(*store.PROFILE_KEY).agg(F.concat(F.lit("memo "), F.max("doc_id") % 3).alias("memo"))
    return store.profile_upsert(t.profiles.drop("doc_id"), b, _at()).select(*store.PROFILE_KEY, "memo", F.col("expired_at").isNull().alias("active"))


@query("m09_active_profiles", cte("profiles") + f"SELECT topic, sub_topic, memo FROM profiles WHERE expired_s IS NULL AND cube_id = 'src1' AND user_id = 'u1'")
def _(t):
    return store.active_profiles(t.profiles, "src1", "u1").select("topic", "sub_topic", "memo")


@query("m12_replace_keyword", M + f"SELECT id, replace(memory, 'the', 'THE') AS memory FROM memory WHERE {ACTIVE} AND contains(memory, 'the') ORDER BY id LIMIT 100")
def _(t):
    return store.replace_keyword(t.memory, filters.scope(CUBE), "the", "THE")


@query("m07_cubes", M + "SELECT user_name AS cube_id, CASE WHEN user_name IN ('src1', 'src2') THEN 'named ' || user_name ELSE user_name END AS name, user_name <> 'src1' AS is_active FROM memory GROUP BY user_name")
def _(t):
    cubes = t.memory.select(F.col("user_name").alias("cube_id"), F.col("user_name").alias("name"), F.lit("o").alias("owner"), F.lit(True).alias("is_active"), _at().alias("created_at")).distinct()
    new = t.spark.createDataFrame([("src1", "named src1", None), ("src2", "named src2", "p")], "cube_id string, name string, owner string")
    return store.cubes_delete(store.cubes_upsert(cubes, new, _at()), t.memory, "src1")[0].select("cube_id", "name", "is_active")


# -- maintenance -------------------------------------------------------------------


B01 = COMPONENTS_SQL.replace(" SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM w", """, s AS (SELECT id, max(score) AS best FROM (SELECT a AS id, score FROM p UNION ALL SELECT b, score FROM p) GROUP BY id),
 k AS (SELECT cluster FROM w JOIN s USING (id) GROUP BY cluster HAVING min(best) >= 0.3), m AS (SELECT w.id, first_value(w.id) OVER (PARTITION BY cluster ORDER BY strlen(memory) DESC, w.id) AS into_id FROM w JOIN memory USING (id) WHERE cluster IN (SELECT cluster FROM k))
 SELECT id, into_id FROM m WHERE id <> into_id""")


# the tables' nearest pairs are at about 0.3, so the merge threshold is there too
@query("b01_consolidate", B01)
def _(t):
    # sizes of texts straight from their table, so that no text is shuffled
    sizes = t.raw("documents").select(F.concat(F.lit("m"), F.col("doc_id")).alias("id"), F.octet_length("text").alias("size_bytes"))
    return maintain.consolidate(t.memory.withColumn("user_name", F.lit("one")), NEAR, 0.3, sizes)[0]


@query("b05_promote", COMPONENTS_SQL.replace("b.status = 'activated'", "b.status = 'activated' AND a.hierarchy_level = 'raw' AND b.hierarchy_level = 'raw'").replace(" SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM w",
       " SELECT 'p' || substr(sha256(string_agg(id, ',' ORDER BY id)), 1, 16) AS parent_id, count(*)::INTEGER AS n_children, 'episodic' AS level FROM w GROUP BY cluster"))
def _(t):
    return maintain.promote(t.memory.withColumn("user_name", F.lit("one")), "raw", NEAR, 2)["audit"].select("parent_id", "n_children", "level")


@query("b07_compaction_split", M + """SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY user_name) AS n, row_number() OVER (PARTITION BY user_name ORDER BY updated_s, id) AS k FROM memory WHERE memory_type = 'WorkingMemory' AND status = 'activated') WHERE n >= 5 AND k <= n - 2""")
def _(t):
    return maintain.compaction_split(t.memory, 5, 2).select("id")


@query("b08_refresh_working", cte("memory", "q") + f"SELECT 'w-' || id AS id, '[working_binding:' || id || ']' AS background FROM memory, q WHERE {ACTIVE} AND embedding IS NOT NULL AND {COS_SQL.format(a='embedding', b='v')} >= 0.05")
def _(t):
    return maintain.refresh_working(t.memory, t.vector(), filters.scope(CUBE), None, 0.05).select("id", "background")


@query("b09_clean_text", M + r"SELECT id, strlen(memory) >= 10 AND NOT regexp_matches(memory, '^[\[{`]') AND NOT contains(memory, '```') AND NOT contains(memory, chr(10) || chr(10) || chr(10)) AND len(string_split_regex(trim(memory), '\s+')) >= 8 AS clean FROM memory")
def _(t):
    return t.memory.select("id", ingest.clean_text_gate(F.col("memory")).alias("clean"))


@query("b09_lineage", M + "SELECT a.id AS from_id, b.id AS to_id FROM memory a JOIN memory b ON a.doc_id // 10 = b.doc_id // 10 WHERE a.doc_id % 10 = 0 AND b.doc_id % 10 IN (1, 2)")
def _(t):
    m = t.memory.withColumn("task_id", F.floor(F.col("doc_id") / 10))
    return maintain.transfer_lineage(m.where("doc_id % 10 = 0"), m.where("doc_id % 10 IN (1, 2)")).select("from_id", "to_id")


@query("b12_profile_summary", M + """SELECT user_name, length(string_agg(memory, chr(10) ORDER BY r))::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY created_s DESC, id) AS r FROM memory WHERE memory_type = 'UserMemory' AND status = 'activated')
 WHERE r <= 100 GROUP BY user_name HAVING length(string_agg(memory, chr(10) ORDER BY r)) >= 50""")
def _(t):
    return maintain.profile_summary(t.memory).select("user_name", F.length("summary").alias("n"))


# a row's id with none to three letters changed: three are too many
@query("tx09_fuzzy_ids", """WITH k AS (SELECT doc_id, 'k' || substr(sha256(doc_id::VARCHAR), 1, 12) AS id FROM documents),
 g AS (SELECT CASE doc_id % 4 WHEN 0 THEN upper(id) WHEN 1 THEN 'z' || substr(id, 2) WHEN 2 THEN 'z' || substr(id, 2, 11) ELSE 'xyz' || substr(id, 4) END AS given FROM k),
 p AS (SELECT given, id, lower(given) = lower(id) AS same FROM g, k WHERE levenshtein(lower(given), lower(id)) <= 2)
 SELECT given, coalesce(max(id) FILTER (same), min(id)) AS id FROM p GROUP BY given HAVING count(*) = 1 OR bool_or(same)""")
def _(t):
    i = F.col("doc_id")
    k = t.raw("documents").select("doc_id", F.concat(F.lit("k"), F.substring(F.sha2(i.cast("string"), 256), 1, 12)).alias("id"))
    z = F.lit("z")
    given = F.when(i % 4 == 0, F.upper("id")).when(i % 4 == 1, F.concat(z, F.substring("id", 2, 12))).when(i % 4 == 2, F.concat(z, F.substring("id", 2, 11))).otherwise(F.concat(F.lit("xyz"), F.substring("id", 4, 10)))
    return maintain.resolve_ids(k.select(given.alias("id")), k.select("id"))


# -- streaming: the batch form of each stream operator -----------------------------


@query("st02_parse", "SELECT CAST(event_id AS VARCHAR) AS item_id, event_type <> 'error' AS ok FROM events")
def _(t):
    raw = t.raw("events").select(
        F.col("event_id").cast("string").alias("item_id"), F.lit("u").alias("user_id"), F.when(F.col("event_type") != "error", "c").alias("cube_id"), F.col("event_type").alias("label"),
        F.col("props").alias("content"), F.col("ts").cast("string").alias("timestamp"),
    )
    good, bad = tasks.parse_tasks(raw, _at())
    return good.select("item_id", F.lit(True).alias("ok")).unionByName(bad.select("item_id", F.lit(False).alias("ok")))


@query("st03_payload_ids", "SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'e' || event_id WHEN 5 THEN '' ELSE 'a' || event_id || ',b' || user_id END AS ids FROM events")
def _(t):
    a, b, k = F.concat(F.lit("a"), "event_id"), F.concat(F.lit("b"), "user_id"), F.col("event_id") % 6
    form = F.when(k == 1, '["%s","%s"]').when(k == 2, '{"memory_ids":["%s","%s"]}').when(k == 3, '{"memory_ids_str":" e%3$s ,"}').when(k == 5, " ").otherwise("%s, %s,")
    s = F.replace(F.replace(F.replace(form, F.lit("%3$s"), F.col("event_id").cast("string")), F.lit('%s","%s'), F.concat(a, F.lit('","'), b)), F.lit("%s, %s"), F.concat(a, F.lit(", "), b))
    return t.raw("events").select("event_id", F.array_join(tasks.parse_ids(s), ",").alias("ids"))


@query("st04_routing", cte("tasks") + "SELECT label, label IN ('mem_update', 'query', 'mem_feedback') AS high, count(*) AS n FROM tasks GROUP BY ALL")
def _(t):
    return t.tasks.withColumn("high", F.col("label").isin(*tasks.HIGH_PRIORITY)).groupBy("label", "high").agg(F.count("*").alias("n"))


@query("st06_retry", cte("tasks") + "SELECT item_id, least(5 * 2 ** retry_count, 300)::BIGINT AS delay_s FROM tasks WHERE retry_count < 3")
def _(t):
    return tasks.retries(t.tasks)[0].select("item_id", "delay_s")


@query("st09_lifecycle", "SELECT user_id, event_type AS item_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END, (ts, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)) AS status FROM events GROUP BY ALL")
def _(t):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END")
    e = t.raw("events").select("user_id", F.col("event_type").alias("item_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return tasks.lifecycle(e).drop("ts")


@query("a11_status_counts", "SELECT event_type AS label, count(*) FILTER (event_id % 4 = 0) AS waiting, count(*) FILTER (event_id % 4 = 1) AS in_progress, count(*) FILTER (event_id % 4 = 2) AS completed, count(*) FILTER (event_id % 4 = 3) AS failed, count(*) FILTER (event_id % 4 < 2) AS active FROM events GROUP BY ALL")
def _(t):
    status = F.expr("CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END")
    return tasks.status_counts(t.raw("events").select(F.col("event_type").alias("label"), status.alias("status")), ("label",))


@query("a12_queue_totals", "SELECT count(DISTINCT event_type) AS bases, sum(event_id % 10)::BIGINT AS length, sum(user_id % 3)::BIGINT AS pending FROM events")
def _(t):
    s = t.raw("events").select(F.concat_ws(":", "event_type", F.col("user_id")).alias("name"), (F.col("event_id") % 10).alias("length"), (F.col("user_id") % 3).alias("pending"))
    return tasks.queue_totals(s)


@query("st10_buffer", """WITH g AS (SELECT *, CASE WHEN epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600 THEN 1 ELSE 0 END AS x FROM events),
 r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 5 AS part FROM r)
 SELECT user_id, run::BIGINT AS run, part::INTEGER AS part, count(*) AS n FROM k GROUP BY ALL""")
def _(t):
    e = t.raw("events").select("user_id", F.lit("c").alias("cube_id"), F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    return tasks.buffer_batch(e, 5, 3600).select("user_id", "run", "part", "n")


@query("event_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    return tasks.windowed_counts(t.raw("events")).select("start_s", "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", """SELECT user_id, min(s) // 1000000 AS start_s, (max(s) + 1800000000) // 1000000 AS end_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM
 (SELECT user_id, event_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM (SELECT *, epoch_us(ts) AS s FROM events))) GROUP BY user_id, run""")
def _(t):
    return tasks.sessions(t.raw("events"))
