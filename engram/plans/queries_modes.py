"""Steps that ask a model, with replies made from the tables, and what search puts beside them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import models
from engram.functions import scoring, text
from engram.operators import approx, evalkit, filters, ingest, maintain, modes, pairs, search
from engram.plans.adapter import AS_OF, COS_SQL, CUBE, EPOCH, cte
from engram.plans.queries_graph import HOP_SQL, PAIR
from engram.plans.registry import query
from engram.sources import tables, web

M, MQ = cte("memory"), cte("memory", "q")
COS = COS_SQL.format(a="embedding", b="v")
SCORE_SQL = "((doc_id * 37) % 101) / 100.0::DOUBLE"


def _d():
    return F.col("doc_id")


def _score():
    return ((_d() * 37) % 101) / 100.0


def _id(n, prefix="m"):
    return F.concat(F.lit(prefix), n)


# -- search ---------------------------------------------------------------------

FINE = M + f""", r AS (SELECT doc_id // 25 AS query_id, id, {SCORE_SQL} AS score, doc_id % 3 <> 0 AND row_number() OVER (PARTITION BY doc_id // 25 ORDER BY {SCORE_SQL} DESC, id) <= 20 AS keep FROM memory),
 t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (keep) OVER (PARTITION BY query_id) AS kept FROM r),
 s AS (SELECT *, n >= 3 AND kept > 0 AND 1 - kept / n::DOUBLE > 0.3 AS short FROM t WHERE n < 3 OR kept = 0 OR keep),
 b AS (SELECT query_id, id, score, 0 AS ord FROM s UNION ALL SELECT m.doc_id // 25, m.id, 0.5, 1 FROM memory m WHERE m.doc_id // 25 IN (SELECT query_id FROM s WHERE short) AND (m.doc_id // 25, m.id) NOT IN (SELECT (query_id, id) FROM s))
 SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY ord, score DESC, id)::INTEGER AS rank FROM b) WHERE rank <= 19"""


@query("r12_fine", FINE)
def _(t):
    q = F.floor(_d() / 25).alias("query_id")
    results = t.memory.select(q, "id", _score().alias("score"))
    verdicts = t.memory.select(q, "id", (_d() % 3 != 0).alias("keep"))
    return modes.fine(results, verdicts, t.memory.select(q, "id", F.lit(0.5).alias("score")), 19).select("query_id", "id", "score", "rank")


@query("r14_expand", M + f""", f AS (SELECT doc_id // 25 AS query_id, id, {SCORE_SQL} AS score, 0 AS stage, 0 AS pos, NULL AS phrase FROM memory WHERE doc_id % 5 < 2
 UNION ALL SELECT doc_id // 25, 'm' || (doc_id // 2), {SCORE_SQL}, 1 + doc_id % 2, doc_id % 3, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'p' || (doc_id % 3) END FROM memory),
 o AS (SELECT * FROM f WHERE stage = 0 OR trim(phrase) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY stage, pos, score DESC) = 1)
 SELECT query_id, id, score, stage::INTEGER AS stage, phrase, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM o""")
def _(t):
    q = F.floor(_d() / 25).alias("query_id")
    first = t.memory.where(_d() % 5 < 2).select(q, "id", _score().alias("score"))
    phrase = F.when(_d() % 7 == 0, " ").otherwise(_id(_d() % 3, "p"))
    found = t.memory.select(q, _id(F.floor(_d() / 2)).alias("id"), _score().alias("score"), (1 + _d() % 2).cast("int").alias("stage"), (_d() % 3).cast("int").alias("pos"), phrase.alias("phrase"))
    return modes.expand(first, found)


@query("r15_rewrite", M + """, t AS (SELECT doc_id, id, CASE WHEN doc_id % 2 = 0 THEN memory ELSE array_to_string(tags, ' ') || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE id END END AS query, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'new ' || id END AS rewritten, (doc_id % 10) / 10.0 AS sure FROM memory),
 u AS (SELECT *, doc_id % 11 <> 0 AND strlen(query) <= 400 AND len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) >= 5 AND trim(rewritten) <> '' AND sure >= 0.5 AS used FROM t)
 SELECT id AS query_id, CASE WHEN used THEN rewritten ELSE query END AS query, used FROM u""")
def _(t):
    short = F.concat(F.array_join("tags", " "), F.lit(" "), F.when(_d() % 3 == 0, "").otherwise(F.col("id")))
    queries = t.memory.select(F.col("id").alias("query_id"), F.when(_d() % 2 == 0, F.col("memory")).otherwise(short).alias("query"))
    new = F.when(_d() % 5 == 0, " ").otherwise(F.concat(F.lit("new "), "id"))
    return modes.rewrite_queries(queries, t.memory.where(_d() % 11 != 0).select(F.col("id").alias("query_id"), new.alias("rewritten"), ((_d() % 10) / 10.0).alias("confidence")))


@query("s09_staged", M + """, s AS (SELECT (doc_id // 60) * 2 + (doc_id % 60 >= 57)::INTEGER AS query_id, id, row_number() OVER (PARTITION BY (doc_id // 60) * 2 + (doc_id % 60 >= 57)::INTEGER ORDER BY (doc_id * 7) % 31, id) - 1 AS pos FROM memory WHERE doc_id % 2 = 0),
 t AS (SELECT (m.doc_id // 60) * 2 + (m.doc_id % 60 >= 57)::INTEGER AS query_id, m.id, m.doc_id, s.pos, row_number() OVER (PARTITION BY (m.doc_id // 60) * 2 + (m.doc_id % 60 >= 57)::INTEGER ORDER BY m.doc_id) AS nth, count(*) OVER (PARTITION BY (m.doc_id // 60) * 2 + (m.doc_id % 60 >= 57)::INTEGER) AS n FROM memory m LEFT JOIN s ON m.id = s.id AND s.pos < 10)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n >= 5 AND nth <= 50 AND pos IS NOT NULL AND (query_id % 3 = 0 OR doc_id % 4 = 0) THEN pos END NULLS LAST, nth)::INTEGER AS place FROM t""")
def _(t):
    q = (F.floor(_d() / 60) * 2 + (_d() % 60 >= 57).cast("int")).alias("query_id")  # 57 rows, or three
    results = t.memory.select(q, "id", _d().alias("ord"))
    w = Window.partitionBy("query_id").orderBy((_d() * 7) % 31, "id")
    short = t.memory.where(_d() % 2 == 0).select(q, "id", "doc_id").withColumn("pos", F.row_number().over(w) - 1)
    verdicts = t.memory.select(q, "id", (_d() % 4 == 0).alias("relevant")).where("query_id % 3 <> 0")
    return modes.staged(results, short, verdicts)


HOPS = HOP_SQL.split("\n SELECT id, min(hop)")[0]


@query("r09_multi_hop", cte("memory", "edges", "q").rstrip() + HOPS + f""", k AS (SELECT id, min(hop) AS hop, arg_min(seed, (hop, seed)) AS seed FROM h WHERE id NOT IN (SELECT id FROM s) GROUP BY id),
 n AS (SELECT k.id, coalesce(({COS} + 1) / 2, CASE seed WHEN 'm1' THEN 0.9 ELSE 0.7 END) * pow(0.8, hop) AS score FROM k JOIN memory USING (id), q WHERE status = 'activated' ORDER BY score DESC, id LIMIT 2)
 SELECT id, round(score, 6) AS score FROM (SELECT * FROM n UNION ALL SELECT 'm1', 0.9 UNION ALL SELECT 'm20', 0.7)""")
def _(t):
    seeds = t.spark.createDataFrame([("m1", 0.9), ("m20", 0.7)], "id string, score double")
    return search.multi_hop(seeds, t.edges.where("relation <> 'MENTIONS_ENTITY'"), t.memory, t.vector(), F.col("status") == "activated").select("id", F.round("score", 6).alias("score"))


@query("v03_knn_cutoff", MQ + f"SELECT id, round({COS}, 6)::DOUBLE AS score FROM memory, q WHERE status = 'activated' AND user_name = '{CUBE}' AND embedding IS NOT NULL AND created_s >= {EPOCH + 90 * 3600}")
def _(t):
    where = filters.scope([CUBE]) & (F.col("created_at") >= F.timestamp_seconds(F.lit(EPOCH + 90 * 3600)))
    return search.knn(t.memory, t.vector(), where, None).select("id", F.round("score", 6).alias("score"))


# how many of these rows are the exact ones is tested: SQL has no such index
@query("v05_approx_knn")
def _(t):
    rows = t.memory.select("id", "status", "embedding")
    centroids = approx.fit(rows)
    return approx.knn(approx.indexed(rows, centroids), centroids, t.vector(), F.col("status") == "activated", 10, 20).select("id", F.round("score", 6).alias("score"))


@query("f11_threshold", MQ + f"SELECT id FROM memory, q WHERE status = 'activated' AND user_name = '{CUBE}' AND (({COS} + 1) / 2 >= 0.52 OR memory_type IN ('WorkingMemory', 'PreferenceMemory') AND ({COS} + 1) / 2 >= 0.52 - 0.10)")
def _(t):
    found = search.cosine_rescore(search.knn(t.memory, t.vector(), filters.scope([CUBE]), None), t.memory, t.vector()).join(t.memory.select("id", "memory_type"), "id")
    soft = F.col("memory_type").isin("WorkingMemory", "PreferenceMemory")
    return search.threshold(found.where(~soft), 0.52).unionByName(search.threshold(found.where(soft), 0.52, True)).select("id")


@query("f17_type_split", M + "SELECT id, CASE WHEN memory_type = 'SkillMemory' THEN 'skill' WHEN memory_type IN ('ToolSchemaMemory', 'ToolTrajectoryMemory') THEN 'tool' WHEN memory_type = 'PreferenceMemory' THEN 'pref' ELSE 'text' END AS bucket FROM memory")
def _(t):
    return t.memory.select("id", search.bucket_of(F.col("memory_type")).alias("bucket"))


@query("tx03_or_query", M + "SELECT id, array_to_string(tags, ' | ') AS query FROM memory")
def _(t):
    return t.memory.select("id", text.or_query(F.col("tags")).alias("query"))


AGE = f"greatest(({AS_OF} - updated_s) / 86400.0, 0)"


@query("s04_half_life", M + f"SELECT id, round(CASE WHEN memory_type = 'WorkingMemory' THEN pagerank ELSE 0.75 * pagerank + 0.25 * CASE WHEN {AGE} <= 730 THEN exp(-ln(2) / 30 * {AGE}) ELSE 0 END END, 6)::DOUBLE AS score FROM memory")
def _(t):
    found = t.memory.select("id", F.col("pagerank").alias("score"))
    return search.apply_decay(found, t.memory, F.timestamp_seconds(F.lit(AS_OF)), scoring.half_life_alpha(30)).select("id", F.round("score", 6).alias("score"))


@query("s10_distilled", M + f"""SELECT id, {SCORE_SQL} AS score FROM memory WHERE status = 'activated' UNION ALL SELECT 'enhanced-' || substr(sha256('who'), 1, 12), 1.0::DOUBLE WHERE EXISTS (SELECT 1 FROM memory WHERE status = 'activated' AND {SCORE_SQL} > 0.4)""")
def _(t):
    return models.distilled_answer(t.memory.where("status = 'activated'").select("id", "memory", _score().alias("score")), "who", "an answer").select("id", "score")


@query("s11_replaced_texts", M + "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'better ' || id ELSE memory END AS memory FROM memory")
def _(t):
    better = t.memory.where(_d() % 3 == 0).select("id", F.concat(F.lit("better "), "id").alias("memory"))
    return models.replace_texts(t.memory.select("id", "memory"), better)


@query("src13_preferences", MQ + f"SELECT id, round({COS}, 6)::DOUBLE AS score FROM memory, q WHERE memory_type = 'PreferenceMemory' AND doc_id % 3 <> 0 AND user_id <> 'u1' AND embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 10")
def _(t):
    p = tables.Preferences(t.memory.where("embedding IS NOT NULL").select(F.col("memory_type").alias("collection"), "id", "user_id", "embedding", "doc_id"))
    p = tables.Preferences(p.delete(p.rows.where(_d() % 3 == 0)))
    return tables.Preferences(p.purge("u1")).nearest("PreferenceMemory", t.vector(), 10).select("id", F.round("score", 6).alias("score"))


@query("src19_web", M + """, f AS (SELECT doc_id // 40 AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'meta' ELSE 'direct' END AS source, 1 + (doc_id % 40) // 2 AS rank, 'u' || ((doc_id * 7) % 23) AS url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'about ' || (doc_id % 23) END AS title FROM memory),
 s AS (SELECT query_id, url AS id, sum(CASE source WHEN 'meta' THEN 1.0 ELSE 1.2 END / (rank + 60)) AS score FROM f WHERE title <> '' GROUP BY ALL)
 SELECT * FROM (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def _(t):
    rank = (1 + F.floor((_d() % 40) / 2)).cast("int").alias("rank")
    found = t.memory.select(
        F.floor(_d() / 40).alias("query_id"), F.when(_d() % 2 == 0, "meta").otherwise("direct").alias("source"), rank, _id((_d() * 7) % 23, "u").alias("url"),
        F.when(_d() % 5 == 0, "").otherwise(_id(_d() % 23, "about ")).alias("title"), F.lit("").alias("content"),
    )
    return web.fuse(found).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


# -- ingest ---------------------------------------------------------------------


@query("i05_async_add", M + """SELECT DISTINCT 'read-' || w AS item_id, user_name AS cube_id, 'mem_read' AS label, '{"memory_ids":["' || w || '"]}' AS content FROM (SELECT user_name, 'w' || substr(sha256(concat_ws('|', user_name, memory)), 1, 16) AS w FROM memory)""")
def _(t):
    rows = t.memory.select("user_name", "memory", F.lit("LongTermMemory").alias("memory_type"))
    return ingest.read_later(ingest.unembedded(ingest.node_pairs(rows).dropDuplicates(["id"])))


@query("i10_believed", M + """, f AS (SELECT (doc_id // 6) * 2 + (doc_id % 6 >= 4)::INTEGER AS conv_id, id, doc_id % 20 = 3 AS flagged, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS keep, count(*) OVER (PARTITION BY (doc_id // 6) * 2 + (doc_id % 6 >= 4)::INTEGER) AS n, bool_or(doc_id % 20 = 3) OVER (PARTITION BY (doc_id // 6) * 2 + (doc_id % 6 >= 4)::INTEGER) AS flags FROM memory)
 SELECT id FROM f WHERE CASE WHEN n <= 2 THEN true WHEN flags THEN NOT flagged ELSE coalesce(keep, true) END""")
def _(t):
    conv = F.floor(_d() / 6) * 2 + (_d() % 6 >= 4).cast("int")  # four facts, or two
    facts = t.memory.select(conv.alias("conv_id"), F.col("id").alias("fact_id"), (_d() % 20 == 3).alias("flagged"))
    verdicts = t.memory.where(_d() % 3 == 0).select(F.col("id").alias("fact_id"), (_d() % 2 == 0).alias("keep"))
    return modes.believed(facts, verdicts).select(F.col("fact_id").alias("id"))


@query("x03_rule_facts", cte("messages") + """, c AS (SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS conversation FROM messages GROUP BY conv_id, turn // 200), l AS (SELECT conv_id, unnest(string_split(conversation, chr(10))) AS line FROM c)
 SELECT conv_id, trim(substr(line, 7)) AS memory FROM l WHERE starts_with(line, 'user: ') AND len(list_filter(regexp_split_to_array(substr(line, 7), '\\s+'), lambda w: w <> '')) >= 8""")
def _(t):
    asked = modes.ask(ingest.conversations(t.messages).select("conv_id", "conversation"), ["conversation"], modes.extraction(models.rule_extractor))
    return ingest.parse_facts(asked).select("conv_id", "memory")


# -- upkeep ---------------------------------------------------------------------

CLUSTERS = M + """, b AS (SELECT doc_id // 6 AS cluster, doc_id % 6 AS place, 'k' || substr(sha256(doc_id::VARCHAR), 1, 12) AS id FROM memory), g AS (SELECT cluster, CASE place WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' ELSE 'bad' END AS what, CASE place WHEN 0 THEN upper(id) WHEN 1 THEN id ELSE id || 'x' END AS given FROM b WHERE place < 3
 UNION ALL SELECT cluster, 'remove', 'nothing like it' FROM b WHERE place = 0),
 r AS (SELECT g.cluster, what, given, min(b.id) AS id FROM g JOIN b ON g.cluster = b.cluster AND levenshtein(lower(given), lower(b.id)) <= 2 GROUP BY ALL HAVING count(*) = 1)
 SELECT o.what AS what, o.id AS id, k.id AS kept FROM r o JOIN r k ON o.cluster = k.cluster AND k.what = 'keep' AND o.what <> 'keep' AND o.id <> k.id"""


@query("b04_cluster_replies", CLUSTERS)
def _(t):
    place, name = _d() % 6, F.concat(F.lit("k"), F.substring(F.sha2(_d().cast("string"), 256), 1, 12))
    members = t.memory.select(F.floor(_d() / 6).alias("cluster"), name.alias("id"), place.alias("place"))
    of = lambda n, c: F.max(F.when(F.col("place") == n, c))
    replies = members.groupBy("cluster").agg(
        of(0, F.upper("id")).alias("keep_id"), F.array(of(1, F.col("id")), F.lit("nothing like it")).alias("remove_ids"), F.array(of(2, F.concat("id", F.lit("x")))).alias("contradicted_ids"), F.lit("").alias("merged_text")
    )
    out = modes.cluster_replies(replies, members)
    return out["merges"].select(F.lit("remove").alias("what"), "id", F.col("into_id").alias("kept")).unionByName(out["contradicted"].select(F.lit("bad").alias("what"), F.col("bad_id").alias("id"), F.col("keep_id").alias("kept")))


@query("b10_feedback_actions", M + "SELECT id, CASE WHEN doc_id % 12 = 2 AND status = 'activated' THEN 'now ' || id ELSE memory END AS memory FROM memory WHERE NOT (doc_id % 12 = 4)")
def _(t):
    asked = t.memory.where(_d() % 2 == 0).select("id")
    what = F.when(_d() % 6 == 2, F.when(_d() % 12 == 2, "update").otherwise("keep")).when(_d() % 12 == 4, "remove").when(_d() % 2 == 1, "remove").otherwise("keep")
    m, _ = modes.feedback_actions(t.memory, t.edges, asked, t.memory.select("id", what.alias("action"), F.concat(F.lit("now "), "id").alias("memory")), F.timestamp_seconds(F.lit(AS_OF)))
    return m.select("id", "memory")


NEIGHBOURS = M + f", c AS (SELECT a.id AS from_id, b.id AS to_id, {PAIR} AS score, a.memory AS x, b.memory AS y FROM memory a JOIN memory b ON a.id <> b.id AND a.status = 'activated' AND b.status = 'activated' AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(score, 9) DESC, to_id) AS r FROM c WHERE score >= 0.30)"


def _neighbours(t):
    return pairs.top_neighbours(t.memory.where("status = 'activated' AND embedding IS NOT NULL"), 10, 0.30)


@query("w07_neighbours", NEIGHBOURS + " SELECT from_id, to_id, r::INTEGER AS rank FROM n WHERE r <= 10")
def _(t):
    return _neighbours(t).select("from_id", "to_id", "rank")


@query("b06_stored_scores", NEIGHBOURS + ", s AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY (1.0::DOUBLE / (1 + abs(length(x) - length(y))))::FLOAT DESC, to_id) AS k FROM n WHERE r <= 10) SELECT from_id AS id, to_id AS best, (SELECT count(*) FROM s b WHERE b.from_id = s.from_id)::INTEGER AS n FROM s WHERE k = 1")
def _(t):
    s = modes.rerank_neighbours(_neighbours(t), t.memory, lambda a, b: 1.0 / (1 + abs(len(a) - len(b))))
    return s.select("id", F.get("ce_score_topk", F.lit(0))["neighbor_id"].alias("best"), F.size("ce_score_topk").alias("n"))


RAW_SQL = "CASE WHEN doc_id % 6 < 2 THEN 'assistant: [2024-01-01]: ' || memory ELSE memory END"
RAW_WHERE = f"instr({RAW_SQL}, 'assistant: [20') > 0 AND memory_type IN ('LongTermMemory', 'UserMemory') AND status = 'activated'"


def _raw(t):
    return t.memory.withColumn("memory", F.when(_d() % 6 < 2, F.concat(F.lit("assistant: [2024-01-01]: "), "memory")).otherwise(F.col("memory")))


@query("src08_raw_windows", M + f"SELECT id FROM memory WHERE {RAW_WHERE} ORDER BY created_s, id LIMIT 50")
def _(t):
    return maintain.raw_windows(_raw(t)).select("id")


@query("src08_raw_count", M + f"SELECT user_name, count(*) AS n FROM memory WHERE {RAW_WHERE} GROUP BY ALL")
def _(t):
    return maintain.raw_window_count(_raw(t))


# -- evaluation -------------------------------------------------------------------


@query("e09_judge", M + """, a AS (SELECT doc_id, id, trim(key) || chr(1) || trim(info_lang) || chr(1) || trim(memory) AS k, list_contains(regexp_split_to_array(lower(memory), '\\s+'), lower(info_lang))::INTEGER AS said FROM memory)
 SELECT id, CASE WHEN k IN (SELECT k FROM a WHERE doc_id % 4 = 0) THEN 7 ELSE said END AS correct FROM a""")
def _(t):
    answers = t.memory.select("id", "doc_id", F.col("key").alias("question"), F.col("info")["lang"].alias("gold"), F.col("memory").alias("prediction"))
    cache = answers.where(_d() % 4 == 0).select(modes.judge_key(F.col("question"), F.col("gold"), F.col("prediction")).alias("key"), F.lit(7).alias("correct")).distinct()
    return modes.judged(answers, cache, modes.contains_judge)[0].select("id", "correct")


@query("e10_prediction", M + "SELECT id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN memory END), ''), array_to_string(tags[1:3], ' ')) AS prediction FROM memory")
def _(t):
    answer = F.when(_d() % 3 == 0, " ").when(_d() % 3 == 1, F.col("memory"))
    return t.memory.select("id", evalkit.prediction(answer, F.col("tags")).alias("prediction"))
