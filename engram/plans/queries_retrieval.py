"""Vector and text search, fusion, scoring, reranking, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import models
from engram.functions import scoring, text, vector
from engram.operators import dedup, evalkit, filters, manysearch, search, textindex
from engram.plans.adapter import AS_OF, COS_SQL, CUBE, cte
from engram.plans.registry import query
from engram.session import scratch_path

MQ = cte("memory", "q")
ACTIVE = f"user_name = '{CUBE}' AND status = 'activated'"
COS = COS_SQL.format(a="embedding", b="v")
TYPES = ["LongTermMemory", "UserMemory", "EpisodicMemory"]
TOKENS = ["the", "thing", "and"]
WORDS_SQL = "list_transform(regexp_extract_all(memory, '[a-zA-ZА-Яа-яёЁ0-9]+'), lambda x: lower(x))"


def _active():
    return F.col("status") == "activated"


def _as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


@query("v01_knn", MQ + f"SELECT id, round({COS}, 6) AS score FROM memory, q WHERE status = 'activated' AND embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 10")
def _(t):
    return search.knn(t.memory, t.vector(), _active(), 10).select("id", F.round("score", 6).alias("score"))


@query("v02_knn_cubes", MQ + f"SELECT id, round({COS}, 6) AS score FROM memory, q WHERE status = 'activated' AND user_name IN ('src0', 'src1', 'src2') AND embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 10")
def _(t):
    return search.knn(t.memory, t.vector(), filters.scope(["src0", "src1", "src2"]), 10).select("id", F.round("score", 6).alias("score"))


@query("v04_knn_min_score", MQ + f"SELECT id, round({COS}, 6) AS score FROM memory, q WHERE status = 'activated' AND memory_type IN ('LongTermMemory', 'UserMemory', 'EpisodicMemory') AND {COS} >= 0.1 ORDER BY {COS} DESC, id LIMIT 10")
def _(t):
    return search.knn(t.memory, t.vector(), _active() & F.col("memory_type").isin(*TYPES), 10, 0.1).select("id", F.round("score", 6).alias("score"))


@query("v06_vector_text", "SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def _(t):
    e = t.raw("embeddings").select("vec_id", vector.parse_vector(vector.format_vector(F.col("embedding"))).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))


@query("v09_mean_pool", "SELECT label, i::INTEGER AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def _(t):
    return t.raw("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("tx01_lexemes", cte("memory") + f"SELECT id, len({WORDS_SQL})::INTEGER AS n, {WORDS_SQL}[1] AS first FROM memory")
def _(t):
    return t.memory.select("id", text.lexemes(F.col("memory")).alias("w")).select("id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"))


STOPS = ", ".join(f"'{w}'" for w in text.STOP_EN)


@query("tx01_keywords", cte("memory") + f"SELECT id, len(list_filter({WORDS_SQL}, lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains([{STOPS}], x)))::INTEGER AS n FROM memory")
def _(t):
    return t.memory.select("id", F.size(text.keywords(F.col("memory"))).alias("n"))


# every third text is spelt with Cyrillic letters and every third with Chinese ones for some of its own
SPELT = (("aeiounrst", "аеиоунрст"), ("aeio", "你好世界"))
PHRASE_SQL = "CASE doc_id % 4 WHEN 1 THEN translate(text, '{}', '{}') WHEN 2 THEN translate(text, '{}', '{}') WHEN 3 THEN '' ELSE text END".format(*SPELT[0], *SPELT[1])


@query("tx02_language", rf"""WITH p AS (SELECT doc_id, {PHRASE_SQL} AS p FROM documents), b AS (SELECT doc_id, regexp_replace(p, '[\s\p{{P}}]', '', 'g') AS a, regexp_replace(p, '[^\p{{L}}\p{{N}}]', '', 'g') AS b FROM p),
 n AS (SELECT doc_id, length(a) AS n, length(a) - length(regexp_replace(a, '[Ѐ-ӿ]', '', 'g')) AS ru, length(a) - length(regexp_replace(a, '[一-鿿㐀-䶿]', '', 'g')) AS zh,
  length(b) AS m, length(b) - length(regexp_replace(b, '[Ѐ-ӿ]', '', 'g')) AS ru2, length(b) - length(regexp_replace(b, '[一-鿿㐀-䶿]', '', 'g')) AS zh2 FROM b)
 SELECT doc_id, CASE WHEN ru > 0.20 * n THEN 'ru' WHEN zh > 0.30 * n THEN 'zh' ELSE 'en' END AS search, CASE WHEN zh2 > 0.3 * m THEN 'zh' WHEN ru2 > 0.3 * m THEN 'ru' ELSE 'en' END AS chat FROM n""")
def _(t):
    k = F.col("doc_id") % 4
    phrase = F.when(k == 1, F.translate("text", *SPELT[0])).when(k == 2, F.translate("text", *SPELT[1])).when(k == 3, "").otherwise(F.col("text"))
    return t.raw("documents").select("doc_id", phrase.alias("p")).select("doc_id", text.search_language(F.col("p")).alias("search"), text.chat_language(F.col("p")).alias("chat"))


HITS_SQL = f"len(list_filter({WORDS_SQL}, lambda x: list_contains(['the', 'thing', 'and'], x)))"
RANK_SQL = f"{HITS_SQL} / (1 + ln(1 + len({WORDS_SQL})))"


@query("tx04_full_text", cte("memory") + f"SELECT id, round({RANK_SQL}, 6) AS score FROM memory WHERE {ACTIVE} AND {HITS_SQL} > 0 ORDER BY {RANK_SQL} DESC, id LIMIT 10")
def _(t):
    return search.full_text(t.memory, TOKENS, filters.scope(CUBE), 10).select("id", F.round("score", 6).alias("score"))


# the index is built of two thirds of the rows; the rest is appended, some rows are replaced twice and others deleted and put back
@query("tx04_indexed", cte("memory") + f"SELECT id, round({RANK_SQL}, 6) AS score FROM memory WHERE {ACTIVE} AND {HITS_SQL} > 0 ORDER BY {RANK_SQL} DESC, id LIMIT 10")
def _(t):
    index = textindex.TextIndex(t.spark, scratch_path(t.spark, "text-index"))
    m, third = t.texts, F.col("doc_id") % 3
    index.append(m.where(third != 0))
    index.append(m.where(third == 0).withColumn("memory", F.concat(F.lit("the the the and "), "memory")))
    index.upsert(m.where(third == 0))
    index.delete(m.where("doc_id % 7 = 0").select("id"))
    index.append(m.where("doc_id % 7 = 0"))
    return index.search(TOKENS, 10, t.memory, filters.scope(CUBE), [CUBE]).select("id", F.round("score", 6).alias("score"))


PAIRS_SQL = "WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1) "
CHARS = "list_distinct(string_split({}, ''))"


def _text_pairs(t):
    b = t.raw("benchmark")
    return b.select("item_id", F.col("text").alias("x")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")


@query("tx05_dice", PAIRS_SQL + f"SELECT item_id, round(2.0 * len(list_intersect({CHARS.format('x')}, {CHARS.format('y')})) / (len({CHARS.format('x')}) + len({CHARS.format('y')})), 6)::DOUBLE AS dice FROM p")
def _(t):
    return _text_pairs(t).select("item_id", F.round(text.dice(F.col("x"), F.col("y")), 6).alias("dice"))


BIGRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query("tx06_bigram", PAIRS_SQL + ", g AS (SELECT item_id, " + BIGRAMS.format("x") + " AS a, " + BIGRAMS.format("y") + " AS b FROM p) SELECT item_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6)::DOUBLE AS jaccard FROM g")
def _(t):
    return _text_pairs(t).select("item_id", F.round(text.bigram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("tx07_tfidf", PAIRS_SQL + """, c AS (SELECT item_id, ch, sum(a) AS a, sum(b) AS b FROM (SELECT item_id, unnest(string_split(x, '')) AS ch, 1 AS a, 0 AS b FROM p UNION ALL SELECT item_id, unnest(string_split(y, '')), 0, 1 FROM p) GROUP BY ALL)
 SELECT item_id, round(sum(a * b) / (sqrt(sum((a * CASE WHEN b > 0 THEN 1.0 ELSE 1.5 END) ^ 2)) * sqrt(sum((b * CASE WHEN a > 0 THEN 1.0 ELSE 1.5 END) ^ 2))), 6) AS tfidf FROM c GROUP BY item_id""")
def _(t):
    return _text_pairs(t).select("item_id", F.round(text.char_tfidf(F.col("x"), F.col("y")), 6).alias("tfidf"))


TFIDF_SQL = """c AS (SELECT item_id, ch, sum(a) AS a, sum(b) AS b FROM (SELECT item_id, unnest(string_split(x, '')) AS ch, 1 AS a, 0 AS b FROM p UNION ALL SELECT item_id, unnest(string_split(y, '')), 0, 1 FROM p) GROUP BY ALL),
 w AS (SELECT item_id, sum(a * b) / (sqrt(sum((a * CASE WHEN b > 0 THEN 1.0 ELSE 1.5 END) ^ 2)) * sqrt(sum((b * CASE WHEN a > 0 THEN 1.0 ELSE 1.5 END) ^ 2))) AS tfidf FROM c GROUP BY item_id)"""


@query("tx08_text_similarity", PAIRS_SQL + ", " + TFIDF_SQL + ", g AS (SELECT item_id, " + f"2.0 * len(list_intersect({CHARS.format('x')}, {CHARS.format('y')})) / (len({CHARS.format('x')}) + len({CHARS.format('y')})) AS dice, " + BIGRAMS.format("x") + " AS a, " + BIGRAMS.format("y") + """ AS b FROM p)
 SELECT item_id, round(0.40 * dice + 0.35 * tfidf + 0.25 * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6)::DOUBLE AS similarity FROM g JOIN w USING (item_id)""")
def _(t):
    return _text_pairs(t).select("item_id", F.round(text.text_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("tx10_content_hash", cte("memory") + "SELECT id, substr(sha256(lower(trim(memory))), 1, 32) AS h FROM memory")
def _(t):
    return t.memory.select("id", text.content_hash(F.col("memory")).alias("h"))


# -- fusion, merging, scoring -----------------------------------------------------

LISTS_SQL = MQ + f""", c AS (SELECT id, 'vector' AS source, {COS} AS score FROM memory, q WHERE {ACTIVE} AND embedding IS NOT NULL
 UNION ALL SELECT id, 'text', {RANK_SQL} FROM memory WHERE {ACTIVE} AND {HITS_SQL} > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, id) AS rank FROM c) """


def _lists(t):
    w = filters.scope(CUBE)
    v = search.knn(t.memory, t.vector(), w, None).withColumn("source", F.lit("vector"))
    x = search.full_text(t.memory, TOKENS, w, None).withColumn("source", F.lit("text"))
    return search.ranked(v.unionByName(x).withColumn("score", F.round("score", 9)), whole=True)


@query("r03_rrf", LISTS_SQL + "SELECT id, round(sum(1.0 / (rank + 60)), 6)::DOUBLE AS score FROM r GROUP BY id")
def _(t):
    return search.rrf(_lists(t)).select("id", F.round("score", 6).alias("score"))


@query("r03_weighted_rrf", LISTS_SQL + "SELECT id, round(sum(CASE source WHEN 'vector' THEN 1.2 ELSE 1.0 END / (rank + 60)), 6)::DOUBLE AS score FROM r GROUP BY id")
def _(t):
    return search.weighted_rrf(_lists(t), {"vector": 1.2, "text": 1.0}).select("id", F.round("score", 6).alias("score"))


TAG_SQL = "least(0.85, 0.70 + 0.05 * len(list_intersect(tags, ['en', 'src0', 'q1', 'b0'])))"


@query("r04_graph_merge", LISTS_SQL + f""", f AS (SELECT id, sum(1.0 / (rank + 60)) AS score FROM r GROUP BY id), g AS (SELECT id, {TAG_SQL} AS gs FROM memory WHERE {ACTIVE} AND len(list_intersect(tags, ['en', 'src0', 'q1', 'b0'])) >= 2)
 SELECT id, round(greatest(score, gs), 6)::DOUBLE AS score FROM f FULL JOIN g USING (id)""")
def _(t):
    tags = search.tag_recall(t.memory, ["en", "src0", "q1", "b0"], filters.scope(CUBE))
    return search.graph_merge(search.rrf(_lists(t)), tags).select("id", F.round("score", 6).alias("score"))


@query("r05_working_score", MQ + f"SELECT id, round(coalesce(least(({COS} + 1) / 2, 0.92), 0.80), 6)::DOUBLE AS score FROM memory, q WHERE memory_type = 'WorkingMemory'")
def _(t):
    cos = vector.cosine(F.col("embedding"), vector.literal(t.vector()))
    return t.memory.where("memory_type = 'WorkingMemory'").select("id", F.round(scoring.working_memory_score(cos), 6).alias("score"))


@query("r08_contradiction", cte("memory", "edges") + f""", r AS (SELECT id, pagerank AS score FROM memory WHERE status = 'activated'), s AS (SELECT id FROM r ORDER BY score DESC, id LIMIT 10),
 b AS (SELECT DISTINCT to_id FROM (SELECT from_id, to_id FROM edges WHERE relation = 'CONTRADICTS' AND NOT dead AND from_id IN (SELECT id FROM s) ORDER BY from_id, to_id LIMIT 20))
 SELECT id, round(CASE WHEN id IN (SELECT to_id FROM b) THEN greatest(score - 0.30, 0.0) ELSE score END, 6)::DOUBLE AS score FROM r""")
def _(t):
    r = t.memory.where(_active()).select("id", F.col("pagerank").alias("score"))
    return search.contradiction_penalty(r, t.edges).select("id", F.round("score", 6).alias("score"))


@query("r10_level_one", MQ + f"SELECT id, round({COS}, 6) AS score FROM memory, q WHERE status = 'activated' AND memory_type = 'WorkingMemory' AND embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 20")
def _(t):
    return search.knn(t.memory, t.vector(), _active() & (F.col("memory_type") == "WorkingMemory"), 20).select("id", F.round("score", 6).alias("score"))


@query("r13_sub_queries", cte("memory") + ", v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (0, 50, 100)), c AS (SELECT id, vec_id, " + COS
       + " AS s, row_number() OVER (PARTITION BY vec_id ORDER BY " + COS + " DESC, id) AS r FROM memory, v WHERE status = 'activated' AND embedding IS NOT NULL) SELECT id, round(max(s), 6) AS score FROM c WHERE r <= 10 GROUP BY id ORDER BY max(s) DESC, id LIMIT 10")
def _(t):
    return search.sub_query_union(t.memory, [t.vector(i) for i in (0, 50, 100)], _active(), 10).select("id", F.round("score", 6).alias("score"))


@query("r17_counters", cte("memory") + "SELECT id, (retrieval_count + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END)::INTEGER AS retrieval_count, round(CASE WHEN doc_id % 6 = 0 THEN least(2.0, importance_score + 0.1) ELSE importance_score END, 6)::DOUBLE AS importance_score FROM memory")
def _(t):
    return search.counters(t.memory, t.memory.where("doc_id % 6 = 0")).select("id", "retrieval_count", F.round("importance_score", 6).alias("importance_score"))


@query("s01_cosine_rescore", MQ + f"SELECT id, round(coalesce(({COS} + 1) / 2, pagerank), 6)::DOUBLE AS score FROM memory, q")
def _(t):
    r = t.memory.select("id", F.col("pagerank").alias("score"))
    return search.cosine_rescore(r, t.memory, t.vector()).select("id", F.round("score", 6).alias("score"))


DAYS = f"(({AS_OF} - updated_s) / 86400.0)"


@query("s02_decay", cte("memory") + f"SELECT id, round(CASE WHEN memory_type = 'WorkingMemory' THEN pagerank ELSE 0.75 * pagerank + 0.25 * CASE WHEN greatest({DAYS}, 0) <= 730 THEN exp(-0.0039 * greatest({DAYS}, 0)) ELSE 0 END END, 6)::DOUBLE AS score FROM memory")
def _(t):
    r = t.memory.select("id", F.col("pagerank").alias("score"))
    return search.apply_decay(r, t.memory, _as_of()).select("id", F.round("score", 6).alias("score"))


@query("s03_importance_decay", cte("memory") + f"""SELECT id, round(CASE WHEN memory_type = 'WorkingMemory' THEN 0.5 ELSE least(1.0, 0.5 * exp(-0.0039 * greatest({DAYS}, 0)) * least(5.0, 1 + ln(1 + access_count))
 * CASE hierarchy_level WHEN 'semantic' THEN 1.15 WHEN 'episodic' THEN 1.08 ELSE 1 END * (1 + pagerank * 0.1)) END, 6)::DOUBLE AS score FROM memory""")
def _(t):
    s = scoring.importance_decay(F.lit(0.5), F.col("updated_at"), _as_of(), F.col("access_count"), F.col("hierarchy_level"), F.col("pagerank"), F.col("memory_type"))
    return t.memory.select("id", F.round(s, 6).alias("score"))


@query("s05_rerank_gate", cte("memory") + """SELECT user_name, n, CASE WHEN n < 4 THEN 'too-few' WHEN hi > 0.93 THEN 'high-confidence' WHEN hi - lo < 0.05 THEN 'clustered' WHEN hi - lo > 0.25 THEN 'wide-spread' ELSE 'medium-spread' END AS decision
 FROM (SELECT user_name, count(*) AS n, max(pagerank) AS hi, min(pagerank) AS lo FROM memory GROUP BY user_name)""")
def _(t):
    a = t.memory.groupBy("user_name").agg(F.count("*").alias("n"), F.max("pagerank").alias("hi"), F.min("pagerank").alias("lo"))
    return a.select("user_name", "n", scoring.rerank_gate(F.col("n"), F.col("hi"), F.col("lo")).alias("decision"))


@query("s06_rerank", MQ + f"""SELECT id, round(CASE WHEN r <= 10 THEN len(list_intersect(list_distinct(regexp_extract_all(lower(memory), '[\\p{{L}}\\p{{N}}_]+')), ['the', 'thing'])) / 2.0 ELSE score END, 6)::DOUBLE AS score, r <= 10 AS reranked
 FROM (SELECT id, memory, {COS} AS score, row_number() OVER (ORDER BY {COS} DESC, id) AS r FROM memory, q WHERE status = 'activated' AND embedding IS NOT NULL) WHERE r <= 20""")
def _(t):
    r = search.knn(t.memory, t.vector(), _active(), 20).join(t.memory.select("id", "memory"), "id")
    return models.rerank(r, "the thing", top=10).select("id", F.round("score", 6).alias("score"), "reranked")


# the best 30 rows as one result list; every row of the table is a stored neighbour of every other
@query("s07_precomputed", MQ + f"""SELECT id, CASE WHEN ord = 0 THEN score ELSE stored END AS score, row_number() OVER (ORDER BY ord <> 0, -stored, ord)::INTEGER AS place, true AS covered
 FROM (SELECT id, round({COS}, 6) AS score, (doc_id % 10) / 10.0::DOUBLE AS stored, row_number() OVER (ORDER BY {COS} DESC, id) - 1 AS ord FROM memory, q WHERE status = 'activated' AND embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 30)""")
def _(t):
    m, best = t.memory, search.knn(t.memory, t.vector(), _active(), 30)
    w = Window.orderBy(F.desc("score"), "id")  # 30 rows
    r = best.withColumn("ord", F.row_number().over(w) - 1).withColumn("score", F.round("score", 6))
    first = r.where("ord = 0").select("id")
    n = F.broadcast(first).join(m.select(F.col("id").alias("neighbor_id"), ((F.col("doc_id") % 10) / 10.0).alias("score")), F.col("id") != F.col("neighbor_id"))
    return search.precomputed_rerank(r, n)


@query("t07_reorder", cte("memory") + """, r AS (SELECT doc_id // 20 AS query_id, id, doc_id, CASE doc_id % 20 WHEN 9 THEN 0 WHEN 2 THEN 1 END AS pos FROM memory)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST, doc_id)::INTEGER AS place FROM r""")
def _(t):
    q, n = F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id") % 20
    given = t.memory.where(n.isin(9, 2)).select(q, "id", F.when(n == 9, 0).otherwise(1).alias("pos"))
    return search.reorder(t.memory.select(q, "id", F.col("doc_id").alias("ord")), given).select("query_id", "id", "place")


@query("d01_text_dedupe", cte("memory") + "SELECT user_name, count(DISTINCT lower(trim(memory))) AS n FROM memory WHERE trim(memory) <> '' GROUP BY user_name")
def _(t):
    one = search.first_by_text(t.memory.withColumn("score", F.col("pagerank")), F.lit(0), ("user_name",))
    return one.groupBy("user_name").agg(F.count("*").alias("n"))


def _candidates(t):
    k = search.knn(t.memory, t.vector(), _active(), 60).join(t.memory.select("id", "memory", "embedding", "memory_type"), "id")
    kind = F.when(F.col("memory_type") == "PreferenceMemory", "pref").otherwise("text")
    return k.select(F.lit(0).cast("long").alias("query_id"), "id", "memory", kind.alias("kind"), F.lit(0).alias("bucket"), "score", "embedding")


@query("d02_greedy")
def _(t):
    return dedup.select_by_query(_candidates(t), "sim", 10)


@query("d03_mmr")
def _(t):
    return dedup.select_by_query(_candidates(t), "mmr", 6, 2, t.vector())


@query("d04_cross_source", cte("memory") + """SELECT id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(memory)) ORDER BY CASE bucket WHEN 'text' THEN 0 WHEN 'skill' THEN 1 WHEN 'tool' THEN 2 ELSE 3 END, pagerank DESC, id) AS r
 FROM (SELECT *, CASE WHEN memory_type = 'SkillMemory' THEN 'skill' WHEN memory_type LIKE 'Tool%' THEN 'tool' WHEN memory_type = 'PreferenceMemory' THEN 'pref' ELSE 'text' END AS bucket FROM memory) WHERE trim(memory) <> '') WHERE r = 1""")
def _(t):
    m = t.memory.select("id", "memory", F.col("pagerank").alias("score"), search.bucket_of(F.col("memory_type")).alias("bucket"))
    return search.cross_source_dedupe(m).select("id", "bucket")


@query("hybrid_search", MQ + f""", w AS (SELECT * FROM memory WHERE {ACTIVE} AND memory_type IN ('LongTermMemory', 'UserMemory', 'EpisodicMemory')),
 v AS (SELECT id, 'v' AS source, round({COS}, 9) AS score FROM w, q WHERE embedding IS NOT NULL ORDER BY {COS} DESC, id LIMIT 30),
 x AS (SELECT id, 't' AS source, round({RANK_SQL}, 9) AS score FROM w WHERE {HITS_SQL} > 0 ORDER BY {RANK_SQL} DESC, id LIMIT 30),
 r AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM (SELECT * FROM v UNION ALL SELECT * FROM x)) GROUP BY id),
 s AS (SELECT r.id, w.memory, w.updated_s, coalesce(({COS} + 1) / 2, r.score) AS score FROM r JOIN w USING (id), q),
 d AS (SELECT id, memory, 0.75 * score + 0.25 * exp(-0.0039 * greatest(({AS_OF} - updated_s) / 86400.0, 0)) AS score FROM s)
 SELECT id, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(memory)) ORDER BY score DESC, id) AS k FROM d WHERE score >= 0.3) WHERE k = 1 ORDER BY 3 LIMIT 10""")
def hybrid(t):
    """kNN and full text, fused, rescored by cosine, decayed, thresholded, deduplicated, cut to ten."""
    where = filters.scope(CUBE, types=TYPES)
    q = t.vector()
    lists = search.knn(t.memory, q, where, 30).withColumn("source", F.lit("v")).unionByName(search.full_text(t.memory, TOKENS, where, 30).withColumn("source", F.lit("t")))
    found = search.rrf(search.ranked(lists.withColumn("score", F.round("score", 9))))
    found = search.threshold(search.rescored(found, t.memory, q, _as_of()), 0.3)  # 60 rows at most
    rows = search.first_by_text(found, F.lit(0))
    rows = search.ranked(rows.withColumn("all", F.lit(1)).withColumn("raw", F.col("score")).withColumn("score", F.round("score", 9)), ("all",))
    return rows.where("rank <= 10").select("id", F.round("raw", 6).alias("score"), "rank")


@query("r01_full_search")
def _(t):
    p = search.resolve_params({"query": "the en src0 q1", "vector": tuple(t.vector()), "cubes": (CUBE,), "top_k": 10, "dedup": "mmr"})
    return search.search(t.memory, t.edges, p, _as_of()).select("bucket", "rank", "id", F.round("score", 6).alias("score"))


SEEN = TYPES + ["SkillMemory"]
TYPES_SQL = ", ".join(f"'{x}'" for x in SEEN)
ASKED = ("die und en src0 q1 e3", "les dans fr src0 b0 e5")
ASKED_SQL = "CASE WHEN vec_id % 40 = 0 THEN {} ELSE {} END".format(*[str(x.split()) for x in ASKED])
MANY_SQL = cte("memory", "edges") + f""", q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, {ASKED_SQL} AS tokens FROM embeddings WHERE vec_id % 20 = 0),
 w AS (SELECT *, {WORDS_SQL} AS ws FROM memory WHERE status = 'activated' AND user_name IN ('src0', 'src1') AND memory_type IN ({TYPES_SQL})),
 c AS (SELECT query_id, id, 'v' AS kind, {COS} AS s FROM w, q WHERE embedding IS NOT NULL UNION ALL
  SELECT query_id, id, 't', h / (1 + ln(1 + n)) FROM (SELECT query_id, id, len(ws) AS n, len(list_filter(ws, lambda x: list_contains(tokens, x))) AS h FROM w, q) WHERE h > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY s DESC, id) AS rank FROM c),
 g AS (SELECT query_id, id, max(s) AS s FROM (SELECT query_id, id, least(0.85, 0.70 + 0.05 * n) AS s FROM (SELECT query_id, id, len(list_intersect(tags, tokens)) AS n FROM w, q) WHERE n >= 2
  UNION ALL SELECT query_id, id, 0.85 FROM w, q WHERE list_contains(tokens, lower(key))
  UNION ALL SELECT query_id, id, 0.85 FROM edges JOIN w ON from_id = id, q WHERE relation = 'MENTIONS_ENTITY' AND NOT dead AND list_contains(tokens, to_id)) GROUP BY ALL),
 g2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM g) WHERE k <= 10),
 f AS (SELECT query_id, id, max(s)::DOUBLE AS s FROM (SELECT query_id, id, sum(1.0 / (60 + rank)) AS s FROM r WHERE rank <= 10 GROUP BY ALL UNION ALL SELECT query_id, id, s FROM g2) GROUP BY ALL),
 u AS (SELECT from_id AS a, to_id AS b FROM edges WHERE NOT dead UNION SELECT to_id, from_id FROM edges WHERE NOT dead),
 h1 AS (SELECT query_id, b AS id, min(f.id) AS seed FROM f JOIN u ON f.id = u.a GROUP BY ALL),
 h2 AS (SELECT query_id, b AS id, min(seed) AS seed FROM h1 JOIN u ON h1.id = u.a GROUP BY ALL),
 h AS (SELECT query_id, id, min(hop) AS hop, arg_min(seed, (hop, seed)) AS seed FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) x ANTI JOIN f USING (query_id, id) GROUP BY ALL),
 hs AS (SELECT h.query_id, h.id, coalesce(({COS} + 1) / 2, f.s) * 0.8 ^ hop AS s FROM h JOIN w USING (id) JOIN q USING (query_id) JOIN f ON f.query_id = h.query_id AND f.id = h.seed),
 hr AS (SELECT query_id, id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM hs) JOIN (SELECT query_id, count(*) AS n FROM f GROUP BY ALL) USING (query_id) WHERE k <= least(n, 30)),
 a AS (SELECT * FROM f UNION ALL SELECT * FROM hr), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM a) WHERE k <= 10),
 bad AS (SELECT DISTINCT query_id, to_id AS id, true AS hit FROM (SELECT query_id, to_id, row_number() OVER (PARTITION BY query_id ORDER BY from_id, to_id) AS k FROM edges JOIN top ON top.id = from_id WHERE relation = 'CONTRADICTS' AND NOT dead) WHERE k <= 20),
 s AS (SELECT query_id, a.id, memory, memory_type, updated_s, coalesce(({COS} + 1) / 2, CASE WHEN hit THEN greatest(s - 0.30, 0.0) ELSE s END) AS rel FROM a JOIN w USING (id) JOIN q USING (query_id) LEFT JOIN bad USING (query_id, id)),
 d AS (SELECT query_id, id, memory, CASE WHEN memory_type = 'SkillMemory' THEN 'skill' ELSE 'text' END AS bucket, 0.75 * rel + 0.25 * CASE WHEN greatest({DAYS}, 0) <= 730 THEN exp(-0.0039 * greatest({DAYS}, 0)) ELSE 0 END AS score FROM s),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(memory)) ORDER BY bucket = 'skill', score DESC, id) AS k FROM d WHERE trim(memory) <> '' AND score >= 0)
 SELECT query_id, bucket, rank::INTEGER AS rank, id, round(score, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, id) AS rank FROM o WHERE k = 1) WHERE rank <= 10"""


@query("r01_many_searches", MANY_SQL)
def _(t):
    p = search.resolve_params({"top_k": 10, "hops": 2})
    asked = F.when(F.col("vec_id") % 40 == 0, ASKED[0]).otherwise(ASKED[1])
    q = t.raw("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), asked.alias("query"), F.col("embedding").alias("vector"), F.array(F.lit("src0"), F.lit("src1")).alias("cubes"))
    found = manysearch.search_many(t.memory, t.edges, q, p, _as_of())
    return found.select("query_id", "bucket", "rank", "id", F.round("score", 6).alias("score"))


# -- evaluation ---------------------------------------------------------------------

PG_SQL = r"""WITH p AS (SELECT a.item_id, a.item_id % 5 + 1 AS category, a.text AS gold, b.text AS pred FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id * 3) % (SELECT count(*) FROM benchmark)),
 n AS (SELECT item_id, category, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(gold), '\b(a|an|the)\b', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' ') AS g,
  string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(pred), '\b(a|an|the)\b', ' ', 'g'), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' ') AS q FROM p),
 c AS (SELECT item_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT item_id, unnest(q) AS t, 1 AS a, 0 AS b FROM n UNION ALL SELECT item_id, unnest(g), 0, 1 FROM n) GROUP BY ALL),
 s AS (SELECT item_id, sum(least(a, b)) AS same, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS bow, count(*) FILTER (a > 0 AND b > 0) AS n_both, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c GROUP BY item_id),
 e AS (SELECT item_id, category, (q = g)::INTEGER::DOUBLE AS em, 2.0 * same / (len(q) + len(g)) AS f1, CASE WHEN n_both = 0 THEN 0.0 ELSE 2.0 * n_both / (da + db) END AS set_f1, (n_both > 0)::INTEGER::DOUBLE AS hit, bow FROM n JOIN s USING (item_id)) """


def _preds(t):
    b, n = t.raw("benchmark"), t.raw("benchmark").count()
    a = b.select("item_id", (F.col("item_id") % 5 + 1).alias("category"), F.col("text").alias("gold"), ((F.col("item_id") * 3) % n).alias("other"))
    return a.join(b.select(F.col("item_id").alias("other"), F.col("text").alias("pred")), "other").select("item_id", "category", "gold", "pred")


def _scored(t):
    p, g = F.col("pred"), F.col("gold")
    return _preds(t).select(
        "item_id", "category", evalkit.exact_match(p, g).alias("em"), evalkit.token_f1(p, g).alias("f1"), evalkit.set_f1(p, g).alias("set_f1"),
        evalkit.any_token_hit(F.array(p), g).alias("hit"), evalkit.bow_cosine(p, g).alias("bow"),
    )


@query("e02_metrics", PG_SQL + "SELECT item_id, em, round(f1, 6)::DOUBLE AS f1, round(set_f1, 6)::DOUBLE AS set_f1, hit, round(bow, 6)::DOUBLE AS bow FROM e")
def _(t):
    return _scored(t).select("item_id", "em", F.round("f1", 6).alias("f1"), F.round("set_f1", 6).alias("set_f1"), "hit", F.round("bow", 6).alias("bow"))


@query("a14_eval_rollup", PG_SQL + "SELECT category, count(*) AS n, round(avg(f1), 6)::DOUBLE AS f1, round(avg(hit), 6)::DOUBLE AS hit FROM e WHERE category <> 5 GROUP BY ROLLUP (category)")
def _(t):
    return evalkit.rollup(_scored(t), ["f1", "hit"], exclude=(5,)).select("category", "n", F.round("f1", 6).alias("f1"), F.round("hit", 6).alias("hit"))


GRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
SAME = "list_sum(list_transform(list_distinct({0}), lambda t: least(len(list_filter({0}, lambda x: x = t)), len(list_filter({1}, lambda x: x = t)))))"


@query("e07_ngram_scores", PG_SQL + f""", k AS (SELECT item_id, q, g, {GRAMS.format("q")} AS q2, {GRAMS.format("g")} AS g2 FROM n),
 o AS (SELECT *, {SAME.format("q", "g")} AS one, {SAME.format("q2", "g2")} AS two FROM k)
 SELECT item_id, round(2.0 * one / (len(q) + len(g)), 6)::DOUBLE AS rouge_1, round(2.0 * two / (len(q2) + len(g2)), 6)::DOUBLE AS rouge_2,
 round(CASE WHEN len(q) >= len(g) THEN 1.0 ELSE exp(1 - len(g) / len(q)::DOUBLE) END * one / len(q), 6)::DOUBLE AS bleu_1 FROM o""")
def _(t):
    p, g = F.col("pred"), F.col("gold")
    return _preds(t).select("item_id", F.round(evalkit.rouge_n(p, g, 1), 6).alias("rouge_1"), F.round(evalkit.rouge_n(p, g, 2), 6).alias("rouge_2"), F.round(evalkit.bleu_1(p, g), 6).alias("bleu_1"))


@query("e08_compare", PG_SQL + "SELECT category, round(avg(set_f1) - avg(f1), 6)::DOUBLE AS delta_f1 FROM e GROUP BY category")
def _(t):
    s = _scored(t)
    base, new = s.groupBy("category").agg(F.avg("f1").alias("f1")), s.groupBy("category").agg(F.avg("set_f1").alias("f1"))
    return evalkit.compare(base, new, ["f1"]).select("category", F.round("delta_f1", 6).alias("delta_f1"))


@query("a15_durations", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    d = evalkit.durations(t.raw("events"), "value", ["event_type"])
    return d.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95")], "n")


@query("a16_accuracy", "SELECT lang, round(100 * avg((n_chars % 3 = 0)::INTEGER), 2)::DOUBLE AS accuracy, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    return evalkit.accuracy(t.raw("documents").withColumn("correct", F.col("n_chars") % 3 == 0), "lang")


@query("a17_error_types", "SELECT event_type AS error_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 2)::DOUBLE AS pct FROM events GROUP BY event_type")
def _(t):
    return evalkit.error_types(t.raw("events").withColumnRenamed("event_type", "error_type"))
