"""Merging of lists and what goes beside the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import filters, merge, search, store
from engram.plans.adapter import COS_SQL, CUBE, cte
from engram.plans.registry import query

CUBES = ("src0", "src1", "src2")
COS = COS_SQL.format(a="embedding", b="v")
MQ = cte("memory", "q")
LISTS = [f"SELECT id, user_name, memory_type, memory, round({COS}, 6) AS score, {i} AS list FROM memory, q WHERE status = 'activated' AND user_name = '{c}' AND embedding IS NOT NULL" for i, c in enumerate(CUBES)]


def _list(t, cube):
    found = search.knn(t.memory, t.vector(), filters.scope([cube]), None)
    return found.join(t.memory.select("id", "user_name", "memory_type", "memory"), "id").withColumn("score", F.round("score", 6))


@query("u04_split_kinds", MQ + "SELECT id, score, CASE WHEN memory_type = 'SkillMemory' THEN 'skill' ELSE 'text' END AS kind FROM (" + " UNION ALL ".join(LISTS) + ")")
def _(t):
    text, skill = merge.split_kinds(*[_list(t, c) for c in CUBES])
    return text.select("id", "score", F.lit("text").alias("kind")).unionByName(skill.select("id", "score", F.lit("skill").alias("kind")))


# the second list holds the first one's rows with other scores, so that ids repeat
@query("u05_multi_cube", MQ + f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY list, score DESC) AS n
 FROM ({" UNION ALL ".join(LISTS)} UNION ALL SELECT id, user_name, memory_type, memory, round(score + 1, 6), 3 FROM ({LISTS[0]}))) WHERE n = 1 ORDER BY score DESC, id LIMIT 200""")
def _(t):
    lists = [_list(t, c) for c in CUBES]
    lists.append(lists[0].withColumn("score", F.round(F.col("score") + 1, 6)))
    return merge.merge_cubes(lists, 200).select("id", "score", "rank")


SPEAKERS = f"""a AS ({LISTS[0]}), b AS (SELECT CASE WHEN doc_id % 10 = 3 THEN NULL ELSE id END AS id, memory, round({COS} * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE -1 END, 6) AS score FROM memory, q
 WHERE status = 'activated' AND user_name = '{CUBE}' AND embedding IS NOT NULL)"""


@query("u06_dual_speaker", MQ.rstrip() + ", " + SPEAKERS + """, u AS (SELECT id, memory, score, 'a' AS speaker FROM a UNION ALL SELECT id, memory, score, 'b' FROM b),
 k AS (SELECT id, score, speaker FROM u WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, speaker) = 1)
 SELECT * FROM (SELECT id, score, speaker FROM k UNION ALL SELECT id, score, speaker FROM u WHERE id IS NULL)""")
def _(t):
    a = _list(t, CUBE).select("id", "memory", "score")
    n = F.substring("id", 2, 20).cast("long")
    b = a.select(F.when(n % 10 != 3, F.col("id")).alias("id"), "memory", n.alias("n"))
    raw = search.knn(t.memory, t.vector(), filters.scope([CUBE]), None).withColumn("n", F.substring("id", 2, 20).cast("long"))
    b = b.join(raw.select("n", F.round(F.col("score") * F.when(F.col("n") % 2 == 0, 2).otherwise(-1), 6).alias("score")), "n").select("id", "memory", "score")
    return merge.merge_speakers(a, b, 2**31 - 1).select("id", "score", "speaker")


@query("f14_outer", cte("memory") + "SELECT id FROM memory WHERE doc_id % 9 <> 0")
def _(t):
    m = t.memory.withColumn("memory_type", F.when(F.col("doc_id") % 9 == 0, "OuterMemory").when(F.col("doc_id") % 9 != 1, F.col("memory_type")))
    return merge.inner_rows(m, False).select("id")


@query("r06_working_bucket", MQ + f"SELECT id, round(({COS} + 1) / 2, 6)::DOUBLE AS score, row_number() OVER (ORDER BY ({COS} + 1) / 2 DESC, id)::INTEGER AS rank FROM memory, q WHERE status = 'activated' AND user_name IN ('src3', 'src7', 'src11') AND memory_type = 'WorkingMemory' AND ({COS} + 1) / 2 >= 0.55 - 0.10 ORDER BY ({COS} + 1) / 2 DESC, id LIMIT 20")
def _(t):
    return merge.working_bucket(t.memory, t.vector(), filters.scope(["src3", "src7", "src11"]), 0.55).select("id", F.round("score", 6).alias("score"), "rank")


@query("d07_preferences", cte("memory") + """SELECT id, memory FROM (SELECT 'p' || (doc_id // 3) AS id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '' ELSE memory END), ''), nullif(trim(CASE WHEN doc_id % 4 = 0 THEN key END), '')) AS memory, doc_id FROM memory)
 WHERE memory IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1""")
def _(t):
    d = F.col("doc_id")
    rows = t.memory.select(F.concat(F.lit("p"), F.floor(d / 3)).alias("id"), F.when(d % 2 == 0, "").otherwise(F.col("memory")).alias("memory"), F.when(d % 4 == 0, F.col("key")).alias("memory_content"), d.alias("ord"))
    return merge.preference_rows(rows).select("id", "memory")


@query("r16_profile_attach", cte("memory") + "SELECT id, CASE WHEN user_name IN ('src0', 'src2') THEN 'profile of ' || user_name ELSE '' END AS profile FROM memory WHERE user_name IS NOT NULL")
def _(t):
    profiles = t.spark.createDataFrame([(c, f"profile of {c}") for c in ("src0", "src2")], "cube_id string, profile string")
    return merge.attach_profiles(t.memory.where("user_name IS NOT NULL"), profiles).select("id", "profile")


PAIR = "SELECT n.id, max({c}) AS best FROM n JOIN o ON n.user_name = o.user_name GROUP BY n.id"
INGEST = cte("memory") + ", n AS (SELECT id, user_name, embedding FROM memory WHERE doc_id % 4 = 1), o AS (SELECT user_name, embedding FROM memory WHERE doc_id % 4 <> 1 AND status = 'activated' AND embedding IS NOT NULL), b AS (" + PAIR.format(c=COS_SQL.format(a="n.embedding", b="o.embedding")) + ") "


def _ingest(t):
    d = F.col("doc_id")
    return t.memory.where(d % 4 == 1).select("id", "user_name", "embedding"), t.memory.where(d % 4 != 1)


# a threshold that splits these vectors; the rule is that of REPEATED
@query("d06_ingest_dedupe", INGEST + "SELECT id FROM n WHERE id NOT IN (SELECT id FROM b WHERE best >= 0.3)")
def _(t):
    new, known = _ingest(t)
    return merge.drop_repeats(new, known, 0.3).select("id")


@query("d06_fine_gate", INGEST + "SELECT id, CASE WHEN best > 0.97 THEN 'skip' WHEN best > 0.92 THEN 'hint' ELSE 'new' END AS gate FROM n LEFT JOIN b USING (id)")
def _(t):
    new, known = _ingest(t)
    return merge.fine_gate(new, known).select("id", "gate")


@query("w04_working_cap", cte("memory") + """SELECT id FROM (SELECT id, memory_type, row_number() OVER (PARTITION BY user_name ORDER BY updated_s DESC, id) AS r, CASE WHEN user_name = 'src1' THEN 5 ELSE 20 END AS k FROM memory WHERE memory_type = 'WorkingMemory') WHERE r <= k
 UNION ALL SELECT id FROM memory WHERE memory_type <> 'WorkingMemory'""")
def _(t):
    return store.keep_newest(t.memory, t.spark.createDataFrame([("src1", 5)], "user_name string, keep int")).select("id")


@query("m11_user_config", """SELECT 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS theme, CASE WHEN c_custkey % 3 = 0 THEN 'on' END AS beta, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS at_s FROM customer""")
def _(t):
    c, one = t.raw("customer"), F.timestamp_seconds(F.lit(1))
    user = F.concat(F.lit("u"), F.col("c_custkey")).alias("user_id")
    old = c.select(user, F.create_map(F.lit("theme"), F.col("c_mktsegment")).alias("settings"), one.alias("updated_at"))
    new = c.where("c_custkey % 3 = 0").select(user, F.create_map(F.lit("theme"), F.lit("new"), F.lit("beta"), F.lit("on")).alias("settings"))
    t = merge.config_upsert(old, new, F.timestamp_seconds(F.lit(2)))
    return t.select("user_id", F.col("settings")["theme"].alias("theme"), F.col("settings")["beta"].alias("beta"), F.unix_timestamp("updated_at").cast("int").alias("at_s"))
