"""The memory model over the driver's tables, as DataFrames and as the same SQL.

The tables hold no memories, so they are mapped: documents to memories, arithmetic
on their ids to edges, conversations to messages, events to tasks.  ``SQL`` has the
same views as common table expressions for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_672_531_200  # 2023-01-01
AS_OF = 1_706_745_600  # 2024-02-01
TYPES = "LongTermMemory UserMemory EpisodicMemory WorkingMemory SkillMemory ToolSchemaMemory ToolTrajectoryMemory PreferenceMemory".split()
LEVELS = ["raw", "episodic", "semantic"]
#: The cube and the query vector that the registered queries use.
CUBE, QUERY_ID = "src0", 0


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def memory(self) -> DataFrame:
        i = F.col("doc_id")
        d = self.raw("documents").select("doc_id", "text", "lang", "source")
        e = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        lab = self.raw("labels")
        t = d.join(e, "doc_id", "left").join(lab, "doc_id", "left")
        kind = F.get(F.array(*[F.lit(x) for x in TYPES]), (i % 8).cast("int"))
        level = F.get(F.array(*[F.lit(x) for x in LEVELS]), (i % 3).cast("int"))
        return t.select(
            "doc_id",
            F.concat(F.lit("m"), i).alias("id"),
            F.col("source").alias("user_name"),
            F.concat(F.lit("u"), i % 3).alias("user_id"),
            F.when(i % 4 == 0, F.concat(F.lit("a"), i % 2)).otherwise("").alias("agent_id"),
            F.concat(F.lit("s"), F.floor(i / 10)).alias("session_id"),
            F.col("text").alias("memory"),
            kind.alias("memory_type"),
            F.when(F.col("toxic") == 1, "archived").otherwise("activated").alias("status"),
            F.timestamp_seconds(EPOCH + i * 3600).alias("created_at"),
            F.timestamp_seconds(EPOCH + i * 3600 + (i % 7) * 86400).alias("updated_at"),
            F.concat_ws("/", "lang", "source").alias("key"),
            F.array(F.col("lang"), F.col("source"), F.concat(F.lit("q"), F.coalesce("quality", F.lit(1))), F.concat(F.lit("b"), i % 5)).alias("tags"),
            F.when(i % 4 == 1, F.concat(F.lit("[working_binding:m"), i - 1, F.lit("]"))).otherwise("").alias("background"),
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.length("text").cast("string")).alias("info"),
            F.lit(0.99).alias("confidence"),
            (F.coalesce("quality", F.lit(1)) * (1 + (i % 10) / 10.0)).alias("importance_score"),
            (i % 17).cast("int").alias("access_count"),
            (i % 5).cast("int").alias("retrieval_count"),
            level.alias("hierarchy_level"),
            ((i % 100) / 100.0).alias("pagerank"),
            "embedding",
        )

    @cached_property
    def texts(self) -> DataFrame:
        """The columns of ``memory`` that are the documents' own, without a join: a text isn't shuffled to be indexed."""
        return self.raw("documents").select("doc_id", F.concat(F.lit("m"), "doc_id").alias("id"), F.col("source").alias("user_name"), F.col("text").alias("memory"))

    @cached_property
    def count(self) -> int:
        return self.raw("documents").count()

    @cached_property
    def edges(self) -> DataFrame:
        n, i = self.count, F.col("doc_id")
        d = self.raw("documents").select("doc_id")
        m = lambda c: F.concat(F.lit("m"), c)
        rel = d.select(m(i).alias("from_id"), m((i * 7 + 6) % n).alias("to_id"), F.lit("RELATED").alias("relation"), ((i % 10) / 10.0).alias("confidence"), (i % 13 == 0).alias("dead"))
        con = d.where(i % 11 == 0).select(m(i).alias("from_id"), m((i * 5 + 1) % n).alias("to_id"), F.lit("CONTRADICTS").alias("relation"), F.lit(1.0).alias("confidence"), F.lit(False).alias("dead"))
        nxt = d.where((i % 10 != 0)).select(m(i).alias("from_id"), m(i - 1).alias("to_id"), F.lit("TIMELINE_NEXT").alias("relation"), F.lit(1.0).alias("confidence"), F.lit(False).alias("dead"))
        ent = d.select(m(i).alias("from_id"), F.concat(F.lit("e"), i % 20).alias("to_id"), F.lit("MENTIONS_ENTITY").alias("relation"), F.lit(0.9).alias("confidence"), F.lit(False).alias("dead"))
        t = rel.unionByName(con).unionByName(nxt).unionByName(ent)
        return t.withColumn("invalid_at", F.when(F.col("dead"), F.timestamp_seconds(F.lit(AS_OF)))).drop("dead")

    @cached_property
    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select("conv_id", "turn", "role", F.col("text").alias("content"), F.timestamp_seconds(EPOCH + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("chat_time"))

    @cached_property
    def tasks(self) -> DataFrame:
        e = self.raw("events")
        label = F.expr("CASE event_type WHEN 'click' THEN 'mem_update' WHEN 'view' THEN 'query' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'mem_read' ELSE 'mem_feedback' END")
        return e.select(
            F.col("event_id").cast("string").alias("item_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("cube_id"),
            label.alias("label"), F.col("props").alias("content"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4).cast("int").alias("retry_count"), "event_id",
        )

    @cached_property
    def profiles(self) -> DataFrame:
        i = F.col("doc_id")
        return self.raw("documents").select(
            F.col("source").alias("cube_id"), F.concat(F.lit("u"), i % 3).alias("user_id"), F.concat(F.lit("t"), i % 4).alias("topic"), F.concat(F.lit("s"), i % 6).alias("sub_topic"),
            F.concat(F.lit("memo "), i % 50).alias("memo"), F.timestamp_seconds(EPOCH + i * 3600).alias("updated_at"), F.when(i % 5 == 0, F.timestamp_seconds(EPOCH + i * 3600 + 60)).alias("expired_at"), "doc_id",
        )

    def vector(self, vec_id: int = QUERY_ID) -> list[float]:
        """One stored vector as the query's."""
        row = self.raw("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
        return list(row.embedding) if row else []


_CASE = lambda names, k: f"CASE d.doc_id % {k} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"

MEMORY_SQL = f"""memory AS (
  SELECT d.doc_id, 'm' || d.doc_id AS id, d.source AS user_name, 'u' || (d.doc_id % 3) AS user_id,
    CASE WHEN d.doc_id % 4 = 0 THEN 'a' || (d.doc_id % 2) ELSE '' END AS agent_id, 's' || (d.doc_id // 10) AS session_id,
    d.text AS memory, {_CASE(TYPES, 8)} AS memory_type, CASE WHEN l.toxic = 1 THEN 'archived' ELSE 'activated' END AS status,
    {EPOCH} + d.doc_id * 3600 AS created_s, {EPOCH} + d.doc_id * 3600 + (d.doc_id % 7) * 86400 AS updated_s,
    d.lang || '/' || d.source AS key, [d.lang, d.source, 'q' || coalesce(l.quality, 1), 'b' || (d.doc_id % 5)] AS tags,
    CASE WHEN d.doc_id % 4 = 1 THEN '[working_binding:m' || (d.doc_id - 1) || ']' ELSE '' END AS background,
    d.lang AS info_lang, length(d.text) AS info_size, 0.99::DOUBLE AS confidence,
    (coalesce(l.quality, 1) * (1 + (d.doc_id % 10) / 10.0))::DOUBLE AS importance_score, (d.doc_id % 17)::INTEGER AS access_count,
    (d.doc_id % 5)::INTEGER AS retrieval_count, {_CASE(LEVELS, 3)} AS hierarchy_level, ((d.doc_id % 100) / 100.0)::DOUBLE AS pagerank,
    e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EDGES_SQL = """edges AS (
  SELECT 'm' || doc_id AS from_id, 'm' || ((doc_id * 7 + 6) % n) AS to_id, 'RELATED' AS relation, ((doc_id % 10) / 10.0)::DOUBLE AS confidence, doc_id % 13 = 0 AS dead FROM documents, (SELECT count(*) AS n FROM documents)
  UNION ALL SELECT 'm' || doc_id, 'm' || ((doc_id * 5 + 1) % n), 'CONTRADICTS', 1.0, false FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 11 = 0
  UNION ALL SELECT 'm' || doc_id, 'm' || (doc_id - 1), 'TIMELINE_NEXT', 1.0, false FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'm' || doc_id, 'e' || (doc_id % 20), 'MENTIONS_ENTITY', 0.9, false FROM documents)"""
MESSAGES_SQL = f"messages AS (SELECT conv_id, turn, role, text AS content, {EPOCH} + conv_id * 3600 + turn * 60 AS chat_s FROM conversations)"
TASKS_SQL = """tasks AS (SELECT CAST(event_id AS VARCHAR) AS item_id, 'u' || user_id AS user_id, 'c' || (user_id % 10) AS cube_id,
  CASE event_type WHEN 'click' THEN 'mem_update' WHEN 'view' THEN 'query' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'mem_read' ELSE 'mem_feedback' END AS label,
  props AS content, ts, (event_id % 4)::INTEGER AS retry_count, event_id FROM events)"""
PROFILES_SQL = f"""profiles AS (SELECT source AS cube_id, 'u' || (doc_id % 3) AS user_id, 't' || (doc_id % 4) AS topic, 's' || (doc_id % 6) AS sub_topic,
  'memo ' || (doc_id % 50) AS memo, {EPOCH} + doc_id * 3600 AS updated_s, CASE WHEN doc_id % 5 = 0 THEN {EPOCH} + doc_id * 3600 + 60 END AS expired_s, doc_id FROM documents)"""
COS_SQL = "CASE WHEN {a} IS NULL THEN NULL ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"


def cte(*parts: str) -> str:
    """WITH clause of the named views: memory, edges, messages, tasks, profiles, q."""
    views = {
        "memory": MEMORY_SQL,
        "edges": EDGES_SQL,
        "messages": MESSAGES_SQL,
        "tasks": TASKS_SQL,
        "profiles": PROFILES_SQL,
        "q": f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {QUERY_ID})",
    }
    return "WITH " + ",\n".join(views[p] for p in parts) + "\n"
