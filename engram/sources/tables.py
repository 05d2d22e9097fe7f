"""Scans of the memory model: paged, filtered, keyed and ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators.filters import compile_filter
from engram.functions import vector


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The stored table without the columns that no search projects."""
    return spark.read.parquet(path).drop("sources")


def multi_get(memory: DataFrame, ids: DataFrame, cube: str | None = None) -> DataFrame:
    m = memory.where(F.col("user_name") == cube) if cube else memory
    return m.join(ids.select("id").distinct(), "id", "left_semi")


def get_in_order(memory: DataFrame, spark: SparkSession, ids: list[str], cached: DataFrame | None = None) -> DataFrame:
    """Rows in request order, cached ones first choice; missing ids are left out."""
    want = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    rows = memory if cached is None else cached.unionByName(memory.join(cached.select("id"), "id", "left_anti"))
    return want.join(rows, "id").orderBy("pos")


def by_key(memory: DataFrame, cube: str, key: str, user: str | None = None) -> DataFrame:
    t = memory.where((F.col("user_name") == cube) & (F.col("key") == key) & (F.col("status") == "activated"))
    return (t.where(F.col("user_id") == user) if user else t).orderBy("id").limit(1)


def list_prefix(memory: DataFrame, cube: str, prefix: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Keys with a prefix (a LIKE pattern, not escaped), with text lengths; limit 1 to 1000."""
    t = memory.where((F.col("user_name") == cube) & (F.col("status") == "activated") & F.col("key").like(prefix + "%"))
    return t.select("id", "key", F.length("memory").alias("n_chars")).orderBy("key", "id").offset(offset).limit(min(max(limit, 1), 1000))


def page(memory: DataFrame, cube: str, types: list[str], number: int = 0, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """One 0-based page, newest first, and the total."""
    t = memory.where((F.col("user_name") == cube) & (F.col("status") == "activated") & F.col("memory_type").isin(*types))
    size = min(max(size, 1), 1000)
    return t.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).offset(number * size).limit(size), t.agg(F.count("*").alias("total"))


def working(memory: DataFrame, cube: str, limit: int, newest: bool = True) -> DataFrame:
    t = memory.where((F.col("user_name") == cube) & (F.col("memory_type") == "WorkingMemory") & (F.col("status") == "activated"))
    order = F.col("updated_at").desc_nulls_last() if newest else F.col("updated_at").asc_nulls_last()
    return t.withColumn("ts", F.unix_timestamp("updated_at")).orderBy(order, "id").limit(limit)


def tier(memory: DataFrame, cube: str, level: str, limit: int) -> DataFrame:
    t = memory.where((F.col("user_name") == cube) & (F.coalesce("hierarchy_level", F.lit("raw")) == level) & F.col("embedding").isNotNull() & (F.col("status") == "activated"))
    return t.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)


def session_neighbours(memory: DataFrame, cube: str, session: str, limit: int, newest: bool = True) -> DataFrame:
    t = memory.where((F.col("user_name") == cube) & (F.col("session_id") == session) & F.col("memory_type").isin("LongTermMemory", "UserMemory"))
    return t.orderBy(F.col("created_at").desc_nulls_last() if newest else F.col("created_at").asc_nulls_last(), "id").limit(limit)


def filtered(memory: DataFrame, cubes: list[str], f, limit: int = 100) -> DataFrame:
    t = memory.where((F.col("status") == "activated") & F.col("user_name").isin(*cubes) & compile_filter(f))
    return t.orderBy("id").limit(min(limit, 1000))


class Preferences:
    """Preference collections: DataFrame(collection, id, user_id, payload, embedding)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def nearest(self, collection: str, query: list[float], k: int) -> DataFrame:
        t = self.rows.where(F.col("collection") == collection)
        return t.select("id", "user_id", vector.cosine(F.col("embedding"), vector.literal(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def scroll(self, user: str, size: int = 100) -> DataFrame:
        return self.rows.where(F.col("user_id") == user).orderBy("collection", "id").limit(size)

    def delete(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select("id"), "id", "left_anti")

    def purge(self, user: str) -> DataFrame:
        return self.rows.where(~F.col("user_id").eqNullSafe(user))


def vector_cache(memory: DataFrame, newest: int = 50) -> DataFrame:
    """The newest working rows of each cube with vectors: what a warm cache holds."""
    w = Window.partitionBy("user_name").orderBy(F.col("updated_at").desc_nulls_last(), "id")
    t = memory.where("memory_type = 'WorkingMemory' AND status = 'activated' AND embedding IS NOT NULL").withColumn("r", F.row_number().over(w))
    return t.where(F.col("r") <= newest).select("user_name", "id", "memory", F.unix_timestamp("updated_at").alias("ts"), "embedding")


def cache_knn(cache: DataFrame, cube: str, query: list[float], k: int, least_ts: int | None = None) -> DataFrame:
    t = cache.where(F.col("user_name") == cube)
    t = t.where(F.col("ts") >= least_ts) if least_ts is not None else t
    return t.select("id", vector.cosine(F.col("embedding"), vector.literal(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


class ResultCache:
    """Cached DataFrames by a key of all parameters, with a time to live and glob invalidation."""

    def __init__(self, ttl: float = 30.0, clock=None):
        import time

        self.ttl, self.clock, self.held = ttl, clock or time.monotonic, {}

    def get(self, key: str, make) -> DataFrame:
        hit = self.held.get(key)
        if hit and self.clock() - hit[0] < self.ttl:
            return hit[1]
        if hit:
            hit[1].unpersist()
        df = make().cache()
        self.held[key] = (self.clock(), df)
        return df

    def invalidate(self, pattern: str) -> int:
        import fnmatch

        gone = [k for k in self.held if fnmatch.fnmatchcase(k, pattern)]
        for k in gone:
            self.held.pop(k)[1].unpersist()
        return len(gone)


DATE_LAYOUTS = ("h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def parse_date(text: Column) -> Column:
    """The first of three layouts that fits; null if none does."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in DATE_LAYOUTS])


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark JSON with dynamic session_N keys -> (sample_id, session, pos, speaker, dia_id, text, at)."""
    msg = "array<struct<speaker:string,dia_id:string,text:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<sample_id:string,conversation:map<string,string>>>")).alias("s"))
    kv = raw.select("s.sample_id", F.explode("s.conversation").alias("k", "v"))
    dates = kv.where(F.col("k").rlike(r"^session_\d+_date_time$")).select("sample_id", F.regexp_extract("k", r"(session_\d+)", 1).alias("session"), parse_date(F.col("v")).alias("at"))
    said = kv.where(F.col("k").rlike(r"^session_\d+$")).select("sample_id", F.col("k").alias("session"), F.posexplode(F.from_json("v", msg)).alias("pos", "m"))
    return said.join(dates, ["sample_id", "session"], "left").select("sample_id", "session", "pos", "m.speaker", "m.dia_id", "m.text", "at")
