"""Merging of result lists, and the rows that go beside them: working memory, preferences, profiles, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import vector
from engram.operators import pairs, ranks, search

#: Cosine from which a new row of fast and raw ingest is a repeat.
REPEATED = 0.92
#: Of fine ingest: the conversation is skipped above the first, and hinted at above the second.
SKIPPED, HINTED = 0.97, 0.92


def split_kinds(*lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of recall lists (id, memory_type, score, ...) as (text rows, skill rows)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    skill = F.coalesce(F.col("memory_type").isin(*search.SKILL_TYPES), F.lit(False))
    return rows.where(~skill), rows.where(skill)


def merge_cubes(lists: list[DataFrame], k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Results of several cubes: of a repeated id the first list's row stays; best score first, with ``rank``.

    Without ``k`` whole lists are ranked, by ranges.
    """
    rows = reduce(DataFrame.unionByName, [x.withColumn("__list", F.lit(i)) for i, x in enumerate(lists)])
    first = Window.partitionBy(*by, "id").orderBy("__list", F.desc("score"))
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__list")
    order = (F.desc("score"), F.col("id").asc())
    if k is None:
        keys = by or ("__all",)
        return ranks.row_numbers(rows if by else rows.withColumn("__all", F.lit(1)), keys, order).select(*rows.columns, "rank")
    if not by:
        rows = rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def merge_speakers(a: DataFrame, b: DataFrame, k: int, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Results (id, memory, score) of two speakers: the larger score of an id wins and names its speaker; rows without an id all stay; the best ``k``."""
    rows = a.withColumn("speaker", F.lit(labels[0])).unionByName(b.withColumn("speaker", F.lit(labels[1])))
    known = rows.where(F.col("id").isNotNull())
    best = F.max_by(F.struct("memory", "score", "speaker"), F.struct("score", F.col("speaker") == labels[0]))
    merged = known.groupBy("id").agg(best.alias("r")).select("id", "r.*")
    return merged.unionByName(rows.where(F.col("id").isNull()).select(*merged.columns)).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "memory").limit(k)


def inner_rows(rows: DataFrame, internet: bool, outer: Column | None = None) -> DataFrame:
    """Rows from outside go unless the search asked for them."""
    outer = F.col("memory_type") == "OuterMemory" if outer is None else outer
    return rows if internet else rows.where(~F.coalesce(outer, F.lit(False)))


def working_bucket(memory: DataFrame, query: list[float], where: Column, least: float, k: int = 20) -> DataFrame:
    """Working rows by (cosine + 1) / 2, with 0.10 of slack below the threshold, the best ``k``: (id, score, rank)."""
    rows = memory.where(where & (F.col("memory_type") == "WorkingMemory") & F.col("embedding").isNotNull())
    rows = rows.select("id", vector.relativity(vector.cosine(F.col("embedding"), vector.literal(query))).alias("score"))
    rows = search.threshold(rows, least, True).orderBy(F.desc("score"), "id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def preference_rows(rows: DataFrame) -> DataFrame:
    """Preferences (id, memory, memory_content, ord): the first of an id, its text else its content; rows without either go."""
    text = F.coalesce(F.nullif(F.trim("memory"), F.lit("")), F.nullif(F.trim("memory_content"), F.lit("")))
    first = Window.partitionBy("id").orderBy("ord")
    t = rows.withColumn("memory", text).where(F.col("memory").isNotNull())
    return t.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("id", "memory", "ord")


def attach_profiles(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each result list's cube with its cached profile text, '' without one.  ``profiles``: cube_id, profile."""
    p = profiles.select(F.col("cube_id").alias("user_name"), "profile")
    return results.join(p, "user_name", "left").withColumn("profile", F.coalesce("profile", F.lit("")))


def drop_repeats(new: DataFrame, memory: DataFrame, least: float = REPEATED) -> DataFrame:
    """New rows (id, user_name, embedding, ...) less those with an active row of their cube at ``least`` cosine or more.

    Rows without a vector or a cube stay.  The search is a join in blocks, so a hot cube is many tasks.
    """
    a = new.select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v"))
    b = memory.where("status = 'activated'").select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v"))
    hit = pairs.nearest(a, b, least).select(F.col("grp").alias("user_name"), "id").distinct()
    return new.join(hit, ["user_name", "id"], "left_anti")


def fine_gate(convs: DataFrame, memory: DataFrame) -> DataFrame:
    """Conversations (id, user_name, embedding) with ``nearest``, ``score`` and ``gate``: skip, hint or new."""
    a = convs.select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v"))
    b = memory.where("status = 'activated'").select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v"))
    best = pairs.nearest(a, b, HINTED).select(F.col("grp").alias("user_name"), "id", F.col("other").alias("nearest"), "score")
    s = F.col("score")
    return convs.select("id", "user_name").join(best, ["user_name", "id"], "left").withColumn("gate", F.when(s > SKIPPED, "skip").when(s > HINTED, "hint").otherwise("new"))


def config_upsert(config: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Settings (user_id, settings map, updated_at), a row a user in both: new keys and values win, others stay; only touched rows get the time."""
    t = config.join(new.select("user_id", F.col("settings").alias("n")), "user_id", "full")
    old, add = F.coalesce("settings", F.create_map().cast("map<string,string>")), F.coalesce("n", F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(add, k)), add)
    return t.select("user_id", both.alias("settings"), F.when(F.col("n").isNotNull(), at).otherwise(F.col("updated_at")).alias("updated_at"))
