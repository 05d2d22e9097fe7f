"""Retrieval: candidate lists, fusion, merging, rescoring, thresholds - one lazy plan.

A candidate list is a DataFrame (query_id, id, score, source).  Every step keeps the
query id, so many queries run as one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import scoring, text, vector
from engram.operators import graph, manysearch, ranks
from engram.operators.filters import scope
from engram.schema import SKILL_TYPES, TEXT_TYPES, TOOL_TYPES


@dataclass(frozen=True)
class SearchParams:
    """Defaults of one search; a profile and then the request override them."""

    query: str = ""
    vector: tuple[float, ...] = ()
    cubes: tuple[str, ...] = ()
    user_id: str = ""
    agent_id: str = ""
    top_k: int = 6
    relativity: float = 0.0
    dedup: str = "no"
    mmr_lambda: float = 0.7
    decay_alpha: float = scoring.DECAY_ALPHA
    importance: bool = False
    level: str = "l3"
    num_stages: int = 0
    llm_rerank: bool = False
    include_skill: bool = True
    include_tool: bool = False
    internet: bool = False
    as_of: object = None
    resort: bool = False
    hops: int = 2
    mode: str = "fast"
    include_working: bool = False
    include_preferences: bool = False
    extra: dict = field(default_factory=dict)


PROFILES = {
    "inject": {"top_k": 5, "relativity": 0.93, "dedup": "mmr", "decay_alpha": 0.01},
    "deep": {"top_k": 10, "relativity": 0.85, "dedup": "mmr", "num_stages": 2, "llm_rerank": True, "decay_alpha": 0.002},
}
#: Rows from outside that every query may get.
WEB_ROWS = 1000
LEVELS = ("l1", "l2", "l3")


def resolve_params(request: dict, profile: str | None = None) -> SearchParams:
    """defaults < profile < request; unknown profiles and levels are errors."""
    if profile and profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    p = replace(SearchParams(), **PROFILES.get(profile or "", {}))
    p = replace(p, **{k: v for k, v in request.items() if v is not None})
    if p.level not in LEVELS:
        raise ValueError(f"unknown level {p.level!r}")
    return p


def inflated_k(k: int, dedup: str) -> int:
    """Candidates to fetch: five times k where near copies will be dropped."""
    return 5 * k if dedup in ("sim", "mmr") else k


# -- candidate lists ------------------------------------------------------


def knn(memory: DataFrame, query: list[float], where: Column, k: int | None, min_score: float | None = None) -> DataFrame:
    """Exact filtered nearest neighbours of one vector: (id, score); all rows, unordered, without ``k``."""
    scored = memory.where(where & F.col("embedding").isNotNull()).select("id", vector.cosine(F.col("embedding"), vector.literal(query)).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def full_text(memory: DataFrame, tokens: list[str], where: Column, k: int | None) -> DataFrame:
    """Rows that hold a query token, by damped term frequency: (id, score); all rows, unordered, without ``k``."""
    query = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    words = text.lexemes(F.col("memory"))
    rows = memory.where(where).select("id", words.alias("words")).where(F.arrays_overlap("words", query))
    scored = rows.select("id", text.text_rank(F.col("words"), query).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def key_recall(memory: DataFrame, tokens: list[str], where: Column) -> DataFrame:
    """Rows whose key is a query token."""
    return memory.where(where & F.lower("key").isin(*(tokens or [""]))).select("id", F.lit(scoring.KEY_SCORE).alias("score"))


def tag_recall(memory: DataFrame, tags: list[str], where: Column, least: int = 2) -> DataFrame:
    """Rows that share at least ``least`` tags: (id, overlap, score)."""
    n = F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags])))
    return memory.where(where).select("id", n.alias("overlap")).where(F.col("overlap") >= least).withColumn("score", scoring.tag_score(F.col("overlap")))


def entity_recall(edges: DataFrame, memory: DataFrame, entities: list[str], where: Column) -> DataFrame:
    """Memories that mention an entity; once per edge, as edges are."""
    live = edges.where((F.col("relation") == "MENTIONS_ENTITY") & F.col("invalid_at").isNull() & F.col("to_id").isin(*entities))
    return live.join(memory.where(where).select("id"), live.from_id == F.col("id")).select("id", F.col("to_id").alias("entity_id"))


# -- fusion ------------------------------------------------------------------


def ranked(candidates: DataFrame, by: tuple[str, ...] = ("source",), whole: bool = False) -> DataFrame:
    """``candidates`` with the 1-based ``rank`` inside each list; ``whole`` for lists of any length, else a list is one task."""
    order = (F.desc("score"), F.col("id").asc())
    if whole:
        return ranks.row_numbers(candidates, by, order)
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(candidates: DataFrame, k: int = scoring.RRF_K, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion over ranked lists: sum of 1 / (rank + k), by id."""
    return candidates.groupBy(*keys, "id").agg(F.sum(1.0 / (F.col("rank") + k)).alias("score"))


def weighted_rrf(candidates: DataFrame, weights: dict[str, float], k: int = scoring.RRF_K) -> DataFrame:
    """Fusion of engines with weights; rows without an id are dropped."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = candidates.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return rows.groupBy("id").agg(F.sum(F.coalesce(w[F.col("source")], F.lit(1.0)) / (F.col("rank") + k)).alias("score"))


def graph_merge(merged: DataFrame, recalled: DataFrame) -> DataFrame:
    """Full outer merge by id; the larger score stays."""
    r = recalled.groupBy("id").agg(F.max("score").alias("graph_score"))
    return merged.join(r, "id", "full").select("id", F.greatest("score", "graph_score").alias("score"))


def union_max(*lists: DataFrame) -> DataFrame:
    """Union of result lists; the best score of an id wins, the first list gives its place."""
    rows = reduce(DataFrame.unionByName, [x.select("id", "score", F.lit(i).alias("ord")) for i, x in enumerate(lists)])
    return rows.groupBy("id").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


def contradiction_penalty(results: DataFrame, edges: DataFrame, top: int = 10, limit: int = 20) -> DataFrame:
    """Targets of CONTRADICTS edges from the best rows lose 0.30, not below 0."""
    seeds = results.orderBy(F.desc("score"), "id").limit(top).select("id")
    bad = edges.where((F.col("relation") == "CONTRADICTS") & F.col("invalid_at").isNull()).join(F.broadcast(seeds), F.col("from_id") == F.col("id"), "left_semi")
    bad = bad.orderBy("from_id", "to_id").limit(limit).select(F.col("to_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    hit = F.greatest(F.col("score") - scoring.CONTRADICTION_PENALTY, F.lit(0.0))
    return results.join(bad, "id", "left").withColumn("score", F.when(F.col("bad"), hit).otherwise(F.col("score"))).drop("bad")


def multi_hop(results: DataFrame, edges: DataFrame, memory: DataFrame, query: list[float], where: Column, depth: int = 2, most: int = 1000) -> DataFrame:
    """Seeds (``most`` of them at most) plus as many neighbours at most: (cos + 1) / 2 x 0.8^hop, or the seed's score x 0.8^hop without a vector."""
    seeds = results.select("id", "score")
    near = graph.k_hop(edges, seeds.select("id"), depth)
    m = memory.where(where).select("id", "embedding")
    cos = vector.cosine(F.col("embedding"), vector.literal(query))
    parent = seeds.select(F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    rows = near.join(m, "id").join(parent, "seed", "left")
    factor = F.pow(F.lit(scoring.HOP_DECAY), F.col("hop").cast("double"))
    rows = rows.select("id", (F.coalesce(vector.relativity(cos), F.col("seed_score")) * factor).alias("score"))
    n = F.broadcast(seeds.agg(F.count("*").alias("n_seeds")))
    rows = rows.orderBy(F.desc("score"), "id").limit(most)  # seeds are no more, so the window below is small
    rows = rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).join(n, F.col("r") <= F.col("n_seeds"))
    return seeds.unionByName(rows.select("id", "score"))


# -- rescoring and selection --------------------------------------------------


def cosine_rescore(results: DataFrame, memory: DataFrame, query: list[float]) -> DataFrame:
    """score := (cos + 1) / 2 where a vector is known."""
    cos = vector.cosine(F.col("embedding"), vector.literal(query))
    return results.join(memory.select("id", "embedding"), "id", "left").withColumn("score", F.coalesce(vector.relativity(cos), F.col("score"))).drop("embedding")


def apply_importance(results: DataFrame, memory: DataFrame, as_of: Column, alpha: float = scoring.DECAY_ALPHA) -> DataFrame:
    """score := score x recency x importance x tier x PageRank, instead of ``apply_decay``."""
    m = memory.select("id", "updated_at", "access_count", "hierarchy_level", "pagerank", "memory_type")
    s = scoring.importance_decay(F.col("score"), F.col("updated_at"), as_of, F.col("access_count"), F.col("hierarchy_level"), F.col("pagerank"), F.col("memory_type"), alpha)
    return results.join(m, "id", "left").select("id", s.alias("score"))


def rescored(found: DataFrame, memory: DataFrame, query: list[float], as_of: Column, alpha: float = scoring.DECAY_ALPHA) -> DataFrame:
    """(id, memory, memory_type, score): cosine and decay of a few candidates (id, score) in one pass over the table.

    ``found`` must be bounded (top-k lists), as it is broadcast.
    """
    m = memory.select("id", "memory", "memory_type", "updated_at", "embedding").join(F.broadcast(found.select("id", "score")), "id")
    rel = F.coalesce(vector.relativity(vector.cosine(F.col("embedding"), vector.literal(query))), F.col("score"))
    m = m.withColumn("score", rel)
    return m.select("id", "memory", "memory_type", scoring.decay(F.col("score"), F.col("updated_at"), as_of, F.col("memory_type"), alpha).alias("score"))


def apply_decay(results: DataFrame, memory: DataFrame, as_of: Column, alpha: float = scoring.DECAY_ALPHA) -> DataFrame:
    m = memory.select("id", "updated_at", "memory_type")
    return results.join(m, "id", "left").withColumn("score", scoring.decay(F.col("score"), F.col("updated_at"), as_of, F.col("memory_type"), alpha)).drop("updated_at", "memory_type")


def threshold(results: DataFrame, least: float, softer: bool = False) -> DataFrame:
    """Rows at or above the threshold; preferences and working memory get 0.10 of slack."""
    t = least - 0.10 if softer and least > 0 else least
    return results.where(F.col("score") >= t)


def preference_quality(text_col: Column) -> Column:
    """At least 30 bytes trimmed, and no bare chat line."""
    t = F.trim(text_col)
    return (F.octet_length(t) >= 30) & ~t.rlike(r"(?i)^(user|assistant|system):")


def chat_backfill(items: DataFrame, least: float = 0.30, at_least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows over the threshold; too few are filled up from the best personal and outer rows.

    ``items``: id, score, outer (boolean), ord (original place); one result list, or
    one for each value of the columns ``by``.
    """
    personal = F.row_number().over(Window.partitionBy(*by, "outer").orderBy("ord"))
    t = items.withColumn("place", personal).withColumn("ok", F.col("score") >= least)
    everything = Window.partitionBy(*by)
    t = t.withColumn("n_ok", F.count(F.when(F.col("ok"), 1)).over(everything)).withColumn("n_personal", F.count(F.when(F.col("ok") & ~F.col("outer"), 1)).over(everything))
    keep = (
        F.when(F.col("n_ok") < at_least, F.col("place") <= at_least)
        .when(F.col("n_personal") < at_least, F.col("ok") | (~F.col("outer") & (F.col("place") > F.col("n_personal")) & (F.col("place") <= at_least)))
        .otherwise(F.col("ok"))
    )
    return t.where(keep).select(*by, "id", "score", "outer", "ord")


def bucket_of(memory_type: Column) -> Column:
    return F.when(memory_type.isin(*SKILL_TYPES), "skill").when(memory_type.isin(*TOOL_TYPES), "tool").when(memory_type == "PreferenceMemory", "pref").otherwise("text")


def first_by_text(rows: DataFrame, priority: Column, by: tuple[str, ...] = (), order: tuple = ()) -> DataFrame:
    """One row a case-folded text: the least priority, then score, then id; empty texts go."""
    w = Window.partitionBy(*by, F.lower(F.trim("memory"))).orderBy(priority, *(order or (F.desc("score"), F.col("id"))))
    return rows.where(F.trim("memory") != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


BUCKET_PRIORITY = "CASE bucket WHEN 'text' THEN 0 WHEN 'skill' THEN 1 WHEN 'tool' THEN 2 ELSE 3 END"


def cross_source_dedupe(rows: DataFrame) -> DataFrame:
    """Text wins over skill, tool and preference."""
    return first_by_text(rows, F.expr(BUCKET_PRIORITY))


def top_per_bucket(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def item_projection(memory: DataFrame) -> DataFrame:
    """The response row: no sources, blank embedding, short reference, default counter."""
    ref = F.concat(F.lit("["), F.get(F.split("id", "-"), F.lit(0)), F.lit("]"))
    return memory.select("id", ref.alias("ref_id"), "memory", bucket_of(F.col("memory_type")).alias("bucket"), F.coalesce("access_count", F.lit(0)).alias("access_count"))


def gate(results: DataFrame) -> DataFrame:
    """One row: the rerank decision for a result list."""
    a = results.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("bottom"))
    return a.select("n", scoring.rerank_gate(F.col("n"), F.col("top"), F.col("bottom")).alias("decision"))


def precomputed_rerank(results: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Scores of the first row's stored neighbours, if they cover all other rows; the first keeps its place.

    ``results``: id, score, ord; ``neighbours``: id, neighbor_id, score.
    """
    anchor = results.orderBy("ord").limit(1).select(F.col("id").alias("anchor"))
    stored = neighbours.join(F.broadcast(anchor), F.col("id") == F.col("anchor")).groupBy("neighbor_id").agg(F.max("score").alias("stored"))
    t = results.join(stored, F.col("id") == F.col("neighbor_id"), "left").join(F.broadcast(anchor.withColumn("is_first", F.lit(True))), F.col("id") == F.col("anchor"), "left")
    first = F.coalesce("is_first", F.lit(False))
    covered = F.bool_and(first | F.col("stored").isNotNull()).over(Window.partitionBy())
    t = t.withColumn("covered", covered)
    new = F.when(F.col("covered") & ~first, F.col("stored")).otherwise(F.col("score"))
    w = Window.orderBy(F.when(F.col("covered"), F.when(first, 0).otherwise(1)).otherwise(0), F.when(F.col("covered"), -new).otherwise(F.col("ord")), "ord")
    return t.withColumn("new", new).withColumn("place", F.row_number().over(w)).select("id", F.col("new").alias("score"), "place", "covered")


def reorder(results: DataFrame, given: DataFrame) -> DataFrame:
    """Each query's rows (query_id, id, ord) with their ``place``: those of ``given`` (query_id, id, pos) first in that order, then the rest in their own."""
    t = results.join(given, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("pos").asc_nulls_last(), "ord", "id")
    return t.withColumn("place", F.row_number().over(w)).drop("pos")


def fill_up(kept: DataFrame, recall: DataFrame, k: int) -> DataFrame:
    """``kept`` and then unseen rows of ``recall`` up to k."""
    more = recall.join(kept.select("id"), "id", "left_anti").withColumn("ord", F.lit(1))
    both = kept.withColumn("ord", F.lit(0)).unionByName(more, allowMissingColumns=True)
    return both.orderBy("ord", F.desc("score"), "id").limit(k).drop("ord")


def counters(memory: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieval counters of returned rows: +1, importance + 0.1 up to 2.0."""
    h = hits.select("id").distinct().withColumn("hit", F.lit(True))
    t = memory.join(h, "id", "left")
    one = F.when(F.col("hit"), 1).otherwise(0)
    return (
        t.withColumn("retrieval_count", F.coalesce("retrieval_count", F.lit(0)) + one)
        .withColumn("access_count", F.coalesce("access_count", F.lit(0)) + one)
        .withColumn("importance_score", F.when(F.col("hit"), F.least(F.lit(2.0), F.coalesce("importance_score", F.lit(0.0)) + 0.1)).otherwise(F.col("importance_score")))
        .drop("hit")
    )


# Words that join parts of a question.
CONNECTORS = frozenset("after before because since when while until then caused led during".split())


def should_decompose(query: str, least_words: int = 8, least_entities: int = 2) -> bool:
    """Long questions with a connector and two capitalised words after the first."""
    words = query.split()
    if len(words) <= least_words:
        return False
    bare = ["".join(c for c in w if c.isalnum()) for w in words]
    entities = sum(w[:1].isupper() for w in bare[1:])
    return any(w.lower() in CONNECTORS for w in bare) and entities >= least_entities


def normalize_subqueries(original: str, parts: list[str], most: int = 5) -> list[str]:
    """The original first; blanks and case-folded repeats dropped; capped."""
    seen, out = set(), []
    for p in [original, *parts]:
        t = p.strip()
        if t and t.lower() not in seen:
            seen.add(t.lower())
            out.append(t)
    return out[:most]


def sub_query_union(memory: DataFrame, vectors: list[list[float]], where: Column, k: int) -> DataFrame:
    """kNN of each sub-query, best score an id."""
    return union_max(*[knn(memory, v, where, k) for v in vectors]).orderBy(F.desc("score"), "id").limit(k)


def search(memory: DataFrame, edges: DataFrame, p: SearchParams, as_of: Column, scorer=None, web: DataFrame | None = None) -> DataFrame:
    """The full search of one query as one lazy plan: (bucket, rank, id, memory, score); see ``manysearch.search_many``."""
    one = manysearch.request_rows(memory.sparkSession, [{"query": p.query, "vector": p.vector, "cubes": p.cubes}])
    return manysearch.search_many(memory, edges, one, p, as_of, scorer, web).drop("query_id")
