"""Maintenance jobs: consolidation, promotion, compaction, refresh, periodic cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text
from engram.operators import graph, hierarchy, ingest, pairs, search, store
from engram.session import materialize

# Thresholds of the jobs.
NEAR_DUPLICATE, AUTO_MERGE, CLUSTER_CHILDREN = 0.85, 0.97, 6
EPISODIC, SEMANTIC = (0.7, 3), (0.6, 2)
COMPACT_AT, COMPACT_KEEP = 50, 10


def duplicate_pairs(memory: DataFrame, least: float = NEAR_DUPLICATE, limit: int | None = None) -> DataFrame:
    """(a, b, score) of active rows of the same cube; the best ``limit`` pairs if one is given."""
    p = pairs.pairs_above(memory.where("status = 'activated'"), least, group="user_name")
    return p.orderBy(F.desc("score"), "a", "b").limit(limit) if limit else p


def clusters(pair_rows: DataFrame, least_size: int = 2) -> DataFrame:
    """(id, cluster, size): components of duplicate pairs."""
    labels = graph.connected_components(pair_rows).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    size = labels.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return labels.join(size, "cluster").select("id", "cluster", "size")


def cluster_scores(pair_rows: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, min_score): the least over members of each one's best pair."""
    both = pair_rows.select(F.col("a").alias("id"), "score").unionByName(pair_rows.select(F.col("b").alias("id"), "score"))
    return least_best(both.select("id", F.col("score").alias("best")), members)


def least_best(scores: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, min_score) from scores(id, best), some a row."""
    best = scores.groupBy("id").agg(F.max("best").alias("best"))
    return members.join(best, "id").groupBy("cluster").agg(F.min("best").alias("min_score"))


def link_clusters(links: DataFrame, least_size: int = 2) -> DataFrame:
    """``clusters`` of ``pairs.links``."""
    return clusters(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), least_size)


def split_clusters(members: DataFrame, most: int = CLUSTER_CHILDREN) -> DataFrame:
    """Slices of at most ``most`` members: (id, cluster, part)."""
    w = Window.partitionBy("cluster").orderBy("id")
    return members.withColumn("part", F.floor((F.row_number().over(w) - 1) / most).cast("int"))


def auto_merge(memory: DataFrame, members: DataFrame, scores: DataFrame, least: float = AUTO_MERGE, sizes: DataFrame | None = None) -> DataFrame:
    """(id, into_id): in clusters above the score the longest text in bytes stays, the least id on a tie.

    ``sizes`` (id, size_bytes), where they are known, save reading the texts.
    """
    sizes = sizes if sizes is not None else memory.select("id", F.octet_length("memory").alias("size_bytes"))
    ok = scores.where(F.col("min_score") >= least).select("cluster")
    t = members.join(ok, "cluster", "left_semi").join(sizes, "id")
    w = Window.partitionBy("cluster").orderBy(F.desc("size_bytes"), "id")
    t = t.withColumn("into_id", F.first("id").over(w))
    return t.where("id <> into_id").select("id", "into_id")


def consolidate(memory: DataFrame, least: float = NEAR_DUPLICATE, merge_at: float = AUTO_MERGE, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges (id, into_id) and their MERGED_INTO edges; ``sizes`` as in ``auto_merge``."""
    found = materialize(pairs.links(memory.where("status = 'activated'"), least, group="user_name"), "links")
    members = link_clusters(found)
    merges = auto_merge(memory, members, least_best(found, members), merge_at, sizes)
    return merges, merges.select(F.col("id").alias("from_id"), F.col("into_id").alias("to_id"), F.lit("MERGED_INTO").alias("relation"), F.lit(1.0).alias("confidence"))


def remove_contradicted(memory: DataFrame, edges: DataFrame, found: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """found(keep_id, bad_id): CONTRADICTS edges are written, edges of the bad row end, the row goes."""
    new = found.select(F.col("keep_id").alias("from_id"), F.col("bad_id").alias("to_id"), F.lit("CONTRADICTS").alias("relation"), F.lit(1.0).alias("confidence"))
    bad = found.select(F.col("bad_id").alias("id"))
    return store.delete_ids(memory, bad), graph.upsert_edges(graph.invalidate(edges, bad, at), new)


def resolve_ids(given: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(given, id): the only known id within ``most`` edits, case folded; ambiguous ones go.

    A known id is cut into ``most`` + 1 segments, of which an id within ``most`` edits
    holds one unchanged, at most ``most`` places away.  So the two tables join on
    (length, segment number, segment), and only such pairs are compared.
    """
    parts = most + 1
    cut = "substring(low, cast(floor(i * n / {0}) AS int) + 1 + {1}, cast(floor((i + 1) * n / {0}) - floor(i * n / {0}) AS int))"
    k = known.select("id", F.lower("id").alias("low")).withColumn("n", F.length("low")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    k = k.select("id", "n", "i", F.expr(cut.format(parts, 0)).alias("segment"))
    g = given.select(F.col("id").alias("given"), F.lower("id").alias("low")).where("low IS NOT NULL").distinct()
    g = g.withColumn("n", F.explode(F.sequence(F.greatest(F.length("low") - most, F.lit(0)), F.length("low") + most))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    g = g.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("at", F.expr(f"cast(floor(i * n / {parts}) AS int) + shift")).where("at >= 0 AND at <= length(low)")
    g = g.select("given", "n", "i", F.expr(cut.format(parts, "shift")).alias("segment")).distinct()
    t = g.join(k, ["n", "i", "segment"]).select("given", "id").distinct().where(F.levenshtein(F.lower("given"), F.lower("id")) <= most)
    exact = F.max(F.lower("given") == F.lower("id"))
    one = t.groupBy("given").agg(F.count("*").alias("n"), exact.alias("exact"), F.min("id").alias("id"), F.max(F.when(F.lower("given") == F.lower("id"), F.col("id"))).alias("same"))
    return one.where("n = 1 OR exact").select("given", F.coalesce("same", "id").alias("id"))


def promote(memory: DataFrame, level: str = "raw", least: float = EPISODIC[0], least_size: int = EPISODIC[1], summarize=None) -> dict[str, DataFrame]:
    """Clusters of a level become parents of the next: parents, levels, edges and audit rows.

    ``summarize`` maps the members' texts (array) to the parent's; the default takes the longest.
    """
    up = {"raw": "episodic", "episodic": "semantic"}[level]
    rows = memory.where((F.coalesce("hierarchy_level", F.lit("raw")) == level) & F.col("embedding").isNotNull() & (F.col("status") == "activated"))
    members = link_clusters(pairs.links(rows, least, group="user_name"), least_size)
    m = members.join(rows.select("id", "user_name", "memory"), "id")
    longest = F.max_by("memory", F.struct(F.octet_length("memory"), F.col("id")))
    texts = summarize(F.collect_list("memory")) if summarize else longest
    parents = m.groupBy("cluster", "user_name").agg(texts.alias("memory"), F.array_sort(F.collect_list("id")).alias("child_ids"))
    parents = parents.withColumn("id", F.concat(F.lit("p"), F.substring(F.sha2(F.array_join("child_ids", ","), 256), 1, 16)))
    links = parents.select(F.explode("child_ids").alias("id"), F.col("id").alias("parent_id"))
    return {
        "parents": parents.select("id", "user_name", "memory", F.lit(up).alias("hierarchy_level")),
        "levels": links.select("id", F.lit(level).alias("level"), "parent_id"),
        "edges": links.select(F.col("id").alias("from_id"), F.col("parent_id").alias("to_id"), F.lit("CONSOLIDATED_INTO").alias("relation"), F.lit(1.0).alias("confidence")),
        "audit": parents.select(F.col("id").alias("parent_id"), "child_ids", F.size("child_ids").alias("n_children"), F.lit(up).alias("level")),
    }


def compaction_split(memory: DataFrame, at: int = COMPACT_AT, keep: int = COMPACT_KEEP) -> DataFrame:
    """Working rows to compact: all but the newest ``keep`` of cubes with at least ``at``."""
    w = Window.partitionBy("user_name")
    t = memory.where("memory_type = 'WorkingMemory' AND status = 'activated'").withColumn("n", F.count("*").over(w))
    t = t.withColumn("place", F.row_number().over(w.orderBy(F.col("updated_at").asc_nulls_first(), "id")))
    return t.where((F.col("n") >= at) & (F.col("place") <= F.col("n") - keep)).drop("n", "place")


def compact(memory: DataFrame, at: int = COMPACT_AT, keep: int = COMPACT_KEEP, now: Column | None = None) -> DataFrame:
    """One episodic row a cube out of its compacted working rows: texts joined, oldest first; the mean vector; the newest time, or ``now``."""
    t = compaction_split(memory, at, keep)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("updated_at", "id", "memory"))), lambda x: x["memory"]), "\n")
    made = t.groupBy("user_name").agg(joined.alias("memory"), F.count("*").alias("n"), F.max("updated_at").alias("updated_at")).withColumn("memory_type", F.lit("EpisodicMemory"))
    made = made if now is None else made.withColumn("updated_at", now)
    if "embedding" not in memory.columns:
        return made
    parts = t.select("user_name", F.posexplode("embedding").alias("i", "x")).groupBy("user_name", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("user_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).cast(memory.schema["embedding"].dataType).alias("embedding"))
    return made.join(mean, "user_name", "left")


def refresh_working(memory: DataFrame, query: list[float], where: Column, k: int | None = 10, least: float = 0.60) -> DataFrame:
    """Long-term rows close to the query (the ``k`` closest, if given) as new working rows, bound to their source."""
    near = search.knn(memory, query, where, k, least)
    t = near.join(memory.select("id", "user_name", "memory"), "id")
    return t.select(F.concat(F.lit("w-"), "id").alias("id"), "user_name", "memory", F.lit("WorkingMemory").alias("memory_type"), F.concat(F.lit("[working_binding:"), F.col("id"), F.lit("]")).alias("background"), "score")


def transfer_lineage(new: DataFrame, processed: DataFrame) -> DataFrame:
    """EXTRACTED_FROM from every new row of a task to every working row it was made from."""
    return new.select("task_id", F.col("id").alias("from_id")).join(processed.select("task_id", F.col("id").alias("to_id")), "task_id").withColumn("relation", F.lit("EXTRACTED_FROM"))


def transfer(memory: DataFrame, extract=None) -> DataFrame:
    """Working rows as long-term facts; without an extractor only clean text is taken as it is."""
    t = memory.where("memory_type = 'WorkingMemory' AND status = 'activated'")
    if extract is not None:
        return extract(t)
    return t.where(ingest.clean_text_gate(F.col("memory"))).select(F.concat(F.lit("x"), F.substring(text.content_hash(F.col("memory")), 1, 16)).alias("id"), "user_name", "memory", F.col("id").alias("from_working"))


def profile_summary(memory: DataFrame, most: int = 100, least_chars: int = 50) -> DataFrame:
    """(user_name, summary): the newest user memories joined, where there is enough text."""
    w = Window.partitionBy("user_name").orderBy(F.col("created_at").desc_nulls_last(), "id")
    t = memory.where("memory_type = 'UserMemory' AND status = 'activated'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    t = t.groupBy("user_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "memory"))), lambda x: x["memory"]), "\n").alias("summary"))
    return t.where(F.length("summary") >= least_chars)


def active_cubes(memory: DataFrame) -> DataFrame:
    return memory.where("status = 'activated'").select("user_name").distinct()


def write_pagerank(memory: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks clamped to [0, 1]; rows without one keep theirs."""
    r = ranks.select("id", F.least(F.greatest(F.round("pagerank", 8), F.lit(0.0)), F.lit(1.0)).alias("new"))
    return memory.join(r, "id", "left").withColumn("pagerank", F.coalesce("new", "pagerank")).drop("new")


def is_raw_window() -> Column:
    return (F.instr("memory", "assistant: [20") > 0) & F.col("memory_type").isin("LongTermMemory", "UserMemory") & (F.col("status") == "activated")


def raw_window_count(memory: DataFrame) -> DataFrame:
    return memory.where(is_raw_window()).groupBy("user_name").agg(F.count("*").alias("n"))


def raw_windows(memory: DataFrame, limit: int = 50) -> DataFrame:
    """Rows that hold raw chat windows, oldest first; 50 a run, 200 at most."""
    t = memory.where(is_raw_window())
    return t.orderBy(F.col("created_at").asc_nulls_last(), "id").limit(min(limit, 200))


def cycle(memory: DataFrame, edges: DataFrame, at: Column, least: float = NEAR_DUPLICATE, tiers: dict[str, tuple[float, int]] | None = None, merge_at: float = AUTO_MERGE) -> tuple[DataFrame, DataFrame]:
    """One periodic round over all cubes: compact, consolidate, grow the tree by both tiers, decay.

    But for the decay of importance a second round over the result changes nothing.
    ``tiers`` sets a tier's cosine and least cluster.
    """
    memory = store._with_column(store._with_column(memory, "hierarchy_level"), "parent_memory_id")
    gone = compaction_split(memory).select("id")
    made = compact(memory, now=at).select(
        F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("\n", "user_name", "memory"), 256), 1, 16)).alias("id"), "user_name", "memory", "memory_type", "embedding", "updated_at", F.col("updated_at").alias("created_at"), F.lit("activated").alias("status")
    )
    made = made.select(*[c for c in made.columns if c in memory.columns])
    m = materialize(store.delete_ids(memory, gone).unionByName(made, allowMissingColumns=True), "compacted")
    # a parent has the vector of its longest child, so it isn't a copy of it
    merges, merged = consolidate(m.where("coalesce(hierarchy_level, 'raw') = 'raw'"), least, merge_at)
    merges = materialize(merges, "merges")
    m = store.soft_merge(m, merges, at)
    e = graph.upsert_edges(edges, merged)
    for level in hierarchy.TIERS:
        cosine, size = (tiers or {}).get(level, (None, None))
        m, e, _ = hierarchy.grow(m, e, at, level, cosine, size)
    return store.decay_importance(m), e
