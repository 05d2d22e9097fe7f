"""The memory tree, kept up from what changed: raw rows gather under episodic parents, those under semantic ones.

A row knows its parent (``parent_memory_id``), and a live CONSOLIDATED_INTO edge says the
same.  A round looks only at rows of a tier without a parent: pairs with at least one of
them are searched, a row that has a parent stands for the parent's whole cluster, and
the connected components of that small graph say who joins, what merges and what is
new.  A cluster that has lost a row is dissolved first, so its rows are looked at again.
A second round over unchanged rows finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import graph, pairs, store
from engram.session import materialize

RELATION = "CONSOLIDATED_INTO"
#: Types that take part in the tree.
TREE_TYPES = ["LongTermMemory", "UserMemory", "EpisodicMemory", "WorkingMemory", "SemanticMemory"]
# The tier above, its cosine and its least cluster, and the type of its parents.
TIERS = {"raw": ("episodic", 0.7, 3, "EpisodicMemory"), "episodic": ("semantic", 0.6, 2, "SemanticMemory")}


def parent_id(level: Column, cluster: Column) -> Column:
    """The id of the parent that a cluster without one gets: by the tier and the cluster's least row."""
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws(":", level, cluster), 256), 1, 16))


def tier_rows(memory: DataFrame, level: str) -> DataFrame:
    """Rows of a tier that can have a parent."""
    live = (F.col("status") == "activated") & F.col("embedding").isNotNull() & F.col("memory_type").isin(*TREE_TYPES) & F.col("user_name").isNotNull()
    return memory.where(live & (F.coalesce("hierarchy_level", F.lit("raw")) == level))


def broken(memory: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """(parent): parents of the tier above that, or a child of which, is no longer active, or left."""
    alive = memory.where("status = 'activated'").select(F.col("id").alias("from_id"), F.col("parent_memory_id").alias("to_id"))
    links = graph.live(edges).where(F.col("relation") == RELATION).select("from_id", "to_id")
    above = memory.where(F.col("hierarchy_level") == TIERS[level][0]).select(F.col("id").alias("to_id"))
    links = links.join(above, "to_id", "left_semi")
    lost = links.join(alive, ["from_id", "to_id"], "left_anti").select("to_id")
    gone = links.join(memory.where("status = 'activated'").select(F.col("id").alias("to_id")), "to_id", "left_anti").select("to_id")
    return lost.unionByName(gone).select(F.col("to_id").alias("parent")).distinct()


def dissolve(memory: DataFrame, edges: DataFrame, parents: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """parents(parent) are archived, their live edges end, and their children have no parent."""
    p = parents.select(F.col("parent").alias("__p"), F.lit(True).alias("__hit"))
    t = memory.join(p, F.col("id") == F.col("__p"), "left").withColumn("__gone", F.coalesce("__hit", F.lit(False))).drop("__p", "__hit")
    t = t.join(p, F.col("parent_memory_id") == F.col("__p"), "left")
    new = {
        "status": F.when(F.col("__gone") & (F.col("status") == "activated"), "archived").otherwise(F.col("status")),
        "parent_memory_id": F.when(F.col("__hit"), F.lit(None)).otherwise(F.col("parent_memory_id")),
    }
    memory = t.select(*[new[c].alias(c) if c in new else F.col(c) for c in memory.columns])
    ended = edges.where(F.col("relation") == RELATION)
    ended = graph.invalidate(ended, parents.select(F.col("parent").alias("id")), at, "to_id")
    return memory, edges.where(~F.col("relation").eqNullSafe(RELATION)).unionByName(ended)


def clusters(rows: DataFrame, least: float, block: int = pairs.BLOCK) -> DataFrame:
    """(id, user_name, cluster, parent): what rows without a parent form among themselves and with clusters that exist.

    ``cluster`` is the least row or parent id of it; ``parent`` the row's present one.
    Clusters that no row without a parent touches are left out.
    """
    root = rows.select("id", F.coalesce("parent_memory_id", "id").alias("root"))
    found = pairs.pairs_touching(rows, rows.where("parent_memory_id IS NULL"), least, "user_name", block=block)
    edges = found.join(root.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    parts = graph.connected_components(edges.where("ra <> rb").select("ra", "rb").distinct(), "ra", "rb")
    t = rows.select("id", "user_name", F.col("parent_memory_id").alias("parent"), F.coalesce("parent_memory_id", "id").alias("node"))
    return t.join(parts, "node").select("id", "user_name", F.col("root").alias("cluster"), "parent")


def grow(memory: DataFrame, edges: DataFrame, at: Column, level: str = "raw", least: float | None = None, least_size: int | None = None, summarize=None, block: int = pairs.BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of a tier: (memory, edges, audit).

    The parent's text and vector are those of its longest child; ``summarize`` (texts as
    an array column -> text) makes the text instead.  Of clusters that merge the least
    parent stays.  ``audit`` has a row a parent made or changed: parent_id, n_children,
    level.
    """
    up, cosine, size, kind = TIERS[level]
    least, least_size = least if least is not None else cosine, least_size if least_size is not None else size
    memory = store._with_column(store._with_column(memory, "parent_memory_id"), "hierarchy_level")
    lost = materialize(broken(memory, edges, level), "broken")
    memory, edges = dissolve(memory, edges, lost, at)
    memory, edges = materialize(memory, "tree"), materialize(edges, "tree-edges")
    rows = tier_rows(memory, level)
    members = materialize(clusters(rows, least, block), "clusters")
    sizes = members.groupBy("cluster", "user_name").agg(F.count("*").alias("n"), F.min("parent").alias("kept"), F.min("id").alias("first")).where(F.col("n") >= least_size)
    sizes = sizes.withColumn("into", F.coalesce("kept", parent_id(F.lit(level), F.col("first"))))
    members = materialize(members.join(sizes.select("cluster", "n", "into"), "cluster"), "members")
    texts = members.join(rows.select("id", "memory", "embedding"), "id")
    longest = F.max_by(F.struct("memory", "embedding"), F.struct(F.octet_length("memory"), F.col("id"))).alias("m")
    made = texts.groupBy("into", "user_name").agg(longest, F.count("*").alias("n_children"), *([F.collect_list("memory").alias("texts")] if summarize else []))
    text = summarize(F.col("texts")) if summarize else F.col("m.memory")
    parents = made.select(F.col("into").alias("id"), "user_name", text.alias("memory"), F.col("m.embedding").alias("embedding"), "n_children")
    merged = members.where("parent IS NOT NULL AND parent <> into").select("parent").distinct()
    memory, edges = dissolve(memory, edges, merged, at)

    known = {"memory_type": F.lit(kind), "status": F.lit("activated"), "hierarchy_level": F.lit(up), "created_at": at, "updated_at": at, "importance_score": F.lit(1.0)}
    old = memory.select("id", *[F.col(c).alias(f"__{c}") for c in ("created_at", "parent_memory_id") if c in memory.columns])
    new = parents.drop("n_children").select("*", *[v.alias(c) for c, v in known.items() if c in memory.columns]).join(old, "id", "left")
    if "created_at" in memory.columns:
        new = new.withColumn("created_at", F.coalesce("__created_at", "created_at")).drop("__created_at")
    new = new.withColumn("parent_memory_id", F.col("__parent_memory_id")).drop("__parent_memory_id")
    memory = store.upsert(memory, new.select(*[c for c in new.columns if c in memory.columns]), ["id"])
    links = members.where("parent IS NULL OR parent <> into")
    memory = store.set_hierarchy(memory, links.select("id", F.lit(level).alias("level"), F.col("into").alias("parent_id")))
    joined = links.select(F.col("id").alias("from_id"), F.col("into").alias("to_id"), F.lit(RELATION).alias("relation"), F.lit(1.0).alias("confidence"))
    # an edge that ended earlier comes to life again
    edges = edges.join(joined.select("from_id", "to_id", "relation"), ["from_id", "to_id", "relation"], "left_anti").select(*edges.columns)
    edges = graph.upsert_edges(edges, joined)
    return materialize(memory, "grown"), materialize(edges, "grown-edges"), parents.select(F.col("id").alias("parent_id"), "n_children", F.lit(up).alias("level"))
