"""Graph operators over edge DataFrames: hops, PageRank, components, structural edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import pairs
from engram.session import materialize, release


def live(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("invalid_at").isNull()) if "invalid_at" in edges.columns else edges


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, each once."""
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hop, seed): nodes within ``depth`` undirected live hops, least hop, then least seed; seeds left out."""
    # a node is reached once, with its least seed: later walks to it can't be shorter, so a hub adds a row, not one a seed
    pairs = symmetric(live(edges))
    front = seeds.select(F.col("id").alias("id"), F.col("id").alias("seed")).distinct()
    seen, found = [front.select("id")], []
    for hop in range(1, depth + 1):
        near = front.join(pairs, front.id == pairs.a).groupBy("b").agg(F.min("seed").alias("seed")).select(F.col("b").alias("id"), "seed")
        front = near.join(reduce(DataFrame.unionByName, seen), "id", "left_anti")
        if hop < depth:  # read by the next hop, the visited nodes and the result
            front = materialize(front, "hop")
        seen.append(front.select("id"))
        found.append(front.select("id", F.lit(hop).alias("hop"), "seed"))
    return reduce(DataFrame.unionByName, found)


def bindings(memory: DataFrame) -> DataFrame:
    """(from_id, to_id) of ``[working_binding:<id>]`` references."""
    ref = F.regexp_extract("background", r"\[working_binding:([^\]]+)\]", 1)
    return memory.select(F.col("id").alias("from_id"), ref.alias("to_id")).where("to_id <> ''")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node of the component.

    Rounds of minimum neighbour label and pointer jumping, each written to the shared
    folder; the driver holds only whether a label changed.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    pairs = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root")), "labels")
    held = labels
    while True:
        near = pairs.join(labels.select(F.col("u").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        step = labels.join(near, "u").select("u", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("root").alias("far"))
        new = materialize(step.join(jump, "next", "left").select("u", F.least("next", "far").alias("new"), F.col("root").alias("old")), "labels")
        release(held)
        labels, held = new.select("u", F.col("new").alias("root")), new
        if new.where(F.col("new") != F.col("old")).isEmpty():
            return labels.select(F.col("u").alias("node"), "root")


def pagerank(edges: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """(id, pagerank): weighted PageRank with dangling mass spread evenly.

    ``edges``: from_id, to_id, weight.  Weights not above 0 count as 1; self loops and
    empty ids are skipped; parallel edges add up.
    """
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    e = edges.where("from_id <> '' AND to_id <> '' AND from_id <> to_id").groupBy("from_id", "to_id").agg(F.sum(w).alias("weight"))
    total = e.groupBy("from_id").agg(F.sum("weight").alias("total"))
    e = materialize(e.join(total, "from_id").select("from_id", "to_id", (F.col("weight") / F.col("total")).alias("share")), "pr-edges")
    nodes = materialize(
        e.select(F.col("from_id").alias("id"), F.lit(1).alias("out")).unionByName(e.select(F.col("to_id").alias("id"), F.lit(0).alias("out"))).groupBy("id").agg(F.max("out").alias("out")), "pr-nodes"
    )
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    rank = materialize(nodes.withColumn("pagerank", F.lit(1.0 / n)), "pr")
    for _ in range(iterations):  # each reads one written table, so the plan doesn't grow
        gained = e.join(rank, e.from_id == rank.id).groupBy("to_id").agg(F.sum(F.col("pagerank") * F.col("share")).alias("gained"))
        lost = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("pagerank"))), F.lit(0.0)).alias("lost")))  # one row
        new = (
            nodes.join(gained, nodes.id == gained.to_id, "left")
            .join(lost, F.lit(True))
            .select("id", "out", (F.lit((1 - damping) / n) + damping * (F.coalesce("gained", F.lit(0.0)) + F.col("lost") / n)).alias("pagerank"))
        )
        new = materialize(new, "pr")
        release(rank)
        rank = new
    return rank.select("id", "pagerank")


def timeline_edges(rows: DataFrame, is_new: Column) -> DataFrame:
    """TIMELINE_NEXT from each row to its predecessor in the session, where either is new."""
    w = Window.partitionBy("user_name", "session_id").orderBy("created_at", "id")
    t = rows.withColumn("new", is_new).withColumn("prev", F.lag("id").over(w)).withColumn("prev_new", F.lag("new").over(w)).withColumn("prev_at", F.lag("created_at").over(w))
    dt = F.abs(F.unix_timestamp("created_at") - F.unix_timestamp("prev_at"))
    return t.where(F.col("prev").isNotNull() & (F.col("new") | F.col("prev_new"))).select(F.col("id").alias("from_id"), F.col("prev").alias("to_id"), F.lit("TIMELINE_NEXT").alias("relation"), dt.alias("dt"))


def same_session_edges(rows: DataFrame, is_new: Column, partners: int = 20) -> DataFrame:
    """SAME_SESSION from each new row to the session's most recent other rows."""
    t = rows.select("user_name", "session_id", "id", "created_at", is_new.alias("new"))
    old = t.where(~F.col("new")).select("user_name", "session_id", F.col("id").alias("to_id"), F.col("created_at").alias("at"))
    # only the most recent partners can be chosen, so each session keeps that many before the join
    w = Window.partitionBy("user_name", "session_id").orderBy(F.desc("at"), "to_id")
    old = old.withColumn("r", F.row_number().over(w)).where(F.col("r") <= partners)
    return t.where("new").join(old, ["user_name", "session_id"]).select(F.col("id").alias("from_id"), "to_id", F.lit("SAME_SESSION").alias("relation"), F.lit(1.0).alias("confidence"))


def cosine_edges(pairs: DataFrame, low: float = 0.85, high: float = 0.92, k: int = 5) -> DataFrame:
    """SIMILAR_COSINE_HIGH for scores strictly between the bounds, the k best a row."""
    w = Window.partitionBy("from_id").orderBy(F.desc("score"), "to_id")
    t = pairs.where((F.col("score") > low) & (F.col("score") < high)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return t.select("from_id", "to_id", F.lit("SIMILAR_COSINE_HIGH").alias("relation"), F.col("score").alias("confidence"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Append new edges; the first writer of (from, to, relation) wins; ids must differ and be there."""
    ok = new.where("from_id <> '' AND to_id <> '' AND from_id <> to_id")
    ok = ok.withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))).dropDuplicates(["from_id", "to_id", "relation"])
    return edges.unionByName(ok.join(edges, ["from_id", "to_id", "relation"], "left_anti"), allowMissingColumns=True)


def invalidate(edges: DataFrame, ids: DataFrame, at: Column, column: str = "from_id") -> DataFrame:
    """Set ``invalid_at`` on live edges whose ``column`` is among ``ids``."""
    hit = ids.select(F.col("id").alias(column)).distinct().withColumn("hit", F.lit(True))
    return edges.join(hit, column, "left").withColumn("invalid_at", F.when(F.col("hit") & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at"))).drop("hit").select(*edges.columns)


def tenant_edges(edges: DataFrame, memory: DataFrame, cube: str) -> DataFrame:
    """Live edges with both ends active in the cube."""
    m = memory.where((F.col("user_name") == cube) & (F.col("status") == "activated")).select("id")
    e = live(edges).join(m, F.col("from_id") == F.col("id"), "left_semi")
    return e.join(m, F.col("to_id") == F.col("id"), "left_semi")


def resolve_entities(new: DataFrame, known: DataFrame, least: float = 0.92, block: int = pairs.BLOCK) -> DataFrame:
    """(name, id): the nearest known entity of the cube, or the normalised name as a new id."""
    n = new.select(F.col("user_name").alias("grp"), F.col("name").alias("id"), F.col("embedding").alias("v"))
    k = known.select(F.col("user_name").alias("grp"), "id", F.col("embedding").alias("v"))
    best = pairs.nearest(n, k, least, block).select(F.col("grp").alias("user_name"), F.col("id").alias("name"), F.col("other").alias("known_id"))
    own = F.lower(F.trim("name"))
    return new.join(best, ["user_name", "name"], "left").select("user_name", "name", F.coalesce("known_id", own).alias("id"), F.col("known_id").isNotNull().alias("merged"))


def link_entities(facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MENTIONS_ENTITY edges of facts(memory_id, user_name, entities, relations), and triples with both ends resolved."""
    r = resolved.select("user_name", F.lower(F.trim("name")).alias("key"), "id")
    named = facts.select("user_name", "memory_id", F.explode("entities").alias("name")).withColumn("key", F.lower(F.trim("name")))
    edges = named.join(r, ["user_name", "key"]).select(F.col("memory_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("MENTIONS_ENTITY").alias("relation")).distinct()
    t = facts.select("user_name", "memory_id", F.explode("relations").alias("t")).select("user_name", "memory_id", F.lower(F.trim("t.subject")).alias("s"), "t.predicate", F.lower(F.trim("t.object")).alias("o"))
    t = t.join(r.select("user_name", F.col("key").alias("s"), F.col("id").alias("from_entity")), ["user_name", "s"])
    t = t.join(r.select("user_name", F.col("key").alias("o"), F.col("id").alias("to_entity")), ["user_name", "o"])
    return edges, t.select("user_name", "from_entity", "predicate", "to_entity", "memory_id")
