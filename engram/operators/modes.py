"""Steps of search, ingest and upkeep that ask a model.

A model's replies are a table, so a step is a join and one plan serves many queries;
``ask`` makes such a table out of any callable.  Result lists are a few rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import models
from engram.operators import ingest, merge, store
from engram.session import materialize

# Gates and bounds of the steps.
FINE_LEAST, FINE_ASKED, FINE_DROPPED = 3, 20, 0.30
REWRITE_BYTES, REWRITE_TOKENS, REWRITE_SURE = 400, 5, 0.5
STAGED_LEAST, STAGED_ASKED, STAGED_SHORT = 5, 50, 10
UNJUDGED_FACTS, TYPO, PREFERENCE_REPEATED = 2, 2, 0.93
#: Share of failed calls from which, with so many at least, the callable is at fault.
MOST_FAILED, FEW_FAILED = 0.5, 5


def ask(rows: DataFrame, columns: list[str], call: Callable[..., str | None], out: str = "reply") -> DataFrame:
    """``rows`` with the callable's reply to ``columns``; null where it raises.  Written once, so a row is asked once.

    More than MOST_FAILED of the rows, if these are FEW_FAILED at least, point to the
    callable and not to a row: that is an error.
    """
    names = [c for c in rows.columns if c != out]
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(*args):
            try:
                return call(*args), None
            except Exception as e:  # a step goes on without this reply
                return None, repr(e)[:200]

        for b in batches:
            replies = [one(*v) for v in zip(*[b.column(i).to_pylist() for i in at])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in replies], pa.string()), pa.array([e for _, e in replies], pa.string())], names=[*names, out, "__fault"])

    base = rows.select(*names)
    asked = materialize(base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{out}` string, __fault string"), "asked")
    n, failed, fault = asked.agg(F.count("*"), F.count("__fault"), F.max("__fault")).first()
    if failed >= FEW_FAILED and failed > MOST_FAILED * n:
        raise RuntimeError(f"{failed} of {n} calls failed: {fault}")
    return asked.drop("__fault")


# -- search ------------------------------------------------------------------


def fine(results: DataFrame, verdicts: DataFrame, recalled: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the results (query_id, id, score) that the judge keeps.

    ``verdicts`` (query_id, id, keep) count for the best FINE_ASKED rows; others go.
    A query with fewer than FINE_LEAST rows, or with none kept, keeps all.  Where more
    than FINE_DROPPED went, unseen rows of ``recalled`` follow, best first.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    whole = Window.partitionBy("query_id")
    yes = verdicts.where("keep").select("query_id", "id", F.lit(True).alias("keep")).distinct()
    t = results.select("query_id", "id", "score").join(yes, ["query_id", "id"], "left")
    t = t.withColumn("keep", F.coalesce("keep", F.lit(False)) & (F.row_number().over(best) <= FINE_ASKED))
    t = t.withColumn("n", F.count("*").over(whole)).withColumn("kept", F.count_if("keep").over(whole))
    judged = (F.col("n") >= FINE_LEAST) & (F.col("kept") > 0)
    stay = t.where(~judged | F.col("keep")).withColumn("short", judged & (1 - F.col("kept") / F.col("n") > FINE_DROPPED))
    more = recalled.select("query_id", "id", "score").join(stay.where("short").select("query_id").distinct(), "query_id", "left_semi")
    more = more.join(stay.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = stay.select("query_id", "id", "score", F.lit(0).alias("ord")).unionByName(more.withColumn("ord", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", F.desc("score"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).drop("ord")


def expand(first: DataFrame, found: DataFrame) -> DataFrame:
    """First-pass rows (query_id, id, score) and the new ids of later stages, with ``stage`` and ``phrase``, best score first as ``rank``.

    ``found``: query_id, stage (from 1), pos of the phrase, phrase, id, score.  The
    earliest stage and phrase gives a repeated id its row; blank phrases and ids go.
    """
    a = first.select("query_id", "id", "score", F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("phrase"))
    b = found.where("trim(phrase) <> '' AND id <> ''").select(*a.columns)
    w = Window.partitionBy("query_id", "id").orderBy("stage", "pos", F.desc("score"))
    t = a.unionByName(b).withColumn("n", F.row_number().over(w)).where("n = 1")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "id", "score", "stage", "phrase", "rank")


def iterate(first: DataFrame, phrases: Callable[[DataFrame, int], list[str]], fetch: Callable[[str], DataFrame], stages: int) -> DataFrame:
    """``expand`` of one query (id, score) by up to ``stages`` stages; a stage without phrases is the last.

    ``phrases`` sees the rows so far and the stage, ``fetch`` gives (id, score) of a phrase.
    """
    rows = first.select(F.lit(0).alias("query_id"), "id", "score", F.lit(0).alias("stage"), F.lit(None).cast("string").alias("phrase"))
    for stage in range(1, stages + 1):
        asked = [p for p in phrases(rows, stage) if p.strip()]
        if not asked:
            break
        found = None
        for pos, p in enumerate(asked):
            one = fetch(p).select(F.lit(0).alias("query_id"), F.lit(stage).alias("stage"), F.lit(pos).alias("pos"), F.lit(p).alias("phrase"), "id", "score")
            found = one if found is None else found.unionByName(one)
        known = rows.select("id")
        new = expand(rows.limit(0), found.join(known, "id", "left_anti")).drop("rank")
        rows = materialize(rows.unionByName(new), "stage")
    return rows.orderBy(F.desc("score"), "id").select("id", "score", "stage", "phrase")


def rewrite_queries(queries: DataFrame, rewrites: DataFrame, sure_from: float = REWRITE_SURE) -> DataFrame:
    """queries(query_id, query) by their rewrites(query_id, rewritten, confidence), where both pass the gates: (query_id, query, used)."""
    long = (F.octet_length("query") <= REWRITE_BYTES) & (F.size(F.filter(F.split("query", r"\s+"), lambda w: w != "")) >= REWRITE_TOKENS)
    sure = (F.trim("rewritten") != "") & (F.col("confidence") >= sure_from)
    used = F.coalesce(long & sure, F.lit(False))
    t = queries.join(rewrites.select("query_id", "rewritten", "confidence"), "query_id", "left")
    return t.select("query_id", F.when(used, F.col("rewritten")).otherwise(F.col("query")).alias("query"), used.alias("used"))


def staged(results: DataFrame, shortlist: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, id, place): relevant rows of the shortlist first, in its order, then the others in theirs.

    ``results``: query_id, id, ord; ``shortlist``: query_id, id, pos, its first
    STAGED_SHORT rows that are among the first STAGED_ASKED results;
    ``verdicts``: query_id, id, relevant.  A query without a verdict takes the whole
    shortlist; one with fewer than STAGED_LEAST rows stays as it is.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    t = results.select("query_id", "id", "ord").withColumn("n", n).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "id")))
    short = shortlist.where(F.col("pos") < STAGED_SHORT).groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    said = verdicts.groupBy("query_id", "id").agg(F.bool_or("relevant").alias("relevant"))
    t = t.join(short, ["query_id", "id"], "left").join(said, ["query_id", "id"], "left")
    judged = F.count("relevant").over(Window.partitionBy("query_id")) > 0
    first = (F.col("n") >= STAGED_LEAST) & (F.col("at") <= STAGED_ASKED) & F.col("pos").isNotNull() & (~judged | F.coalesce("relevant", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.when(first, F.col("pos")).asc_nulls_last(), "at")
    return t.select("query_id", "id", F.row_number().over(order).alias("place"))


# -- ingest ------------------------------------------------------------------


def believed(facts: DataFrame, verdicts: DataFrame, by: str = "conv_id", key: str = "fact_id") -> DataFrame:
    """Facts (``by``, ``key``, flagged, ...) less the ones a check calls invented.

    A conversation with UNJUDGED_FACTS or fewer keeps all.  Flags of the extractor
    decide where it set any; else ``verdicts`` (``key``, keep) do, a missing one keeps.
    """
    w = Window.partitionBy(by)
    flag = F.coalesce("flagged", F.lit(False))
    t = facts.join(verdicts.select(key, F.col("keep").alias("__keep")), key, "left")
    t = t.withColumn("__n", F.count("*").over(w)).withColumn("__any", F.bool_or(flag).over(w))
    ok = F.when(F.col("__n") <= UNJUDGED_FACTS, True).when(F.col("__any"), ~flag).otherwise(F.coalesce("__keep", F.lit(True)))
    return t.where(ok).drop("__keep", "__n", "__any")


def extracted(messages: DataFrame, memory: DataFrame, cube: str, extract: Callable[[str], str], make=models.HashEmbedder) -> DataFrame:
    """Facts of the requests that are worth it: classified, not yet known as a whole (``merge.fine_gate``), read by ``extract``."""
    convs = ingest.classified(ingest.conversations(messages)).where("skip_reason = ''")
    convs = convs.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("request").cast("string")).alias("id"), F.lit(cube).alias("user_name"), F.col("conversation").alias("memory"))
    convs = materialize(models.embed_column(convs, make=make), "requests")
    fresh = merge.fine_gate(convs, memory).where("gate <> 'skip'").select("id")
    asked = ask(convs.join(fresh, "id", "left_semi").select(F.col("id").alias("conv_id"), "user_name", "memory"), ["memory"], extract)
    return ingest.parse_facts(asked.select("conv_id", "user_name", "reply"))


def apply_facts(memory: DataFrame, edges: DataFrame, facts: DataFrame, at: Column, make=models.HashEmbedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory, edges, added rows) after facts(user_name, memory, memory_type, action, target_id).

    Facts to add go by hash where the cube has them; the others become a working and a
    long-term row.  Updates and deletions reach rows of their own cube only.
    """
    add = ingest.skip_known(facts.where("action = 'add'").select("user_name", "memory", "memory_type"), memory)
    new = models.embed_column(ingest.node_pairs(add).dropDuplicates(["id"]), make=make)
    new = materialize(new.withColumn("status", F.lit("activated")).withColumn("created_at", at).withColumn("updated_at", at), "facts")
    own = memory.select(F.col("id").alias("target_id"), "user_name")
    change = facts.where("action IN ('update', 'delete')").join(own, ["user_name", "target_id"], "left_semi").dropDuplicates(["target_id"])
    m, e = store.apply_fact_actions(memory, edges, change, at)
    return store.upsert(m, new, ["id"]), e, new


# -- upkeep ------------------------------------------------------------------


def cluster_replies(replies: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Replies (cluster, keep_id, remove_ids, contradicted_ids, merged_text) as changes.

    ``members``: id, cluster, a few a cluster.  A given id means the only member of
    its cluster within TYPO edits, the equal one first; a reply whose kept id means
    none is left out, and so is every other such id.  Gives ``merges`` (id, into_id),
    ``contradicted`` (keep_id, bad_id) and ``texts`` (id, memory).
    """
    given = replies.select(
        "cluster", "merged_text",
        F.explode(F.concat(F.array(F.struct(F.lit("keep").alias("what"), F.col("keep_id").alias("given"))),
                           F.transform(F.coalesce("remove_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("remove").alias("what"), x.alias("given"))),
                           F.transform(F.coalesce("contradicted_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("bad").alias("what"), x.alias("given"))))).alias("g"),
    ).select("cluster", "merged_text", "g.what", "g.given")
    edits = F.levenshtein(F.lower("given"), F.lower("id"))
    near = given.join(members.select("cluster", "id"), "cluster").withColumn("edits", edits).where(F.col("edits") <= TYPO)
    one = near.groupBy("cluster", "what", "given", "merged_text").agg(F.count("*").alias("n"), F.min_by("id", F.struct("edits", "id")).alias("id"), F.min("edits").alias("edits"))
    one = one.where("n = 1 OR edits = 0")
    kept = one.where("what = 'keep'").select("cluster", F.col("id").alias("keep_id"), "merged_text")
    other = one.where("what <> 'keep'").groupBy("cluster", "id").agg(F.max(F.col("what") == "remove").alias("remove")).join(kept, "cluster").where("id <> keep_id")
    return {
        "merges": other.where("remove").select("id", F.col("keep_id").alias("into_id")),
        "contradicted": other.where("NOT remove").select("keep_id", F.col("id").alias("bad_id")),
        "texts": kept.where("trim(merged_text) <> ''").select(F.col("keep_id").alias("id"), F.trim("merged_text").alias("memory")),
    }


def new_preferences(found: DataFrame, memory: DataFrame, at: Column, make=models.HashEmbedder, least: float = PREFERENCE_REPEATED) -> DataFrame:
    """Preference texts (user_name, user_id, memory) as user memories, but for those that the cube's user memories hold already."""
    rows = found.where("trim(memory) <> ''").withColumn("memory", F.trim("memory"))
    rows = rows.withColumn("id", F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", "user_name", "memory"), 256), 1, 16))).dropDuplicates(["id"])
    rows = merge.drop_repeats(models.embed_column(rows, make=make), memory.where("memory_type = 'UserMemory'"), least)
    return rows.select("id", "user_name", "user_id", "memory", F.lit("UserMemory").alias("memory_type"), F.lit("activated").alias("status"), F.array(F.lit("mode:pref_add")).alias("tags"), at.alias("created_at"), at.alias("updated_at"), "embedding")


def feedback_actions(memory: DataFrame, edges: DataFrame, asked: DataFrame, actions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """keep, update and remove of actions(id, action, memory), for ids that were asked about only."""
    ok = actions.join(asked.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    change = ok.select(F.col("id").alias("target_id"), F.lower(F.trim("action")).alias("a"), "memory")
    change = change.select("target_id", "memory", F.when(F.col("a") == "remove", "delete").when((F.col("a") == "update") & (F.trim("memory") != ""), "update").alias("action")).where("action IS NOT NULL")
    return store.apply_fact_actions(memory, edges, change, at)


def rerank_neighbours(pairs: DataFrame, memory: DataFrame, call: Callable[[str, str], float]) -> DataFrame:
    """Stored rerank scores (id, ce_score_topk) of neighbour pairs (from_id, to_id, rank): the scorer's value of both texts."""
    m = memory.select("id", "memory")
    t = pairs.select("from_id", "to_id").join(m.select(F.col("id").alias("from_id"), F.col("memory").alias("a")), "from_id").join(m.select(F.col("id").alias("to_id"), F.col("memory").alias("b")), "to_id")
    t = ask(t, ["a", "b"], lambda a, b: repr(float(call(a, b)))).select("from_id", "to_id", F.col("reply").cast("float").alias("s")).where("s IS NOT NULL")
    entry = F.struct((-F.col("s")).alias("o"), F.col("to_id").alias("neighbor_id"), F.col("s").alias("score"))
    top = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["neighbor_id"].alias("neighbor_id"), x["score"].alias("score")))
    return t.groupBy(F.col("from_id").alias("id")).agg(top.alias("ce_score_topk"))


# -- evaluation ----------------------------------------------------------------


def judge_key(question: Column, gold: Column, prediction: Column) -> Column:
    part = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.sha2(F.concat_ws("\u0001", part(question), part(gold), part(prediction)), 256)


def judged(answers: DataFrame, cache: DataFrame, judge: Callable[[str, str, str], int]) -> tuple[DataFrame, DataFrame]:
    """answers(question, gold, prediction, ...) with ``key`` and ``correct``, and the cache (key, correct) with the new verdicts.

    A key is asked once, however often it comes; a judge that fails says 0.
    """
    t = answers.withColumn("key", judge_key(F.col("question"), F.col("gold"), F.col("prediction")))
    new = t.select("key", "question", "gold", "prediction").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = ask(new, ["question", "gold", "prediction"], lambda q, g, p: str(int(judge(q, g, p))))
    held = cache.select("key", "correct").unionByName(new.select("key", F.coalesce(F.try_to_number("reply", F.lit("9")).cast("int"), F.lit(0)).alias("correct")))
    return t.join(held, "key", "left"), held


def contains_judge(question: str, gold: str, prediction: str) -> int:
    """The offline judge: the gold answer's words are all in the prediction."""
    return int(bool(gold) and set(gold.lower().split()) <= set((prediction or "").lower().split()))


def extraction(call: Callable[[str], list[dict]]) -> Callable[[str], str]:
    """An extractor of fact dictionaries as one of JSON text."""
    import json

    return lambda conversation: json.dumps(call(conversation))

