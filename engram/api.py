"""The engine as one class: a method for each route of a memory service."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import models, tuning
from engram.functions import text
from engram.operators import filters, graph, ingest, maintain, merge, modes, pairs, search, store
from engram.session import materialize
from engram.sources import tables
from engram.streaming import loops, tasks


def normalize_request(r: dict) -> dict:
    """Older field names as today's: cube lists, message, info."""
    out = dict(r)
    if "mem_cube_id" in out:
        cube = out.pop("mem_cube_id")
        out.setdefault("readable_cube_ids", [cube])
        out.setdefault("writable_cube_ids", [cube])
    if "memory_content" in out:
        out.setdefault("messages", [{"role": "user", "content": out.pop("memory_content")}])
    if "source" in out:
        out.setdefault("info", {})["source"] = out.pop("source")
    return out


class Engine:
    """Memories and edges as DataFrames; every change returns and keeps the new table."""

    def __init__(self, spark: SparkSession, memory: DataFrame, edges: DataFrame, as_of: Column | None = None, profiles: DataFrame | None = None, tunables: tuning.Tunables | None = None):
        self.spark, self.memory, self.edges, self.profiles = spark, memory, edges, profiles
        self.tunables = tunables or tuning.tunables()
        self.as_of = as_of if as_of is not None else F.current_timestamp()
        self.cache = tables.ResultCache()
        #: what ``llm_rerank`` calls, and the rows that ``internet`` adds
        self.scorer, self.web = None, None
        #: what rewrites a query, and what judges a row of a fine search
        self.rewriter, self.judge = None, None
        #: status events (user_id, item_id, status, ts)
        self.events: DataFrame | None = None
        #: the tasks of the last 'async' add
        self.queued: DataFrame | None = None

    # reads
    def scan(self, cube: str, types: list[str], page: int = 0, size: int = 100) -> tuple[DataFrame, DataFrame]:
        return tables.page(self.memory, cube, types, page, size)

    def get(self, id_: str) -> DataFrame:
        return store.point(self.memory, id_)

    def get_many(self, ids: list[str]) -> DataFrame:
        return tables.get_in_order(self.memory, self.spark, ids)

    def get_by_key(self, cube: str, key: str) -> DataFrame:
        return tables.by_key(self.memory, cube, key)

    def list_prefix(self, cube: str, prefix: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return tables.list_prefix(self.memory, cube, prefix, limit, offset)

    def filter(self, cubes: list[str], f: dict, limit: int = 100) -> DataFrame:
        return tables.filtered(self.memory, cubes, f, limit)

    def owners(self, ids: list[str]) -> DataFrame:
        return self.memory.where(F.col("id").isin(*ids)).select("id", "user_name")

    # search
    def params(self, request: dict, profile: str | None = None) -> search.SearchParams:
        """Defaults that the environment may set, then the profile, then the request; the query rewritten where a rewriter is sure."""
        given = search.PROFILES.get(profile or "", {}) | {k: v for k, v in request.items() if v is not None}
        own = {k: v for k, v in (("decay_alpha", self.tunables.alpha), ("mmr_lambda", self.tunables.mmr_lambda)) if k not in given}
        p = search.resolve_params(request | own, profile)
        return replace(p, query=self._rewritten(p.query)) if self.rewriter is not None and p.query else p

    def _rewritten(self, query: str) -> str:
        """``rewriter`` (query -> JSON with query and confidence) decides, inside the gates of ``modes.rewrite_queries``."""
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        reply = F.from_json("reply", "query string, confidence double")
        said = modes.ask(q, ["query"], self.rewriter).select("query_id", reply.alias("r")).select("query_id", F.col("r.query").alias("rewritten"), F.col("r.confidence").alias("confidence"))
        return modes.rewrite_queries(q, said, self.tunables.rewrite_sure).first().query

    def search(self, request: dict, profile: str | None = None) -> DataFrame:
        p = self.params(request, profile)
        rows = search.search(self.memory, self.edges, p, self.as_of, self.scorer, self.web)
        return self._judged(rows, p) if p.mode == "fine" and self.judge is not None else rows

    def _judged(self, rows: DataFrame, p: search.SearchParams) -> DataFrame:
        """Fine search: ``judge`` (query, text) -> 'keep' or not looks at the text rows; what it drops is made up for by a wider recall."""
        rows = materialize(rows, "judged")  # a few rows, asked once
        texts = rows.where("bucket = 'text'").select(F.lit(0).cast("long").alias("query_id"), "id", "score", "memory")
        said = modes.ask(texts.withColumn("query", F.lit(p.query)), ["query", "memory"], self.judge)
        verdicts = said.select("query_id", "id", (F.lower(F.trim("reply")) == "keep").alias("keep"))
        wider = search.search(self.memory, self.edges, replace(p, top_k=2 * p.top_k, llm_rerank=False, mode="fast"), self.as_of).where("bucket = 'text'")
        wider = materialize(wider, "wider")
        kept = modes.fine(texts, verdicts, wider.select(F.lit(0).cast("long").alias("query_id"), "id", "score"), p.top_k)
        known = texts.select("id", "memory").unionByName(wider.select("id", "memory")).dropDuplicates(["id"])
        kept = kept.join(known, "id").select(F.lit("text").alias("bucket"), "rank", "id", "memory", "score")
        return kept.unionByName(rows.where("bucket <> 'text'").select(*kept.columns))

    def respond(self, request: dict, profile: str | None = None) -> dict[str, DataFrame]:
        """The whole answer: results, and where asked for working rows, preferences and the cubes' profile texts."""
        p = self.params(request, profile)
        out = {"results": self.search(request, profile)}
        where = filters.scope(list(p.cubes), p.user_id or None, None, p.agent_id)
        if p.include_working:
            near = merge.working_bucket(self.memory, list(p.vector), where, p.relativity)
            out["working"] = near.join(self.memory.select("id", "memory"), "id")
        if p.include_preferences:
            kind = where & (F.col("memory_type") == "PreferenceMemory")
            found = search.knn(self.memory, list(p.vector), kind, p.top_k).join(self.memory.select("id", "memory"), "id")
            found = found.where(search.preference_quality(F.col("memory")))
            rows = found.select("id", "memory", F.lit(None).cast("string").alias("memory_content"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("ord"))  # top_k rows
            out["preferences"] = merge.preference_rows(rows)
        if self.profiles is not None:
            cubes = self.spark.createDataFrame([(c,) for c in p.cubes], "user_name string")
            out["profile"] = merge.attach_profiles(cubes, self._profile_texts())
        return out

    def _profile_texts(self) -> DataFrame:
        """(cube_id, profile): each cube's active profile lines inside the token budget."""
        lines = store.active_profiles(self.profiles).withColumn("confidence", F.coalesce("confidence", F.lit(0.9)) if "confidence" in self.profiles.columns else F.lit(0.9))
        packed = ingest.pack_profile(lines, by=("cube_id",))
        return packed.groupBy("cube_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("profile"))  # inside the budget

    def search_cubes(self, request: dict, profile: str | None = None) -> DataFrame:
        """Each cube searched by itself, with its own ``top_k``; then merged, best score first: (bucket, rank, id, memory, score)."""
        lists = [self.search(request | {"cubes": (c,)}, profile) for c in request["cubes"]]
        p = self.params(request, profile)
        return merge.merge_cubes([x.drop("rank") for x in lists], p.top_k, ("bucket",)).select("bucket", "rank", "id", "memory", "score")

    def search_speakers(self, request: dict, cubes: tuple[str, str], labels: tuple[str, str] = ("a", "b")) -> DataFrame:
        """The text rows of two speakers' cubes, the larger score of an id with its speaker."""
        a, b = (self.search(request | {"cubes": (c,)}).where("bucket = 'text'").select("id", "memory", "score") for c in cubes)
        return merge.merge_speakers(a, b, self.params(request).top_k, labels)

    def context(self, request: dict, least: float = 0.30, texts: DataFrame | None = None) -> DataFrame:
        """Search rows as chat context: thresholded with back-fill, rows from outside only where asked for, and ``texts`` (id, memory) instead of stored ones."""
        p = self.params(request)
        rows = materialize(self.search(request), "context")  # a few rows, read twice
        outer = F.lit(False)
        if self.web is not None:
            rows = rows.join(self.web.select("id", F.lit(True).alias("outer")), "id", "left").withColumn("outer", F.coalesce("outer", F.lit(False)))
            rows, outer = merge.inner_rows(rows, p.internet, F.col("outer")), F.col("outer")
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # ranks restart in every bucket
        items = rows.select("id", "score", outer.alias("outer"), place.alias("ord"))
        found = search.chat_backfill(items, least).join(rows.select("id", "memory"), "id")
        return models.replace_texts(found, texts) if texts is not None else found

    def touch(self, hits: DataFrame) -> DataFrame:
        self.memory = search.counters(self.memory, hits)
        return self.memory

    # writes
    def add(self, messages: DataFrame, cube: str, mode: str = "fast") -> DataFrame:
        """New rows of messages(conv_id, turn, role, content, chat_time); they join the table.

        Content that the cube has goes, by its hash and, but for 'async', by its vector.
        'async' stores working rows with a zero vector, for a task to finish.  The cube's
        working rows beyond the cap go, the oldest first.
        """
        if mode not in ("raw", "fast", "async"):
            raise ValueError(f"mode {mode!r} reads facts: see add_fine")
        rows = ingest.raw_memories(messages) if mode == "raw" else ingest.message_windows(messages)
        rows = materialize(rows.select(F.lit(cube).alias("user_name"), "memory", "memory_type", F.col("conv_id").cast("string").alias("session_id"), F.col("turn" if mode == "raw" else "first").alias("at")), "read")
        new = ingest.node_pairs(ingest.skip_known(rows.drop("session_id", "at"), self.memory)).dropDuplicates(["id"])
        if mode == "async":
            new = ingest.unembedded(new.where("memory_type = 'WorkingMemory'"))
            self.queued = ingest.read_later(new)
        else:
            new = merge.drop_repeats(models.embed_column(new), self.memory)
        new = new.withColumn("status", F.lit("activated")).withColumn("created_at", self.as_of).withColumn("updated_at", self.as_of)
        if "session_id" in self.memory.columns:
            # of text that a conversation repeats the first place counts
            place = rows.groupBy("user_name", "memory").agg(F.min(F.struct("session_id", "at")).alias("p"))
            new = new.join(place, ["user_name", "memory"], "left").withColumn("session_id", F.col("p.session_id")).withColumn("created_at", F.col("created_at") + F.make_dt_interval(secs=F.coalesce(F.col("p.at"), F.lit(0)) / 1_000_000)).drop("p")
        new = materialize(new, "added")
        self.memory = store.keep_newest(store.upsert(self.memory, new, ["id"]))
        if "session_id" in self.memory.columns and mode != "async":
            self._link(new)
        return new

    def _link(self, new: DataFrame) -> None:
        """Edges of new long-term rows: to their predecessor and the others of their session, and to rows close by vector."""
        m = materialize(self.memory.where("status = 'activated' AND memory_type <> 'WorkingMemory'"), "linked")
        ids = new.where("memory_type <> 'WorkingMemory'").select("id")
        flagged = m.join(ids.withColumn("is_new", F.lit(True)), "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        talk = flagged.where("session_id IS NOT NULL")
        near = pairs.pairs_touching(m, ids, 0.85, "user_name")
        near = near.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "score").unionByName(near.select(F.col("b").alias("from_id"), F.col("a").alias("to_id"), "score")).join(ids, F.col("from_id") == F.col("id"), "left_semi")
        made = [graph.timeline_edges(talk, F.col("is_new")).withColumn("confidence", F.lit(1.0)).drop("dt"), graph.same_session_edges(talk, F.col("is_new")), graph.cosine_edges(near)]
        for e in made:
            self.edges = graph.upsert_edges(self.edges, e.select("from_id", "to_id", "relation", "confidence"))
        self.edges = materialize(self.edges, "edges")

    def add_fine(self, messages: DataFrame, cube: str, extract=None, verdicts: DataFrame | None = None) -> DataFrame:
        """Facts that ``extract`` (conversation -> JSON reply; by rule without one) reads out of worthwhile requests, applied to the table.

        ``verdicts`` (memory, keep) leave out facts that a check calls invented.
        """
        facts = modes.extracted(messages, self.memory, cube, extract or modes.extraction(models.rule_extractor))
        if verdicts is not None:
            facts = modes.believed(facts.withColumn("flagged", F.lit(False)), verdicts, "conv_id", "memory").drop("flagged")
        self.memory, self.edges, new = modes.apply_facts(self.memory, self.edges, facts, self.as_of)
        self.memory = store.keep_newest(self.memory)
        return new

    def update(self, changes: DataFrame) -> DataFrame:
        self.memory = store.update_rows(self.memory, changes, self.as_of)
        return self.memory

    def delete(self, cubes: list[str], ids: list[str] | None = None, where: dict | None = None) -> DataFrame:
        if ids is not None:
            gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
            self.memory = store.delete_ids(self.memory, gone, cubes)
            return gone
        self.memory, gone = store.delete_where(self.memory, cubes, filters.parse(where))
        return gone

    def delete_all(self, cube: str) -> None:
        self.memory = store.delete_cube(self.memory, cube)

    def feedback(self, ops: DataFrame, cube: str | None = None) -> DataFrame:
        self.memory = store.feedback_ops(self.memory, ops, self.as_of, cube)
        return self.memory

    def reprocess(self, limit: int = 50) -> DataFrame:
        return maintain.raw_windows(self.memory, limit)

    def reorganize(self, least: float | None = None) -> None:
        """One round of upkeep; the thresholds are the tunables'."""
        least = self.tunables.near_duplicate if least is None else least
        self.memory, self.edges = maintain.cycle(self.memory, self.edges, self.as_of, least, merge_at=self.tunables.auto_merge)

    # tasks
    def status(self, user: str | None = None) -> DataFrame:
        """Counts of the last statuses, by user or of one."""
        last = tasks.lifecycle(self.events)
        return tasks.status_counts(last if user is None else last.where(F.col("user_id") == user), ("user_id",))

    def wait(self, user: str, timeout: float = loops.WAIT_DEFAULT):
        """Events until the user has no waiting or running task."""
        active = lambda: tasks.lifecycle(self.events).where((F.col("user_id") == user) & F.col("status").isin("waiting", "in_progress")).count()
        return loops.wait(active, timeout)

    # users and cubes
    def users(self) -> DataFrame:
        return self.memory.select("user_name").distinct().orderBy("user_name")

    def exists(self, cube: str) -> bool:
        return not self.memory.where(F.col("user_name") == cube).isEmpty()

    def cubes_with_tag(self, tag: str) -> DataFrame:
        return self.memory.where(F.array_contains("tags", tag)).select("user_name").distinct()

    def instances(self) -> DataFrame:
        return self.memory.agg(F.countDistinct("user_name").alias("n"))

    def canary(self, users: DataFrame, percent: int) -> DataFrame:
        return users.withColumn("canary", text.canary_bucket(F.col("user_id")) < percent)
