"""Mutable-table semantics over immutable snapshots: every operator returns the new table.

``Snapshots`` writes each version to a new folder and then a marker file of its own, so
a table is never overwritten while it is read, and a crash at any point leaves the
last whole version readable.  Conditions that decide a deletion are false for nulls: a
row whose cube or type is not known stays.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import graph
from engram.operators.filters import Filter, check_delete, compile_filter


def point(memory: DataFrame, id_: str) -> DataFrame:
    return memory.where((F.col("id") == id_) & (F.col("status") == "activated")).limit(1)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with the same keys; the last one wins only if keys repeat nowhere else."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_ids(memory: DataFrame, ids: DataFrame, cubes: list[str] | None = None) -> DataFrame:
    gone = ids.select("id").distinct()
    if cubes is None:
        return memory.join(gone, "id", "left_anti")
    hit = gone.withColumn("hit", F.lit(True))
    return memory.join(hit, "id", "left").where(~F.coalesce(F.col("hit") & F.col("user_name").isin(*cubes), F.lit(False))).drop("hit")


def delete_cube(memory: DataFrame, cube: str) -> DataFrame:
    """All active rows of a cube go."""
    return memory.where(~(F.col("user_name").eqNullSafe(cube) & F.col("status").eqNullSafe("activated")))


def delete_where(memory: DataFrame, cubes: list[str], f: Filter) -> tuple[DataFrame, DataFrame]:
    """(rows left, ids deleted) of the same snapshot; rows of any status."""
    check_delete(cubes, f)
    hit = F.coalesce(F.col("user_name").isin(*cubes) & compile_filter(f), F.lit(False))
    return memory.where(~hit), memory.where(hit).select("id")


def one_change(changes: DataFrame, columns: list[str]) -> DataFrame:
    """A row an id: of each column the last value by ``pos`` that isn't null, or without ``pos`` the greatest."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))) if "pos" in changes.columns else F.max(c) for c in columns]
    return changes.where(F.col("id").isNotNull()).groupBy("id").agg(F.lit(True).alias("__hit"), *[x.alias(f"__{c}") for x, c in zip(last, columns)])


def update_rows(memory: DataFrame, changes: DataFrame, at: Column, columns: tuple[str, ...] = ("memory", "embedding")) -> DataFrame:
    """Patch named columns of active rows where ``changes`` has a value; only touched rows get the time.

    An id that ``changes`` repeats is patched once, see ``one_change``.
    """
    have = [c for c in columns if c in changes.columns]
    t = memory.join(one_change(changes, have), "id", "left")
    live = F.col("__hit") & (F.col("status") == "activated")
    for c in have:
        new = F.col(f"__{c}")
        use = live & new.isNotNull()
        if c == "embedding":
            use = use & (F.size(new) > 0)
        t = t.withColumn(c, F.when(use, new).otherwise(F.col(c)))
    t = t.withColumn("updated_at", F.when(live, at).otherwise(F.col("updated_at")))
    return t.drop("__hit", *[f"__{c}" for c in have]).select(*memory.columns)


def _with_column(memory: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return memory if name in memory.columns else memory.withColumn(name, F.lit(None).cast(kind))


def soft_merge(memory: DataFrame, merged: DataFrame, at: Column) -> DataFrame:
    """merged(id, into_id): status merged, merged_into_id set; of a repeated id the least target.  Rows merged before keep their target."""
    memory = _with_column(memory, "merged_into_id")
    t = memory.join(merged.groupBy("id").agg(F.min("into_id").alias("__into")), "id", "left")
    hit = F.col("__into").isNotNull()
    new = {"status": F.lit("merged"), "updated_at": at, "merged_into_id": F.col("__into")}
    return t.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in memory.columns])


def set_hierarchy(memory: DataFrame, levels: DataFrame) -> DataFrame:
    """levels(id, level, parent_id): hierarchy_level and parent_memory_id; other rows, and null values, keep theirs.  Of a repeated id the least row counts."""
    memory = _with_column(_with_column(memory, "hierarchy_level"), "parent_memory_id")
    one = levels.groupBy("id").agg(F.min(F.struct(F.col("level"), F.col("parent_id"))).alias("__l"))
    new = {"hierarchy_level": "__l.level", "parent_memory_id": "__l.parent_id"}
    return memory.join(one, "id", "left").select(*[F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in memory.columns])


def clear_neighbour(memory: DataFrame, ids: list[str]) -> DataFrame:
    """Drop stored rerank scores that name one of ``ids``."""
    hit = F.exists("ce_score_topk", lambda x: x["neighbor_id"].isin(*ids))
    return memory.withColumn("ce_score_topk", F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col("ce_score_topk")))


def set_ce_scores(memory: DataFrame, scores: DataFrame) -> DataFrame:
    """scores(id, ce_score_topk) replace what a row had."""
    return memory.drop("ce_score_topk").join(scores.select("id", "ce_score_topk"), "id", "left")


def decay_importance(memory: DataFrame, factor: float = 0.95, archive_below: float = 0.10, types: tuple[str, ...] = ("LongTermMemory", "UserMemory")) -> DataFrame:
    """Importance x 0.95 (missing is 1.0), then active rows below 0.10 are archived."""
    hit = F.col("memory_type").isin(*types) & (F.col("status") == "activated")
    new = F.greatest(F.coalesce("importance_score", F.lit(1.0)) * factor, F.lit(0.0))
    t = memory.withColumn("importance_score", F.when(hit, new).otherwise(F.col("importance_score")))
    return t.withColumn("status", F.when(hit & (F.col("importance_score") < archive_below), "archived").otherwise(F.col("status")))


def keep_newest(memory: DataFrame, limits: DataFrame | None = None, default: int = 20, memory_type: str = "WorkingMemory") -> DataFrame:
    """The newest rows of a type stay, up to the cube's limit; other types stay."""
    w = Window.partitionBy("user_name").orderBy(F.col("updated_at").desc_nulls_last(), "id")
    some = memory.where(F.col("memory_type") == memory_type).withColumn("__r", F.row_number().over(w))
    some = some.join(limits.select("user_name", F.col("keep").alias("__k")), "user_name", "left") if limits is not None else some.withColumn("__k", F.lit(default))
    some = some.where(F.col("__r") <= F.coalesce("__k", F.lit(default))).drop("__r", "__k")
    return memory.where(~F.col("memory_type").eqNullSafe(memory_type)).unionByName(some)


def cubes_upsert(cubes: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Null names, owners and settings keep what there was."""
    n = new.select("cube_id", *[F.col(c).alias(f"n_{c}") for c in ("name", "owner")])
    t = cubes.join(n, "cube_id", "full")
    return t.select(
        "cube_id", F.coalesce("n_name", "name", "cube_id").alias("name"), F.coalesce("n_owner", "owner").alias("owner"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"), F.coalesce("created_at", at).alias("created_at"),
    )


def cubes_delete(cubes: DataFrame, memory: DataFrame, cube: str, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cube is marked inactive; a hard delete takes its memories too."""
    left = cubes.withColumn("is_active", F.when(F.col("cube_id") == cube, False).otherwise(F.col("is_active")))
    return left, memory.where(~F.col("user_name").eqNullSafe(cube)) if hard else memory


PROFILE_KEY = ["cube_id", "user_id", "topic", "sub_topic"]


def profile_batch(batch: DataFrame) -> DataFrame:
    """Last memo of a key wins (by ``pos``), at the first position."""
    return batch.groupBy(*PROFILE_KEY).agg(F.max_by("memo", "pos").alias("memo"), F.min("pos").alias("pos"))


def profile_upsert(profiles: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """SCD-2: a new memo expires the active row and is inserted; the same memo changes nothing."""
    for k in PROFILE_KEY:
        if k not in batch.columns:
            raise ValueError(f"profile key {k} is missing")
    new = batch.where(" AND ".join(f"coalesce({k}, '') <> ''" for k in PROFILE_KEY)).select(*PROFILE_KEY, F.col("memo").alias("new_memo"))
    old = profiles.join(new, PROFILE_KEY, "left")
    changed = F.col("expired_at").isNull() & F.col("new_memo").isNotNull() & (F.col("memo") != F.col("new_memo"))
    old = old.withColumn("expired_at", F.when(changed, at).otherwise(F.col("expired_at"))).drop("new_memo")
    same = profiles.where("expired_at IS NULL").select(*PROFILE_KEY, F.col("memo").alias("new_memo"))
    fresh = new.join(same, [*PROFILE_KEY, "new_memo"], "left_anti").withColumnRenamed("new_memo", "memo")
    fresh = fresh.withColumn("updated_at", at).withColumn("expired_at", F.lit(None).cast("timestamp"))
    return old.unionByName(fresh, allowMissingColumns=True)


def active_profiles(profiles: DataFrame, cube: str | None = None, user: str | None = None, topic: str | None = None) -> DataFrame:
    t = profiles.where("expired_at IS NULL")
    for c, v in (("cube_id", cube), ("user_id", user), ("topic", topic)):
        t = t.where(F.col(c) == v) if v else t
    return t.orderBy("topic", "sub_topic", F.desc("updated_at"))


def append_feedback(events: DataFrame, new: DataFrame, labels: list[str]) -> DataFrame:
    """Append-only; a label outside the enumeration is an error when the rows are made."""
    bad = F.raise_error(F.concat(F.lit("unknown feedback label "), F.coalesce("label", F.lit("null"))))
    return events.unionByName(new.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(bad)), allowMissingColumns=True)


def replace_keyword(memory: DataFrame, where: Column, old: str, new: str, limit: int = 100) -> DataFrame:
    """Exact substring replaced in at most ``limit`` matching rows: (id, memory)."""
    hit = memory.where(where & F.col("memory").contains(old)).orderBy("id").limit(limit)
    return hit.select("id", F.replace(F.col("memory"), F.lit(old), F.lit(new)).alias("memory"))


def apply_fact_actions(memory: DataFrame, edges: DataFrame, facts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """update and delete facts: rows rewritten or gone, their live edges invalidated, stored scores cleared."""
    gone = facts.where("action = 'delete'").select(F.col("target_id").alias("id"))
    changed = facts.where("action = 'update'").select(F.col("target_id").alias("id"), "memory")
    m = update_rows(delete_ids(memory, gone), changed, at, ("memory",))
    return m, graph.invalidate(edges, gone.unionByName(changed.select("id")), at)


def feedback_ops(memory: DataFrame, ops: DataFrame, at: Column, cube: str | None = None) -> DataFrame:
    """ADD / UPDATE / NONE operations; ids that are not active rows are dropped.

    An id updated twice gets one text, see ``one_change``.  An added row belongs to the
    ``user_name`` of its operation, or to ``cube``; without either the operation is an
    error.  Equal additions to a cube, also to one that has the row, are one row.
    """
    owner = F.lit(cube) if cube is not None else F.lit(None).cast("string")
    owner = F.coalesce("user_name", owner) if "user_name" in ops.columns else owner
    order = ["pos"] if "pos" in ops.columns else []
    upd = ops.where("upper(op) = 'UPDATE'").select("id", "memory", *order).join(memory.where("status = 'activated'").select("id"), "id", "left_semi")
    owner = F.when((owner != "") & owner.isNotNull(), owner).otherwise(F.raise_error(F.lit("an added row needs a cube")))
    add = ops.where("upper(op) = 'ADD' AND trim(memory) <> ''").select(owner.alias("user_name"), "memory")
    add = add.withColumn("id", F.concat(F.lit("f"), F.substring(F.sha2(F.concat_ws("\n", "user_name", "memory"), 256), 1, 16))).dropDuplicates(["id"])
    add = add.join(memory.select("id"), "id", "left_anti").select("id", "user_name", "memory", F.lit("activated").alias("status"), F.lit("LongTermMemory").alias("memory_type"), at.alias("created_at"), at.alias("updated_at"))
    have = [c for c in add.columns if c in memory.columns]
    return update_rows(memory, upd, at, ("memory",)).unionByName(add.select(*have), allowMissingColumns=True)


def purge(tables: dict[str, DataFrame], cube: str) -> dict[str, DataFrame]:
    """Delete from a cube cascades: every table's rows of the cube go."""
    out = {}
    for name, t in tables.items():
        c = next((c for c in ("user_name", "cube_id", "collection") if c in t.columns), None)
        out[name] = t.where(~F.col(c).eqNullSafe(cube)) if c else t
    return out


#: Seconds after which a marker without a name is a crashed commit.
COMMIT_SECONDS = 60


class Snapshots:
    """Versions of a table under one root: a folder each, and a marker file once it is whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _marker(self, version: int) -> str:
        return f"{self.root}/WHOLE-{version:012d}"

    def _markers(self) -> dict[int, tuple[int, float]]:
        """Of every version's marker its length and its time in seconds."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/WHOLE-*")) or []
        return {int(x.getPath().getName()[6:]): (x.getLen(), x.getModificationTime() / 1000) for x in found}

    def version(self) -> int:
        """The newest version whose marker names its folder; -1 without one."""
        return max((v for v, (size, _) in self._markers().items() if size), default=-1)

    def _folder(self, version: int) -> str:
        """The folder that a version's marker names."""
        fs, path = self._fs()
        stream = fs.open(path(self._marker(version)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v < 0:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{self._folder(v)}")

    def write(self, df: DataFrame, partition_by: str | None = None, base: int | None = None) -> int:
        """Write the next version into a folder of its own, then the marker that names it.

        ``base`` is the version that ``df`` was made from, the newest now without one.  If
        another writer has committed since, its marker exists: that is an error, and this
        writer's folder goes.  Folders of crashed writers have no marker and are never read.
        """
        base = self.version() if base is None else base
        folder = f"v{base + 1}-{uuid.uuid4().hex[:12]}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(f"{self.root}/{folder}")
        fs, path = self._fs()
        later = {v: x for v, x in self._markers().items() if v > base}
        # an empty marker is a commit just now, or one that crashed between its two steps, whose number is left out
        crashed = {v for v, (size, at) in later.items() if not size and time.time() - at > COMMIT_SECONDS}
        v = max([base, *crashed]) + 1
        try:
            if set(later) - crashed:
                raise FileExistsError(f"version {min(set(later) - crashed)} of {self.root} was written by another writer")
            try:
                stream = fs.create(path(self._marker(v)), False)  # fails if it exists: one writer wins
            except Exception as e:
                raise FileExistsError(f"version {v} of {self.root} was written by another writer") from e
        except FileExistsError:
            fs.delete(path(f"{self.root}/{folder}"), True)
            raise
        stream.write(bytearray(folder.encode()))
        stream.close()
        return v


def schema_versions(spark: SparkSession, applied: list[tuple[int, str]]) -> DataFrame:
    """(version, checksum) instead of migrations; drift is a different checksum."""
    import hashlib

    return spark.createDataFrame([(v, hashlib.sha256(ddl.encode()).hexdigest()) for v, ddl in applied], "version int, checksum string")


def params_key(params: dict) -> str:
    """A cache key of all parameters."""
    return json.dumps(params, sort_keys=True, default=str)
