"""A table as a log of changes: files of rows and lists of deleted keys, merged on read.

A commit writes only what it changes.  Every file has a number; a row is dead if a list
with the same number or a later one names its key, so a change is a list and, one number
on, a file.  The files that make up the table are named by a manifest of versions
(``store.Snapshots``): a commit is one more version, whole or not at all.

Commits are optimistic.  One that began from an older version is rebased if no commit in
between names any of its keys; else it fails and changes nothing, and the caller reads and
tries again.  ``compact`` writes the living rows as one file; old versions stay readable
until ``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import store
from engram.session import materialize

_MANIFEST = "kind string, number long, path string, commit string"
#: Files and lists from which ``compact_if_needed`` compacts.
MANY = 32
#: Times that a commit is rebased before it gives up.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has changed the same keys."""


class TableLog:
    """A table with a key column under one root folder."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", schema: str | None = None):
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self.versions = store.Snapshots(spark, f"{self.root}/manifest")

    # -- reading

    def version(self) -> int:
        return self.versions.version()

    def manifest(self, version: int | None = None) -> list:
        """A row a file or list of the version, few by ``compact``."""
        v = self.version() if version is None else version
        return self.versions.read(v).collect() if v >= 0 else []

    def _files(self, rows: list) -> DataFrame | None:
        parts = [self.spark.read.parquet(r.path).withColumn("__number", F.lit(r.number)) for r in rows if r.kind == "data"]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _deleted(self, rows: list) -> DataFrame | None:
        parts = [self.spark.read.parquet(r.path).select(F.col(self.key).alias("__key"), F.lit(r.number).alias("__upto")) for r in rows if r.kind == "deleted"]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest without one."""
        rows = self.manifest(version)
        t, dead = self._files(rows), self._deleted(rows)
        if t is None:
            if not self.schema:
                raise FileNotFoundError(self.root)
            return self.spark.createDataFrame([], self.schema)
        if dead is not None:
            last = dead.groupBy("__key").agg(F.max("__upto").alias("__upto"))
            t = t.join(last, (F.col(self.key) == F.col("__key")) & (F.col("__number") <= F.col("__upto")), "left_anti")
        return t.drop("__number")

    # -- commits

    def _touched(self, rows: list) -> DataFrame | None:
        """Keys that the commits of some manifest rows name."""
        lists = [self.spark.read.parquet(r.path).select(F.col(self.key).alias("__key")) for r in rows]
        return reduce(DataFrame.unionByName, lists) if lists else None

    def commit(self, add: DataFrame | None = None, delete: DataFrame | None = None, base: int | None = None) -> int:
        """Delete keys, then add rows; the new version.

        ``base`` is the version that the change was worked out from, the newest without
        one.  ``add`` may not repeat a key, nor hold one that stays in the table: that
        shows as two rows, which ``upsert`` avoids.
        """
        base = self.version() if base is None else base
        name = uuid.uuid4().hex[:12]
        new: list[tuple[str, str]] = []
        if delete is not None:
            path = f"{self.root}/deleted-{name}"
            delete.select(self.key).where(F.col(self.key).isNotNull()).distinct().write.parquet(path)
            new.append(("deleted", path))
        if add is not None:
            path = f"{self.root}/data-{name}"
            add.write.parquet(path)
            new.append(("data", path))
        mine = None
        for _ in range(TRIES):
            now = self.version()
            rows = self.manifest(now)
            if now > base:
                known = {(r.kind, r.path) for r in self.manifest(base)}
                theirs = self._touched([r for r in rows if (r.kind, r.path) not in known])
                mine = mine if mine is not None else reduce(DataFrame.unionByName, [self.spark.read.parquet(p).select(F.col(self.key).alias("__key")) for _, p in new])
                if theirs is not None and not mine.join(theirs, "__key", "left_semi").isEmpty():
                    raise Conflict(f"keys of {self.root} were changed since version {base}")
            last = max((r.number for r in rows), default=-1)
            # a list kills what has its number or an older one, and so not the rows added with it
            numbers = {"deleted": last, "data": last + 1}
            made = [tuple(r) for r in rows] + [(kind, numbers[kind], path, name) for kind, path in new]
            try:
                return self.versions.write(self.spark.createDataFrame(made, _MANIFEST).coalesce(1), base=now)
            except FileExistsError:  # another commit came first: look at it
                continue
        raise Conflict(f"{self.root} is changed too often")

    def append(self, rows: DataFrame) -> int:
        """Rows with new keys."""
        return self.commit(add=rows)

    def upsert(self, rows: DataFrame, base: int | None = None, order: Column | None = None) -> int:
        """Rows replace those with their keys; of a repeated key the greatest by ``order``, or else the whole row, counts."""
        rows = rows.where(F.col(self.key).isNotNull())
        whole = F.struct(*[F.col(c) for c in rows.columns])
        best = F.max_by(whole, order) if order is not None else F.max_by(whole, F.xxhash64(F.to_json(whole)))
        one = materialize(rows.groupBy(self.key).agg(best.alias("__r")).select("__r.*"), "upsert")
        return self.commit(add=one, delete=one, base=base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        return self.commit(delete=keys, base=base)

    def change(self, work: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Rows that ``work`` makes of the table, new or patched, upserted; read and worked out anew after a conflict."""
        for left in range(tries - 1, -1, -1):
            base = self.version()
            try:
                return self.upsert(work(self.read(base)), base)
            except Conflict:
                if not left:
                    raise
        return self.version()

    # -- upkeep

    def compact(self) -> int:
        """The living rows as one file instead of all; a commit in between makes it fail with a conflict."""
        base = self.version()
        path = f"{self.root}/data-{uuid.uuid4().hex[:12]}"
        last = max((r.number for r in self.manifest(base)), default=-1)
        self.read(base).write.parquet(path)
        try:
            return self.versions.write(self.spark.createDataFrame([("data", last + 1, path, "compact")], _MANIFEST).coalesce(1), base=base)
        except FileExistsError as e:
            raise Conflict(f"{self.root} was changed while it was compacted") from e

    def compact_if_needed(self, many: int = MANY) -> bool:
        if len(self.manifest()) < many:
            return False
        self.compact()
        return True

    def clean(self, keep_from: int) -> int:
        """Delete files that no version from ``keep_from`` on names; how many.  Readers of older versions must have ended."""
        fs, path = self.versions._fs()
        last = self.version()
        used = {r.path for v in range(max(0, keep_from), last + 1) for r in self.manifest(v)}
        old = {r.path for v in range(0, max(0, keep_from)) for r in self.manifest(v)} - used
        for p in old:
            fs.delete(path(p), True)
        return len(old)
