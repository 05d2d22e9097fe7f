"""A stored inverted index for full-text search: only blocks of postings that can enter the top k are read.

A document's score is the count of its tokens that the query names, over 1 + ln(1 +
length).  Documents are dealt into blocks by cube and length class, so a block's scores
are alike.  The index holds, for every term and block, the documents with their counts,
and beside them, in a small table, the greatest score that the term gives in the block.
Texts are shuffled once, by block, and a block's postings are made where its texts lie.
A search adds these up to each block's bound, scores the few best blocks, and then reads
only blocks whose bound reaches the k-th score found.  The result equals a full scan.

New rows are appended as a segment of their own; deleted ids are listed with the segment
up to which they are dead.  A manifest of versions (``store.Snapshots``) makes each change
whole or not at all; ``compact`` merges segments.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text
from engram.operators import store
from engram.session import materialize, release

#: Documents of a block, about.
BLOCK = 4096
#: Words of a block and of a task that makes postings, about; a longer document is a block of its own.
BLOCK_WORDS, TASK_WORDS = 1 << 20, 4 << 20
#: Blocks scored first, to learn the k-th score.
FIRST = 8
#: Blocks up to which a search names them to the scan; more are joined.
NAMED = 1000
#: Folders that the terms are dealt to, so a search opens those of its terms only.
BUCKETS = 16

_MANIFEST = "kind string, segment int, path string, n long"
_POSTINGS = "term string, block long, user_name string, n long, most double, docs array<struct<id: string, tf: int, size: int>>"
_BOUNDS = "term string, block long, user_name string, n long, most double"


def weight(tf: Column, size: Column) -> Column:
    return tf / (1 + F.log1p(size))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, user_name, id, size, words) by block to a row a term and block."""
    held: list = []  # what has come of one block
    for batch in batches:
        cuts = np.flatnonzero(np.diff(batch.column("block").to_numpy())) + 1
        for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(first, end - first)
            if held and part.num_rows and held[0]["block"][0] != part["block"][0]:
                yield _of_block(pa.Table.from_batches(held))
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield _of_block(pa.Table.from_batches(held))


def _of_block(docs: pa.Table) -> pa.RecordBatch:
    seen = [Counter(words.split(" ")) for words in docs["words"].to_pylist()]
    terms = pa.array([t for c in seen for t in c], pa.string()).dictionary_encode()
    code = terms.indices.to_numpy()
    order, counts = np.argsort(code, kind="stable"), np.bincount(code)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(seen)), [len(c) for c in seen])[order]
    tf = np.fromiter((n for c in seen for n in c.values()), np.int32, len(order))[order]
    size = docs["size"].to_numpy()[doc]
    most = np.maximum.reduceat(tf / (1 + np.log1p(size)), ends - counts)
    ids = pa.concat_arrays(docs["id"].chunks).take(pa.array(doc))
    rows = pa.StructArray.from_arrays([ids, pa.array(tf, pa.int32()), pa.array(size, pa.int32())], ["id", "tf", "size"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), rows)
    same = [pa.array([docs[c][0].as_py()] * len(counts), k) for c, k in (("block", pa.int64()), ("user_name", pa.string()))]
    return pa.RecordBatch.from_arrays([terms.dictionary, *same, pa.array(counts, pa.int64()), pa.array(most), lists], ["term", "block", "user_name", "n", "most", "docs"])


def documents(memory: DataFrame) -> DataFrame:
    """(id, user_name, size, words) of rows (id, user_name, memory), the words in order with a space between."""
    rows = memory.where("id IS NOT NULL AND memory IS NOT NULL").select("id", "user_name", text.lexemes(F.col("memory")).alias("words"))
    return rows.select("id", "user_name", F.size("words").alias("size"), F.array_join("words", " ").alias("words"))


def postings(docs: DataFrame, parts: DataFrame, tasks: int) -> DataFrame:
    """(bucket, term, block, user_name, n, most, docs) of ``documents``, whose classes (__u, __k) are cut to ``parts`` blocks."""
    dealt = docs.where("size > 0").join(parts, F.col("user_name").eqNullSafe(F.col("__u")) & (_kind() == F.col("__k")))
    number = F.xxhash64(F.coalesce("user_name", F.lit("")), F.col("user_name").isNull(), "__k", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.select(number.alias("block"), "user_name", "id", "size", "words").repartition(tasks, "block").sortWithinPartitions("block")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    return dealt.mapInArrow(_inverted, _POSTINGS).select(bucket.alias("bucket"), "*")


def class_parts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(__u, __k, parts): blocks of a cube's documents of a length class, by their number and their words."""
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_WORDS))
    return docs.groupBy(F.col("user_name").alias("__u"), _kind().alias("__k")).agg(parts.alias("parts"))


def _kind() -> Column:
    return F.floor(2 * F.log2(1 + F.col("size")))


class TextIndex:
    """An index under one root folder."""

    def __init__(self, spark: SparkSession, root: str, block: int = BLOCK):
        self.spark, self.root, self.block = spark, root.rstrip("/"), block
        self.versions = store.Snapshots(spark, f"{self.root}/manifest")

    # -- upkeep

    def _manifest(self) -> list:
        """A row a segment and a list of deletions; few, as ``compact`` merges them."""
        return self.versions.read().orderBy("segment", "kind", "path").collect() if self.versions.version() >= 0 else []

    def _commit(self, rows: list[tuple], base: int) -> None:
        self.versions.write(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1), base=base)

    def _write_segment(self, memory: DataFrame) -> tuple[str, int]:
        path = f"{self.root}/segment-{uuid.uuid4().hex[:12]}"
        docs = materialize(documents(memory), "documents")
        n, words = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        parts = materialize(class_parts(docs, self.block), "parts")  # its true size lets Spark choose the join
        # sorted by term and block, so that a scan skips row groups and pages
        dealt = postings(docs, parts, 1 + words // TASK_WORDS).sortWithinPartitions("bucket", "term", "block")
        dealt.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        written = self.spark.read.schema(f"{_BOUNDS}, bucket int").parquet(f"{path}/postings")
        written.select("bucket", "term", "block", "user_name", "n", "most").repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/bounds")
        docs.select("id").write.parquet(f"{path}/ids")
        release(docs)
        release(parts)
        return path, n

    def change(self, add: DataFrame | None = None, delete: DataFrame | None = None) -> int:
        """Delete ids and then append rows (id, user_name, memory), as one version; the version's number."""
        base = self.versions.version()
        rows = [tuple(r) for r in self._manifest()]
        last = max((r[1] for r in rows), default=-1)
        if delete is not None and last >= 0:
            path = f"{self.root}/deleted-{uuid.uuid4().hex[:12]}"
            delete.select("id").where("id IS NOT NULL").distinct().write.parquet(path)
            rows.append(("deleted", last, path, 0))
        if add is not None:
            path, n = self._write_segment(add)
            rows.append(("segment", last + 1, path, n))
        self._commit(rows, base)
        return base + 1

    def append(self, memory: DataFrame) -> int:
        """Rows with new ids."""
        return self.change(add=memory)

    def upsert(self, memory: DataFrame) -> int:
        """Rows replace those with their ids."""
        return self.change(add=memory, delete=memory)

    def delete(self, ids: DataFrame) -> int:
        return self.change(delete=ids)

    def compact(self, memory: DataFrame) -> int:
        """One segment of the rows of ``memory``, the table as it is, instead of all segments and deletions."""
        base = self.versions.version()
        path, n = self._write_segment(memory)
        self._commit([("segment", max((r[1] for r in self._manifest()), default=-1) + 1, path, n)], base)
        return base + 1

    # -- search

    def _table(self, name: str, tokens: list[str], cubes: list[str] | None, manifest: list) -> DataFrame | None:
        """The rows of a table of all segments for some terms, with ``segment``."""
        found = None
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
        for r in manifest:
            if r.kind == "segment" and r.n:
                schema = _POSTINGS if name == "postings" else _BOUNDS
                t = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{r.path}/{name}").where(F.col("bucket").isin(buckets) & F.col("term").isin(tokens))
                t = t.where(F.col("user_name").isin(cubes)) if cubes else t
                t = t.withColumn("segment", F.lit(r.segment))
                found = t if found is None else found.unionByName(t)
        return found

    def _scored(self, table: DataFrame, manifest: list, memory: DataFrame | None, where: Column | None) -> DataFrame:
        docs = table.select("segment", F.explode("docs").alias("d")).select("segment", "d.*")
        out = docs.groupBy("segment", "id").agg(F.sum("tf").alias("tf"), F.max("size").alias("size"))
        for r in manifest:
            if r.kind == "deleted":
                gone = self.spark.read.parquet(r.path).select(F.col("id").alias("__id"))
                out = out.join(gone, (F.col("id") == F.col("__id")) & (F.col("segment") <= r.segment), "left_anti")
        out = out.select("id", weight(F.col("tf"), F.col("size")).alias("score"))
        return out if memory is None else out.join(memory.where(where if where is not None else F.lit(True)).select("id"), "id", "left_semi")

    def read_blocks(self, tokens: list[str], k: int, memory: DataFrame | None = None, where: Column | None = None, cubes: list[str] | None = None) -> tuple[DataFrame | None, int, int]:
        """The postings that a search reads, how many blocks these are, and how many hold a token."""
        manifest, tokens = self._manifest(), list(dict.fromkeys(tokens))
        bounds = self._table("bounds", tokens, cubes, manifest) if tokens else None
        if bounds is None:
            return None, 0, 0
        every = self._table("postings", tokens, cubes, manifest)
        bounds = bounds.groupBy("segment", "block").agg(F.sum("most").alias("bound"))
        bounds = materialize(bounds, "bounds")
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()
        best = self._scored(every.where(F.col("block").isin([r.block for r in first])), manifest, memory, where).orderBy(F.desc("score")).limit(k).collect()
        least = best[-1].score if len(best) == k and k else 0.0
        rest = bounds.where(F.col("bound") * (1 + 1e-9) >= least)
        n, total = rest.count(), bounds.count()
        if n <= NAMED:
            every = every.where(F.col("block").isin([r.block for r in rest.select("block").collect()]))
        else:
            every = every.join(rest.select("block").distinct(), "block", "left_semi")
        return every, n, total

    def search(self, tokens: list[str], k: int, memory: DataFrame | None = None, where: Column | None = None, cubes: list[str] | None = None) -> DataFrame:
        """(id, score): the best ``k`` rows that hold a token, ties by id, as ``search.full_text`` gives them.

        ``where`` is over ``memory``, without which every row of the index counts;
        ``cubes``, where they are known, keep the scan to their blocks.
        """
        manifest = self._manifest()
        every, _, _ = self.read_blocks(tokens, k, memory, where, cubes)
        if every is None:
            return self.spark.createDataFrame([], "id string, score double")
        return self._scored(every, manifest, memory, where).orderBy(F.desc("score"), "id").limit(k)

