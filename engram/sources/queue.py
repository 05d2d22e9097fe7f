"""A durable task queue in a shared folder: numbered segments, a streaming source with offsets, and a sink that writes a batch once.

A producer writes its messages as JSON lines and then renames each file to the next
number, so a segment is whole or not there.  The stream's offset is the number of the last
segment read: a restart from the checkpoint asks for the same segments again, nothing is
lost.  ``commit`` notes how far every message has been handled, and ``trim`` deletes what
is older.  ``write_once`` puts each batch into the folder of its number, so a batch that
is run again replaces itself, and nothing is repeated.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from engram.schema import TASKS

FORMAT = "engram_queue"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _segments(uri: str) -> dict[int, str]:
    """Paths of the segments by number."""
    files, root = _open(uri)
    found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return {int(x.base_name[:-6]): x.path for x in found if x.base_name.endswith(".jsonl") and x.base_name[:-6].isdigit()}


def publish(rows: DataFrame, root: str) -> int:
    """Append rows as segments, one a partition of ``rows``; the number of the last segment.

    Two producers may publish at once: a number that another has taken is left for the next.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex[:12]}"
    rows.write.json(staged)
    last = max([*_segments(root), acknowledged(root)], default=0)
    parts = sorted(str(x.getPath().toString()) for x in files.globStatus(path(f"{staged}/part-*")) or [])
    for part in parts:
        while True:
            last += 1
            to = path(f"{root.rstrip('/')}/{last:012d}.jsonl")
            lock = path(f"{root.rstrip('/')}/.taken-{last:012d}")
            try:
                files.create(lock, False).close()  # exclusive: one producer has the number
            except Exception:
                continue
            files.rename(path(part), to)
            break
    files.delete(path(staged), True)
    return last


def acknowledged(root: str) -> int:
    """The last segment whose messages have all been handled; 0 before any."""
    files, base = _open(root)
    found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return max((int(x.base_name[6:]) for x in found if x.base_name.startswith("acked-")), default=0)


def trim(root: str) -> int:
    """Delete acknowledged segments; how many."""
    files, _ = _open(root)
    upto, gone = acknowledged(root), 0
    for n, path in _segments(root).items():
        if n <= upto:
            files.delete_file(path)
            gone += 1
    return gone


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"], schema
        self.most = int(options.get("segmentsPerBatch", "0"))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        have = sorted(n for n in _segments(self.root) if n > self.at)
        self.at = have[: self.most or None][-1] if have else self.at
        return {"segment": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Segment]:
        self.at = max(self.at, end["segment"])
        return [_Segment(p) for n, p in sorted(_segments(self.root).items()) if start["segment"] < n <= end["segment"]]

    def read(self, partition: _Segment):
        names = self.schema.names
        files, _ = _open(self.root)
        with files.open_input_stream(partition.path) as f:
            rows = [json.loads(x) for x in f.readall().decode().split("\n") if x]
        columns = [pa.array([None if r.get(c) is None else str(r[c]) for r in rows], pa.string()) for c in names]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def commit(self, end: dict) -> None:
        files, root = _open(self.root)
        with files.open_output_stream(f"{root}/acked-{end['segment']:012d}") as f:
            f.write(b"1")


class QueueSource(DataSource):
    """``spark.readStream.format("engram_queue").option("path", folder)``: text columns of the task schema."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TASKS

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)


def read_queue(spark: SparkSession, root: str, segments_per_batch: int = 0) -> DataFrame:
    """The queue as a stream of tasks; at most so many segments a batch, if given."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(FORMAT).option("path", root).option("segmentsPerBatch", str(segments_per_batch)).load()


def write_once(batch: DataFrame, number: int, root: str) -> None:
    """Write a micro-batch into the folder of its number: run again, it replaces itself.  For ``foreachBatch``."""
    batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={number}")


def read_once(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What ``write_once`` has written whole; folders without a success mark are left out."""
    files, base = _open(root)
    whole = [x.path for x in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if files.get_file_info(f"{x.path}/_SUCCESS").type == pafs.FileType.File]
    scheme = root.split("://")[0] + "://" if "://" in root else "file://"
    return spark.read.schema(schema).parquet(*[f"{scheme}{p}" for p in whole]) if whole else spark.createDataFrame([], schema)
