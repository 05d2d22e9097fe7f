"""Media columns: archives of lossless images behind a custom Spark data source.

Payloads are stored as 8-bit grey PNG images of WIDTH pixels a row, as members of
ordinary ZIP archives (stored, not deflated again).  Member names have a fixed
length, so the archive's central directory is a table of fixed-width entries.  The
source lists a folder once and plans byte ranges over the archives' sizes; a task
finds its first member by binary search in the directory, reads the directory on from
there in slices and streams members through Arrow.  Every read, of a member, of a
directory slice or of an end record, is retried by itself at its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from engram.llm.columns import picked
from engram.session import materialize, scratch_path

WIDTH = 576
#: An archive is closed at either bound; both keep it below ZIP's 32-bit limits.
ARCHIVE_BYTES = 128 << 20
ARCHIVE_MEMBERS = 60_000
#: Bytes of archive that one task reads.
RANGE_BYTES = 32 << 20
#: Bytes of payload that one Arrow batch holds, about.
BATCH_BYTES = 16 << 20
TRIES = 4
#: Directory entries of one read.
SLICE = 4096

_NAME = "{:018d}.p"
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_ENTRY = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
_ENTRY_BYTES = _ENTRY.size + 20


# -- PNG ------------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * ((-len(data)) % unit if data else unit)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey image of 8-bit samples, ``width`` a row; equal payloads, equal bytes."""
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a grey 8-bit PNG; every chunk's checksum is verified."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width = 8, [], 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            width, _, depth, colour, *_, interlace = struct.unpack(">IIBBBBB", chunk)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit grey PNG")
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    filters = rows[:, 0]
    if not filters.any():
        return rows[:, 1:].tobytes()
    out = np.zeros((len(rows), width), np.uint8)
    above = np.zeros(width, np.uint8)
    for i, (f, row) in enumerate(zip(filters.tolist(), rows[:, 1:])):
        out[i] = above = _unfilter(f, row, above)
    return out.tobytes()


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, dtype=np.uint8)
    if kind == 2:
        return row + above
    got, left, corner = [], 0, 0
    for x, up in zip(row.tolist(), above.tolist()):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        left, corner = (x + guess) & 255, up
        got.append(left)
    return np.array(got, np.uint8)


def features(payload: bytes) -> str:
    """Size, mean and spread of the samples, and an 8 x 8 average hash, all in integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    cells = [int(c.sum()) * n >= total * len(c) for c in np.array_split(x, 64)]
    bits = sum(b << (63 - i) for i, b in enumerate(cells))
    return f"{WIDTH}x{n // WIDTH};mean={1000 * total // n};var={1000 * (n * square - total * total) // (n * n)};ahash={bits:016x}"


# -- archives ---------------------------------------------------------------


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    # Spark's name of the object store's scheme
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ArchiveWriter:
    """One ZIP archive of stored members, numbered from 0; it gets its name when it is closed, so a listing sees whole ones only."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = _file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.fs, self.path = fs, path
        self.out, self.size, self.entries = fs.open_output_stream(path + ".part"), 0, []

    def add(self, data: bytes) -> int:
        """Append a member; its offset."""
        name, crc, at = _NAME.format(len(self.entries)).encode(), zlib.crc32(data), self.size
        self.out.write(_LOCAL.pack(0x04034B50, 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name + data)
        self.size += _LOCAL.size + len(name) + len(data)
        self.entries.append(_ENTRY.pack(0x02014B50, 20, 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, at) + name)
        return at

    def close(self) -> None:
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.out.write(directory + _END.pack(0x06054B50, 0, 0, n, n, len(directory), self.size, 0))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class Archive:
    """Random access to an archive: its directory by entry number, its members by offset."""

    def __init__(self, uri: str, tries: int = TRIES):
        self.uri, self.tries, self.file = uri, tries, None
        end = self._retried(lambda: self._read(self._size() - _END.size, _END.size), f"the end record of {uri}")
        sign, _, _, _, self.count, self.directory_bytes, self.directory, _ = _END.unpack(end)
        if sign != 0x06054B50 or self.directory_bytes != self.count * _ENTRY_BYTES:
            raise ValueError(f"no fixed-width archive directory in {uri}")

    def _size(self) -> int:
        self._open()
        return self.file.size()

    def _open(self) -> None:
        if self.file is None:
            fs, path = _file_system(self.uri)
            self.file = fs.open_input_file(path)

    def _read(self, at: int, size: int) -> bytes:
        self._open()
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise OSError(f"short read at {at} of {self.uri}")
        return data

    def _retried(self, read, what: str, whole=lambda data: True) -> bytes:
        """``read()``, tried again on a newly opened file if it fails or its bytes aren't ``whole``."""
        for k in range(self.tries):
            try:
                data = read()
                if whole(data):
                    return data
                fault: Exception = OSError(f"checksum of {what}")
            except OSError as e:
                fault = e
            if self.file is not None:
                held, self.file = self.file, None
                try:
                    held.close()
                except OSError:  # it is given up in any case
                    pass
            if k + 1 < self.tries:
                time.sleep(0.05 * 2**k)
        raise fault

    def entries(self, k: int, n: int) -> list[tuple[int, int, int]]:
        """(offset, size, checksum) of ``n`` members from number k on, or as many as there are, in one read."""
        n = max(0, min(n, self.count - k))
        data = self._retried(lambda: self._read(self.directory + k * _ENTRY_BYTES, n * _ENTRY_BYTES), f"the directory of {self.uri}") if n else b""
        found = (_ENTRY.unpack_from(data, i * _ENTRY_BYTES) for i in range(n))
        return [(e[16], e[8], e[7]) for e in found]

    def entry(self, k: int) -> tuple[int, int, int]:
        return self.entries(k, 1)[0]

    def first_at(self, offset: int) -> int:
        """The first member whose offset is not below ``offset``, by binary search."""
        lo, hi = 0, self.count
        while lo < hi:
            mid = (lo + hi) // 2
            if self.entry(mid)[0] < offset:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def member(self, offset: int, size: int, crc: int) -> bytes:
        """A member's bytes; a failed or corrupt read is tried again by its offset alone."""
        return self._retried(lambda: self._read(offset + _LOCAL.size + 20, size), f"the member at {offset} of {self.uri}", lambda data: zlib.crc32(data) == crc)


class _Range(InputPartition):
    def __init__(self, uri: str, low: int, high: int):
        self.uri, self.low, self.high = uri, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri in self.paths:
            fs, path = _file_system(uri)
            info = fs.get_file_info(path)
            files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
            prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
            # one listing, as for any file source; it has the sizes
            for f in sorted((f for f in files if f.type == pafs.FileType.File and f.path.endswith(".zip")), key=lambda f: f.path):
                out += [_Range(prefix + f.path, low, low + self.range_bytes) for low in range(0, max(1, f.size), self.range_bytes)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        archive = Archive(partition.uri)
        names = ["archive", "offset", "size", "data"]
        offsets, sizes, data, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.uri] * len(data), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=names)

        for offset, size, crc in self._members(archive, partition):
            offsets.append(offset)
            sizes.append(size)
            data.append(archive.member(offset, size, crc))
            held += size
            if held >= BATCH_BYTES:
                yield batch()
                offsets, sizes, data, held = [], [], [], 0
        if data:
            yield batch()

    @staticmethod
    def _members(archive: Archive, partition: _Range) -> Iterator[tuple[int, int, int]]:
        k = archive.first_at(partition.low)
        while k < archive.count:
            for e in archive.entries(k, SLICE):
                if e[0] >= partition.high:
                    return
                yield e
            k += SLICE


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: archive, offset, size, data."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, size long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


# -- operators --------------------------------------------------------------


def _store(folder: str):
    """Batches of (doc_id, text) -> archives below ``folder``, and where each text went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            rows: list[tuple] = []
            done: list[ArchiveWriter] = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if writer is None:
                    # each attempt of a task has files of its own; rows name only those of the attempt that succeeded
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                offset = writer.add(to_png(padded(data)))
                rows.append((writer.uri, offset, len(data)))
                if writer.size >= ARCHIVE_BYTES or len(writer.entries) >= ARCHIVE_MEMBERS:
                    done.append(writer)
                    writer = None
            for w in done:
                w.close()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["doc_id", "archive", "offset", "n_bytes"],
            )
        if writer is not None:
            writer.close()

    return run


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as an archive member; (doc_id, archive, offset, n_bytes), kept as a table."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "media")
    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return materialize(rows.mapInArrow(_store(folder), "doc_id long, archive string, offset long, n_bytes long"), "members")


def read_archives(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of archives (files or folders) through the data source."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("paths", "\n".join(paths)).option("rangebytes", str(range_bytes)).load()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for data in batch.column(2):
            media = data.as_py()
            payload = from_png(media)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload))
            for column, v in zip(out, row):
                column.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["archive", "offset", *names])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the archives back through the source and describe the bytes read.

    Null text is empty text (a payload of WIDTH bytes 255); null and repeated ids keep
    their rows; other columns are ignored; an empty table gives no row.  Archives of
    attempts that failed after closing some are named by no row; the join leaves them out.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "media")
    members = store(docs, folder, id_col, text_col)
    seen = read_archives(spark, [folder]).select("archive", "offset", "data").mapInArrow(
        _describe, "archive string, offset long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    # archives have unique names; a file system may spell their folder in another way
    name = F.substring_index("archive", "/", -1)
    members, seen = members.withColumn("archive", name), seen.withColumn("archive", name)
    return members.join(seen, ["archive", "offset"]).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
