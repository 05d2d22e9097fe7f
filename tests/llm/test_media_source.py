"""The archive source: retries of every read, half-written archives, brute-force features and image bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import media


def archive(tmp_path, n=30, name="a.zip"):
    w = media.ArchiveWriter(str(tmp_path / name))
    data = [bytes([i % 251]) * (20 + i) for i in range(n)]
    for x in data:
        w.add(x)
    return w, data


class Flaky:
    """A file whose every third read fails or is cut short."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def read(self, size):
        self.n += 1
        if self.n % 3 == 1:
            raise OSError("lost")
        data = self.file.read(size)
        return data[: size // 2] if self.n % 3 == 2 else data

    def __getattr__(self, name):
        return getattr(self.file, name)


def test_every_read_is_retried_by_itself(tmp_path, monkeypatch):
    w, data = archive(tmp_path)
    w.close()
    opened, real = [], media._file_system

    def flaky(uri):
        fs, path = real(uri)

        class Wrapped:
            def open_input_file(self, p):
                opened.append(p)
                if len(opened) % 4 == 2:
                    raise OSError("cannot open")
                file = Flaky(fs.open_input_file(p))
                file.n = len(opened) % 3
                return file

        return Wrapped(), path

    monkeypatch.setattr(media, "_file_system", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    a = media.Archive(w.uri, tries=20)
    entries = a.entries(0, 99)
    assert len(entries) == len(data) and a.first_at(entries[7][0]) == 7 and a.entries(28, 5) == entries[28:]
    assert [a.member(*e) for e in entries] == data
    bad = (entries[3][0], entries[3][1], entries[3][2] ^ 1)
    with pytest.raises(OSError):
        a.member(*bad)


def test_unfinished_archives_are_not_listed(spark, tmp_path):
    w, data = archive(tmp_path)
    w.close()
    half, _ = archive(tmp_path, name="b.zip")
    half.out.close()
    rows = media.read_archives(spark, [str(tmp_path)]).collect()
    assert sorted(r.data for r in rows) == sorted(bytearray(x) for x in data)
    assert media.read_archives(spark, [str(tmp_path / "none")]).count() == 0


def test_object_store_names(monkeypatch):
    asked = []

    class Systems:
        class FileSystem:
            @staticmethod
            def from_uri(uri):
                asked.append(uri)
                return None, "bucket/key"

    monkeypatch.setattr(media, "pafs", Systems)
    media._file_system("s3a://bucket/key")
    assert asked == ["s3://bucket/key"]


def test_rows_equal_brute_force(spark):
    texts = [None, "", "x", "é漢" * 500, "plain words " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.round_trip(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        n = max(1, -(-len(data) // 576)) * 576
        payload = data + b"\xff" * (n - len(data))
        # a grey image written from the PNG specification
        lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, n, 576))
        parts = [(b"IHDR", struct.pack(">II5B", 576, n // 576, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 3)), (b"IEND", b"")]
        image = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
        samples = list(payload)
        mean, square = sum(samples), sum(x * x for x in samples)
        cells = np.array_split(np.array(samples), 64)
        bits = "".join("1" if sum(c.tolist()) / len(c) >= mean / n else "0" for c in cells)
        feature = f"576x{n // 576};mean={1000 * mean // n};var={1000 * (n * square - mean * mean) // (n * n)};ahash={int(bits, 2):016x}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), feature)
    assert media.round_trip(docs.where(F.lit(False))).count() == 0
