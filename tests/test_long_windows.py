"""Windows across long conversations: equal to one pass, also over 50,000 turns of one conversation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import ingest, windows


def says(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, line string")


def one_pass(rows, size, overlap):
    out = []
    for c in {r[0] for r in rows}:
        lines = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3]))]
        out += [(c, i, a, b, t, kind) for i, (a, b, t, kind) in enumerate(ingest.windows_of(lines, size, overlap))]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "window", "first", "end", "memory", "memory_type").collect()), key=repr)


@pytest.mark.parametrize("size,overlap,stretch", [(64, 20, 2), (64, 0, 3), (100, 99, 1), (4096, 800, 64)])
def test_equal_to_one_pass(spark, monkeypatch, size, overlap, stretch):
    monkeypatch.setattr(windows, "CHUNK", 7)
    rng = random.Random(size + overlap)
    rows = [(c, t * rng.choice([1, 1, 3]) if c else t, rng.choice(["user", "user", "assistant"]), "ä" * rng.choice([0, 1, 5, 20, 90])) for c, n in ((0, 90), (1, 1), (2, 40)) for t in range(n)]
    rows += [(3, 0, "user", "x" * 1000), (3, 1, "user", ""), (3, 2, "user", "y" * 700), (3, 2, "user", "y" * 700)]  # lines longer than a stretch, a repeated turn
    assert rows_of(windows.windows(says(spark, rows), size, overlap, stretch)) == one_pass(rows, size, overlap)


def test_fifty_thousand_turns_of_one_conversation(spark):
    rng = random.Random(1)
    rows = [(7, t, "user" if t % 2 else "assistant", "w" * rng.randrange(60)) for t in range(50_000)]
    got = windows.windows(says(spark, rows).repartition(8), 256, 64, 16)
    assert rows_of(got) == one_pass(rows, 256, 64)


def test_messages_with_nulls_and_none(spark):
    m = spark.createDataFrame([(1, 0, None, None, None), (1, 1, "user", "hello", None), (None, 0, "user", "lost", None)], "conv_id long, turn int, role string, content string, chat_time timestamp")
    got = {r.conv_id: r.memory for r in ingest.message_windows(m).collect()}
    assert got == {1: ": [None]: \nuser: [None]: hello", None: "user: [None]: lost"}
    assert ingest.message_windows(m.limit(0)).count() == 0
