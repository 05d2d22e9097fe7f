"""The queue folder as a stream: offsets, restarts, batches written once, trimming, two producers."""

from __future__ import annotations

import pytest

from engram.schema import TASKS
from engram.sources import queue


def messages(spark, first, n, parts=1):
    rows = [(str(first + i), f"u{i % 3}", "c", "add" if i % 2 else "query", '{"a": "ü\n"}', None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, TASKS).repartition(parts)


def run(spark, root, out, where, crash_on=None, per_batch=1):
    """One run over all that is there; ``crash_on``: the batch that is written and then fails."""

    def sink(batch, number):
        queue.write_once(batch, number, out)
        if number == crash_on:
            raise RuntimeError("lost after writing")

    q = queue.read_queue(spark, root, per_batch).writeStream.foreachBatch(sink).option("checkpointLocation", where).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def ids(spark, out):
    return sorted(int(r.item_id) for r in queue.read_once(spark, out, TASKS).collect())


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    root, out, where = (str(tmp_path / x) for x in ("queue", "out", "checkpoint"))
    queue.publish(messages(spark, 0, 10, 2), root)
    assert queue.publish(messages(spark, 10, 5), root) == 3
    run(spark, root, out, where)
    assert ids(spark, out) == list(range(15))
    queue.publish(messages(spark, 15, 5), root)
    queue.publish(messages(spark, 20, 5), root)
    with pytest.raises(Exception, match="lost after writing"):
        run(spark, root, out, where, crash_on=3)
    queue.publish(messages(spark, 25, 2), root)
    run(spark, root, out, where)  # the batch that was written and lost comes again, into its folder
    assert ids(spark, out) == list(range(27))
    rows = queue.read_once(spark, out, TASKS).where("item_id = '3'").collect()
    assert [r.content for r in rows] == ['{"a": "ü\n"}'] and rows[0].timestamp is None
    assert queue.acknowledged(root) >= 5 and queue.trim(root) >= 5
    assert queue.publish(messages(spark, 27, 1), root) == 7  # numbers go on
    run(spark, root, out, where)
    assert ids(spark, out) == list(range(28))


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    assert queue.read_once(spark, out, TASKS).count() == 0
    queue.write_once(messages(spark, 0, 3), 0, out)
    queue.write_once(messages(spark, 3, 3), 1, out)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert ids(spark, out) == [0, 1, 2]
