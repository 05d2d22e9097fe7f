"""Periodic jobs, progress rows and waiting: what surrounds the task queue."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# Periods, and the seconds of a wait.
REORGANIZE_SECONDS, PAGERANK_SECONDS = 6 * 3600, 6 * 3600
WAIT_POLL, WAIT_BEAT, WAIT_DEFAULT, WAIT_MOST = 0.5, 15.0, 120.0, 600.0


def claim(spark: SparkSession, root: str, job: str, slot: int) -> bool:
    """True for the one caller that creates the slot's marker file: of many drivers on one folder, one leads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{job}-{slot:012d}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    try:
        fs.create(path, False).close()
    except Exception as e:  # another driver was first
        if fs.exists(path):
            return False
        raise e
    return True


def run_due(spark: SparkSession, jobs: dict[str, tuple[float, Callable[[], None]]], root: str, now: float | None = None) -> list[str]:
    """Run each job (seconds, call) whose period no driver has claimed yet; returns their names.

    A job that raises keeps its period, the next one tries again.
    """
    at, ran = time.time() if now is None else now, []
    for name, (seconds, call) in jobs.items():
        if claim(spark, root, name, int(at // seconds)):
            call()
            ran.append(name)
    return ran


def periodic(spark: SparkSession, jobs: dict[str, tuple[float, Callable[[], None]]], root: str, tick: str = "1 minute") -> StreamingQuery:
    """``run_due`` at every tick of a rate stream, as a service."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda _batch, _id: run_due(spark, jobs, root) and None
    return ticks.writeStream.foreachBatch(run).trigger(processingTime=tick).option("checkpointLocation", f"{root.rstrip('/')}/ticks").start()


PROGRESS = "batch long, at string, rows long, rows_per_s double, state_rows long"


def progress(query: StreamingQuery) -> DataFrame:
    """The query's recent batches as rows."""
    rows = []
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        rows.append((int(p["batchId"]), p["timestamp"], int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), sum(int(s["numRowsTotal"]) for s in p.get("stateOperators", []))))
    return SparkSession.active().createDataFrame(rows, PROGRESS)


def wait(active: Callable[[], int], timeout: float = WAIT_DEFAULT, poll: float = WAIT_POLL, beat: float = WAIT_BEAT, clock=time.monotonic, sleep=time.sleep) -> Iterator[dict]:
    """Events of a wait until ``active`` is 0: progress on a change, heartbeat, then done or timeout."""
    timeout = min(timeout if timeout > 0 else WAIT_DEFAULT, WAIT_MOST)
    start = last = clock()
    before = None
    while True:
        n = active()
        now = clock()
        if n == 0:
            yield {"event": "done", "active": 0}
            return
        if now - start >= timeout:
            yield {"event": "timeout", "active": n}
            return
        if n != before:
            before, last = n, now
            yield {"event": "progress", "active": n}
        elif now - last >= beat:
            last = now
            yield {"event": "heartbeat", "active": n}
        sleep(poll)
