"""The task queue on Structured Streaming: parse, route, prioritise, retry, dead letters.

The same column functions serve batches and streams; state that must outlive a
micro-batch (retries, buffers, task lifecycles) is a stateful operator with timers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from engram.functions import scoring
from engram.schema import HIGH_PRIORITY, TASKS

MOST_RETRIES = 3
DEAD_LETTERS = 1000
BUFFER_SIZE, BUFFER_SECONDS = 5, 30
READ_BATCH = 10


def read_tasks(spark: SparkSession, folder: str, per_trigger: int = READ_BATCH) -> DataFrame:
    """JSON task files as a stream, a bounded number of files a trigger (admission control)."""
    return spark.readStream.schema(TASKS).option("maxFilesPerTrigger", per_trigger).json(folder)


def parse_timestamp(text: Column, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), default)


def parse_tasks(raw: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): cube and label are mandatory; bad times become ``now``."""
    ok = (F.coalesce("cube_id", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != "")
    t = raw.withColumn("ts", parse_timestamp(F.col("timestamp"), now if now is not None else F.current_timestamp()))
    return t.where(ok).withColumn("high_priority", F.col("label").isin(*HIGH_PRIORITY)), raw.where(~ok)


def parse_ids(content: Column) -> Column:
    """Ids of a payload: JSON array, JSON object (memory_ids or memory_ids_str) or comma list."""
    t = F.trim(content)
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    obj = F.from_json(t, "memory_ids array<string>, memory_ids_str string")
    from_array = F.from_json(t, "array<string>")
    from_obj = F.when(F.size(obj["memory_ids"]) > 0, obj["memory_ids"]).when(F.coalesce(obj["memory_ids_str"], F.lit("")) != "", split(obj["memory_ids_str"]))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>"))
        .when(t.startswith("[") & (F.size(from_array) > 0), from_array)
        .when(t.startswith("{") & from_obj.isNotNull(), from_obj)
        .otherwise(split(t))
    )


def parse_conversation(content: Column) -> Column:
    """Conversation text of a preference payload: its field, or its history joined, else the text itself."""
    t = F.trim(F.coalesce(content, F.lit("")))
    o = F.from_json(t, "conversation string, content string, history array<struct<role:string,content:string>>")
    history = F.array_join(F.transform(o["history"], lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    inner = F.coalesce(F.nullif(o["conversation"], F.lit("")), F.nullif(o["content"], F.lit("")), F.nullif(history, F.lit("")))
    return F.when(t.startswith("{"), F.coalesce(inner, t)).otherwise(t)


def prioritized(batch: DataFrame) -> DataFrame:
    """High-priority tasks first, then by time."""
    return batch.orderBy(F.desc("high_priority"), "ts", "item_id")


def route(batch: DataFrame, handlers: dict[str, Callable[[DataFrame], None]]) -> None:
    """foreachBatch body: each label's rows to its handler, high-priority labels first."""
    batch.persist()
    try:
        for label in sorted(handlers, key=lambda x: (x not in HIGH_PRIORITY, x)):
            handlers[label](batch.where(F.col("label") == label))
    finally:
        batch.unpersist()


def retries(failed: DataFrame, most: int = MOST_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(to retry with ``delay_s`` and ``retry_at``, dead letters)."""
    t = failed.withColumn("delay_s", scoring.retry_delay_seconds(F.col("retry_count")))
    again = t.where(F.col("retry_count") < most).withColumn("retry_at", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("delay_s")))
    return again, t.where(F.col("retry_count") >= most)


def cap_dead_letters(letters: DataFrame, most: int = DEAD_LETTERS) -> DataFrame:
    return letters.orderBy(F.desc("ts"), "item_id").limit(most)


def lifecycle(events: DataFrame) -> DataFrame:
    """The last status of each (user, item): events(user_id, item_id, status, ts)."""
    rank = F.expr("CASE status WHEN 'waiting' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END")
    return events.groupBy("user_id", "item_id").agg(F.max_by("status", F.struct("ts", rank.alias("r"))).alias("status"), F.max("ts").alias("ts"))


def status_counts(status: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    names = ("waiting", "in_progress", "completed", "failed")
    counts = [F.count_if(F.col("status") == n).alias(n) for n in names]
    return status.groupBy(*by).agg(*counts, F.count_if(F.col("status").isin("waiting", "in_progress")).alias("active"))


def lifecycle_stream(events: DataFrame, ttl_days: int = 7) -> DataFrame:
    """Streaming last status with state that expires: needs ``ts`` as timestamp."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at = state.get if state.exists else ("", 0.0)
        order = {"waiting": 0, "in_progress": 1}
        for b in batches:
            for s, t in zip(b["status"], b["ts"]):
                when = t.timestamp()
                if (when, order.get(s, 2)) >= (at, order.get(status, 2) if status else -1):
                    status, at = s, when
        state.update((status, at))
        state.setTimeoutDuration(ttl_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "item_id": [key[1]], "status": [status], "at": [at]})

    return events.groupBy("user_id", "item_id").applyInPandasWithState(
        step, "user_id string, item_id string, status string, at double", "status string, at double", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def buffer_stream(entries: DataFrame, size: int = BUFFER_SIZE, seconds: int = BUFFER_SECONDS) -> DataFrame:
    """Per (user, cube) buffers flushed at ``size`` entries or when the oldest is older than ``seconds``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []  # (arrival in ms, content), oldest first

        def flushed(part: list) -> pd.DataFrame:
            return pd.DataFrame({"user_id": [key[0]], "cube_id": [key[1]], "content": ["\n---\n".join(c for _, c in part)], "n": [len(part)]})

        if state.hasTimedOut:
            state.remove()
            if held:
                yield flushed(held)
            return
        now = state.getCurrentProcessingTimeMs()
        for b in batches:
            held += [(now, c) for c in b["content"].fillna("").tolist()]
        while len(held) >= size or held and now - held[0][0] >= seconds * 1000:
            yield flushed(held[:size])
            held = held[size:]
        if held:
            state.update((json.dumps(held),))
            # new entries don't put off the flush of the oldest
            state.setTimeoutDuration(max(1, held[0][0] + seconds * 1000 - now))
        elif state.exists:
            state.remove()

    return entries.groupBy("user_id", "cube_id").applyInPandasWithState(
        step, "user_id string, cube_id string, content string, n int", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def buffer_batch(entries: DataFrame, size: int = BUFFER_SIZE, seconds: int = BUFFER_SECONDS) -> DataFrame:
    """The batch analogue: gaps over ``seconds`` end a run, runs are cut by ``size``."""
    order = [F.col("ts").asc_nulls_last(), F.col("item_id").asc_nulls_last()]
    w = Window.partitionBy("user_id", "cube_id").orderBy(*order)
    second = F.rint(F.unix_micros("ts") / F.lit(1e6))  # the nearest second; the order keeps the fractions
    t = entries.withColumn("gap", second - F.lag(second).over(w))
    t = t.withColumn("run", F.sum(F.when(F.col("gap") > seconds, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.row_number().over(Window.partitionBy("user_id", "cube_id", "run").orderBy(*order)) - 1
    t = t.withColumn("part", F.floor(k / size).cast("int"))
    return t.groupBy("user_id", "cube_id", "run", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def retry_stream(failed: DataFrame) -> DataFrame:
    """Failed tasks held for their back-off and then emitted with one more retry; dead ones at once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, content = state.get
            state.remove()
            yield pd.DataFrame({"item_id": [key[0]], "content": [content], "retry_count": [n + 1], "dead": [False]})
            return
        for b in batches:
            for n, content in zip(b["retry_count"], b["content"]):
                if n >= MOST_RETRIES:
                    yield pd.DataFrame({"item_id": [key[0]], "content": [content], "retry_count": [n], "dead": [True]})
                else:
                    state.update((int(n), content))
                    state.setTimeoutDuration(int(min(5 * 2**n, 300) * 1000))

    return failed.groupBy("item_id").applyInPandasWithState(
        step, "item_id string, content string, retry_count int, dead boolean", "n int, content string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, timers: bool = False) -> None:
    """Process what is there and stop; the checkpoint and an idempotent handler make it exactly once.

    Operators with processing-time timers always have another batch to run, so with
    ``timers`` all data is one batch; timers fire while the query runs as a service.
    """
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = (w.trigger(once=True) if timers else w.trigger(availableNow=True)).start()
    q.awaitTermination()


def queue_totals(streams: DataFrame) -> DataFrame:
    """streams(name, length, pending): distinct bases, total length and pending."""
    base = F.regexp_replace("name", r":[^:]*$", "")
    return streams.agg(F.countDistinct(base).alias("bases"), F.sum("length").alias("length"), F.sum("pending").alias("pending"))


# -- event-time operators over ``events`` -----------------------------------


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; works on a batch and on a stream."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    t = t.withWatermark("ts", late)
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return t.groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows a user."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)
    t = t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return t.select("user_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "n")


def dedupe_stream(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.dropDuplicatesWithinWatermark(keys) if t.isStreaming else t.dropDuplicates(keys)
