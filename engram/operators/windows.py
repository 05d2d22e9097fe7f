"""Greedy overlapping windows over conversations of any length.

Where a window starts depends on the one before, so the plain way is one pass over a
conversation.  Here a conversation is cut into stretches of bytes.  Where the next window
starts is a function of where this one does, so each stretch gives, for every line of
it, the line of a later stretch at which windows leave it.  These functions are composed
by doubling (after k rounds every pointer jumps 2^k stretches), which tells at which line
the windows enter every stretch; then each stretch writes its windows by itself.  No
task holds more than a stretch, and a conversation of one stretch needs no round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.session import materialize, release

#: Windows that fit a stretch, about.
STRETCH = 64
#: Turns that are numbered together.
CHUNK = 1024


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines(conv_id, turn, role, line) with their number ``s``, the bytes before and after them, and the conversation's number of lines.

    Numbers and bytes are running sums: inside chunks of turns, plus those of the chunks before.
    """
    t = lines.withColumn("turn", F.coalesce("turn", F.lit(-1))).withColumn("size", F.octet_length("line") + 1).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "line")
    t = t.withColumn("i", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))  # a row in CHUNK
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("lines_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bytes_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    chunks = chunks.withColumn("total", F.sum("n").over(Window.partitionBy("conv_id"))).drop("n", "bytes")
    chunks = chunks.withColumnsRenamed({"conv_id": "__c", "chunk": "__k"})
    t = t.join(chunks, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__k")))
    after = F.col("bytes_before") + F.col("upto")
    return t.select("conv_id", "role", "line", (F.col("lines_before") + F.col("i") - 1).alias("s"), (after - F.col("size")).alias("start"), after.alias("after"), "total")


def next_windows(start: np.ndarray, after: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every line, by place: where a window from it ends, and where the next one starts.

    A window holds lines of ``size`` bytes at most, and one at least.  The next starts
    where ``overlap`` bytes repeat, at least one line on.
    """
    here = np.arange(len(start))
    end = np.maximum(np.searchsorted(after, start + size, "right"), here + 1)
    back = np.searchsorted(start, after[end - 1] - overlap, "right") - 1 if overlap > 0 else end
    return end, np.maximum(np.minimum(back, end), here + 1)


def _stretches(lines: DataFrame, width: int, size: int, *columns: str) -> DataFrame:
    """Lines by stretch, with those of the next one that a window may reach."""
    k = F.floor(F.col("start") / width)
    copies = F.when((k > 0) & (F.col("start") - k * width <= size), F.array(k, k - 1)).otherwise(F.array(k))
    return lines.select(*columns, k.alias("own"), F.explode(copies).alias("stretch"))


def windows(lines: DataFrame, size: int, overlap: int, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, window, first, end, memory, memory_type) of lines(conv_id, turn, role, line), equal to one pass over each conversation.

    ``first`` and ``end`` number the lines by turn, then role and text; a conversation
    of user lines only, in a window, makes it a UserMemory.  Null conversations are one, a null turn comes first.
    """
    width = stretch * size
    t = materialize(numbered_lines(lines.fillna("", ["role", "line"])), "lines")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        own = int((pdf["own"] == pdf["stretch"]).sum())
        s, total = pdf["s"].to_numpy(), int(pdf["total"].iloc[0])
        end, then = next_windows(pdf["start"].to_numpy(), pdf["after"].to_numpy(), size, overlap)
        out = np.full(own, -1, np.int64)
        for i in range(own - 1, -1, -1):  # later lines first, so each knows its way already
            if s[i] + (end[i] - i) < total:
                out[i] = out[then[i]] if then[i] < own else s[i] + (then[i] - i)
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy()[:own], "s": s[:own], "to": out})

    id_type = t.schema["conv_id"].dataType.simpleString()
    narrow = _stretches(t, width, size, "conv_id", "s", "start", "after", "total")
    jump = materialize(narrow.groupBy("conv_id", "stretch").applyInPandas(leave, f"conv_id {id_type}, s long, to long").where("to >= 0"), "jumps")
    entries = materialize(t.where("s = 0").select("conv_id", "s"), "entries")
    while True:
        same = entries.conv_id.eqNullSafe(jump.conv_id) & (entries.s == jump.s)
        new = entries.join(jump, same).select(entries.conv_id, F.col("to").alias("s"))
        more = materialize(entries.unionByName(new).distinct(), "entries")
        done = more.count() == entries.count()
        release(entries)
        entries = more
        if done:
            break
        a, b = jump.select("conv_id", "s", "to"), jump.select(F.col("conv_id").alias("c"), F.col("s").alias("at"), F.col("to").alias("far"))
        twice = materialize(a.join(b, a["conv_id"].eqNullSafe(b["c"]) & (a["to"] == b["at"])).select("conv_id", "s", F.col("far").alias("to")), "jumps")
        release(jump)
        jump = twice

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        own = int((pdf["own"] == pdf["stretch"]).sum())
        s, total, roles, texts = pdf["s"].to_numpy(), int(pdf["total"].iloc[0]), pdf["role"].tolist(), pdf["line"].tolist()
        end, then = next_windows(pdf["start"].to_numpy(), pdf["after"].to_numpy(), size, overlap)
        rows, at = [], np.flatnonzero(pdf["entry"].to_numpy()[:own])
        i = int(at[0]) if len(at) else own
        while i < own:
            a, b = i, int(end[i])
            kind = "UserMemory" if all(r == "user" for r in roles[a:b]) else "LongTermMemory"
            rows.append((pdf["conv_id"].iloc[0], pdf["stretch"].iloc[0], len(rows), s[a], s[a] + b - a, "\n".join(texts[a:b]).strip(), kind))
            i = int(then[i]) if s[a] + b - a < total else own
        return pd.DataFrame(rows, columns=["conv_id", "stretch", "i", "first", "end", "memory", "memory_type"])

    e = entries.select(F.col("conv_id").alias("__c"), F.col("s").alias("__s"))
    marked = t.join(e, t.conv_id.eqNullSafe(F.col("__c")) & (t.s == F.col("__s")), "left").withColumn("entry", F.col("__s").isNotNull())
    wide = _stretches(marked, width, size, "conv_id", "s", "start", "after", "total", "role", "line", "entry")
    found = wide.groupBy("conv_id", "stretch").applyInPandas(write, f"conv_id {id_type}, stretch long, i int, first long, end long, memory string, memory_type string")
    found = materialize(found, "windows")
    counts = found.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("__c"), F.col("stretch").alias("__k"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    out = found.join(counts, found.conv_id.eqNullSafe(F.col("__c")) & (found.stretch == F.col("__k")))
    return out.select("conv_id", (F.col("i") + F.col("earlier")).cast("int").alias("window"), F.col("first").cast("int").alias("first"), F.col("end").cast("int").alias("end"), "memory", "memory_type")
