"""Mixture-controlled packing of token documents into fixed windows.

Deficit round-robin over one queue per source: each round is a window, credits every
queue with its quantum (its target share of one window) and sends packets of PACKET
tokens while the credit lasts; what is left is carried to the next round, so to the
next window and the next partition.  A queue starts with credit for half a packet, so
it is never further than that from its target.  Documents are cut where the packets of a round
end, so a long one spreads over many windows and no source fills a window alone.

Packet m of a queue (from 1) therefore leaves in round ceil((m - 1/2) * PACKET / quantum).
That closed form needs only each document's first token's place in its queue, which
prefix sums over buckets give without a global sort on one task; the place in the
sent stream follows from the quanta and sizes of at most LANES queues.  The stream
is cut at multiples of the window, so at most the last window has padding.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.columns import picked
from engram.session import materialize

WINDOW = 2048
END_ID = 1
#: Tokens that a queue sends at once.
PACKET = 32
#: Queues at most.  A window has no room for a packet of each of so many; the smallest sources share the last queue.
LANES = 1024
#: Rows of a queue that one prefix-sum bucket holds, about.
BUCKET_ROWS = 512
#: Buckets under one bucket of the next level.
FAN = 1024


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` JSON file, run by the faster library.

    The JSON's vocabulary (its merges in order) gives the ranks; special tokens'
    strings in a text stay ordinary text.  Ids equal those of ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"] for x in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): rank for piece, rank in model["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.array([*encode(t.as_py() or ""), END_ID], "<u2") for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "queue", "n", "ids"],
                )

    return run


def tokenize(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, queue, n, ids): little-endian 16-bit ids with the end id, written once."""
    path = path or default_vocabulary()
    rows = picked(docs, doc_id=(id_col, "long"), queue=(source_col, "string"), text=(text_col, "string")).fillna("", ["queue"])
    made = rows.mapInArrow(_tokenize(path), "doc_id long, queue string, n long, ids binary")
    return materialize(made.withColumn("row_id", F.monotonically_increasing_id()), "tokens", compression="zstd")


def _before(totals: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """``totals`` (one row a bucket) with ``before``: the sum of earlier buckets of the same ``by``.

    Two levels, so no task reads more than FAN buckets of a group, or a FAN-th of them.
    """
    upper = F.floor(F.col(bucket) / FAN).alias("upper")
    t = totals.select(*by, bucket, value, upper)
    inner = Window.partitionBy(*by, "upper").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    tops = t.groupBy(*by, "upper").agg(F.sum(value).alias("all")).withColumn("base", F.coalesce(F.sum("all").over(outer), F.lit(0))).drop("all")
    t = t.withColumn("low", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(tops, [*by, "upper"])
    return t.select(*by, bucket, (F.col("base") + F.col("low")).alias("before"))


@dataclass(frozen=True)
class Lanes:
    """The queues of a packing: their quanta (tokens a round) and sizes, in the order in which a round serves them."""

    quanta: np.ndarray
    sizes: np.ndarray
    packet: int = PACKET

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each lane has sent when the given rounds are over, a row a round."""
        r = np.asarray(rounds, np.float64)[:, None]
        m = np.floor(r * self.quanta / self.packet + 0.5)
        # the same test decides a packet's round, so both agree whatever is rounded
        m += (m + 0.5) * self.packet / self.quanta <= r
        m -= (m - 0.5) * self.packet / self.quanta > r
        return np.minimum(m.astype(np.int64) * self.packet, self.sizes)

    def round_of(self, lane: int, packets: np.ndarray) -> np.ndarray:
        """The round in which each packet (from 1) of a lane leaves."""
        return np.ceil((np.asarray(packets, np.float64) - 0.5) * self.packet / self.quanta[lane]).astype(np.int64)

    def pieces(self, lane: int, first: int, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, place in the sent stream) of the parts of ``n`` tokens that are number ``first`` and on in their lane."""
        packets = np.arange(first // self.packet, (first + n - 1) // self.packet + 1)
        starts = np.maximum(packets * self.packet, first)
        rounds = self.round_of(lane, packets + 1)
        new = np.flatnonzero(np.r_[True, rounds[1:] != rounds[:-1]])  # packets of one round leave together
        starts, rounds = starts[new], rounds[new]
        at = np.empty(len(starts), np.int64)
        step = max(1, (1 << 20) // len(self.sizes))
        for i in range(0, len(rounds), step):
            before, after = self.sent(rounds[i : i + step] - 1), self.sent(rounds[i : i + step])
            at[i : i + step] = after[:, :lane].sum(1) + before[:, lane:].sum(1) + starts[i : i + step] - before[:, lane]
        # cut at the windows of the stream
        ends = np.r_[starts[1:], first + n]
        cuts = (at + ends - starts - 1) // window - at // window
        k = np.repeat(np.arange(len(starts)), cuts + 1)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(cuts + 1) - cuts - 1, cuts + 1)
        place = np.where(nth > 0, (at[k] // window + nth) * window, at[k])
        return starts[k] + place - at[k] - first, place


def schedule(tokens: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, packet: int = PACKET, most: int = LANES) -> tuple[DataFrame, Lanes]:
    """(row_id, lane, first) - the number of each document's first token in its lane - and the lanes.

    ``targets`` maps a source to its share of every window (others share the rest by
    size); without it each source's target is its share of all tokens, so no queue
    runs dry before the others.  In a lane documents go by the hash of their id.
    """
    place = F.xxhash64("doc_id", "n").alias("place")
    sizes = tokens.groupBy("queue").agg(F.sum("n").alias("size"))
    total, count = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the largest sources and those with a target have lanes of their own, at most ``most`` - 1
    named = sizes.orderBy(F.col("queue").isin(list(targets or {})).cast("int").desc(), F.desc("size"), "queue").limit(most - 1).collect()
    named.sort(key=lambda r: r.queue)
    rest = total - sum(r["size"] for r in named)
    held = np.array([r["size"] for r in named] + [rest] * (rest > 0), np.int64)
    share = held / max(1, total)
    if targets:
        free = max(0.0, 1 - sum(targets.values()))
        loose = sum(r["size"] for r in named if r.queue not in targets) + rest
        share = np.array([targets.get(r.queue, free * r["size"] / max(1, loose)) for r in named] + [free * rest / max(1, loose)] * (rest > 0))
    lanes = Lanes(np.maximum(share * window, 1e-6), held, packet)
    rows = tokens.select("row_id", "queue", "n", place)
    numbers = tokens.sparkSession.createDataFrame([(r.queue, i) for i, r in enumerate(named)], "queue string, lane int")
    # at most LANES - 1 rows
    t = rows.join(F.broadcast(numbers), "queue", "left").withColumn("lane", F.coalesce("lane", F.lit(len(named)))).drop("queue")
    buckets = max(16, count // BUCKET_ROWS)
    bucket: Column = F.least(F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1))
    t = t.withColumn("bucket", bucket.cast("long"))
    offsets = _before(t.groupBy("lane", "bucket").agg(F.sum("n").alias("tokens")), ["lane"], "bucket", "tokens")
    inside = Window.partitionBy("lane", "bucket").orderBy("place", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return t.join(offsets, ["lane", "bucket"]).select("row_id", "lane", (F.col("before") + F.col("inside")).alias("first")), lanes


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(lanes: Lanes, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            docs, blobs, numbers, sums, cut = batch.column(0), batch.column(4), [], [], []
            made: list[list[np.ndarray]] = [[] for _ in range(4)]
            for i, (lane, first, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                start, place = lanes.pieces(lane, first, n, window)
                length = np.diff(np.r_[start, n])
                data = np.frombuffer(blobs[i].as_buffer(), "<u2").astype("<u4").tobytes()
                parts = [data[4 * a : 4 * (a + k)] for a, k in zip(start.tolist(), length.tolist())]
                sums += map(zlib.crc32, parts)
                cut += parts if with_ids else []
                numbers += [i] * len(start)
                for column, v in zip(made, (start, length, np.full(len(start), n), place)):
                    column.append(v)
                if len(numbers) >= 1 << 16:
                    yield _made(docs, numbers, made, sums, cut, window, names)
                    numbers, sums, cut, made = [], [], [], [[] for _ in range(4)]
            if numbers:
                yield _made(docs, numbers, made, sums, cut, window, names)

    return run


def _made(docs: pa.Array, numbers: list[int], made: list[list[np.ndarray]], sums: list[int], cut: list[bytes], window: int, names: list[str]) -> pa.RecordBatch:
    start, length, n, place = (np.concatenate(c) for c in made)
    arrays = [docs.take(pa.array(numbers, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, sums, n, place // window, place % window))]
    return pa.RecordBatch.from_arrays(arrays + ([pa.array(cut, pa.binary())] if "ids" in names else []), names=names)


def pack(
    docs: DataFrame, path: str | None = None, targets: dict[str, float] | None = None, window: int = WINDOW, with_ids: bool = False, packet: int = PACKET, lanes: int = LANES, **columns: str
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    ``ids`` (little-endian 32-bit) on request.  Null text is empty text (one end id),
    a null source is the queue '', null or repeated ids are rows of their own, ties
    of the queue order fall by row number, other columns are ignored.  Every id of
    every document lies in exactly one piece.  An empty table gives no piece.
    """
    tokens = tokenize(docs, path, **columns)
    placed, made = schedule(tokens, targets, window, packet, lanes)
    rows = tokens.select("row_id", "doc_id", "n", "ids").join(placed, "row_id").select("doc_id", "lane", "first", "n", "ids")
    return rows.mapInArrow(_cut(made, window, with_ids), _PIECES + (", ids binary" if with_ids else ""))
