"""Models as pluggable functions, with deterministic defaults for offline use."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of word tokens, L2 normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


_REGISTRY: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    _REGISTRY[name] = make


def embedder(name: str = "hash") -> Embedder:
    return _REGISTRY[name]()


def embed_column(rows: DataFrame, text_col: str = "memory", out: str = "embedding", make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """``rows`` with an embedding column, computed in Arrow batches."""
    names = [c for c in rows.columns if c != out]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            v = model.embed([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*names, out])

    base = rows.select(*names)
    return base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{out}` array<float>")


reembed = embed_column


#: Rows that one rerank call sees at most.
RERANKED = 50


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words that a text holds."""
    q = set(re.findall(r"\w+", query.lower()))
    return [len(q & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(q)) for t in texts]


def rerank(results: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]] = overlap_reranker, top: int = RERANKED) -> DataFrame:
    """Scores of the ``top`` (id, memory, score) rows replaced by the scorer's; other rows keep theirs.

    The scorer sees the best rows as one list, in their order; ``top`` bounds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("id", pa.string()), ("memory", pa.string())]))  # ``top`` rows
        if t.num_rows:
            ids, texts = t.column(0).combine_chunks(), t.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(scorer(query, texts), pa.float64())], names=["id", "new"])

    head = results.orderBy(F.desc("score"), "id").limit(top).coalesce(1)
    new = head.select("id", "memory").mapInArrow(run, "id string, new double")
    return results.join(new, "id", "left").select("id", "memory", F.coalesce("new", "score").alias("score"), F.col("new").isNotNull().alias("reranked"))


def with_retries(call: Callable, tries: int = 3, models: tuple[str, ...] = ("default",), sleep: Callable[[float], None] | None = None):
    """Call each model of a fallback chain up to ``tries`` times, with a doubling pause."""

    def run(*args):
        fault: Exception | None = None
        for m in models:
            for k in range(tries):
                try:
                    return call(m, *args)
                except Exception as e:  # any backend error moves on
                    fault = e
                    if sleep:
                        sleep(0.1 * 2**k)
        raise fault or RuntimeError("no model")

    return run


def rule_extractor(conversation: str) -> list[dict]:
    """Facts by rule: each user line of eight words or more."""
    out = []
    for line in conversation.split("\n"):
        role, _, said = line.partition(": ")
        if role == "user" and len(said.split()) >= 8:
            out.append({"raw_text": said, "resolved_text": said, "action": "add", "confidence": 0.9, "type": "UserMemory"})
    return out


def distilled_answer(results: DataFrame, query: str, answer: str, least: float = 0.4, top: int = 5) -> DataFrame:
    """A synthetic first row made from the best rows above ``least``; none without such rows."""
    name = "enhanced-" + hashlib.sha256(query.encode()).hexdigest()[:12]
    have = results.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(top).limit(1)
    first = have.select(F.lit(name).alias("id"), F.lit(answer).alias("memory"), F.lit(1.0).alias("score"))
    return first.unionByName(results.select("id", "memory", "score"))


def replace_texts(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of ids in ``texts`` (id, memory) instead of the stored ones."""
    return results.join(texts.select("id", F.col("memory").alias("__new")), "id", "left").withColumn("memory", F.coalesce("__new", "memory")).drop("__new")
