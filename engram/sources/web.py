"""Web rows: several engines asked in tasks, fused by weighted reciprocal ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import search
from engram.session import materialize

# The weights of a meta search and of direct engines, and the rows kept.
WEIGHTS = {"meta": 1.0, "direct": 1.2}
KEPT = 5

FOUND = "query_id long, source string, rank int, url string, title string, content string"


def ask_engines(queries: DataFrame, engines: dict[str, Callable[[str], list[tuple[str, str, str]]]]) -> DataFrame:
    """(query_id, source, rank, url, title, content): each engine's (url, title, content) list for each queries(query_id, query); one that fails has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, q, name in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    found = engines[name](q)
                except Exception:  # the other engines still answer
                    found = []
                rows += [(i, name, r, *x) for r, x in enumerate(found, 1)]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 3)
            names = ["query_id", "source", "rank", "url", "title", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    names = F.explode(F.array(*[F.lit(n) for n in engines]))
    asked = queries.select(F.col("query_id").cast("long"), "query", names.alias("source"))
    return materialize(asked.mapInArrow(run, FOUND), "web")


def fuse(found: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = KEPT) -> DataFrame:
    """The best ``k`` pages a query: (query_id, id, memory, score, rank); pages without title and content go."""
    t = found.where("url <> '' AND trim(concat_ws('', title, content)) <> ''")
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    part = F.coalesce(w[F.col("source")], F.lit(1.0)) / (F.col("rank") + search.scoring.RRF_K)
    first = F.min_by(F.struct("title", "content"), F.struct(F.col("rank"), F.col("source")))
    t = t.groupBy("query_id", F.col("url").alias("id")).agg(F.sum(part).alias("score"), first.alias("page"))
    t = t.select("query_id", "id", F.trim(F.concat_ws("\n", "page.title", "page.content")).alias("memory"), "score")
    return search.ranked(t, ("query_id",)).where(F.col("rank") <= k)


def web_rows(spark: SparkSession, query: str, engines: dict[str, Callable[[str], list[tuple[str, str, str]]]], k: int = KEPT) -> DataFrame:
    """(id, memory, score) for ``search.search(..., web=...)``."""
    return fuse(ask_engines(spark.createDataFrame([(0, query)], "query_id long, query string"), engines), k=k).select("id", "memory", "score")
