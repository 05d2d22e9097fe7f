"""Approximate nearest neighbours by inverted lists: an index over every row, of which a search reads some lists.

Centroids are fitted by k-means on a bounded sample (the ``SAMPLE`` rows of least id
hash) of unit vectors; every row with a vector goes to its nearest centroid's list, so
a stored index, partitioned by ``list``, prunes the lists that are not probed.  With
all lists probed the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import vector

#: Rows that the centroids are fitted on at most, and the lists.
SAMPLE, LISTS = 100_000, 32


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def fit(memory: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centroids, a row each; fewer where the sample has fewer different vectors, none without vectors."""
    rows = memory.where("embedding IS NOT NULL").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = rows.select(array_to_vector(unit(F.col("embedding"))).alias("features")).persist()
    try:
        n = rows.count()
        return np.array(KMeans(k=min(lists, n), seed=seed, maxIter=10).fit(rows).clusterCenters()) if n > 1 else np.zeros((n, 0))
    finally:
        rows.unpersist()


def indexed(memory: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every row with a vector, and its ``list``; write it with partitionBy("list")."""
    base = memory.where("embedding IS NOT NULL")
    at, names = base.columns.index("embedding"), base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.zeros(b.num_rows, np.int32)
            if centroids.size and b.num_rows:
                x = np.array(b.column(at).to_pylist(), np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                near = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*names, "list"])

    return base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", list int")


def probed(centroids: np.ndarray, query: list[float], probes: int) -> list[int]:
    """The ``probes`` lists whose centroids are nearest to the query."""
    if not centroids.size:
        return [0]
    q = np.array(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    return np.argsort(((centroids - q) ** 2).sum(1), kind="stable")[:probes].tolist()


def knn(index: DataFrame, centroids: np.ndarray, query: list[float], where: Column, k: int, probes: int) -> DataFrame:
    """(id, score): the ``k`` best rows of the probed lists by exact cosine; ties by id."""
    rows = index.where(F.col("list").isin(probed(centroids, query, probes)) & where)
    return rows.select("id", vector.cosine(F.col("embedding"), vector.literal(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)
