"""Hard negatives: for an anchor and each of its positives, the closest rows of other labels that score just below the positive.

Scores are integer inner products.  Blocks of anchors meet blocks of rows, first to
find the anchors' positives, then for the negatives: an anchor's scores over the
block are sorted in full by score and id, every positive's upper limit is found by
binary search, and the next k entries above its lower limit are read.  The blocks'
few entries are ranked again, so no task holds more than two blocks and no label
meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.columns import picked
from engram.session import materialize

#: Components of the rows, and of the anchors, that one task holds.
ROW_VALUES, ANCHOR_VALUES = 1 << 22, 1 << 20
#: Rows of a block at least, where fewer would only make more tasks.
LEAST_ROWS = 2048
#: Scores that a task holds at once.
SCORES = 1 << 22


@dataclass(frozen=True)
class Mining:
    """What to mine: anchors' ids are divisible by ``anchor_every``; a negative's score is ``least`` to 1 times the positive's."""

    anchor_every: int = 100
    positives: int = 5
    negatives: int = 5
    least: tuple[int, int] = (80, 100)
    scale: float = 256.0


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    """floor(scale * v) as whole doubles; short vectors end in zeros."""
    v = table.column("v").combine_chunks()
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def scores_of(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole doubles, over the components that both have.

    Doubles are exact while no sum can reach 2^53; rows beyond that are multiplied as
    Python integers.  A score outside a long is an error.
    """
    w = min(a.shape[1], x.shape[1])
    a, x = a[:, :w], x[:, :w]
    limit = np.abs(x).sum(1) * np.abs(a).max(initial=0.0)
    large = ~(limit < 2.0**53)
    out = (a @ np.where(large[:, None], 0.0, x).T).astype(np.int64)
    if large.any():
        whole = np.vectorize(int, otypes=[object])
        exact = whole(a).dot(whole(x[large]).T)
        if exact.size and max(abs(exact.min()), abs(exact.max())) >= 1 << 63:
            raise OverflowError("a score does not fit a long")
        out[:, large] = exact.astype(np.int64)
    return out


def _slices(table: pa.Table, scale: float):
    """The block of rows sorted by id, and the anchors in slices with their scores: (ids, labels, anchor rows, scores)."""
    side = table.column("side").to_numpy()
    rows, anchors = table.filter(pa.array(side == 0)).sort_by("id"), table.filter(pa.array(side == 1))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    x = _matrix(rows, scale)
    step = max(1, SCORES // max(1, len(ids)))
    for start in range(0, anchors.num_rows, step):
        part = anchors.slice(start, step)
        yield ids, labels, part, scores_of(_matrix(part, scale), x)


def best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by score, the highest first, and then by id."""
    return np.lexsort((ids, -scores))


def _positives(table: pa.Table, m: Mining) -> pa.Table:
    out: list[list] = [[], [], []]
    for ids, labels, part, scores in _slices(table, m.scale):
        for anchor, label, s in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), scores):
            same = np.flatnonzero((labels == label) & (ids != anchor))
            if len(same):
                top = same[best_first(s[same], ids[same])[: m.positives]]
                out[0] += [anchor] * len(top)
                out[1] += ids[top].tolist()
                out[2] += s[top].tolist()
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("anchor_id", "positive_id", "positive_score"), out)})


def _negatives(table: pa.Table, m: Mining) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    low, high = m.least
    for ids, labels, part, scores in _slices(table, m.scale):
        for anchor, label, positives, s in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), part.column("positives").to_pylist(), scores):
            other = np.flatnonzero(labels != label)
            order = other[best_first(s[other], ids[other])]
            down = -s[order]
            for p in positives:
                score = p["positive_score"]
                first = np.searchsorted(down, -score, "left")
                end = np.searchsorted(down, (-low * score) // high, "right")  # -s <= floor(-low * p / high)
                found = order[first : min(first + m.negatives, end)]
                for c, v in enumerate(([anchor] * len(found), [p["positive_id"]] * len(found), ids[found].tolist(), [score] * len(found), s[found].tolist())):
                    out[c] += v
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out)})


def _first(rows: DataFrame, k: int, keys: tuple[str, ...], score: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cleaned(table: DataFrame, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): rows that take part, one an id; ``label`` may change the label."""
    rows = picked(table, id=(id_col, "long"), label=(label_col, "long"), v=(vector_col, "array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return one if label is None else one.withColumn("label", label)


def mine(table: DataFrame, label: Column | None = None, mining: Mining = Mining(), row_values: int = ROW_VALUES, anchor_values: int = ANCHOR_VALUES, least_rows: int = LEAST_ROWS, **columns: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are the anchor's best other rows of its label; higher scores come first,
    ties by the smaller id.  Rows with a null id, label, vector or component, or one
    that isn't finite, take no part; of rows that share an id the one with the least
    (label, vector) does.  Of vectors of different lengths the common components count,
    so an empty vector scores 0.  An anchor without positives, or a positive without
    negatives in its range, has no row; other columns are ignored; an empty table
    gives no row.  ``label`` (a column over id and label) replaces the label.
    """
    rows = materialize(cleaned(table, label, **columns), "vectors")
    every = F.col("id") % mining.anchor_every == 0
    n, n_anchors, dim = rows.agg(F.count("*"), F.count(F.when(every, 1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    per_block, per_anchors = max(1, row_values // max(1, dim)), max(1, anchor_values // max(1, dim))
    a = -(-max(1, n_anchors) // per_anchors)
    tasks = -(-2 * table.sparkSession.sparkContext.defaultParallelism // a)
    r = max(-(-max(1, n) // per_block), min(tasks, -(-max(1, n) // least_rows)))

    def dealt(anchors: DataFrame) -> DataFrame:
        """Rows and anchors, a copy for each block of the other side."""
        none = F.lit(None).cast(anchors.schema["positives"].dataType)
        left = rows.select(F.pmod(F.xxhash64("id"), F.lit(r)).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("ab"), F.lit(0).alias("side"), "id", "label", "v", none.alias("positives"))
        right = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(a)).alias("ab"), F.lit(1).alias("side"), "id", "label", "v", "positives")
        return left.unionByName(right)

    pair = "array<struct<positive_id: bigint, positive_score: bigint>>"
    anchors = rows.where(every)
    found = dealt(anchors.withColumn("positives", F.lit(None).cast(pair))).groupBy("rb", "ab").applyInArrow(lambda t: _positives(t, mining), "anchor_id long, positive_id long, positive_score long")
    found = _first(found, mining.positives, ("anchor_id",), "positive_score", "positive_id")
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # ``positives`` of them at most
    anchors = materialize(anchors.join(found, F.col("id") == F.col("anchor_id")).select("id", "label", "v", F.col("positives").cast(pair)), "positives")
    low = dealt(anchors).groupBy("rb", "ab").applyInArrow(lambda t: _negatives(t, mining), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    low = _first(low, mining.negatives, ("anchor_id", "positive_id"), "negative_score", "negative_id")
    return low.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Some labels of the table are wrong on purpose, so that near rows of another label exist.
def contract_label() -> Column:
    return F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle(m: Mining = Mining()) -> str:
    """DuckDB SQL of ``mine`` with ``contract_label``."""
    return f"""
WITH r AS (SELECT CAST(vec_id AS BIGINT) AS id, min(struct_pack(l := CAST(label AS BIGINT), v := CAST(embedding AS DOUBLE[]))) AS s FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 GROUP BY 1),
t AS (SELECT id, CASE WHEN id % 7 = 0 THEN (s.l + 1) % 10 ELSE s.l END AS label, list_transform(s.v, lambda x: floor({m.scale} * x)) AS v FROM r),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM t a JOIN t b ON a.id <> b.id WHERE a.id % {m.anchor_every} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
f AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {m.least[0]} * p.score <= {m.least[1]} * s.score AND s.score <= p.score WHERE p.k <= {m.positives})
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM f WHERE r <= {m.negatives}"""
