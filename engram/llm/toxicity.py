"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression.

P(grade >= k | x) = sigmoid(w . x - b_k), one weight vector for all thresholds
b_1 < b_2 < ...; the expected grade is the sum of these probabilities.  Features are
sparse: the distinct words of the text that the labelled rows tie to severity.

Grades come from the labels: 0 not toxic; 1 toxic; 2 toxic and of low quality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked

#: Labelled rows that a fit reads at most, those with the least hash of their id.
FIT_ROWS = 40_000
#: Words that a model knows at most.
FEATURES = 4096
#: A word becomes a feature if this many labelled texts hold it and its log odds differ from 0 by so many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 3.5
#: A text is toxic if P(grade >= 1) reaches this.
CUT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    """Word weights and the ordered thresholds."""

    weights: dict[str, float]
    bounds: tuple[float, ...]

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        get = self.weights.get
        score = sum([get(w, 0.0) for w in words_of(text)])
        return 1 / (1 + np.exp(-np.clip(score - np.array(self.bounds), -60, 60)))


def fit_sparse(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, d: int, grades: int, decay: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bounds by full-batch Adam on the penalised likelihood.

    Text ``rows[i]`` holds word ``columns[i]``.  The bounds are a running sum of
    exponentials after the first, so they stay ordered.
    """
    n = len(y)
    share = np.array([max(0.5, (y >= k).sum()) / max(1, n) for k in range(1, grades)]).clip(1e-6, 1 - 1e-6)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    theta = np.r_[np.zeros(d), start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at_least = np.arange(1, grades)
    for step in range(1, rounds + 1):
        w, raw = theta[:d], theta[d:]
        gaps = np.r_[raw[0], np.exp(raw[1:])]
        bounds = np.cumsum(gaps)
        score = np.bincount(rows, w[columns], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - bounds, -60, 60)))
        full = np.c_[np.ones(n), p, np.zeros(n)]
        mine = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-12)
        slope = p * (1 - p)
        # d log P(y) / d (score - bound_k): up for the bound below the grade, down for the one above
        up = (at_least == y[:, None]) * slope / mine[:, None]
        down = (at_least == y[:, None] + 1) * slope / mine[:, None]
        g = up - down
        g_raw = np.cumsum(-g.mean(0)[::-1])[::-1] * np.r_[1.0, gaps[1:]]
        grad = -np.r_[np.bincount(columns, g.sum(1)[rows], d) / n - decay * w, g_raw]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = theta[d:]
    return theta[:d], np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(words_of(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))], names=["doc_id", "grade", "words"])


def graded(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, grade, text) of labelled documents, one row an id: the ``rows`` with the least id hash."""
    texts = picked(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.coalesce(F.col("quality"), F.lit(1))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(toxic > 0, 1 + (quality < 1).cast("int")).otherwise(0)).alias("grade"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most FIT_ROWS pairs of numbers; of repeated ids the least text counts
    return texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))


def fit(sample: DataFrame, features: int = FEATURES) -> Model:
    """A model of a bounded (doc_id, grade, text) sample; without rows of both kinds it calls nothing toxic."""
    words = sample.mapInArrow(_words, "doc_id long, grade int, words array<string>").persist()
    try:
        sizes = {r.grade: r["count"] for r in words.groupBy("grade").count().collect()}
        total, bad = sum(sizes.values()), sum(n for g, n in sizes.items() if g > 0)
        if not bad or bad == total:
            return Model({}, (np.inf, np.inf))
        seen = words.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("bad"))
        a, b = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
        c, d = F.lit(bad) - F.col("bad") + 0.5, F.lit(total - bad) - (F.col("n") - F.col("bad")) + 0.5
        z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        top = seen.where(F.col("n") >= LEAST_TEXTS).select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
        names = [r.word for r in top]
        if not names:
            share = bad / total
            bound = float(np.log((1 - share) / share))
            return Model({}, (bound, bound + 1))
        kept = words.select("grade", F.array_intersect("words", F.array(*[F.lit(w) for w in names])).alias("words")).collect()
    finally:
        words.unpersist()
    at = {w: i for i, w in enumerate(names)}
    rows = np.repeat(np.arange(len(kept)), [len(r.words) for r in kept])
    columns = np.array([at[w] for r in kept for w in r.words], np.int64)
    weights, bounds = fit_sparse(rows, columns, np.array([r.grade for r in kept]), len(names), 3)
    return Model(dict(zip(names, weights.tolist())), tuple(bounds.tolist()))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    return fit(graded(docs, labels, rows))


def score(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_toxic, severity, grade, toxic) for every row.

    ``severity`` is the expected grade, ``grade`` the largest k with P(grade >= k) of
    at least one half.  Null or empty text has no words; null and repeated ids keep
    their rows; other columns are ignored; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.chances(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(model.bounds))
            arrays = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "p_toxic", "severity", "grade", "toxic"])

    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, p_toxic double, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns, whatever their names.

    Null or empty text has no words and stays, unless the model calls that toxic too;
    null and repeated ids are rows of their own; an empty table gives no row.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.chances(t.as_py())[0] < cut for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
