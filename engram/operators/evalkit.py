"""Answer evaluation: EM, F1, hits, cosine, roll-ups, n-gram scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import models
from engram.functions import text

# Names of question categories, by number only.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def exact_match(pred: Column, gold: Column) -> Column:
    return (text.answer_normalize(pred) == text.answer_normalize(gold)).cast("double")


def _overlap(p: Column, g: Column) -> Column:
    """Multiset overlap of two token arrays."""
    count = lambda of, t: F.size(F.filter(of, lambda x: x == t))
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))


def token_f1(pred: Column, gold: Column) -> Column:
    p, g = text.answer_tokens(pred), text.answer_tokens(gold)
    same = _overlap(p, g)
    f1 = 2.0 * same / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(f1)


def set_f1(pred: Column, gold: Column) -> Column:
    p, g = F.array_distinct(text.answer_tokens(pred)), F.array_distinct(text.answer_tokens(gold))
    both = F.size(F.array_intersect(p, g))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def any_token_hit(retrieved: Column, gold: Column) -> Column:
    """1 if some retrieved text (array) shares a token with the gold answer."""
    g = text.answer_tokens(gold)
    return F.coalesce(F.exists(retrieved, lambda r: F.arrays_overlap(text.answer_tokens(r), g)), F.lit(False)).cast("double")


def bow_cosine(a: Column, b: Column) -> Column:
    x, y = text.answer_tokens(a), text.answer_tokens(b)
    count = lambda of, t: F.size(F.filter(of, lambda v: v == t)).cast("double")
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, t: s + count(x, t) * count(y, t))
    length = lambda of: F.sqrt(F.aggregate(F.array_distinct(of), F.lit(0.0), lambda s, t: s + count(of, t) * count(of, t)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / (length(x) * length(y)))


def _ngrams(tokens: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(pred: Column, gold: Column, n: int = 1) -> Column:
    """F-measure of n-gram overlap, without stemming."""
    p, g = _ngrams(text.answer_tokens(pred), n), _ngrams(text.answer_tokens(gold), n)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * _overlap(p, g) / (F.size(p) + F.size(g)))


def bleu_1(pred: Column, gold: Column) -> Column:
    """Unigram precision with the brevity penalty."""
    p, g = text.answer_tokens(pred), text.answer_tokens(gold)
    n = F.size(p)
    brevity = F.when(n >= F.size(g), 1.0).otherwise(F.exp(1 - F.size(g) / n))
    return F.when((n == 0) | (F.size(g) == 0), 0.0).otherwise(brevity * _overlap(p, g) / n)


def _meteor(pred: list[str], gold: list[str]) -> float:
    """Exact matches, left to right: 10PR / (R + 9P), less half the cube of the chunks a match."""
    free: dict[str, list[int]] = {}
    for i, w in enumerate(gold):
        free.setdefault(w, []).append(i)
    at = []
    for w in pred:
        places = free.get(w)
        if places:
            after = at[-1] + 1 if at else -1
            at.append(places.pop(places.index(after) if after in places else 0))
    if not at:
        return 0.0
    p, r = len(at) / len(pred), len(at) / len(gold)
    chunks = 1 + sum(b != a + 1 for a, b in zip(at, at[1:]))
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(at)) ** 3)


def meteor(pred: Column, gold: Column) -> Column:
    """METEOR by exact words, without stems and synonyms."""

    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([_meteor(list(x), list(y)) for x, y in zip(p, g)], dtype="float64")

    return score(text.answer_tokens(pred), text.answer_tokens(gold))


def embedding_similarity(rows: DataFrame, pred: str, gold: str, make=models.HashEmbedder, out: str = "similarity") -> DataFrame:
    """``rows`` with the cosine of the embedded texts, 0 where one is empty."""
    t = models.embed_column(models.embed_column(rows, pred, "__p", make), gold, "__g", make)
    dot = F.aggregate(F.zip_with("__p", "__g", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return t.withColumn(out, dot).drop("__p", "__g")


def prediction(chat_answer: Column, retrieved: Column) -> Column:
    """The chat answer, else the first three retrieved texts."""
    return F.coalesce(F.nullif(F.trim(chat_answer), F.lit("")), F.array_join(F.slice(retrieved, 1, 3), " "))


def rollup(scores: DataFrame, metrics: list[str], category: str = "category", exclude: tuple[int, ...] = ()) -> DataFrame:
    """Means by category and overall (category null), without excluded categories."""
    t = scores.where(~F.col(category).isin(*exclude)) if exclude else scores
    return t.rollup(category).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def compare(base: DataFrame, new: DataFrame, metrics: list[str], key: str = "category") -> DataFrame:
    """new - base of every metric, by category."""
    b = base.select(F.col(key).alias("k"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    return new.join(b, F.col(key).eqNullSafe(F.col("k"))).select(key, *[(F.col(m) - F.col(f"b_{m}")).alias(f"delta_{m}") for m in metrics])


def durations(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, p50 and p95."""
    v = F.col(value).cast("double")
    return rows.groupBy(*(by or [])).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.95)).alias("p95"), F.count("*").alias("n")
    )


def accuracy(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.round(100 * F.avg(F.col("correct").cast("double")), 2).alias("accuracy"), F.count("*").alias("n"))


def error_types(rows: DataFrame) -> DataFrame:
    """Counts and percentages of ``error_type``; the total is one aggregated row joined back."""
    c = rows.groupBy("error_type").agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))  # one row
    return c.join(total, F.lit(True)).select("error_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))
