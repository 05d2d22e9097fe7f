"""Score expressions: decay, importance, boosts, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the retrieval model.
SEMANTIC_WEIGHT, RECENCY_WEIGHT = 0.75, 0.25
DECAY_ALPHA, MAX_AGE_DAYS = 0.0039, 730.0
IMPORTANCE_CAP = 5.0
TIER_BOOST = {"semantic": 1.15, "episodic": 1.08}
PAGERANK_WEIGHT = 0.1
RRF_K = 60
KEY_SCORE, TAG_BASE, TAG_STEP = 0.85, 0.70, 0.05
CONTRADICTION_PENALTY = 0.30
HOP_DECAY = 0.8


def half_life_alpha(days: float) -> float:
    """The decay rate with which a score halves in ``days``."""
    import math

    return math.log(2) / days


def age_days(ref: Column, as_of: Column) -> Column:
    return F.greatest((as_of.cast("double") - ref.cast("double")) / 86400.0, F.lit(0.0))


def recency(days: Column, alpha: float = DECAY_ALPHA) -> Column:
    return F.when(days <= MAX_AGE_DAYS, F.exp(-alpha * days)).otherwise(0.0)


def decay(rel: Column, ref: Column, as_of: Column, memory_type: Column, alpha: float = DECAY_ALPHA) -> Column:
    """0.75 relativity + 0.25 recency; working memory and rows without a time stay as they are."""
    mixed = SEMANTIC_WEIGHT * rel + RECENCY_WEIGHT * recency(age_days(ref, as_of), alpha)
    return F.when((memory_type == "WorkingMemory") | ref.isNull(), rel).otherwise(mixed)


def importance(access_count: Column) -> Column:
    return F.least(F.lit(IMPORTANCE_CAP), 1 + F.log1p(F.greatest(F.coalesce(access_count, F.lit(0)), F.lit(0)).cast("double")))


def tier_boost(level: Column) -> Column:
    return F.when(level == "semantic", TIER_BOOST["semantic"]).when(level == "episodic", TIER_BOOST["episodic"]).otherwise(1.0)


def pagerank_boost(pr: Column, weight: float = PAGERANK_WEIGHT) -> Column:
    return F.when(pr > 0, 1 + pr * weight).otherwise(1.0)


def importance_decay(rel: Column, ref: Column, as_of: Column, access: Column, level: Column, pr: Column, memory_type: Column, alpha: float = DECAY_ALPHA) -> Column:
    """min(1, relativity x recency x importance x tier x pagerank)."""
    full = rel * recency(age_days(ref, as_of), alpha) * importance(access) * tier_boost(level) * pagerank_boost(pr)
    return F.when((memory_type == "WorkingMemory") | ref.isNull(), rel).otherwise(F.least(F.lit(1.0), full))


def working_memory_score(cos: Column) -> Column:
    """(cos + 1) / 2 up to 0.92; 0.80 without a vector."""
    return F.coalesce(F.least((cos + 1) / 2, F.lit(0.92)), F.lit(0.80))


def tag_score(overlap: Column) -> Column:
    return F.least(F.lit(KEY_SCORE), TAG_BASE + TAG_STEP * overlap)


def rerank_gate(n: Column, top: Column, bottom: Column) -> Column:
    """Which rerank the score spread asks for."""
    spread = top - bottom
    return (
        F.when(n < 4, "too-few").when(top > 0.93, "high-confidence").when(spread < 0.05, "clustered").when(spread > 0.25, "wide-spread").otherwise("medium-spread")
    )


def retry_delay_seconds(retries: Column) -> Column:
    """5 s doubled by each retry, 300 s at most."""
    return F.least(F.lit(300.0), 5.0 * F.pow(F.lit(2.0), F.least(retries.cast("double"), F.lit(20.0)))).cast("long")
