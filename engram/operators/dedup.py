"""Greedy result selection: similarity dedupe and maximal marginal relevance.

Both are sequential over a bounded candidate list, so they run as one grouped Arrow
function a query.  Ties fall to the earlier candidate.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of the selection.
SIMILAR, TEXT_GATE, TEXT_SIMILAR = 0.92, 0.9, 0.92
MMR_ALPHA, MMR_SOFT = 5.0, 0.9


def cosine_matrix(vectors: list) -> np.ndarray:
    """All pairs; 0 where a vector is missing or has no length."""
    width = max((len(v) for v in vectors if v is not None), default=1)
    m = np.zeros((len(vectors), width))
    for row, v in zip(m, vectors):
        if v is not None and len(v) == width:
            row[:] = v
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    s = u @ u.T
    np.fill_diagonal(s, 1.0)
    return s


def text_similarity(a: str, b: str) -> float:
    """0.40 Dice of characters + 0.35 character TF-IDF cosine + 0.25 bigram Jaccard."""
    if not a or not b:
        return 0.0
    x, y = Counter(a), Counter(b)
    both = x.keys() & y.keys()
    dice = 2 * len(both) / (len(x) + len(y))
    idf = lambda c: 1.0 if c in both else 1.5
    length = lambda t: math.sqrt(sum((n * idf(c)) ** 2 for c, n in t.items()))
    tfidf = sum(x[c] * y[c] for c in both) / (length(x) * length(y))
    p, q = ({t[i : i + 2] for i in range(len(t) - 1)} or {t} for t in (a, b))
    return 0.40 * dice + 0.35 * tfidf + 0.25 * len(p & q) / len(p | q)


def greedy_similarity(pdf: pd.DataFrame, k: int, most: float = SIMILAR) -> pd.DataFrame:
    """By falling score, rows whose cosine with every kept row is at most ``most``, up to k."""
    pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    s = cosine_matrix(list(pdf["embedding"]))
    kept: list[int] = []
    for i in range(len(pdf)):
        if len(kept) >= k:
            break
        if all(s[i, j] <= most for j in kept):
            kept.append(i)
    return pdf.iloc[kept]


def _near_text(i: int, chosen: list[int], s: np.ndarray, texts: list[str]) -> bool:
    if not chosen:
        return False
    j = max(chosen, key=lambda c: s[i, c])
    return s[i, j] > TEXT_GATE and any(s[i, c] > TEXT_GATE and text_similarity(texts[i], texts[c]) >= TEXT_SIMILAR for c in chosen)


def mmr(pdf: pd.DataFrame, text_k: int, pref_k: int, query: list[float] | None, lam: float = 0.7) -> pd.DataFrame:
    """Maximal marginal relevance over (id, memory, kind, bucket, score, embedding).

    ``kind`` is 'text' or 'pref'; every bucket of a kind has its own cap.  Two rows are
    prefilled by relevance; then lambda x relevance - (1 - lambda) x diversity decides,
    where a cosine above 0.9 is punished exponentially.  Selected rows are returned by
    score.
    """
    pdf = pdf.reset_index(drop=True)
    n = len(pdf)
    if n <= 1:
        return pdf
    vectors, scores = list(pdf["embedding"]), pdf["score"].tolist()
    s = cosine_matrix(vectors)
    texts = [(t or "").strip() for t in pdf["memory"]]
    kinds, buckets = pdf["kind"].tolist(), pdf["bucket"].tolist()
    relevance = list(scores)
    if query is not None and len(query):
        q = np.asarray(query, float)
        for i, v in enumerate(vectors):
            if v is not None and len(v) == len(q):
                length = np.linalg.norm(v) * np.linalg.norm(q)
                relevance[i] = ((float(np.dot(v, q)) / length if length else 0.0) + 1) / 2
    cap = {"text": text_k, "pref": pref_k}
    used: Counter = Counter()
    chosen: list[int] = []
    seen: set[str] = set()

    def select(i: int) -> None:
        if used[kinds[i], buckets[i]] < cap[kinds[i]]:
            used[kinds[i], buckets[i]] += 1
            chosen.append(i)
            seen.add(texts[i])

    prefill = min(2, text_k) if "pref" not in kinds else min(2, text_k, pref_k)
    for i in sorted(range(n), key=lambda i: -relevance[i]):
        if len(chosen) >= prefill:
            break
        if texts[i] not in seen and not _near_text(i, chosen, s, texts):
            select(i)
    left = [i for i in range(n) if i not in chosen]
    while left:
        best, best_score = None, -math.inf
        for i in left:
            if used[kinds[i], buckets[i]] >= cap[kinds[i]] or texts[i] in seen or _near_text(i, chosen, s, texts):
                continue
            near = max([0.0, *(float(s[i, j]) for j in chosen)])
            diversity = near * math.exp(MMR_ALPHA * (near - MMR_SOFT)) if near > MMR_SOFT else near
            value = lam * relevance[i] - (1 - lam) * diversity
            if value > best_score:
                best, best_score = i, value
        if best is None:
            break
        select(best)
        left.remove(best)
    order = sorted(chosen, key=lambda i: (kinds[i] != "text", str(buckets[i]), -scores[i], i))
    return pdf.iloc[order]


def select_by_query(candidates: DataFrame, how: str, k: int, pref_k: int = 0, query: list[float] | None = None, lam: float = 0.7) -> DataFrame:
    """Candidates (query_id, id, memory, kind, bucket, score, embedding) -> the selected rows with ``place``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy_similarity(pdf, k) if how == "sim" else mmr(pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable"), k, pref_k, query, lam)
        return out[["query_id", "id", "score"]].assign(place=range(1, len(out) + 1))

    return candidates.groupBy("query_id").applyInPandas(one, "query_id long, id string, score double, place int")
