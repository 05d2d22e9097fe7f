"""Hard negatives, licence scan and divergence audit: brute force, edge cases, SQL on the given tables."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck, rows_of, sql_rows

from engram.llm import divergence, hard_negatives, license_scan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i % 97} the and of" for i in range(8000))


def out(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_license_scan", "op13_divergence"])
def test_query_equals_sql(spark, name):
    from engram.llm import queries

    assert rows_of(queries.queries()[name](spark, SF)) == sql_rows(duck(SF), queries.oracle_sql()[name])


# -- hard negatives ----------------------------------------------------------


def brute_mine(rows, m=hard_negatives.Mining()):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in one or (label, v) < one[i]:
            one[i] = (label, v)
    t = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    found = []
    for a in t:
        if a % m.anchor_every:
            continue
        score = {b: sum(x * y for x, y in zip(t[a][1], t[b][1])) for b in t if b != a}
        best = sorted((b for b in score if t[b][0] == t[a][0]), key=lambda b: (-score[b], b))[: m.positives]
        for p in best:
            low = sorted((b for b in score if t[b][0] != t[a][0] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]), key=lambda b: (-score[b], b))
            found += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(low[: m.negatives])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("blocks", [{}, {"row_values": 200, "anchor_values": 16, "least_rows": 1}])
def test_hard_negatives_equal_brute_force(spark, blocks):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, 0.2), 2) for x in base[rng.randrange(6)]], 0 if rng.random() < 0.4 else rng.randrange(10)) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1], i % 10) for i in range(60)]  # ties
    rows += [(None, [1.0] * 8, 1), (800, None, 1), (900, [1.0] * 8, None), (1000, [math.nan] * 8, 1), (1100, [math.inf] + [0.0] * 7, 1), (1200, [None] + [0.0] * 7, 1)]
    rows += [(1300, [], 2), (1301, [1.0, 2.0], 2), (1400, [0.0] * 8, 3), (100, rows[100][1], rows[100][2]), (200, [9.0] * 8, 9)]  # short and repeated
    t = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, side string").repartition(5)
    names = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    got = hard_negatives.mine(t, hard_negatives.contract_label(), **blocks)
    assert out(got, *names) == brute_mine(rows)
    assert out(got, *names)
    assert hard_negatives.mine(t.limit(0)).count() == 0


def test_scores_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    x = np.array([[2.0**20 + 1, 5.0], [2.0, 2.0]])
    assert hard_negatives.scores_of(a, x).tolist() == [[2**40 * (2**20 + 1) + 15, 2**41 + 6], [2**20 + 6, 4]]
    with pytest.raises(OverflowError):
        hard_negatives.scores_of(np.array([[2.0**62]]), np.array([[4.0]]))


# -- licences ------------------------------------------------------------------


def brute_scan(text, templates=license_scan.TEMPLATES, phrases=license_scan.PHRASES):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {label for _, label in base}, 0.0
    for label, t in templates:
        own, step = set(t.split()), license_scan.step_of(len(t.split()))
        for start in range(0, len(words), step):
            n = len(own & set(words[start : start + 2 * step]))
            if 100 * n >= 85 * len(own):
                labels.add(label)
                best = max(best, n / len(own))
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best


NOTICES = [t for _, t in license_scan.TEMPLATES]


def licence_texts():
    rng = random.Random(5)
    filler = "river stone the of and licensed under license copyright software free this any to".split()
    texts = [None, "", " \n\t", "CC BY cc-by CC  BY\ncc", "all rights reserved", "All rights reserved. ALL RIGHTS RESERVED!", "ÄLL rights reserved", LONG, LONG + " Released under the MIT License."]
    for notice in NOTICES:
        words = notice.split()
        for lost in (0, 1, 2, 3, 5):  # words missing, in running text, over line ends
            kept = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), min(lost, len(words)))]
            around = [[rng.choice(filler) for _ in range(rng.randrange(40))] for _ in range(2)]
            texts.append(" ".join(around[0]) + ".\n" + "\n".join(kept).title() + "; " + " ".join(around[1]))
    return texts


def test_licences_equal_brute_force(spark):
    texts = licence_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "released under the mit license", "x", 1)]
    t = spark.createDataFrame(rows, "doc_id long, text string, labels string, row int").repartition(3)
    names = "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    got = out(license_scan.scan(t), *names)
    assert got == sorted(((i, *brute_scan(x)) for i, x, _, _ in rows), key=repr)
    assert license_scan.scan(t.limit(0)).count() == 0
    found = {label for r in got for label in r[6].split(",")}
    assert {label for label, _ in license_scan.TEMPLATES} <= found


def test_word_order_changes_no_result():
    """The filters lose nothing, whatever the corpus frequencies are."""
    texts = [t for t in licence_texts() if t]
    rng = random.Random(1)
    words = sorted({w for t in NOTICES for w in license_scan.words_of(t.encode())})
    for _ in range(3):
        known = license_scan.ordered(license_scan.TEMPLATES, {w: rng.randrange(50) for w in words})
        for text in texts:
            blocks = {(step, start): set(own) for step, start, own in license_scan.candidate_blocks(license_scan.words_of(text.encode()), known)}
            all_words = license_scan.words_of(text.encode())
            for t in known.rows:
                for start in range(0, len(all_words), t.step):
                    n = len(set(t.words) & {known.order[w] for w in all_words[start : start + 2 * t.step] if w in known.order})
                    if n >= t.needs:
                        assert (t.step, start) in blocks


def test_template_broadcast_is_bounded(spark, monkeypatch):
    t = spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string")
    monkeypatch.setattr(license_scan, "MOST_TEMPLATES", 1)
    assert license_scan.scan(t).first().labels == "mit"


# -- divergence ------------------------------------------------------------------


def brute_audit(rows, least=3, ranks=200):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), lang or "", src or "") for t, lang, src in rows]
    found = []
    for lang in {x[1] for x in docs}:
        own = [x for x in docs if x[1] == lang]
        df = Counter(w for ws, _, _ in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for ws, _, s in own:
            counts[s].update(w for w in ws if df[w] >= least)
        total = {s: sum(c.values()) for s, c in counts.items()}
        share = lambda n, t: 1 + 1_000_000_000 * (n + 1) // (t + len(kept))
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        for s in counts:
            lists = {"pair": [(i, sum((p - q) ** 2 // q for w in kept for p, q in ((share(counts[s][w], total[s]), share(counts[i][w], total[i])),))) for i in counts if i != s], "term": []}
            for w in kept:
                p, q = share(counts[s][w], total[s]), share(whole[w], sum(total.values()))
                if counts[s][w] and p > q:
                    lists["term"].append((w, (p - q) ** 2 // q))
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < ranks]
    return sorted(found, key=repr)


def divergence_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "kä lo MI Ne" .split() for b in "ra st ßo né 日本 x y".split()]
    rows = [(" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(30))), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}") for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("one two", "fr", None), ("one", "fr", "b"), ("same same same", "it", "x"), ("same", "it", "x"), ("Same!", "it", "y"), (LONG, "en", "s1"), (LONG, "en", "s1")]
    return rows


@pytest.mark.parametrize("few", [100_000, 0])
def test_divergence_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    rows = divergence_rows()
    t = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    got = divergence.audit(t)
    assert out(got, "lang", "source", "part", "item", "value", "rank") == brute_audit(rows)
    assert divergence.audit(t.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(c := rng.randrange(10**k), c + rng.randrange(1, 10**k)) for k in range(1, 16) for _ in range(20)]
    t = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in t.collect())
