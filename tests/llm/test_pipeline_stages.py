"""Every pipeline stage on nulls, repeated and clashing rows and empty tables; near duplicates against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components

import corpus_pipeline
from engram.llm import ngram_join

W = "the river and a stone of the field with clouds that have a house in it to be for".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, __drop string, body int, root int, c0 int"


def text(seed, n=90):
    rng = random.Random(seed)
    return " ".join(rng.choice(W) if k % 3 else f"{rng.choice(W)}{seed}x{k}" for k in range(n))


def row(i, t, extra="x"):
    return (i, t, "en", None if t is None else "s1", None if t is None else len(t), extra, extra, 1, 2, 3)


@pytest.fixture(scope="module")
def odd(spark):
    a, b, c = text(1), text(2), text(3)
    near = a.replace(a.split()[42], "edit")
    rows = [row(3, a), row(5, near), row(5, b), row(7, c), row(7, c, "y"), row(None, b + " tail"), row(None, text(4)), row(None, text(4)), row(9, None), row(9, None), row(10, ""), row(11, " \n")]
    return spark.createDataFrame(rows, DDL)


def test_one_row_of_each_group_stays(odd):
    out = ngram_join.near_duplicate_keepers(odd)
    assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
    got = sorted(((r.doc_id, (r.text or "")[:12]) for r in out.collect()), key=repr)
    a, b, c, d = (text(k)[:12] for k in (1, 2, 3, 4))
    # id 5 keeps its own text b although another row 5 is a copy of 3; of the equal rows 7 one stays; null ids yield
    assert got == sorted([(3, a), (5, b), (7, c), (None, d), (9, ""), (9, ""), (10, ""), (11, " \n")], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_keepers_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [text(100 * seed + k, rng.randint(4, 80)) for k in range(12)]
    texts = base + [" ".join(w if rng.random() > 0.02 else "edit" for w in rng.choice(base).split()) for _ in range(30)] + ["", None]
    rows = [row(rng.choice([None, *range(25)]), rng.choice(texts)) for _ in range(70)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    # brute force over unique numbers, so that ids play no part in the grouping
    groups = {n: root for n, _, root in brute_components([(n, r[1]) for n, r in enumerate(rows)])}
    best = {}
    for n, r in enumerate(rows):
        best.setdefault(groups[n], []).append((r[0] is None, r[0] or 0, r[1] or ""))
    got = ngram_join.near_duplicate_keepers(docs, block_rows=rng.choice([3, 2048])).collect()
    blank = sum(not (r[1] or "").split() for r in rows)
    kept = [(r.doc_id is None, r.doc_id or 0, r.text) for r in got if (r.text or "").split()]
    assert len(got) - len(kept) == blank
    want = [v for v in best.values() if v[0][2].split()]
    assert len(kept) == len(want)
    for v in want:
        least = min(v)[:2]
        assert sum(k[:2] == least and k in v for k in kept) >= 1


def test_passages_that_many_documents_share(spark):
    shared = " ".join(f"licence{k}" for k in range(40))
    rows = [(k, f"{shared} {text(k, 40 if k % 2 else 5)}") for k in range(120)] + [(200, shared), (201, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = ngram_join.ngram_join(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_their_contract(spark, odd, tmp_path, stage):
    spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (77, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, odd, str(tmp_path))
    if name != "packing":
        assert out.columns == odd.columns
    n = out.count()
    assert n == {"quality": n, "toxicity": odd.count(), "near_duplicates": 8, "secrets": odd.count(), "packing": n}[name]
    if name == "packing":
        assert out.groupBy("doc_id").count().count() == odd.select("doc_id").distinct().count()
    if name == "quality":
        assert out.where(F.col("text").isNull()).count() == 0
    assert run(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
