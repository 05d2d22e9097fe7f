"""Queries on fixtures that are larger than, or unlike, the smallest tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import duck, rows_of, sql_rows
from engram.operators import dedup, graph, search
from engram.plans.adapter import CUBE, Tables


def write_tables(spark, folder, docs, vectors, lang="en", quality=1):
    """documents (doc_id, text, source), their embeddings and labels."""
    rows = [(i, t, lang, s, len(t)) for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, quality, 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def big_cube(spark, tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("cube")
    docs = [(i, f"the thing and {' '.join(rng.choice(['the', 'and', 'other', 'word']) for _ in range(12))} {i}", "src0") for i in range(1300)]
    write_tables(spark, folder, docs, enumerate(np.random.default_rng(5).normal(size=(1300, 8)) + 1), "zz", 0)  # tags that few rows share with the query
    return str(folder)


@pytest.mark.parametrize("name", ["r03_rrf", "r03_weighted_rrf", "r04_graph_merge", "b08_refresh_working"])
def test_a_cube_of_more_than_1000_rows_equals_sql(spark, big_cube, name):
    got = rows_of(entry.queries()[name](spark, big_cube))
    assert got == sql_rows(duck(big_cube), entry.oracle_sql()[name]) and len(got[1]) > 1000


def brute_entities(new, known, least):
    """(user_name, name) -> the known id of the largest cosine, the greatest id of several."""
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    out = {}
    for g, name, v in new:
        found = [(round(float(unit(v) @ unit(w)), 9), i) for h, i, w in known if g == h and g is not None and len(v) == len(w)]
        found = [x for x in found if x[0] >= least]
        out[g, name] = max(found)[1] if found else name.strip().lower()
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_entities_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    known = [(f"g{i % 3}", f"k{i}", rng.normal(size=4).tolist()) for i in range(90)] + [("g0", "twin1", [1.0, 0.0, 0.0, 0.0]), ("g0", "twin2", [2.0, 0.0, 0.0, 0.0]), (None, "nobody", [1.0, 0.0, 0.0, 0.0]), ("g1", "short", [1.0])]
    new = [(f"g{i % 4}", f" Name {i}", rng.normal(size=4).tolist()) for i in range(80)] + [("g0", "Twin", [3.0, 0.0, 0.0, 0.0]), (None, "Lost", [1.0, 0.0, 0.0, 0.0]), ("g1", "Zero", [0.0] * 4)]
    got = graph.resolve_entities(spark.createDataFrame(new, "user_name string, name string, embedding array<double>"), spark.createDataFrame(known, "user_name string, id string, embedding array<double>"), 0.8, block).collect()
    want = brute_entities(new, known, 0.8)
    assert len(got) == len(new) and {(r.user_name, r.name): r.id for r in got} == want and want["g0", "Twin"] == "twin2"
    assert all(r.merged == (r.id != r.name.strip().lower()) for r in got)


def test_entity_resolution_reads_every_row(spark, big_cube):
    rows = spark.read.parquet(f"{big_cube}/embeddings.parquet").collect()
    known = [("src0", f"m{r.vec_id}", r.embedding) for r in rows if r.vec_id % 2 == 0]
    new = [("src0", f" Name {r.vec_id}", r.embedding) for r in rows if r.vec_id % 2]
    got = entry.queries()["g10_entity_resolution"](spark, big_cube).collect()
    assert len(got) == 650 and {(r.user_name, r.name): r.id for r in got} == brute_entities(new, known, 0.2)


@pytest.fixture(scope="module")
def near_copies(spark, tmp_path_factory):
    """40 near copies of one text beside the query's vector, and 120 other texts farther away."""
    rng, folder = np.random.default_rng(9), tmp_path_factory.mktemp("copies")
    same = "the river runs along the old stone wall of the town and on to the sea, says note"
    docs, vectors = [], []
    for i in range(160):
        copy = i % 4 == 0
        docs.append((i, f"{same} {i}" if copy else " ".join(str(x) for x in rng.integers(10**9, size=12)), CUBE))
        vectors.append((i, np.eye(16)[0] + rng.normal(size=16) * (0.001 if copy else 0.5)))
    write_tables(spark, folder, docs, vectors)
    return str(folder), {f"m{i}" for i in range(0, 160, 4)}, {f"m{i}": v for i, v in vectors}


def test_full_search_drops_near_copies(spark, near_copies):
    folder, copies, _ = near_copies
    got = [r.id for r in entry.queries()["r01_full_search"](spark, folder).where("bucket = 'text'").collect()]
    assert len(got) == len(set(got)) == 10 and len(copies & set(got)) == 1


def test_search_by_similarity_and_importance(spark, near_copies):
    folder, copies, vectors = near_copies
    t = Tables(spark, folder)
    given = {"query": "the en src0 q1", "vector": tuple(t.vector()), "cubes": (CUBE,), "top_k": 10}
    run = lambda **kw: search.search(t.memory, t.edges, search.resolve_params(given | kw), F.timestamp_seconds(F.lit(1_706_745_600))).where("bucket = 'text'").collect()
    plain = run(dedup="no")
    assert len(copies & {r.id for r in plain}) > 1
    ids = [r.id for r in run(dedup="sim")]
    unit = {i: vectors[i] / np.linalg.norm(vectors[i]) for i in ids}
    assert len(ids) == 10 and all(unit[a] @ unit[b] <= 0.92 + 1e-6 for a in ids for b in ids if a < b)
    assert [r.score for r in run(dedup="no", importance=True)] != [r.score for r in plain]


def test_text_similarity_reads_whole_texts(spark, tmp_path):
    rng, head = random.Random(4), "the first sixty characters of all these texts are quite the same "
    texts = [head + "".join(rng.choice("abcdefghij klmnop") for _ in range(300)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r.similarity for r in entry.queries()["tx08_text_similarity"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: dedup.text_similarity(texts[i], texts[i + 1]) for i in range(19)}, abs=1e-6)
    assert all(v < 1 for v in got.values())
