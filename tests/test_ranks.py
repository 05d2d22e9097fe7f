"""Ranks by ranges: equal to row_number, with ties, nulls and one hot list that no single task holds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import merge, ranks, search

ORDER = lambda: (F.desc("score"), F.col("id").asc())


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "b", None]), f"i{i:05d}", rng.choice([0.5, 0.5, rng.random()]), i) for i in range(4000)]
    return spark.createDataFrame(rows, "source string, id string, score double, extra int").repartition(5)


def test_equal_to_row_number(spark, lists):
    want = lists.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*ORDER())))
    for parts in (1, 7, 40):
        got = ranks.row_numbers(lists, ("source",), ORDER(), parts=parts)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == 4000
    assert search.ranked(lists, whole=True).exceptAll(want).isEmpty()
    assert ranks.row_numbers(lists.limit(0), ("source",), ORDER()).count() == 0


def test_a_hot_list_is_many_ranges(spark, lists):
    sizes = [r["count"] for r in ranks.ranges(lists, ("source",), ORDER(), 20).groupBy("__range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2.5 * 4000 / 20
    tied = lists.withColumn("score", F.lit(1.0)).withColumn("source", F.lit("one"))
    sizes = [r["count"] for r in ranks.ranges(tied, ("source",), ORDER(), 20).groupBy("__range").count().collect()]
    assert max(sizes) < 2.5 * 4000 / 20


def test_whole_lists_of_cubes_merge(spark, lists):
    a, b = lists.where("extra < 3000"), lists.where("extra > 1000").withColumn("score", F.col("score") / 2)
    got = merge.merge_cubes([a, b])
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 4000 and sorted(r["rank"] for r in rows.values()) == list(range(1, 4001))
    order = sorted(rows.values(), key=lambda r: (-r.score, r.id))
    assert [r["rank"] for r in order] == list(range(1, 4001)) and all(r.extra >= 3000 or r.score == s for r, s in ((rows[x.id], x.score) for x in a.collect()))
    by = merge.merge_cubes([a, b], by=("source",))
    assert by.where("source IS NULL").agg(F.max("rank")).first()[0] == lists.where("source IS NULL").count()
