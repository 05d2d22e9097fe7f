"""The memory tree and the periodic cycle: repeated rounds, new rows, lost rows; mutations that meet repeated ids; two writers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import graph, hierarchy, maintain, store
from engram.schema import EDGES, MEMORY



def at():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def cluster_rows(centres, start=0, cube="c", level="raw", kind="LongTermMemory", spread=0.05, seed=3):
    """Rows around unit vectors, numbered from ``start``."""
    rng = np.random.default_rng(seed)
    out = []
    for k, c in enumerate(centres):
        v = np.zeros(8)
        v[c] = 1
        v = v + rng.normal(size=8) * spread
        out.append((f"r{start + k:03d}", cube, "x" * (5 + k), kind, "activated", level, [float(x) for x in v]))
    return out


def tables(spark, rows):
    m = spark.createDataFrame(rows, "id string, user_name string, memory string, memory_type string, status string, hierarchy_level string, embedding array<float>")
    full = spark.createDataFrame([], MEMORY)
    return full.unionByName(m, allowMissingColumns=True), spark.createDataFrame([], EDGES)


def state(m, e):
    rows = sorted((r.id, r.status, r.hierarchy_level, r.parent_memory_id or "") for r in m.collect())
    links = sorted((r.from_id, r.to_id) for r in graph.live(e).where(F.col("relation") == hierarchy.RELATION).collect())
    return rows, links


def check_whole(m, e):
    """Parents exist and are active, edges and pointers agree, no id repeats."""
    rows, links = state(m, e)
    assert len({r[0] for r in rows}) == len(rows)
    active = {r[0]: r for r in rows if r[1] == "activated"}
    assert all(a in active and b in active for a, b in links)
    assert sorted((r[0], r[3]) for r in active.values() if r[3]) == links


def test_second_round_changes_nothing_and_new_rows_join(spark):
    m, e = tables(spark, cluster_rows([0, 0, 0, 1, 1, 1, 1, 2, 2]))
    m, e, audit = hierarchy.grow(m, e, at())
    assert sorted(r.n_children for r in audit.collect()) == [3, 4]
    check_whole(m, e)
    m2, e2, audit2 = hierarchy.grow(m, e, at())
    assert state(m2, e2) == state(m, e) and audit2.count() == 0
    # one more row joins a parent, another makes two rows a cluster
    more, _ = tables(spark, cluster_rows([0, 2], start=50, seed=8))
    m3, e3, audit3 = hierarchy.grow(m2.unionByName(more), e2, at())
    check_whole(m3, e3)
    assert sorted(r.n_children for r in audit3.collect()) == [3, 4]
    parents = {r[0]: r[3] for r in state(m3, e3)[0] if r[3]}
    assert parents["r050"] == parents["r000"] and parents["r051"] == parents["r007"] == parents["r008"]
    # as one round over all rows would have it
    whole, none = tables(spark, cluster_rows([0, 0, 0, 1, 1, 1, 1, 2, 2]) + cluster_rows([0, 2], start=50, seed=8))
    w, we, _ = hierarchy.grow(whole, none, at())
    groups = lambda m: sorted(sorted(r.id for r in m.collect() if r.parent_memory_id == p) for p in {r.parent_memory_id for r in m.collect()} - {None})
    assert groups(m3) == groups(w)


def test_a_row_between_two_clusters_merges_them(spark):
    m, e = tables(spark, cluster_rows([0, 0, 0, 1, 1, 1]))
    m, e, _ = hierarchy.grow(m, e, at(), least=0.6)
    assert len({r[3] for r in state(m, e)[0] if r[3]}) == 2
    bridge = [("r900", "c", "bridge", "LongTermMemory", "activated", "raw", [1.0, 1.0] + [0.0] * 6)]
    m, e, audit = hierarchy.grow(m.unionByName(tables(spark, bridge)[0]), e, at(), least=0.6)
    check_whole(m, e)
    (row,) = audit.collect()
    assert row.n_children == 7 and [r[1] for r in state(m, e)[0] if r[0].startswith("p")].count("archived") == 1


def test_a_cluster_that_lost_a_row_is_made_anew(spark):
    m, e = tables(spark, cluster_rows([0, 0, 0, 0, 1, 1, 1]))
    m, e, _ = hierarchy.grow(m, e, at())
    m, e, audit = hierarchy.grow(m.where("id NOT IN ('r000', 'r004')"), e, at())
    check_whole(m, e)
    assert [r.n_children for r in audit.collect()] == [3]  # three of four are a cluster still, two of three none
    rows = {r[0]: r for r in state(m, e)[0]}
    assert rows["r005"][3] == rows["r006"][3] == "" and [r[1] for r in rows.values()].count("archived") == 2
    again = hierarchy.grow(m, e, at())
    assert state(*again[:2]) == state(m, e)


def test_other_cubes_types_and_nulls_stay_out(spark):
    rows = cluster_rows([0, 0, 0]) + cluster_rows([0, 0], start=10, cube="d") + cluster_rows([0], start=20, kind="PreferenceMemory") + [("r030", None, "t", "LongTermMemory", "activated", None, [1.0] + [0.0] * 7), ("r031", "c", None, "LongTermMemory", "activated", None, None)]
    m, e, audit = hierarchy.grow(*tables(spark, rows), at())
    assert [r.n_children for r in audit.collect()] == [3]
    check_whole(m, e)
    m, e, audit = hierarchy.grow(*tables(spark, []), at())
    assert m.count() == 0 and audit.count() == 0


def test_cycle_twice(spark):
    rows = cluster_rows([0, 0, 0, 0], spread=0.12) + cluster_rows([1, 1, 1], start=10, spread=0.12) + cluster_rows([3, 3], start=20, spread=0.001)
    rows += [(f"w{i:03d}", "c", f"working {i}", "WorkingMemory", "activated", None, [0.0] * 5 + [1.0, 0.1 * (i % 3), 0.0]) for i in range(55)]
    m, e = tables(spark, rows)
    m = m.withColumn("updated_at", F.timestamp_seconds(F.lit(1_600_000_000)))
    tiers = {"raw": (0.7, 3), "episodic": (0.6, 2)}
    m1, e1 = maintain.cycle(m, e, at(), 0.9, tiers)
    check_whole(m1, e1)
    got = {r.id: r for r in m1.collect()}
    assert sum(r.hierarchy_level == "episodic" for r in got.values()) >= 2
    assert sum(r.status == "merged" for r in got.values()) >= 1
    (made,) = [r for r in got.values() if r.id.startswith("c")]
    assert made.embedding is not None and made.updated_at is not None and made.memory.startswith("working 0\n")
    m2, e2 = maintain.cycle(m1, e1, at(), 0.9, tiers)
    assert state(m2, e2) == state(m1, e1)
    assert sorted(m2.columns) == sorted(m1.columns)


def test_repeated_ids_change_a_row_once(spark):
    m, _ = tables(spark, cluster_rows([0, 1]))
    ch = spark.createDataFrame([("r000", "b", 1), ("r000", "a", 2), ("r000", None, 3), (None, "x", 1), ("none", "y", 1)], "id string, memory string, pos int")
    got = {r.id: r.memory for r in store.update_rows(m, ch, at()).collect()}
    assert got == {"r000": "a", "r001": "xxxxxx"}
    assert {r.id: r.memory for r in store.update_rows(m, ch.drop("pos"), at()).collect()}["r000"] == "b"
    merged = spark.createDataFrame([("r000", "r001"), ("r000", "r009")], "id string, into_id string")
    once = store.soft_merge(m, merged, at())
    twice = store.soft_merge(once, spark.createDataFrame([("r001", "r009")], "id string, into_id string"), at())
    assert {r.id: (r.status, r.merged_into_id) for r in twice.collect()} == {"r000": ("merged", "r001"), "r001": ("merged", "r009")}
    levels = spark.createDataFrame([("r000", "raw", "p1")], "id string, level string, parent_id string")
    up = store.set_hierarchy(store.set_hierarchy(m, levels), spark.createDataFrame([("r001", "raw", "p2")], "id string, level string, parent_id string"))
    assert {r.id: r.parent_memory_id for r in up.collect()} == {"r000": "p1", "r001": "p2"}


def test_feedback_rows_have_a_cube(spark):
    m, _ = tables(spark, cluster_rows([0, 1]))
    ops = spark.createDataFrame([("ADD", None, "new", "c"), ("add", None, "new", "c"), ("ADD", None, "new", "d"), ("UPDATE", "r000", "u1", None), ("UPDATE", "r000", "u2", None), ("NONE", "r001", "n", None)], "op string, id string, memory string, user_name string")
    got = store.feedback_ops(m, ops, at())
    assert sorted((r.user_name, r.memory) for r in got.collect()) == [("c", "new"), ("c", "u2"), ("c", "xxxxxx"), ("d", "new")]
    assert store.feedback_ops(got, ops, at()).count() == 4
    assert store.feedback_ops(m, ops.drop("user_name"), at(), cube="e").where("user_name = 'e'").count() == 1
    with pytest.raises(Exception, match="needs a cube"):
        store.feedback_ops(m, ops.drop("user_name"), at()).collect()


def test_one_of_two_writers_wins(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "t"))
    s.write(spark.range(3))
    base = s.version()
    one, two = spark.range(4), spark.range(5)
    assert s.write(one, base=base) == 1
    with pytest.raises(FileExistsError):
        s.write(two, base=base)  # it began from the same version
    assert s.version() == 1 and s.read().count() == 4
    assert s.write(two) == 2 and s.read().count() == 5 and s.read(1).count() == 4


def test_a_commit_that_crashed_is_left_out(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "t"))
    s.write(spark.range(3))
    marker = tmp_path / "t" / "WHOLE-000000000001"
    marker.touch()
    with pytest.raises(FileExistsError):  # another writer may be at it just now
        s.write(spark.range(4))
    import os

    os.utime(marker, (1, 1))
    assert s.version() == 0 and s.write(spark.range(4)) == 2 and s.read().count() == 4
