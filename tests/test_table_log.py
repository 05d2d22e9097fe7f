"""The change log: equal to full rewrites, racing writers, crashes between steps, compaction."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import tablelog

DDL = "id string, n int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def rows_of(log, version=None):
    return sorted(tuple(r) for r in log.read(version).collect())


def test_random_changes_equal_a_dict(spark, tmp_path):
    rng, log, want = random.Random(2), tablelog.TableLog(spark, str(tmp_path / "t"), schema=DDL), {}
    assert rows_of(log) == [] and log.version() == -1
    history = []
    for step in range(9):
        ids = [f"i{rng.randrange(30):02d}" for _ in range(8)]
        if step % 3 == 2:
            log.delete(frame(spark, [(i, 0, "") for i in ids] + [(None, 0, "")]))
            want = {k: v for k, v in want.items() if k not in ids}
        else:
            rows = [(i, step * 100 + k, "t") for k, i in enumerate(ids)]
            log.upsert(frame(spark, rows + [(None, 1, "lost")]), order=F.col("n"))  # repeated keys: the last wins
            want |= {i: (i, n, t) for i, n, t in rows}
        assert rows_of(log) == sorted(want.values())
        history.append(sorted(want.values()))
        if step == 5:
            log.compact()
            assert rows_of(log) == history[-1] and len(log.manifest()) == 1
            history.append(history[-1])
    assert [rows_of(log, v) for v in range(len(history))] == history  # old versions stay readable
    assert log.compact_if_needed(3) and not log.compact_if_needed(3) and rows_of(log) == history[-1]
    assert log.clean(log.version()) > 0 and rows_of(log) == history[-1]


def test_racing_writers(spark, tmp_path):
    log = tablelog.TableLog(spark, str(tmp_path / "t"))
    log.append(frame(spark, [(f"i{k}", k, "") for k in range(6)]))
    other = tablelog.TableLog(spark, str(tmp_path / "t"))
    base = log.version()
    other.upsert(frame(spark, [("i1", 100, "other")]), base)
    log.upsert(frame(spark, [("i2", 200, "mine")]), base)  # other keys: rebased
    assert rows_of(log)[1:3] == [("i1", 100, "other"), ("i2", 200, "mine")]
    before = rows_of(log)
    with pytest.raises(tablelog.Conflict):
        log.upsert(frame(spark, [("i1", 1, "late")]), base)
    with pytest.raises(tablelog.Conflict):
        log.delete(frame(spark, [("i2", 0, "")]), base + 1)
    assert rows_of(log) == before


def test_a_change_is_worked_out_anew_after_a_conflict(spark, tmp_path):
    log = tablelog.TableLog(spark, str(tmp_path / "t"))
    log.append(frame(spark, [("a", 1, ""), ("b", 1, "")]))
    calls = []

    def work(t):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between reading and writing
            tablelog.TableLog(spark, log.root).upsert(frame(spark, [("a", 10, "other")]))
        return t.where("id = 'a'").withColumn("n", F.col("n") + 1)

    log.change(work)
    assert len(calls) == 2 and rows_of(log) == [("a", 11, "other"), ("b", 1, "")]


@pytest.mark.parametrize("step", ["files", "manifest"])
def test_a_crash_changes_nothing(spark, tmp_path, monkeypatch, step):
    log = tablelog.TableLog(spark, str(tmp_path / "t"))
    log.append(frame(spark, [("a", 1, "")]))

    def crash(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "files":
            m.setattr(log, "manifest", crash)
        else:
            m.setattr(log.versions, "write", crash)
        with pytest.raises(OSError):
            log.upsert(frame(spark, [("a", 2, ""), ("b", 2, "")]))
    assert rows_of(log) == [("a", 1, "")] and log.version() == 0
    log.upsert(frame(spark, [("a", 3, "")]))
    assert rows_of(log) == [("a", 3, "")]
