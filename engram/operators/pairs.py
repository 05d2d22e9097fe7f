"""Vector pair joins: all pairs above a cosine, top-k neighbours of each row, and the nearest row of another table.

The result is exact.  A group (tenant) that fits a block is one task.  A larger one is
cut by pivots: every row goes to its nearest pivot, and the rows of a pivot are cut
into rings by their angle to it.  Angles obey the triangle inequality, so two rings
whose angles to their pivots, and the angle between the pivots, put them further
apart than the wanted cosine are never brought together; of two rings that may meet,
only the rows that can reach the other ring are copied.  The rings of a group are put
into ``LOTS`` lots (more, where a lot would not fit into a task), and a task has one
pair of lots: a row is copied once a lot that it can reach, not once a ring, so the
copies grow with the rows.  Inside a task rings are multiplied as matrices, a tile at a
time, and those that are too far apart are skipped; a hot tenant becomes many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.session import materialize

#: Rows of a block, about: a ring may hold up to twice as many.
BLOCK = 4096
#: Lots of a large group, and the components of a lot's vectors above which it has more.
LOTS, LOT_VALUES = 16, 1 << 22
#: Rows and columns of a tile of scores.
TILE = 2048, 4096
#: Pivots at most, and components of the sample that they are fitted on.
PIVOTS, SAMPLE_VALUES = 256, 1 << 21
#: Rows that share an angle bucket of this width, in radians, are split by their hash.
BUCKET = 1 / 256
#: Slack for angles of rounded cosines.
EPS = 1e-6
#: Pivot numbers of rows without a direction, and of groups that fit a block; their rings meet whatever they may.
NO_DIRECTION, SMALL = -1, -2
_WIDE = 10.0


# -- geometry -----------------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit_pivots(rows: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    """At most ``n`` unit vectors: k-means of a bounded sample of rows(id, v), the ones of least id hash.

    Pivots decide how much is pruned, never what is found.  They have the most common
    length of the vectors; rows of another length count as without direction.
    """
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = max(1, lengths.d if lengths else 1)
    some = rows.where(F.size("v") == dim).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(n, SAMPLE_VALUES // dim)).select("v").toArrow()
    x = _unit(np.array(some.column("v").to_pylist(), np.float64).reshape(some.num_rows, -1))
    x = np.unique(x[np.linalg.norm(x, axis=1) > 0], axis=0)
    if len(x) <= n:
        return x
    rng = np.random.default_rng(seed)
    points = x[[rng.integers(len(x))]]
    far = 1 - x @ points[0]
    for _ in range(n - 1):  # spread: the next one is far from all others, with a chance by its distance
        p = np.maximum(far, 0) / np.maximum(far, 0).sum() if (far > 1e-12).any() else None
        points = np.vstack([points, x[rng.choice(len(x), p=p)]])
        far = np.minimum(far, 1 - x @ points[-1])
    for _ in range(8):
        near = (x @ points.T).argmax(1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, x)
        points = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, points)
        points = _unit(points)
    return points


def _placed(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """rows(grp, id, v, large) with the nearest ``pivot`` and the ``angle`` to it, for rows of large groups."""

    def run(batches):
        for b in batches:
            pivot, angle = np.full(b.num_rows, SMALL, np.int32), np.zeros(b.num_rows)
            at = np.flatnonzero(b.column("large").to_numpy(zero_copy_only=False))
            if len(at):
                width = points.shape[1]
                x = np.array([v if len(v) == width else [0.0] * width for v in b.column("v").take(pa.array(at)).to_pylist()], np.float64).reshape(len(at), width)
                x = _unit(x)
                cos = x @ points.T if points.size else np.zeros((len(at), 1))
                best = cos.argmax(1)
                none = ~x.any(1)
                pivot[at] = np.where(none, NO_DIRECTION, best)
                angle[at] = np.where(none, 0.0, np.arccos(np.clip(cos[np.arange(len(at)), best], -1, 1)))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("v"), pa.array(pivot), pa.array(angle)], names=["grp", "id", "v", "pivot", "angle"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("grp", "id", "v", "large").mapInArrow(run, f"grp string, id string, v {kind}, pivot int, angle double")


def _rings(placed: DataFrame, block: int, tag: str) -> DataFrame:
    """(grp, ring, id, v, pivot, angle): cells of rows by pivot, cut by the angle into rings of about ``block`` rows.

    The cuts come from counts of angle buckets, so no cell passes through one task; a
    bucket that alone is larger than a block is split by the rows' hash.
    """
    bucket = F.floor(F.col("angle") / BUCKET).cast("int")
    counts = placed.groupBy("grp", "pivot", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("grp", "pivot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.withColumn("cut", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / block)).withColumn("parts", F.ceil(F.col("n") / block))
    t = placed.withColumn("bucket", bucket).join(cuts.select("grp", "pivot", "bucket", "cut", "parts"), ["grp", "pivot", "bucket"])
    ring = F.struct("pivot", F.col("cut").alias("cut"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    return materialize(t.select("grp", ring.alias("ring"), "id", "v", "pivot", "angle"), tag)


def _bounds(rings: DataFrame, width: int) -> DataFrame:
    """(grp, ring, pivot, low, high, lot, number): the angles that a ring spans, its lot and its number in the group.

    A group has a ring for about a block of its rows, so its rings are few.
    """
    wide = F.col("pivot") < 0
    b = rings.groupBy("grp", "ring", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    order = Window.partitionBy("grp").orderBy("ring")
    every = F.sum("n").over(Window.partitionBy("grp"))
    lots = F.greatest(F.lit(LOTS), F.ceil(every * width / LOT_VALUES))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("lot", F.floor(before * lots / every).cast("int")).withColumn("number", F.row_number().over(order))
    return b.select("grp", "ring", "pivot", F.when(wide, -_WIDE).otherwise(F.col("low")).alias("low"), F.when(wide, _WIDE).otherwise(F.col("high")).alias("high"), "lot", "number")


def _between(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """(p, q, between): the angles between all pivots; rows without a direction are near all, small groups near themselves."""
    angles = np.arccos(np.clip(points @ points.T, -1, 1)) if points.size else np.zeros((len(points), len(points)))
    k = len(points)
    out = [(p, q, float(angles[p, q])) for p in range(k) for q in range(k)] + [(NO_DIRECTION, q, 0.0) for q in range(-1, k)] + [(p, NO_DIRECTION, 0.0) for p in range(k)] + [(SMALL, SMALL, 0.0)]
    return rows.sparkSession.createDataFrame(out, "p int, q int, between double")


def _apart(x_low: Column, x_high: Column, y_low: Column, y_high: Column, between: Column) -> Column:
    """The least angle between a row with angle [x_low, x_high] to its pivot and one with [y_low, y_high] to another pivot."""
    return F.greatest(between - x_high - y_high, x_low - y_high - between, y_low - x_high - between)


def _meeting(a: DataFrame, b: DataFrame, between: DataFrame) -> DataFrame:
    """Pairs of rings that may hold a wanted pair.  ``a`` has a ``reach`` a ring: the angle that its rows look as far as.

    Cells (all rings of a pivot) are compared first, so rings meet only inside cells that do.
    """
    cell = ["grp", "pivot"]
    ca = a.groupBy(*cell).agg(F.min("low").alias("a_low"), F.max("high").alias("a_high"), F.max("reach").alias("cell_reach")).withColumnRenamed("pivot", "p")
    cb = b.groupBy(*cell).agg(F.min("low").alias("b_low"), F.max("high").alias("b_high")).withColumnRenamed("pivot", "q")
    near = ca.join(cb, "grp").join(F.broadcast(between), ["p", "q"])  # (PIVOTS + 1)^2 rows of numbers
    near = near.where(_apart(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"), F.col("between")) <= F.col("cell_reach")).select("grp", "p", "q", "between")
    ra = a.select("grp", F.col("pivot").alias("p"), F.col("ring").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), "reach", F.col("lot").alias("lot_a"), F.col("number").alias("number_a"))
    rb = b.select("grp", F.col("pivot").alias("q"), F.col("ring").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("lot").alias("lot_b"), F.col("number").alias("number_b"))
    t = near.join(ra, ["grp", "p"]).join(rb, ["grp", "q"])
    return t.where(_apart(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"), F.col("between")) <= F.col("reach"))


def _copies(rows: DataFrame, meets: DataFrame) -> DataFrame:
    """(grp, a, b, side, id, v, number, pivot, angle): a copy of a row for each pair of lots with a ring of ``meets`` that it can reach.

    ``rows`` may have a ``reach`` of their own, which holds where the row looks for others (side 0).
    """
    own = F.coalesce(F.col("own_reach"), F.lit(math.inf)) if "own_reach" in rows.columns else F.lit(math.inf)
    least = lambda x: F.when(x["side"] == 0, F.least(own, x["reach"])).otherwise(x["reach"])
    near = lambda x: (F.col("pivot") < 0) | (_apart(F.col("angle"), F.col("angle"), x["low"], x["high"], x["between"]) <= least(x))
    lots = F.array_distinct(F.transform(F.filter("meets", near), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["side"].alias("side"))))
    t = rows.join(meets, ["grp", "ring"])
    return t.select("grp", F.explode(lots).alias("lot"), "id", "v", "number", "pivot", "angle").select("grp", "lot.a", "lot.b", "lot.side", "id", "v", "number", "pivot", "angle")


def _dealt(rows_a: DataFrame, rows_b: DataFrame, meeting: DataFrame, symmetric: bool) -> DataFrame:
    """Both sides' copies for the pairs of lots that hold meeting rings.

    Where the two tables are one (``symmetric``), a row is sent to a pair of lots once,
    and a lot that meets itself has one side.
    """
    same = F.lit(symmetric) & (F.col("lot_a") == F.col("lot_b"))

    def meets(ring: str, number: str, other: str, side: Column) -> DataFrame:
        found = F.struct(F.col("lot_a").alias("a"), F.col("lot_b").alias("b"), side.alias("side"), F.col(f"{other}_low").alias("low"), F.col(f"{other}_high").alias("high"), "between", "reach")
        return meeting.select("grp", F.col(ring).alias("ring"), F.col(number).alias("number"), found.alias("m"))

    left = meets("a", "number_a", "b", F.lit(0))
    right = meets("b", "number_b", "a", F.when(same, 0).otherwise(1))
    one = lambda m: m.groupBy("grp", "ring", "number").agg(F.collect_list("m").alias("meets"))  # noqa: E731  # at most the rings of a group, twice
    if symmetric:
        return _copies(rows_a, one(left.unionByName(right)))
    return _copies(rows_a, one(left)).unionByName(_copies(rows_b, one(right)))


def _reach(least: float) -> float:
    return math.acos(max(-1.0, min(1.0, least))) + EPS


class _Cut:
    """Tables (grp, id, v) cut into rings around the same pivots."""

    def __init__(self, tables: list[DataFrame], block: int, pivots: int | None = None):
        self.tables = [materialize(t, "vectors") for t in tables]
        sizes = [t.groupBy("grp").agg(F.count("*").alias("n")) for t in self.tables]
        every = sizes[0]
        for s in sizes[1:]:
            every = every.unionByName(s)
        every = every.groupBy("grp").agg(F.sum("n").alias("n"))
        most = every.agg(F.max("n")).first()[0] or 0
        #: whether no group is larger than a block
        self.small = most <= block
        self.points = np.zeros((0, 1))
        if self.small:
            return
        n = min(PIVOTS, pivots or max(2, 4 * math.isqrt(-(-most // block))))
        self.points = fit_pivots(self.tables[0], n)
        large = every.select("grp", (F.col("n") > block).alias("large"))
        self.rings = [_rings(_placed(t.join(large, "grp"), self.points), block, "rings") for t in self.tables]

    def between(self) -> DataFrame:
        return _between(self.rings[0], self.points)

    def whole(self, table: int, side: int) -> DataFrame:
        """Without large groups: the rows of a table as one side, a group to a task."""
        return self.tables[table].select("grp", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(side).alias("side"), "id", "v", F.lit(0).alias("number"), F.lit(SMALL).alias("pivot"), F.lit(0.0).alias("angle"))

    def bounds(self, table: int) -> DataFrame:
        return _bounds(self.rings[table], self.points.shape[1])


def _base(rows: DataFrame, group: str | None, id_col: str, vector_col: str) -> DataFrame:
    grp = F.col(group).cast("string") if group else F.lit("")
    v = F.col(vector_col) if rows.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")  # floats take half the room
    return rows.where(F.col(vector_col).isNotNull()).select(grp.alias("grp"), F.col(id_col).cast("string").alias("id"), v.alias("v"))


# -- kernels ----------------------------------------------------------------------


class _Side:
    """The rows of one side of a task, ordered by ring: ids, unit vectors, and the rings with the angles that they span."""

    def __init__(self, table: pa.Table, side: int):
        part = table.filter(pa.array(table.column("side").to_numpy() == side))
        number = part.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        self.ids = part.column("id").combine_chunks().take(pa.array(order))
        self.n = len(order)
        self.x = _unit(_vectors(part.column("v"))[order])
        number, pivot, angle = number[order], part.column("pivot").to_numpy()[order], part.column("angle").to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if self.n else np.zeros(0, int)
        ends = np.r_[starts[1:], self.n]
        self.rings = [(int(number[i]), int(pivot[i]), float(angle[i:j].min()), float(angle[i:j].max()), int(i), int(j)) for i, j in zip(starts, ends)]

    def place(self) -> np.ndarray:
        """The place of each id in the order of ids; equal ids have equal places."""
        return pc.rank(self.ids, tiebreaker="dense").to_numpy().astype(np.int64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if not len(lists):
        return np.zeros((0, 1))
    sizes = pc.list_value_length(lists).to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of a group must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[_Side, _Side, str, bool]:
    """Both sides, the group, and whether the task is a lot with itself."""
    table = pa.Table.from_batches(list(batches))
    return _Side(table, 0), _Side(table, 1), table.column("grp")[0].as_py(), table.column("a")[0] == table.column("b")[0]


def _angles(points: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ points.T, -1, 1))


def _far(a: tuple, b: tuple, angles: np.ndarray, reach: float) -> bool:
    """Whether two rings are too far apart for a pair within ``reach``."""
    _, p, a_low, a_high, *_ = a
    _, q, b_low, b_high, *_ = b
    if p < 0 or q < 0:
        return False
    between = angles[p, q]
    return max(between - a_high - b_high, a_low - b_high - between, b_low - a_high - between) > reach


def _tiles(first: int, last: int, step: int) -> Iterator[tuple[int, int]]:
    return ((i, min(i + step, last)) for i in range(first, last, step))


def _found(x: _Side, y: _Side, alone: bool, least: float, angles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the pairs at ``least`` between two sides, a tile at a time; with ``alone`` each pair of rings of a side once."""
    if not x.n or not y.n:
        return
    if x.x.shape[1] != y.x.shape[1]:
        raise ValueError("vectors of a group must have one length")
    reach = _reach(least)
    for a in x.rings:
        for b in y.rings:
            if (alone and a[0] > b[0]) or _far(a, b, angles, reach):
                continue
            for r, s in _tiles(a[4], a[5], TILE[0]):
                for t, u in _tiles(b[4], b[5], TILE[1]):
                    if alone and a[0] == b[0] and u <= r:
                        continue
                    scores = x.x[r:s] @ y.x[t:u].T
                    i, j = np.nonzero(scores >= least)
                    if alone and a[0] == b[0]:
                        ahead = i + r < j + t
                        i, j = i[ahead], j[ahead]
                    yield i + r, j + t, scores[i, j]


_PAIR = "a string, b string, score double"


def _pair_batches(batches: Iterator[pa.RecordBatch], least: float, angles: np.ndarray, one_table: bool) -> Iterator[pa.RecordBatch]:
    x, y, _, alone = _sides(batches)
    alone = alone and one_table
    y = x if alone else y
    ids = pa.concat_arrays([x.ids, y.ids])
    place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, int)
    for i, j, score in _found(x, y, alone, least, angles):
        j = j + x.n
        other = place[i] != place[j]
        i, j, score = i[other], j[other], score[other]
        swap = place[i] > place[j]
        low, high = np.where(swap, j, i), np.where(swap, i, j)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(low)), ids.take(pa.array(high)), pa.array(score, pa.float64())], names=["a", "b", "score"])


def _pair_cut(rows: DataFrame, least: float, group: str | None, id_col: str, vector_col: str, block: int, pivots: int | None) -> tuple[DataFrame, np.ndarray]:
    cut = _Cut([_base(rows, group, id_col, vector_col)], block, pivots)
    if cut.small:
        return cut.whole(0, 0), cut.points
    bounds = materialize(cut.bounds(0), "bounds")
    meeting = _meeting(bounds.withColumn("reach", F.lit(_reach(least))), bounds, cut.between()).where("a <= b")
    return _dealt(cut.rings[0], cut.rings[0], meeting, True), cut.points


def pair_copies(rows: DataFrame, least: float, group: str | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """The copies of rows that ``pairs_above`` shuffles: (grp, a, b, side, id, v, number, pivot, angle)."""
    return _pair_cut(rows, least, group, id_col, vector_col, block, pivots)[0]


def pairs_above(rows: DataFrame, least: float, group: str | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """(a, b, score): every pair a < b of a group whose cosine reaches ``least``.

    Rows without a vector, or without a group where one is named, take no part.
    """
    copies, points = _pair_cut(rows, least, group, id_col, vector_col, block, pivots)
    angles = _angles(points)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pair_batches(batches, least, angles, True)

    return copies.groupBy("grp", "a", "b").applyInArrow(multiply, _PAIR)


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least labels after the pairs (i, j) are joined; ``root`` points each row straight at its label."""
    while True:
        p, q = root[i], root[j]
        live = p != q
        if not live.any():
            return root
        i, j, p, q = i[live], j[live], p[live], q[live]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            far = root[root]
            if (far == root).all():
                break
            root = far


def links(rows: DataFrame, least: float, group: str | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """(id, root, best) instead of the pairs of ``pairs_above``: the same components and each row's best score.

    A task joins its pairs at once and returns a row for each of its rows that has one:
    the least row that it is joined with there, and its best score there.  So what is
    kept grows with the rows, though the pairs may grow with their square.
    """
    copies, points = _pair_cut(rows, least, group, id_col, vector_col, block, pivots)
    angles = _angles(points)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, _, alone = _sides(batches)
        y = x if alone else y
        ids = x.ids if alone else pa.concat_arrays([x.ids, y.ids])
        place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1  # rows of one id are one
        n = int(place.max()) + 1
        root, best = np.arange(n), np.full(n, -np.inf)
        for i, j, score in _found(x, y, alone, least, angles):
            p, q = place[i], place[j if alone else j + x.n]
            other = p != q
            p, q, score = p[other], q[other], score[other]
            np.maximum.at(best, p, score)
            np.maximum.at(best, q, score)
            root = _joined(root, p, q)
        first = np.zeros(n, np.int64)
        first[place] = np.arange(len(place))
        at = np.flatnonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[at])), ids.take(pa.array(first[root[at]])), pa.array(best[at], pa.float64())], names=["id", "root", "best"])

    return copies.groupBy("grp", "a", "b").applyInArrow(join, "id string, root string, best double")


def pairs_touching(rows: DataFrame, ids: DataFrame, least: float, group: str | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, score), a < b, with at least one side among ``ids``: rings of those meet rings of all."""
    base = _base(rows, group, id_col, vector_col)
    some = base.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("grp", "id", "v")
    copies, points = _two_tables(base, some, least, block)
    angles = _angles(points)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pair_batches(batches, least, angles, False)

    found = copies.groupBy("grp", "a", "b").applyInArrow(multiply, _PAIR)
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))  # twice if both are among the ids


def _two_tables(others: DataFrame, rows: DataFrame, least: float, block: int) -> tuple[DataFrame, np.ndarray]:
    """Copies of both tables (grp, id, v) for the pairs of lots that may hold a pair at ``least``, side 0 ``rows``, side 1 ``others``; and the pivots."""
    cut = _Cut([others, rows], block)
    if cut.small:
        return cut.whole(1, 0).unionByName(cut.whole(0, 1)), cut.points
    far, near = (materialize(cut.bounds(n), "bounds") for n in (0, 1))
    meeting = materialize(_meeting(near.withColumn("reach", F.lit(_reach(least))), far, cut.between()), "meeting")
    return _dealt(cut.rings[1], cut.rings[0], meeting, False), cut.points


def _ranked(i: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The candidates that are among the first ``k`` of their row: larger scores first, then the smaller place."""
    order = np.lexsort((place, -score, i))
    start = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0]) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return order[rank < k]


def _best_of(x: _Side, y: _Side, k: int, least: float, below: float, digits: int, angles: np.ndarray, skip_own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score): the ``k`` best partners of each row of x, a strip of rows at a time."""
    if not x.n or not y.n:
        return
    every = pa.concat_arrays([x.ids, y.ids])
    place = pc.rank(every, tiebreaker="dense").to_numpy().astype(np.int64)
    mine, theirs = place[: x.n], place[x.n :]
    slack = 2 * 10.0**-digits
    for a in x.rings:
        for r, s in _tiles(a[4], a[5], TILE[0]):
            i, j, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            bar = np.full(s - r, least)  # what a row's next partner must reach
            for b in y.rings:
                if (skip_own and a[0] == b[0]) or _far(a, b, angles, _reach(float(bar.min()))):
                    continue
                for t, u in _tiles(b[4], b[5], TILE[1]):
                    scores = x.x[r:s] @ y.x[t:u].T
                    if below < math.inf:
                        scores[scores >= below] = -math.inf
                    scores[mine[r:s, None] == theirs[None, t:u]] = -math.inf
                    hit = scores >= bar[:, None]
                    if np.count_nonzero(hit) > 4 * (k + 1) * len(bar) and u - t > k:
                        bar = np.maximum(bar, np.partition(scores, u - t - k, axis=1)[:, u - t - k] - slack)
                        hit = scores >= bar[:, None]
                    p, q = np.nonzero(hit)
                    if not len(p):
                        continue
                    i, j, score = np.r_[i, p], np.r_[j, q + t], np.r_[score, scores[p, q]]
                    keep = _ranked(i, np.round(score, digits), theirs[j], k)
                    i, j, score = i[keep], j[keep], score[keep]
                    full = np.bincount(i, minlength=len(bar)) >= k
                    worst = np.full(len(bar), math.inf)
                    np.minimum.at(worst, i, score)
                    bar = np.where(full, np.maximum(bar, worst - slack), bar)
            yield i + r, j, score


def top_neighbours(
    rows: DataFrame, k: int, least: float = -1.0, group: str | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK, below: float = math.inf, digits: int = 9
) -> DataFrame:
    """(from_id, to_id, score, rank): the k nearest others of each row in its group; ties, to ``digits`` digits, by id.

    Only others with a score below ``below`` count.  First every ring is searched by
    itself.  The k-th best score that a row then has is its reach: it is copied only to
    lots that can hold a better one.  Each pair of lots keeps k rows a side before the
    shuffle.
    """
    cut = _Cut([_base(rows, group, id_col, vector_col)], block)
    angles = _angles(cut.points)

    def search(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[pa.RecordBatch]:
        x, y, _, _ = _sides(batches)
        y = y if apart else x
        for i, j, score in _best_of(x, y, k, least, below, digits, angles, apart):
            yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(i)), y.ids.take(pa.array(j)), pa.array(score, pa.float64())], names=["from_id", "to_id", "score"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(batches, False)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(batches, True)

    schema = "from_id string, to_id string, score double"
    if cut.small:
        found = cut.whole(0, 0).groupBy("grp", "a", "b").applyInArrow(inside, schema)
    else:
        rings = cut.rings[0]
        own = rings.select("grp", F.col("ring").alias("a"), F.col("ring").alias("b"), F.lit(0).alias("side"), "id", "v", F.lit(0).alias("number"), "pivot", "angle")
        alone = materialize(own.groupBy("grp", "a", "b").applyInArrow(inside, schema), "alone")
        # a row with fewer than k neighbours looks as far as ``least``; ties after rounding are kept
        kth = alone.groupBy("from_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        limit = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth") - 2e-9))) + EPS
        reached = rings.join(kth.select(F.col("from_id").alias("id"), limit.alias("own_reach")), "id", "left")
        reached = materialize(reached.withColumn("own_reach", F.least(F.coalesce("own_reach", F.lit(_reach(least))), F.lit(_reach(least)))), "reached")
        bounds = materialize(cut.bounds(0), "bounds")
        looking = bounds.join(reached.groupBy("grp", "ring").agg(F.max("own_reach").alias("reach")), ["grp", "ring"])
        meeting = materialize(_meeting(looking, bounds, cut.between()).where("a <> b"), "meeting")
        found = alone.unionByName(_dealt(reached, rings, meeting, False).groupBy("grp", "a", "b").applyInArrow(across, schema))
    w = Window.partitionBy("from_id").orderBy(F.desc(F.round("score", digits)), "to_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, others: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(grp, id, other, score): the row of ``others`` of the group with the largest cosine, if that reaches ``least``.

    Both tables are (grp, id, v); rows of one id share a result.  Ties, to nine
    digits, fall to the greatest id; vectors of different lengths don't match.
    """
    sized = F.concat_ws(":", F.size("v"), "grp")  # vectors of one length
    sides = [t.where("grp IS NOT NULL AND v IS NOT NULL").select(sized.alias("grp"), F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")) for t in (others, rows)]
    copies, points = _two_tables(*sides, least, block)
    angles = _angles(points)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, grp, _ = _sides(batches)
        if not x.n or not y.n:
            return
        place = y.place()
        other, score = np.full(x.n, -1), np.full(x.n, -np.inf)
        for a in x.rings:
            for b in y.rings:
                if _far(a, b, angles, _reach(least)):
                    continue
                for r, s in _tiles(a[4], a[5], TILE[0]):
                    for t, u in _tiles(b[4], b[5], TILE[1]):
                        order = np.argsort(-place[t:u], kind="stable")
                        scores = x.x[r:s] @ y.x[t:u][order].T
                        best = np.round(scores, 9).argmax(1)
                        value, at = scores[np.arange(s - r), best], order[best] + t
                        old, new = np.round(score[r:s], 9), np.round(value, 9)
                        better = (new > old) | ((new == old) & (place[at] > place[other[r:s]]))
                        other[r:s], score[r:s] = np.where(better, at, other[r:s]), np.where(better, value, score[r:s])
        i = np.flatnonzero(score >= least)
        yield pa.RecordBatch.from_arrays(
            [pa.array([grp] * len(i), pa.string()), x.ids.take(pa.array(i)), y.ids.take(pa.array(other[i])), pa.array(score[i], pa.float64())], names=["grp", "id", "other", "score"]
        )

    found = copies.groupBy("grp", "a", "b").applyInArrow(multiply, "grp string, id string, other string, score double")
    best = F.max(F.struct(F.round("score", 9).alias("r"), "other", "score")).alias("best")
    return found.groupBy("grp", "id").agg(best).select(F.expr("substring(grp, instr(grp, ':') + 1)").alias("grp"), "id", "best.other", "best.score")
