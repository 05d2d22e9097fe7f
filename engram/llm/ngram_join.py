"""N-gram Jaccard join: signature trees over blocks of documents.

The join is exact.  For every pair of different shingle sets with
``100 * |A & B| >= 80 * |A | B|`` a chain of verified links joins the two.

1. *Shingle.*  One pass over the text hashes 5-word shingles (64 bits), merges
   equal sets inside a batch and deals the hashes by value range.  A hash that HOT or
   more sets of a batch hold is dealt once, with their number.
2. *Count.*  Each range finds the shingles that two or more sets share and sends
   them, with their frequency, back to their batches.  Unshared shingles stop here.
3. *Prefix.*  Sorted rarest first, two linked sets must share a shingle among the
   first ``n - ceil(0.8 n) + 1``.  Those prefixes are the block keys; a set whose
   unshared shingles fill its prefix has no partner at all.
4. *Trees.*  Blocks with the same members are processed once.  A block is a tree
   whose nodes hold the OR of the token bitmaps below and their size range; a dual
   traversal drops node pairs whose maximum possible overlap is too small, and the
   surviving leaf pairs are verified on the shared shingles.  For components alone a
   pair already joined inside the task is skipped, so a group of n near copies gives
   about n links.  For link counts every pair is verified, once, in the block of its
   least common prefix shingle.
   Blocks above ``block_rows`` are dealt into slices by hash, one task a slice pair.
5. *Components.*  Minimum-label propagation with pointer jumping over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import name_of, numbered, picked
from engram.operators.graph import connected_components
from engram.session import input_bytes, materialize

WORDS = 5
#: A link needs 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Bytes of text that one batch merges before it is dealt out.
BATCH_BYTES = 16 << 20
#: A batch numbers its sets in 15 bits; the 16th marks a hash that stands for many sets.
BATCH_SETS = 1 << 15
MANY = 0x8000
#: From so many sets of a batch on, a hash is dealt once.
HOT = 16
#: Bytes of compressed input a hash range, and with a large input; ranges in between.
RANGE_BYTES, WIDE_RANGE_BYTES, RANGES = 1 << 23, 1 << 26, 4096
#: Rows that one task of the tree join reads at most for a single block.
BLOCK_ROWS = 2048
LEAF = 32
#: Distinct tokens up to which a leaf's 0/1 rows are kept, and columns multiplied at once.
WIDE = 1 << 14
BITMAP_WORDS = 16

# A dealt hash is its low 48 bits: the range that it was dealt to gives the high ones again.
_ENTRY = np.dtype([("low", "<u4"), ("mid", "<u2"), ("set", "<u2")])
_SHARED = np.dtype([("low", "<u4"), ("mid", "<u2"), ("set", "<u2"), ("df", "<u2")])
_DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("batch", pa.binary()), ("data", pa.binary())])
_DEALT_DDL = "part int, kind byte, batch binary, data binary"
_SETS_DDL = "doc_id long, body long, fp binary, n_shingles long, tokens binary, rare binary, mask binary"
_MEMBER = np.dtype([("doc", "<i8"), ("null", "?"), ("body", "<i8"), ("set", "<i4")])


class _WordHashes(dict):
    """word -> 64-bit hash; bounded in entries and bytes, since a worker lives longer than a batch."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 250_000:
                self.clear()
            self[word] = value
        return value


def shingle_hashes(text: str | None, cache: dict | None = None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one of the whole sequence if shorter."""
    if not text:
        return np.empty(0, "<u8")
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    cache = _WordHashes() if cache is None else cache
    h = np.fromiter((cache[t] for t in tokens), "<u8", len(tokens))
    with np.errstate(over="ignore"):
        if len(h) < words:
            out = np.uint64(len(h))
            for x in h:
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
            return np.array([out], "<u8")
        out = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out = _mix(out + h[k : len(h) - words + 1 + k])
    return np.unique(out)


def _mix(x):
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _low(entries: np.ndarray) -> np.ndarray:
    return entries["low"].astype("<u8") | (entries["mid"].astype("<u8") << np.uint64(32))


def _deal(parts: int):
    """Batches of (doc_id, text, body) -> hash ranges of a batch and its member list."""

    def flush(name: str, rows: list, sets: dict) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        members = np.array(rows, dtype=_MEMBER)
        prints = b"".join(fp for fp in sets)
        sizes = np.fromiter((len(v[1]) for v in sets.values()), "<i8", len(sets))
        key = xxhash.xxh3_128_digest(name.encode())
        part, kind, data = [int.from_bytes(key[:8], "little") % parts], [1], [b""]
        hot_tokens, hot_counts, hot_sets = np.empty(0, "<u8"), np.empty(0, "<i4"), np.empty(0, "<u2")
        if len(sizes) and sizes.sum():
            hashes = np.concatenate([v[1] for v in sets.values()])
            order = np.argsort(hashes, kind="stable")
            entry = np.empty(len(hashes), _ENTRY)
            entry["set"] = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)[order]
            hashes = hashes[order]
            entry["low"], entry["mid"] = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) & np.uint64(0xFFFF)
            # hash ranges are equal slices of the 64-bit space, by the top 32 bits
            slot = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            counts = np.diff(np.r_[starts, len(hashes)])
            hot = counts >= HOT
            if hot.any():
                many = np.repeat(hot, counts)
                hot_counts, hot_sets = counts[hot].astype("<i4"), entry["set"][many]
                entry["set"][starts[hot]] = MANY | np.minimum(counts[hot], MANY - 1)
                hot_tokens = _token(entry[starts[hot]], slot[starts[hot]])
                stay = ~many
                stay[starts[hot]] = True
                entry, slot = entry[stay], slot[stay]
            edges = np.flatnonzero(np.diff(slot)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(entry)]):
                part.append(int(slot[a]))
                kind.append(0)
                data.append(entry[a:b].tobytes())
        head = np.array([len(rows), len(sets), len(hot_tokens), len(hot_sets)], "<i8")
        data[0] = b"".join(x.tobytes() for x in (head, members, sizes)) + prints + b"".join(x.tobytes() for x in (hot_tokens, hot_counts, hot_sets))
        arrays = [pa.array(part, pa.int32()), pa.array(kind, pa.int8()), pa.array([key] * len(part), pa.binary()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rows, sets, held, number, salt = _WordHashes(), [], {}, 0, 0, None
        for batch in batches:
            for doc, text, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                h = shingle_hashes(text, cache)
                fp = xxhash.xxh3_128_digest(h.tobytes())
                if salt is None:  # names the batch by its first row; a retried task names it alike
                    salt = f"{doc}-{fp.hex()}-{_partition()}"
                at = sets.setdefault(fp, (len(sets), h))[0]
                rows.append((doc or 0, doc is None, body, at))
                held += len(text or "")
                if held >= BATCH_BYTES or len(sets) >= BATCH_SETS or len(rows) >= 20 * BATCH_SETS:
                    yield from flush(f"{salt}-{number}", rows, sets)
                    rows, sets, held, number = [], {}, 0, number + 1
        yield from flush(f"{salt}-{number}", rows, sets)

    return run


def _token(entries: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The number by which shingles are compared: a dealt hash and its range."""
    return _low(entries) | ((part.astype("<u8") & np.uint64(0xFFFF)) << np.uint64(48))


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _shared(table: pa.Table) -> pa.Table:
    """One hash range: the entries whose hash two or more sets hold, by batch; members pass through."""
    kind = table.column("kind").to_numpy()
    names, data = table.column("batch").to_pylist(), table.column("data")
    out_names = [names[i] for i in np.flatnonzero(kind == 1)]
    out_data = [data[int(i)].as_py() for i in np.flatnonzero(kind == 1)]
    out_kind = [1] * len(out_data)
    chunks = np.flatnonzero(kind == 0)
    part = table.column("part")[0].as_py() if table.num_rows else 0
    if len(chunks):
        parts = [np.frombuffer(data[int(i)].as_buffer(), _ENTRY) for i in chunks]
        hashes = np.concatenate([_low(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        counts = np.diff(np.r_[starts, len(ranked)])
        held = np.concatenate([p["set"] for p in parts])[order]
        sums = np.add.reduceat(np.where(held >= MANY, held & (MANY - 1), 1).astype(np.int64), starts)
        df = np.empty(len(ranked), "<u2")
        df[order] = np.repeat(np.minimum(sums, 0xFFFF), counts)
        at = 0
        for i, p in zip(chunks, parts):
            mine = df[at : at + len(p)]
            at += len(p)
            keep = mine > 1
            if keep.any():
                rows = np.empty(int(keep.sum()), _SHARED)
                for name in _ENTRY.names:
                    rows[name] = p[name][keep]
                rows["df"] = mine[keep]
                out_names.append(names[i])
                out_data.append(rows.tobytes())
                out_kind.append(0)
    n = len(out_data)
    arrays = [pa.array([part] * n, pa.int32()), pa.array(out_kind, pa.int8()), pa.array(out_names, pa.binary()), pa.array(out_data, pa.binary())]
    return pa.Table.from_arrays(arrays, schema=_DEALT)


def _planes(tokens: np.ndarray) -> bytes:
    """Sorted tokens byte plane by byte plane, most of which then compress well."""
    return np.sort(tokens).view("u1").reshape(-1, 8).T.tobytes()


def _tokens(planes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(8, -1).T).view("<u8").ravel()


def need(n: int) -> int:
    """The smallest overlap with which a set of n shingles can have a partner: ceil(0.8 n)."""
    return -(-THRESHOLD * n // 100)


_SETS = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("fp", pa.binary()), ("n_shingles", pa.int64()), ("tokens", pa.binary()), ("rare", pa.binary()), ("mask", pa.binary())])


def _prefixes(table: pa.Table) -> pa.Table:
    """One batch: a row for each document, and one for each set that can have a partner."""
    kind, data = table.column("kind").to_numpy(), table.column("data")
    blob = data[int(np.flatnonzero(kind == 1)[0])].as_py()
    n_rows, n_sets, n_hot, n_held = (int(x) for x in np.frombuffer(blob, "<i8", 4))
    at = 32 + n_rows * _MEMBER.itemsize
    members = np.frombuffer(blob, _MEMBER, n_rows, 32)
    sizes = np.frombuffer(blob, "<i8", n_sets, at)
    at += 8 * n_sets
    prints = [blob[at + 16 * i : at + 16 * i + 16] for i in range(n_sets)]
    at += 16 * n_sets
    hot_tokens, hot_counts, hot_sets = (np.frombuffer(blob, t, n, at + skip) for t, n, skip in (("<u8", n_hot, 0), ("<i4", n_hot, 8 * n_hot), ("<u2", n_held, 12 * n_hot)))
    docs = pa.array(members["doc"], pa.int64(), mask=members["null"])
    fps, ns = [prints[i] for i in members["set"]], sizes[members["set"]]
    tables = [pa.Table.from_arrays([docs, pa.array(members["body"], pa.int64()), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), *[pa.nulls(n_rows, pa.binary())] * 3], schema=_SETS)]
    at, part = np.flatnonzero(kind == 0), table.column("part").to_numpy()
    if len(at):
        chunks = [np.frombuffer(data[int(i)].as_buffer(), _SHARED) for i in at]
        rows = np.concatenate(chunks)
        tokens = _token(rows, np.repeat(part[at], [len(c) for c in chunks]))
        many = rows["set"] >= MANY
        if many.any():  # these stand for the sets that the batch kept
            by = np.argsort(hot_tokens)
            which = by[np.searchsorted(hot_tokens, tokens[many], sorter=by)]
            first = np.cumsum(hot_counts) - hot_counts
            n = hot_counts[which]
            wide = np.empty(int(n.sum()), _SHARED)
            wide["df"] = np.repeat(rows["df"][many], n)
            wide["set"] = hot_sets[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(len(wide))]
            rows, tokens = np.concatenate([rows[~many], wide]), np.concatenate([tokens[~many], np.repeat(tokens[many], n)])
        order = np.lexsort((tokens, rows["df"], rows["set"]))
        rows, tokens = rows[order], tokens[order]
        starts = np.flatnonzero(np.r_[True, rows["set"][1:] != rows["set"][:-1]])
        got: list[tuple] = []
        for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
            i = int(rows["set"][a])
            n, m = int(sizes[i]), int(b - a)
            prefix = n - need(n) + 1 - (n - m)
            if prefix > 0:
                # one bit a token, in the order of the planes: whether it is in the prefix
                mask = np.packbits(np.argsort(tokens[a:b]) < prefix).tobytes()
                got.append((prints[i], n, _planes(tokens[a:b]), tokens[a : a + prefix].tobytes(), mask))
        if got:
            fp, n, planes, rare, mask = zip(*got)
            arrays = [pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.int64()), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(planes, pa.binary()), pa.array(rare, pa.binary()), pa.array(mask, pa.binary())]
            tables.append(pa.Table.from_arrays(arrays, schema=_SETS))
    return pa.concat_tables(tables)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n, rare) -> a (token, fp, n) row for each prefix shingle."""
    for batch in batches:
        fps, sizes = batch.column(0), batch.column(1)
        hashes = [np.frombuffer(t.as_buffer(), "<i8") for t in batch.column(2)]
        if hashes:
            index = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes), pa.int64()), fps.take(index), sizes.take(index)], names=["token", "fp", "n"])


class SignatureTree:
    """A static tree over sets sorted by size; nodes hold OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        width = np.uint64(64 * BITMAP_WORDS)
        self.sets, self.sizes = sets, sizes
        bits = np.zeros((len(sets), BITMAP_WORDS), "<u8")
        for row, s in zip(bits, sets):
            at = (s.view("<u8") >> np.uint64(7)) % width
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
        self.bits = bits
        #: tokens that a bitmap cannot show: all shared ones less the bits set
        self.spare = np.array([len(s) for s in sets]) - np.bitwise_count(bits).sum(1, dtype=int) if sets else np.empty(0, int)
        #: levels of nodes, leaves first: (first row, end row, bitmap, least size, most size, most spare)
        self.levels = []
        bounds = [(a, min(a + LEAF, len(sets))) for a in range(0, len(sets), LEAF)]
        while bounds:
            self.levels.append([(a, b, np.bitwise_or.reduce(bits[a:b]), int(sizes[a:b].min()), int(sizes[a:b].max()), int(self.spare[a:b].max())) for a, b in bounds])
            if len(bounds) == 1:
                break
            bounds = [(bounds[i][0], bounds[min(i + 3, len(bounds) - 1)][1]) for i in range(0, len(bounds), 4)]


def _overlap_needed(x: int, y: int) -> int:
    """ceil of THRESHOLD * (x + y) / (100 + THRESHOLD): the overlap that makes a link."""
    return -(-THRESHOLD * (x + y) // (100 + THRESHOLD))


def _possible(p: tuple, q: tuple) -> bool:
    """Whether some set under node p may link with some set under node q."""
    if 100 * p[4] < THRESHOLD * q[3] or 100 * q[4] < THRESHOLD * p[3]:
        return False
    common = int(np.bitwise_count(p[2] & q[2]).sum())
    return common + min(p[5], q[5]) >= _overlap_needed(p[3], q[3])


def dual_traversal(left: SignatureTree, right: SignatureTree) -> Iterator[tuple[int, int, int, int]]:
    """Leaf row ranges of both trees that may hold a link; for one tree with itself, each pair once."""
    if not left.levels or not right.levels:
        return
    same = left is right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        i, x, j, y = stack.pop()
        p, q = left.levels[i][x], right.levels[j][y]
        if same and q[1] <= p[0] or not _possible(p, q):
            continue
        if i == 0 and j == 0:
            yield p[0], p[1], q[0], q[1]
        elif i >= j:
            stack += [(i - 1, c, j, y) for c in range(4 * x, min(4 * x + 4, len(left.levels[i - 1])))]
        else:
            stack += [(i, x, j - 1, c) for c in range(4 * y, min(4 * y + 4, len(right.levels[j - 1])))]


def _links(table: pa.Table) -> pa.Table:
    """One block: verified links that join every linkable pair of it."""
    fps = table.column("fp").to_pylist()
    sizes = table.column("n_shingles").to_numpy()
    side = table.column("side").to_numpy()
    order = np.lexsort((np.array(fps, "S16"), sizes))
    data = table.column("tokens")
    trees, ids = [], []
    for s in (0, 1):
        rows = [int(i) for i in order if side[i] == s]
        trees.append(SignatureTree([_tokens(data[i].as_buffer()) for i in rows], sizes[rows]))
        ids.append(rows)
    if not ids[1]:
        trees[1], ids[1] = trees[0], ids[0]
    same = trees[0] is trees[1]
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found: list[tuple[bytes, bytes]] = []
    a, b = trees
    for lo, hi, lo2, hi2 in dual_traversal(a, b):
        for x in range(lo, hi):
            y0 = max(lo2, x + 1) if same else lo2
            if y0 >= hi2:
                continue
            sx, sy = a.sizes[x], b.sizes[y0:hi2]
            common = np.bitwise_count(a.bits[x] & b.bits[y0:hi2]).sum(1, dtype=int)
            short = common + np.minimum(a.spare[x], b.spare[y0:hi2])
            for y in np.flatnonzero((short * (100 + THRESHOLD) >= THRESHOLD * (sx + sy)) & (100 * sy >= THRESHOLD * sx) & (100 * sx >= THRESHOLD * sy)) + y0:
                p, q = ids[0][x], ids[1][int(y)]
                if find(p) == find(q):
                    continue
                both = len(np.intersect1d(a.sets[x], b.sets[int(y)], assume_unique=True))
                if 100 * both >= THRESHOLD * (int(sx) + int(b.sizes[int(y)]) - both):
                    root[find(p)] = find(q)
                    found.append((fps[p], fps[q]))
    return pa.Table.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


def _rows_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of ``sets``, sorted, and a 0/1 row over them for each set."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.zeros((len(sets), len(tokens)), "u1")
    rows[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
    return tokens, rows


class _Leaves:
    """The 0/1 rows of a tree's leaves; wide ones are made anew each time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.kept = sets, {}

    def rows(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.kept.get(lo)
        if found is None:
            found = _rows_of(self.sets[lo:hi])
            if len(found[0]) <= WIDE:
                self.kept[lo] = found
        return found


def _overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The overlap of each set of one leaf with each of another."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    out = np.zeros((len(x[1]), len(y[1])), "<i8")
    for k in range(0, len(i), WIDE):
        out += (x[1][:, i[k : k + WIDE]].astype("<f4") @ y[1][:, j[k : k + WIDE]].astype("<f4").T).astype("<i8")
    return out


def _counted(table: pa.Table) -> pa.Table:
    """One block: links (a, b) that join every linkable pair of it, and rows (a, null, n) with a set's links.

    Both are over the pairs whose least common prefix shingle is the block's; ``n``
    weighs a link by the copies of its other end.
    """
    token, lo, hi = (table.column(c)[0].as_py() for c in ("token", "lo", "hi"))
    fps = table.column("fp").to_pylist()
    sizes, side, copies = (table.column(c).to_numpy() for c in ("n_shingles", "side", "copies"))
    order = np.lexsort((np.array(fps, "S16"), sizes))
    data, masks = table.column("tokens"), table.column("mask")
    trees, ids, leaves, lower = [], [], [], []
    for s in (0,) if lo == hi else (0, 1):
        rows = np.array([i for i in order if side[i] == s], int)
        sets = [_tokens(data[int(i)].as_buffer()) for i in rows]
        before = []
        for i, t in zip(rows, sets):
            t = t[np.unpackbits(np.frombuffer(masks[int(i)].as_buffer(), "u1"), count=len(t)).view("?")]
            before.append(t[t.view("<i8") < token])
        trees.append(SignatureTree(sets, sizes[rows]))
        ids.append(rows)
        leaves.append(_Leaves(sets))
        lower.append(_Leaves(before))
    same = lo == hi
    (a, b), (mine, others) = (trees[0], trees[-1]), (ids[0], ids[-1])
    n, label = np.zeros(len(fps), "<i8"), np.arange(len(fps))
    found: list[tuple[bytes, bytes]] = []
    for x, x2, y, y2 in dual_traversal(a, b):
        sx, sy = a.sizes[x:x2, None], b.sizes[None, y:y2]
        common = np.bitwise_count(a.bits[x:x2, None] & b.bits[None, y:y2]).sum(2, dtype=int)
        short = common + np.minimum(a.spare[x:x2, None], b.spare[None, y:y2])
        near = (short * (100 + THRESHOLD) >= THRESHOLD * (sx + sy)) & (100 * sy >= THRESHOLD * sx) & (100 * sx >= THRESHOLD * sy)
        if same:
            near &= np.arange(y, y2)[None] > np.arange(x, x2)[:, None]
        if near.any():
            near &= _overlaps(lower[0].rows(x, x2), lower[-1].rows(y, y2)) == 0
        if not near.any():
            continue
        both = _overlaps(leaves[0].rows(x, x2), leaves[-1].rows(y, y2))
        i, j = np.nonzero(near & (100 * both >= THRESHOLD * (sx + sy - both)))
        p, q = mine[x + i], others[y + j]
        np.add.at(n, p, copies[q])
        np.add.at(n, q, copies[p])
        while len(p):
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            if len(p):
                found.append((fps[p[0]], fps[q[0]]))
                label[label == label[q[0]]] = label[p[0]]
    some = np.flatnonzero(n)
    first = [x for x, _ in found] + [fps[i] for i in some]
    return pa.Table.from_arrays(
        [pa.array(first, pa.binary()), pa.array([y for _, y in found] + [None] * len(some), pa.binary()), pa.array([None] * len(found) + n[some].tolist(), pa.int64())], names=["a", "b", "n"]
    )


def _body(text: Column) -> Column:
    """The hash by which rows of equal id are told apart."""
    return F.xxhash64(text.isNull(), text)


def sets_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, body, fp, n_shingles) for each document, plus a row (fp, n_shingles, tokens, rare, mask) with null doc_id and set tokens for each set that can have a partner.

    ``body`` is the hash of the whole text.
    """
    size = input_bytes(docs)
    if size > 1 << 50:  # not known to the optimizer, or multiplied up by it
        size = picked(docs, text=(text_col, "string")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(48, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, size // RANGE_BYTES), size // WIDE_RANGE_BYTES)
    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("body", _body(F.col("text")))
    dealt = rows.mapInArrow(_deal(parts), _DEALT_DDL)
    shared = dealt.groupBy("part").applyInArrow(_shared, _DEALT_DDL)
    return materialize(shared.groupBy("batch").applyInArrow(_prefixes, _SETS_DDL), "sets")


def jaccard_links(sets: DataFrame, block_rows: int = BLOCK_ROWS, counted: bool = False) -> DataFrame:
    """Verified links (a, b) between set fingerprints; enough of them to join every linkable pair.

    With ``counted`` every pair is verified, and rows (a, null, n), several a set, add
    up to the documents of other sets that the set ``a`` links with.
    """
    able = sets.where(F.col("tokens").isNotNull()).dropDuplicates(["fp"]).select("fp", "n_shingles", "tokens", "rare", *(["mask"] if counted else []))
    if counted:
        able = able.join(sets.where(F.col("tokens").isNull()).groupBy("fp").agg(F.count("*").alias("copies")), "fp")
    able = materialize(able, "able")
    keys = able.select("fp", "n_shingles", "rare").mapInArrow(_explode, "token long, fp binary, n long")
    keys = materialize(keys, "keys")
    seal = F.xxhash64("fp")
    blocks = keys.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(seal.cast("decimal(20,0)")).alias("s"), F.bit_xor(seal).alias("x"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    # two sets of too different sizes can't link
    blocks = blocks.where((F.col("n") > 2) | ((F.col("n") == 2) & (100 * F.col("least") >= THRESHOLD * F.col("most"))))
    once = blocks.groupBy("n", "s", "x").agg(F.min("token").alias("token")).select("token", "n")
    rows = keys.select("token", "fp").join(once, "token")
    # a block of more than block_rows is cut into k slices; slice pairs are separate tasks
    k = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k"))
    rows = rows.withColumn("k", k).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "fp")
    full = rows.join(able.drop("rare"), "fp")
    if counted:
        return full.groupBy("token", "lo", "hi").applyInArrow(_counted, "a binary, b binary, n long")
    return full.groupBy("token", "lo", "hi").applyInArrow(_links, "a binary, b binary")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Null or blank text: n_shingles 0, its own component (the doc_id, which may be
    null).  Repeated ids give a row each; ties inside a component fall to the least
    id.  Other columns of ``docs`` are ignored, whatever their names.  An empty
    table gives an empty result.
    """
    sets = sets_table(docs, id_col, text_col)
    return _members(sets, materialize(jaccard_links(sets, block_rows), "links")).select("doc_id", "n_shingles", "component_id")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``ngram_components`` and ``n_links``: the other rows whose shingles link with the row's.

    Rows of equal shingles link too; blank rows have no link.
    """
    sets = sets_table(docs, id_col, text_col)
    found = materialize(jaccard_links(sets, block_rows, True), "links")
    n = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n"))
    rows = _members(sets, found.where(F.col("b").isNotNull()).select("a", "b"), n)
    linked = F.when(F.col("n_shingles") > 0, F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    return rows.select("doc_id", "n_shingles", "component_id", linked.alias("n_links"))


def _members(sets: DataFrame, links: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(doc_id, body, fp, root, n_shingles, copies, component_id) for every document, and the columns that ``extra`` has by fp."""
    labels = connected_components(links)
    members = sets.where(F.col("tokens").isNull()).select("doc_id", "body", "fp", "n_shingles")
    firsts = members.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    rooted = firsts.join(labels, firsts.fp == labels.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    ids = rooted.join(least, "root").select("fp", "root", "least", "copies")
    if extra is not None:
        ids = ids.join(extra, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return members.join(ids, "fp", "left").select("doc_id", "body", "fp", "root", "n_shingles", "copies", component, *([] if extra is None else ["n"]))


def near_duplicate_keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of ``docs`` for each group of near copies; all columns stay.

    The row with the least id stays, ids that are null come last, and of rows with that
    id the one with the least text hash; of rows equal in id and text one stays.  Rows
    are judged by id and text together, so a repeated id does not tie other texts to
    a group.  Rows of null or blank text are linked with nothing and all stay.  Other
    columns may have any names.  An empty table gives no row.
    """
    sets = sets_table(docs, id_col, text_col)
    rows = _members(sets, materialize(jaccard_links(sets, block_rows), "links")).where("n_shingles > 0")
    keys = rows.groupBy("root", "doc_id", "body").agg(F.count("*").alias("n"))
    keys = materialize(keys, "keys")
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("body").alias("b"))
    first = keys.groupBy("root").agg(F.min(order).alias("first")).select(F.col("root").alias("r"), "first")
    kept = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("body").alias("b")).eqNullSafe(F.col("first"))
    judged = materialize(keys.join(first, keys.root == F.col("r")).select("doc_id", "body", "n", kept.alias("kept")), "judged")
    table, names = numbered(docs), docs.columns
    doc_id, body = F.col(name_of(docs, id_col)).cast("long"), _body(F.col(name_of(docs, text_col)).cast("string"))
    same = doc_id.eqNullSafe(F.col("k_id")) & (body == F.col("k_body"))
    gone = judged.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("doc_id").alias("k_id"), F.col("body").alias("k_body"))
    out = table.join(gone, same, "left_anti")
    repeated = judged.where(F.col("kept") & (F.col("n") > 1)).select(F.col("doc_id").alias("k_id"), F.col("body").alias("k_body"))
    if not repeated.isEmpty():
        whole = F.struct(*table.columns)
        one = table.join(repeated, same).groupBy("k_id", "k_body").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
        out = out.unionByName(one)
    return out.toDF(*names)
