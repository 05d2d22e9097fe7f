"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a space mark with the word after it) are concatenated and
indexed by a suffix array.  Every piece of the model is binary-searched in it, all at
once; the occurrence ranges become edges (start, length, piece), which are sorted by
position.  Each unit is then relaxed over its edges: adjacent symbols whose union is
an edge merge, the best score first and the leftmost among equals, until none is left,
which is the model's own (BPE) segmentation.  Characters without an edge fall back to
bytes.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked

MARK = "▁"
_UNIT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
#: Units that a worker keeps, and their characters.
KEPT, KEPT_CHARACTERS = 500_000, 1 << 24
#: Characters of new units that one suffix array indexes.
INDEXED = 1 << 19
#: Units longer than this are relaxed one by one.
LONG = 64
NONE = np.iinfo(np.int32).max


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in the order of their first ``depth`` codes at least (prefix doubling)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width or None] = rank[width:] + 1 if width < len(rank) else after[:0]
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        width *= 2
    return order


class PieceModel:
    """The pieces, scores and bytes of a BPE SentencePiece model."""

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.text[i][3:5], 16) for i in range(size) if m.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.hidden = {i for i in range(size) if m.is_control(i)}
        self.unknown = m.unk_id()
        ordinary = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        best_first = np.argsort([-m.get_score(i) for i in ordinary], kind="stable")
        #: of each ordinary piece its place by score, and the ids in that order
        self.rank = np.empty(len(ordinary), np.int32)
        self.rank[best_first] = np.arange(len(ordinary))
        self.by_rank = np.array(ordinary, np.int64)[best_first]
        self.ids = np.array(ordinary, np.int64)
        self.longest = max(len(self.text[i]) for i in ordinary)
        self.length = np.array([len(self.text[i]) for i in ordinary], np.int64)
        self.codes = np.full((len(ordinary), self.longest), -1, np.int64)
        for row, i in zip(self.codes, ordinary):
            row[: len(self.text[i])] = [ord(c) for c in self.text[i]]
        #: no piece has a mark after another character, so units can be encoded alone
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in ordinary)

    def units(self, text: str) -> list[str]:
        """The marked text, cut before each mark that follows another character."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _UNIT.split(marked) if self.splits else [marked]

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, piece rows) of every occurrence of every piece, sorted by position."""
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.full(self.longest, -2, np.int64)])
        low, high = self._bound(padded, order, False), self._bound(padded, order, True)
        hits = high - low
        rows = np.repeat(np.arange(len(self.ids)), hits)
        starts = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        at = order[starts]
        by = np.argsort(at, kind="stable")
        return at[by], rows[by]

    def _bound(self, padded: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
        """For each piece the first suffix not below it, or not below and not prefixed by it."""
        lo = np.zeros(len(self.ids), np.int64)
        hi = np.full(len(self.ids), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            start = order[mid]
            sign = np.zeros(len(open_), np.int64)  # -1: the suffix is less
            left = np.arange(len(open_))
            for k in range(self.longest):
                left = left[self.length[open_[left]] > k]
                if not len(left):
                    break
                d = np.sign(padded[start[left] + k] - self.codes[open_[left], k])
                sign[left] = d
                left = left[d == 0]
            below = sign <= 0 if upper else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as little-endian 32-bit integers."""
        if not units:
            return []
        sizes = np.array([len(u) + 1 for u in units])
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes[starts + sizes - 1] = -3  # ends a unit; no piece holds it
        at, rows = self.occurrences(codes)
        # the sorted edges as a table: (start, length) -> rank of the piece, best first
        width = self.longest + 1
        edges = np.full(len(codes) * width, NONE, np.int32)
        edges[at * width + self.length[rows]] = self.rank[rows]
        long = sizes - 1 > LONG
        begin, size, unit = self._relax_together(edges, starts, sizes - 1, ~long)
        if long.any():
            parts = [self._relax_alone(edges, int(starts[k]), int(sizes[k]) - 1) for k in np.flatnonzero(long)]
            begin = np.concatenate([begin, *(p[0] for p in parts)])
            size = np.concatenate([size, *(p[1] for p in parts)])
            unit = np.concatenate([unit, np.repeat(np.flatnonzero(long), [len(p[0]) for p in parts])])
        by = np.argsort(begin, kind="stable")
        begin, size, unit = begin[by], size[by], unit[by]
        rank = edges[begin * width + size]
        ids = np.where(rank == NONE, self.unknown, self.by_rank[np.where(rank == NONE, 0, rank)]).astype("<i4")
        bare = np.flatnonzero(rank == NONE)
        if len(bare):  # characters without a piece become their bytes
            texts = [chr(c).encode("utf-8", "surrogatepass") for c in codes[begin[bare]].tolist()]
            many = np.ones(len(ids), np.int64)
            many[bare] = [len(t) for t in texts]
            to = np.cumsum(many) - many
            ids, unit = np.repeat(ids, many), np.repeat(unit, many)
            for k, t in zip(to[bare].tolist(), texts):
                ids[k : k + len(t)] = [self.byte_ids.get(x, self.unknown) for x in t]
        cuts = 4 * np.searchsorted(unit, np.arange(len(units) + 1))
        data, cuts = ids.tobytes(), cuts.tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _relax_together(self, edges: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols (begin, size, unit) of all chosen units; each round merges the best pair of every unit."""
        width = self.longest + 1
        which = np.flatnonzero(chosen)
        unit = np.repeat(which, sizes[which])
        begin = np.arange(len(unit)) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which]) + starts[unit]
        size = np.ones(len(unit), np.int64)
        done: list[tuple] = []
        while len(unit):
            both = size[:-1] + size[1:]
            fits = np.flatnonzero((unit[:-1] == unit[1:]) & (both <= self.longest))
            rank = np.full(len(unit), NONE, np.int32)
            rank[fits] = edges[begin[fits] * width + both[fits]]
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank, first)
            wide = np.repeat(best, np.diff(np.r_[first, len(unit)]))
            hit = np.flatnonzero((rank == wide) & (wide != NONE))
            hit = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]] if len(hit) else hit
            size[hit] += size[hit + 1]
            over = wide == NONE
            if over.any():
                done.append((begin[over], size[over], unit[over]))
            stay = ~over
            stay[hit + 1] = False
            begin, size, unit = begin[stay], size[stay], unit[stay]
        if not done:
            return begin, size, unit
        return tuple(np.concatenate(x) for x in zip(*done))

    def _relax_alone(self, edges: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (begin, size) of one long unit, by a queue of the pairs that are edges."""
        width = self.longest + 1

        def queue(i: int, a: int, b: int) -> None:
            if a + b < width and (r := int(edges[(start + i) * width + a + b])) != NONE:
                heapq.heappush(heap, (r, i, a, b))

        size, back, dead, heap = [1] * n, list(range(-1, n - 1)), [False] * n, []
        for i in range(n - 1):
            queue(i, 1, 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j, k = i + a, i + a + b
            if dead[i] or size[i] != a or dead[j] or size[j] != b:
                continue
            size[i] = a + b
            dead[j] = True
            if k < n:
                back[k] = i
                queue(i, a + b, size[k])
            if (p := back[i]) >= 0:
                queue(p, size[p], a + b)
        kept = [i for i in range(n) if not dead[i]]
        return np.array(kept, np.int64) + start, np.array([size[i] for i in kept], np.int64)

    def decode(self, ids) -> str:
        """The text of ids: marks become spaces, the first one goes, bytes are joined."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes batches; units seen before keep their ids (bounded)."""

    def __init__(self, model: PieceModel):
        self.model, self.known, self.held = model, {}, 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        cut = [self.model.units(t or "") for t in texts]
        new = {u for units in cut for u in units if u not in known}
        self.held += sum(map(len, new))
        if len(known) + len(new) > KEPT or self.held > KEPT_CHARACTERS:
            known.clear()
            self.held = sum(map(len, new))
            new = {u for units in cut for u in units}
        group, held = [], 0
        for u in new:
            group.append(u)
            held += len(u) + 1
            if held >= INDEXED:
                self._index(group)
                group, held = [], 0
        self._index(group)
        return [np.frombuffer(b"".join([known[u] for u in units]), "<i4") for units in cut]

    def _index(self, units: list[str]) -> None:
        for u, ids in zip(units, self.model.encode_units(units)):
            self.known[u] = ids


#: Rows whose new units share a suffix array.
BATCH = 2000


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; null or empty text has no ids."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(piece_model(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ids; null ids give an empty text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, restored): encoded, decoded and compared in one pass.

    ``ids_crc32`` is the unsigned CRC-32 of the little-endian 32-bit ids.  Null text is
    empty text; null and repeated ids keep their rows; other columns are ignored.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        encoder = Encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = part.column(1).to_pylist()
                ids = encoder.encode(texts)
                same = [model.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "restored"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, restored boolean")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
