"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes a trie.  Every node has a failure link to the node of what is
left after the longest matching pieces of its string are taken, and the count of the
pieces so popped.  One pass over a word adds the popped counts along failure links
and never builds a piece.  A character that no piece starts with costs its UTF-8
bytes, as under byte fallback.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked

MARK = "▁"


class LongestMatch:
    """Trie with failure links; ``count(word)`` is the number of greedy pieces of ``word``."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        order = [(0, -1, "")]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = to
            if at:
                final[at] = True
        n = len(self.next)
        #: where matching goes on when a node has no child, and the pieces popped on the way
        self.fail, self.pops = [0] * n, [0] * n
        for at, parent, c in order:
            if parent >= 0:
                if final[at]:
                    self.pops[at] = 1
                else:
                    self.fail[at], self.pops[at] = self._move(self.fail[parent], c, self.pops[parent]) if parent else (0, len(c.encode("utf-8", "surrogatepass")))
            order += [(to, at, c) for c, to in self.next[at].items()]

    def _move(self, at: int, c: str, count: int) -> tuple[int, int]:
        """Read ``c`` from ``at`` with ``count`` pieces popped so far."""
        while True:
            to = self.next[at].get(c)
            if to is not None:
                return to, count
            if at == 0:
                return 0, count + len(c.encode("utf-8", "surrogatepass"))
            count += self.pops[at]
            at = self.fail[at]

    def count(self, word: str) -> int:
        at, count = 0, 0
        moves, move = self.next, self._move
        for c in word:
            to = moves[at].get(c)
            if to is None:
                at, count = move(at, c, count)
            else:
                at = to
        while at:
            count += self.pops[at]
            at = self.fail[at]
        return count


@functools.cache
def automaton(path: str) -> LongestMatch:
    """The automaton of a SentencePiece model's ordinary pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return LongestMatch(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def count_words(text: str | None, counts: dict[str, int]) -> tuple[int, int]:
    words = text.split() if text else []
    return len(words), sum([counts[w] for w in words])


class _Counts(dict):
    """Counts of words seen, bounded in entries and in characters."""

    def __init__(self, machine: LongestMatch):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(MARK + word)
        if len(word) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) over whole texts.

    Null, empty or blank text counts 0; null and repeated ids keep their rows; other
    columns are ignored; an empty table gives no row.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(automaton(path))
        for batch in batches:
            rows = [count_words(t.as_py(), counts) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
