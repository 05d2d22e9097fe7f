"""Secret scanning with one combined deterministic automaton.

All rule expressions are compiled together: parsed, reversed, joined in one
Thompson automaton, made deterministic by subset construction over byte classes
and minimised by partition refinement into one transition array.  A single pass
over the bytes of a text, from its end to its start, visits every rule at once and
yields the positions where a match of some rule starts.  From such a start the
rule's own small anchored automaton reads the longest match, so matches are the
leftmost, non-overlapping ones of each kind.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked


@dataclass(frozen=True)
class Rule:
    """``head`` + ``body``, and ``tail``, which may match nothing; a match counts if its body (or all of it, without a head) has ``least`` characters.

    Syntax: literals, ``\\xHH`` and escaped characters, ``[...]`` with ranges and ``^``,
    groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``.  ASCII letters of ``head``
    match in either case if ``any_case``.
    """

    kind: str
    body: str
    least: int
    head: str = ""
    any_case: bool = False
    tail: str = ""


#: The base kinds, in the order that ties follow.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 12, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
#: A line break of a key, also an escaped one, or spaces where a key is put on one line.
_BREAK = r"(\x0d?\x0a[\x20\x09]*|\\n|\x20+)"
#: A key below its BEGIN line: headers, base64 lines and the END line.  Without that
#: line the body ends with the last long base64 line, or a short one that is padded.
_KEY_BODY = (
    rf"(({_BREAK}(Proc-Type|DEK-Info):[\x20-~]*)+{_BREAK})?({_BREAK}[A-Za-z0-9+/=]{{16,}})*"
    rf"({_BREAK}[A-Za-z0-9+/]+=+|({_BREAK}[A-Za-z0-9+/=]+)?{_BREAK}-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----)?"
)
#: What the operator finds besides.
MORE = (
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 1, tail=_KEY_BODY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),
    Rule("git_token", r"(ghp|gho|ghu|ghs|ghr|glpat)[_-][A-Za-z0-9_-]+", 24),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("pay_key", r"(sk|rk|pk)_(live|test)_[A-Za-z0-9]+", 24),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$*+=-]+@", 8),
)


class _Parser:
    """Recursive descent to ('set', bytes) | ('cat', ...) | ('alt', ...) | ('rep', node, low, high)."""

    def __init__(self, text: str, any_case: bool):
        self.s, self.i, self.any_case = text, 0, any_case

    def alternatives(self):
        parts = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, node):
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.s.index("}", self.i)
                a, comma, b = self.s[self.i : end].partition(",")
                low, high = int(a), (int(b) if b else None if comma else int(a))
                self.i = end + 1
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.bracket())
        return ("set", self.cased({self.char()}))

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def bracket(self) -> frozenset:
        self.i += 1
        negated = self.s[self.i] == "^"
        self.i += negated
        got: set[int] = set()
        while self.s[self.i] != "]":
            a = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                got |= set(range(a, self.char() + 1))
            else:
                got.add(a)
        self.i += 1
        return frozenset(range(256)) - self.cased(got) if negated else self.cased(got)

    def cased(self, got) -> frozenset:
        if self.any_case:
            got = {y for x in got for y in ((x, x ^ 32) if chr(x).isascii() and chr(x).isalpha() else (x,))}
        return frozenset(got)


def parse(pattern: str, any_case: bool = False):
    return _Parser(pattern, any_case).alternatives()


def mirrored(node):
    """The expression of the reversed strings."""
    match node[0]:
        case "set":
            return node
        case "cat":
            return ("cat", *(mirrored(x) for x in reversed(node[1:])))
        case "alt":
            return ("alt", *(mirrored(x) for x in node[1:]))
    return ("rep", mirrored(node[1]), node[2], node[3])


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, at: int) -> int:
        """Build ``node`` from state ``at``; the state after it."""
        match node[0]:
            case "set":
                end = self.state()
                self.moves[at].append((node[1], end))
                return end
            case "cat":
                for x in node[1:]:
                    at = self.add(x, at)
                return at
            case "alt":
                end = self.state()
                for x in node[1:]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(x, start)].append(end)
                return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[at].append(end)
        for _ in range(high - low):
            at = self.add(inner, at)
            self.free[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for y in self.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state + byte]`` is the next state; states are multiples of 256, 0 the start.

    States from ``accepting`` on accept; ``kinds[state >> 8]`` are the rule numbers.
    ``dead`` (or -1) is the state that no accepting state follows.
    """

    table: list[int]
    accepting: int
    kinds: list[tuple[int, ...]]
    dead: int


def compile_rules(nodes: list, unanchored: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation, of all expressions together."""
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    for rule, node in enumerate(nodes):
        first = nfa.state()
        nfa.free[start].append(first)
        ends[nfa.add(node, first)] = rule
    # bytes that no expression tells apart form one class
    sets = {s for m in nfa.moves for s, _ in m}
    marks: dict[tuple, list[int]] = {}
    for b in range(256):
        marks.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(marks.values())
    begin = nfa.closure([start])
    found, rows = {begin: 0}, []
    order = [begin]
    for states in order:
        row = []
        for c in classes:
            to = nfa.closure({y for x in states for s, y in nfa.moves[x] if c[0] in s})
            if unanchored:
                to |= begin
            if to not in found:
                found[to] = len(order)
                order.append(to)
            row.append(found[to])
        rows.append(row)
    accept = [tuple(sorted({ends[x] for x in s if x in ends})) for s in order]
    # refine the partition by acceptance until no class is split
    block = {k: i for i, k in enumerate(sorted(set(accept)))}
    part = [block[a] for a in accept]
    while True:
        keys = [(part[i], *(part[x] for x in rows[i])) for i in range(len(rows))]
        ids: dict[tuple, int] = {}
        new = [ids.setdefault(k, len(ids)) for k in keys]
        if len(ids) == len(set(part)):
            break
        part = new
    first_of = {p: i for i, p in reversed(list(enumerate(part)))}
    ranked = sorted(first_of, key=lambda p: (bool(accept[first_of[p]]), part[0] != p))
    if accept[0]:
        raise ValueError("a rule matches the empty text")
    number = {p: i for i, p in enumerate(ranked)}
    table = [0] * (256 * len(ranked))
    for p, i in number.items():
        for c, to in zip(classes, rows[first_of[p]]):
            for b in c:
                table[256 * i + b] = 256 * number[part[to]]
    kinds = [accept[first_of[p]] for p in ranked]
    n_plain = sum(not k for k in kinds)
    dead = next((256 * i for i in range(n_plain) if all(x == 256 * i for x in table[256 * i : 256 * i + 256])), -1)
    return Dfa(table, 256 * n_plain, kinds, dead)


class Scanner:
    """All rules compiled; ``spans(text)`` gives (start, end, rule number) in code points."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [("cat", parse(r.head, r.any_case), parse(r.body)) for r in rules]
        self.backward = compile_rules([mirrored(x) for x in whole], True)
        # tails don't move a start, so only the automata that read the ends have them
        self.forward = [compile_rules([("cat", x, parse(r.tail)) if r.tail else x], False) for x, r in zip(whole, rules)]
        self.heads = [compile_rules([parse(r.head, r.any_case)], False) if r.head else None for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, state) of every start of a match, last first: the one byte pass."""
        table, accepting, state, found = self.backward.table, self.backward.accepting, 0, []
        at = len(data)
        for byte in reversed(data):
            at -= 1
            state = table[state + byte]
            if state >= accepting:
                found.append((at, state))
        return found

    @staticmethod
    def longest(dfa: Dfa, data: bytes, at: int) -> int:
        """The end of the longest match from ``at``; ``at`` if there is none."""
        table, accepting, dead, state, end = dfa.table, dfa.accepting, dfa.dead, 0, at
        for i in range(at, len(data)):
            state = table[state + data[i]]
            if state >= accepting:
                end = i + 1
            elif state == dead:
                break
        return end

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found, free = [], [0] * len(self.rules)
        for at, state in reversed(self.starts(data)):
            for rule in self.backward.kinds[state >> 8]:
                if at < free[rule]:
                    continue
                end = free[rule] = self.longest(self.forward[rule], data, at)
                head = self.heads[rule]
                body = self.longest(head, data, at) if head else at
                if end - body >= self.rules[rule].least:
                    found.append((at, end, rule))
        if found and len(data) != len(text):
            cuts = sorted({x for s in found for x in s[:2]})
            points, at, seen = {}, 0, 0
            for x in cuts:
                seen += len(data[at:x].decode("utf-8", "surrogatepass"))
                points[x] = seen
                at = x
            found = [(points[a], points[b], r) for a, b, r in found]
        return sorted(found, key=lambda s: (s[0], s[2], s[1]))


@functools.cache
def scanner(rules: tuple[Rule, ...] = BASE + MORE) -> Scanner:
    return Scanner(rules)


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], only: int | None = None) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, b, r in spans if only is None or r < only)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<kind,start,end>>) for every row.

    Null or empty text has no span; null and repeated ids keep their rows; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in s.spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    rules = BASE + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            rows = [s.spans(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(r == k for *_, r in x) for x in rows], pa.int64()) for k in range(len(BASE))]
            hashed = [hashlib.sha256(joined(x, rules, len(BASE)).encode()).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(hashed, pa.string()), pa.array([joined(x, rules) for x in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; ``length_col`` is counted again where the text changed.

    Overlapping spans get one mark.  Null and empty texts, null and repeated ids and
    all other columns, whatever their names, stay as they are; an empty table gives no row.
    """
    rules, names = BASE + MORE, docs.columns
    at = names.index(text_col)
    size = names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            texts, lengths = batch.column(at).to_pylist(), batch.column(size).to_pylist() if size is not None else []
            for i, text in enumerate(texts):
                spans = s.spans(text)
                if spans:
                    out, upto = [], 0
                    for a, b, _ in spans:
                        if b > upto:
                            if a >= upto:
                                out += [text[upto:a], mark]
                            upto = b
                    texts[i] = "".join([*out, text[upto:]])
                    if size is not None:
                        lengths[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                arrays[size] = pa.array(lengths, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
