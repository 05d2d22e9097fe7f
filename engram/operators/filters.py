"""The JSON filter language, compiled to one Spark Column.

``{"and": [...]}``, ``{"or": [...]}`` or a flat object (implicit AND).  A field maps to
a scalar (equality) or to one ``{operator: value}``.  Combinators don't nest.  Several
fields of one item under ``or`` are alternatives of their own (``strict_or=True``
keeps them together).
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a filter may name.
FIELDS = frozenset(
    "id key tags type usage memory status sources user_id graph_id user_name background confidence created_at session_id updated_at file_ids".split()
)
ARRAYS = frozenset(("tags", "sources", "file_ids"))
TIMES = frozenset(("created_at", "updated_at"))
OPERATORS = frozenset(("=", "gt", "lt", "gte", "lte", "in", "contains", "like"))
_FIELD = re.compile(r"(info\.)?[A-Za-z_][A-Za-z0-9_]*\Z")
_CUBE = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")


class FilterError(ValueError):
    """A filter that the language doesn't allow."""


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any

    @property
    def is_array(self) -> bool:
        return self.field.removeprefix("info.") in ARRAYS

    @property
    def is_time(self) -> bool:
        return self.field.removeprefix("info.") in TIMES


@dataclass(frozen=True)
class Filter:
    """``groups`` are joined by ``how``; the conditions of a group by AND."""

    how: str
    groups: tuple[tuple[Condition, ...], ...]


def _value(v: Any, allow_list: bool = False) -> Any:
    if isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            raise FilterError("NaN and Inf are not supported")
        return int(v) if v == int(v) and abs(v) < 2**63 else v
    if isinstance(v, list) and allow_list:
        return tuple(_value(x) for x in v)
    raise FilterError(f"unsupported value {v!r}")


def _condition(field: str, raw: Any) -> Condition:
    if not isinstance(field, str) or not _FIELD.match(field):
        raise FilterError(f"invalid field name {field!r}")
    if not field.startswith("info.") and field not in FIELDS:
        raise FilterError(f"unknown field {field!r}")
    if isinstance(raw, dict):
        if len(raw) != 1:
            raise FilterError(f"{field}: one operator is needed")
        ((op, v),) = raw.items()
        op = op.lower()
        if op not in OPERATORS:
            raise FilterError(f"{field}: unknown operator {op!r}")
        return Condition(field, op, _value(v, op == "in"))
    return Condition(field, "=", _value(raw))


def parse(raw: dict | str | None, strict_or: bool = False) -> Filter | None:
    """The filter of a JSON object or text; None for an empty one."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise FilterError(str(e)) from e
    if raw is None or raw == {}:
        return None
    if not isinstance(raw, dict):
        raise FilterError("a filter is an object")
    how = [k for k in ("or", "and") if k in raw]
    if not how:
        return Filter("and", tuple((_condition(k, v),) for k, v in raw.items()))
    if len(raw) > 1:
        raise FilterError("a combinator must be the only key")
    items = raw[how[0]]
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        raise FilterError(f"'{how[0]}' must be a list of objects")
    if any(k in ("or", "and") for x in items for k in x):
        raise FilterError("nested combinators are not supported")
    groups = [tuple(_condition(k, v) for k, v in x.items()) for x in items]
    if not strict_or:
        groups = [(c,) for g in groups for c in g]
    return Filter(how[0], tuple(g for g in groups if g))


def _field(c: Condition, prefix: str) -> Column:
    if c.field.startswith("info."):
        return F.col(f"{prefix}info")[c.field[5:]]
    return F.col(prefix + {"type": "memory_type"}.get(c.field, c.field))


def _text(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def _compile(c: Condition, prefix: str) -> Column:
    col = _field(c, prefix)
    info = c.field.startswith("info.")
    lit = lambda v: F.lit(_text(v)) if info else F.lit(v)  # noqa: E731  info holds text
    if c.op == "=":
        return col == F.array(F.lit(_text(c.value))) if c.is_array and not info else col == lit(c.value)
    if c.op in ("gt", "lt", "gte", "lte"):
        right = F.to_timestamp(F.lit(c.value)) if c.is_time else F.lit(c.value)
        if info and not c.is_time and not isinstance(c.value, str):
            col = F.expr(f"try_cast({prefix}info['{c.field[5:]}'] AS DOUBLE)")
        return {"gt": col > right, "lt": col < right, "gte": col >= right, "lte": col <= right}[c.op]
    if c.op == "contains":
        return F.array_contains(col, _text(c.value)) if not info else F.coalesce(F.array_contains(F.from_json(col, "array<string>"), _text(c.value)), F.lit(False))
    if c.op == "in":
        if not c.value:
            return F.lit(False)
        if c.is_array and not info:
            return F.arrays_overlap(col, F.array(*[F.lit(_text(v)) for v in c.value]))
        return col.isin(*[_text(v) if info else v for v in c.value])
    text = F.to_json(col) if c.is_array and not info else col.cast("string")
    return text.contains(_text(c.value))


def compile_filter(f: Filter | dict | str | None, prefix: str = "", strict_or: bool = False) -> Column:
    """The predicate; true for an empty filter.  Values become literals, never SQL text."""
    f = f if isinstance(f, Filter) or f is None else parse(f, strict_or)
    if f is None or not f.groups:
        return F.lit(f is None or f.how == "and")
    each = [reduce(lambda a, b: a & b, [_compile(c, prefix) for c in g]) for g in f.groups]
    return reduce((lambda a, b: a | b) if f.how == "or" else (lambda a, b: a & b), each)


def valid_cube(name: str) -> bool:
    return bool(_CUBE.match(name))


def check_delete(cubes: list[str], f: Filter | None) -> None:
    """A delete by filter names at least one valid cube and one condition."""
    if not cubes or not all(map(valid_cube, cubes)):
        raise FilterError("at least one valid cube id is needed")
    if f is None or not f.groups:
        raise FilterError("at least one condition is needed")


def scope(cubes: list[str] | str, users: str | None = None, types: list[str] | None = None, agent: str = "", need_vector: bool = False, as_of=None, days: int = 0) -> Column:
    """The predicate of every search: active rows of the cubes, person, types and agent."""
    cubes = [cubes] if isinstance(cubes, str) else list(cubes)
    out = (F.col("status") == "activated") & F.col("user_name").isin(*cubes)
    if users:
        out = out & (F.col("user_id") == users)
    if types:
        out = out & F.col("memory_type").isin(*types)
    if agent:
        out = out & (F.col("agent_id") == agent)
    if need_vector:
        out = out & F.col("embedding").isNotNull()
    if days and as_of is not None:
        out = out & (F.col("created_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return out
