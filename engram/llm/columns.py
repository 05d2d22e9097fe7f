"""Columns by place: tables whose column names clash, or differ in case only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... in their order."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def name_of(df: DataFrame, column: str) -> str:
    """The name in ``numbered(df)`` of the column called exactly ``column``, or else in another case."""
    names = df.columns
    if column not in names:
        lower = [n.lower() for n in names]
        if column.lower() not in lower:
            raise ValueError(f"no column {column} in {names}")
        return f"c{lower.index(column.lower())}"
    return f"c{names.index(column)}"


def picked(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """New columns from named ones: ``picked(df, doc_id=("id", "long"))``."""
    return numbered(df).select(*[F.col(name_of(df, old)).cast(kind).alias(new) for new, (old, kind) in columns.items()])
