"""Row numbers of long lists, without one task a list.

Rows are dealt into ranges of (list, order) by sampled boundaries, so a list that is
most of the table is many ranges.  A range is numbered by itself; the rows that the
list has in earlier ranges are added from a table of counts, one row a list and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.session import materialize


def ranges(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...], parts: int | None = None) -> DataFrame:
    """``rows`` written by range, with the number of their range as ``__range``."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    # written, so that a range's number stays when a task is run again
    return materialize(rows.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges")


def row_numbers(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...], out: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with the 1-based number ``out`` inside each list of the columns ``by``, as row_number() gives it.

    ``order`` should end on a key, as rows that tie are numbered in any order.  Null is a
    value of ``by`` like others; an empty table gives no row.
    """
    t = ranges(rows, by, order, parts)
    counts = t.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a list and range that holds some of it: lists and ranges together at most
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), "__before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)] + [F.col("__range") == F.col("__r")])
    local = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    t = t.withColumn("__local", local).join(offsets, same)
    return t.select(*rows.columns, (F.col("__local") + F.col("__before")).alias(out))
