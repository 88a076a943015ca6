"""Positions and running totals in a total order of all rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.storage import durable

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """``df`` with each row's position (from 0) in the order given, which should be total.

    Rows are dealt to ranges and sorted there; only the number of rows of each range meets in one place.
    """
    at, part = f"_at_{name}", f"_part_{name}"
    ranges = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    ranges = ranges.withColumn(part, F.shiftright(at, ROW_BITS))
    sizes = ranges.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part)) - F.col("_n")
    offsets = sizes.select(part, before.alias(f"_before_{name}"))
    out = ranges.join(F.broadcast(offsets), part)
    return out.withColumn(name, F.col(f"_before_{name}") + F.col(at).bitwiseAND((1 << ROW_BITS) - 1)).drop(at, part, f"_before_{name}")


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each one; ``order`` is a distinct whole number from 0.

    Totals of runs of ``width`` numbers are summed first, so one task sees a ``width``-th of the numbers.
    """
    run, before = f"_run_{name}", f"_before_{name}"
    rows = df.withColumn(run, F.floor(F.col(order) / width))
    totals = rows.groupBy(run).agg(F.sum(value).alias("_n"))
    offsets = totals.select(run, (F.sum("_n").over(Window.orderBy(run)) - F.col("_n")).alias(before))
    inside = F.sum(value).over(Window.partitionBy(run).orderBy(order))
    return rows.withColumn(name, inside).join(offsets, run).withColumn(name, F.col(name) + F.col(before)).drop(run, before)
