"""Exact percentiles of whole columns and large groups with bounded memory.

``percentile`` holds every distinct value of a group in one aggregation buffer. That is right for the values of one
source; for a whole column or a few large groups this module narrows the range that holds the wanted ranks instead: each pass counts
the rows in CELLS equal cells of every open range at once, until a cell has so few rows that they can be sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.expr import finite

CELLS = 1024
#: Values that visit the driver at once, at most, over all ranges.
FEW = 20_000


def _ranges(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """A small literal table of open ranges: i, k, low, high."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("rk"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (k, low, high) in enumerate(rows)]
    return F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*cells))))


def grouped_percentiles(df: DataFrame, group: str, value: str, marks: list[float], few: int = FEW) -> dict:
    """Linear-interpolation percentiles of ``value`` for each of a bounded number of groups; nulls, NaN and infinities don't count."""
    rows = df.select(F.col(group).alias("k"), finite(value).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    ends = {r["k"]: r for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    wanted = {(k, int(x)) for k, e in ends.items() for m in marks for x in (math.floor(m * (e["n"] - 1)), math.ceil(m * (e["n"] - 1)))}
    found: dict[tuple, float] = {}
    # open ranges: group, low, high (both included), rows below low, rows inside
    todo = [(k, e["a"], e["b"], 0, e["n"]) for k, e in ends.items()]
    while todo:
        share, narrow, wide = max(1, few // len(todo)), [], []
        for k, low, high, below, n in todo:
            if low == high:
                found |= {(k, r): low for g, r in wanted if g == k and below <= r < below + n}
            else:
                # a range of so few steps of the number format has no more values than cells
                (narrow if n <= share or (high / 2 - low / 2) / CELLS < 4 * math.ulp(max(abs(low), abs(high))) else wide).append((k, low, high, below))
        met = lambda part: rows.join(_ranges(df, [x[:3] for x in part]), (F.col("k") == F.col("rk")) & F.col("v").between(F.col("low"), F.col("high")))
        if narrow:
            at = {i: x[3] for i, x in enumerate(narrow)}
            for row in met(narrow).groupBy("i", "v").count().orderBy("i", "v").collect():
                i, k = row["i"], narrow[row["i"]][0]
                found |= {(g, r): row["v"] for g, r in wanted if g == k and at[i] <= r < at[i] + row["count"]}
                at[i] += row["count"]
        todo = []
        if wide:
            cell = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / ((F.col("high") / 2 - F.col("low") / 2) / CELLS)), F.lit(CELLS - 1))
            at = {i: x[3] for i, x in enumerate(wide)}
            for row in met(wide).groupBy("i", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i", "cell").collect():
                i, k = row["i"], wide[row["i"]][0]
                if any(g == k and (g, r) not in found and at[i] <= r < at[i] + row["n"] for g, r in wanted):
                    todo.append((k, row["a"], row["b"], at[i], row["n"]))
                at[i] += row["n"]
    out = {}
    for k, e in ends.items():
        x = [m * (e["n"] - 1) for m in marks]
        ab = [(found[k, math.floor(p)], found[k, math.ceil(p)]) for p in x]
        out[k] = [a + (b - a) * (p - math.floor(p)) if a != b else a for p, (a, b) in zip(x, ab, strict=True)]
    return out


def exact_percentiles(df: DataFrame, columns: list[str], marks: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """The same for whole columns; a column without values gives nulls."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), finite(c).alias("v")) for k, c in enumerate(columns)])))
    found = grouped_percentiles(long, "k", "v", marks, few)
    return {c: found.get(k, [None] * len(marks)) for k, c in enumerate(columns)}
