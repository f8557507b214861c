"""Segmentation of ordered lines by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented(lines: DataFrame, keys: list[str], order: str, starts: Column, name: str) -> DataFrame:
    """Number the segments of each group: one begins at each line where ``starts`` holds; lines before the first go."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(starts.cast("long")).over(w)).where(F.col(name) > 0)


def joined_lines(line: str, order: str, when: Column, sep: str = "\n") -> Column:
    """An aggregate: the non-blank lines where ``when`` holds, in order, joined."""
    kept = F.collect_list(F.when(when & (F.trim(line) != ""), F.struct(order, line)))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x[line]), sep)
