"""Segmentation by carried state: blocks and continuation lines as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, part: str, order: str, starts: Column, out: str = "block") -> DataFrame:
    """Number of the block that a row belongs to: a row for which ``starts`` holds opens one."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def joined_lines(df: DataFrame, part: str, order: str, text: str) -> DataFrame:
    """Logical lines: a line that ends in a backslash goes on in the next one."""
    continued = F.col(text).endswith("\\")
    before = F.coalesce(F.lag(continued).over(Window.partitionBy(part).orderBy(order)), F.lit(False))
    marked = blocks(df.withColumn("_before", before), part, order, ~F.col("_before"), "line_group")
    body = F.regexp_replace(F.col(text), r"\\$", "")
    rows = marked.groupBy(part, "line_group").agg(F.min(order).alias("first_line"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("t")))).alias("ls"))
    return rows.select(part, "line_group", "first_line", F.array_join(F.transform("ls", lambda x: x["t"]), "").alias("logical"))


def last_header(df: DataFrame, part: str, order: str, header: Column, out: str) -> DataFrame:
    """The last header at or before each row."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(header, ignorenulls=True).over(w))


def near_after(text: Column, offset: Column, needle: str, width: int = 1500) -> Column:
    """Whether ``needle`` is within ``width`` characters from the offset on."""
    return F.substring(text, offset, F.lit(width)).contains(needle)
