"""Aggregates that depend on encounter order, given as a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(value: str, seq: str) -> Column:
    """The first value that isn't null."""
    return F.expr(f"min_by(`{value}`, `{seq}`) FILTER (WHERE `{value}` IS NOT NULL)")


def last_known(value: str, seq: str) -> Column:
    return F.expr(f"max_by(`{value}`, `{seq}`) FILTER (WHERE `{value}` IS NOT NULL)")


def ordered_union(value: str, seq: str) -> Column:
    """Distinct values in order of first encounter; ``value`` is a scalar or an array."""
    pairs = F.array_sort(F.expr(f"collect_list(struct(`{seq}` AS s, `{value}` AS v)) FILTER (WHERE `{value}` IS NOT NULL)"))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def ordered_union_arrays(value: str, seq: str) -> Column:
    pairs = F.array_sort(F.expr(f"collect_list(struct(`{seq}` AS s, `{value}` AS v)) FILTER (WHERE `{value}` IS NOT NULL)"))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: p["v"])))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; null keys are equal."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_map_entries(df: DataFrame, key: str, entries: str, seq: str, name: str = "entries") -> DataFrame:
    """``key`` and a map in which every entry has its first value."""
    flat = df.select(key, seq, F.explode(entries).alias("k", "v"))
    each = flat.groupBy(key, "k").agg(F.min_by("v", seq).alias("v"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))


def top_one(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``first_per_key``, by aggregation: only ``columns`` survive, and hot keys are reduced on the map side."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")
