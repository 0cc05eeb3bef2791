"""Lookup caches: layers of files, upserts, suggestions and a stable dump."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import first_per_key


def later_wins(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """The last layer that has a key gives its row; rows without a key are skipped."""
    every = reduce(DataFrame.unionByName, [d.withColumn("_prio", F.lit(i)) for i, d in enumerate(layers)])
    return first_per_key(every.where(F.col(key).isNotNull()), [key], [F.col("_prio").desc()]).drop("_prio")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, key, [F.col(c).desc() for c in order])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows stay; a new row's known values overwrite."""
    values = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in values])
    out = old.join(n, F.col(key) == F.col("_key"), "full")
    return out.select(F.coalesce("_key", key).alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def suggestions(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Candidates whose key isn't there yet, case-insensitively."""
    return candidates.join(existing.select(F.lower(key).alias("_k")).distinct(), F.lower(key) == F.col("_k"), "left_anti")


def unknown_keys(curated: DataFrame, known: DataFrame, key: str) -> DataFrame:
    hit = suggestions(curated, known, key)
    return hit.select(F.lit("curated_key_unknown").alias("code"), F.col(key).alias("subject"), F.lit("no component has this key").alias("detail"))


def dump(df: DataFrame, key: str) -> str:
    """JSON with sorted keys; the cache is a dimension table that the driver writes as one file."""
    rows = {r[key]: {k: v for k, v in r.asDict().items() if k != key and v is not None} for r in df.toLocalIterator()}
    return json.dumps(rows, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def warning_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
