"""Typed edges: identities, duplicates, roll-ups and emission order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import first_per_key, ordered_union

SEMANTIC = ("root", "from_kind", "from_id", "to_kind", "to_id", "relation", "usage_scope", "reachability")
EXACT = (*SEMANTIC, "source_file", "source_revision")
PYTHON = ("from_id", "to_id", "relation", "usage_scope")


def deduplicate(edges: DataFrame, key: Sequence[str] = SEMANTIC, seq: str = "seq") -> DataFrame:
    """Without self-loops, the first edge of each key; nulls in keys are equal."""
    loop = F.col("from_kind").eqNullSafe(F.col("to_kind")) & F.col("from_id").eqNullSafe(F.col("to_id"))
    return first_per_key(edges.where(~loop), list(key), [seq])


def depends_on(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """name and the distinct components it leads to, in order."""
    own = edges.where("from_kind = 'component' AND to_kind = 'component' AND from_id <> to_id")
    return own.groupBy(F.col("from_id").alias("name")).agg(ordered_union("to_id", seq).alias("depends_on"))


def emission_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.coalesce("root", F.lit("")), "from_kind", "from_id", "to_kind", "to_id", "relation")
