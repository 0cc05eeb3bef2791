"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of
    its component. ``links`` has columns u and v; loops and repeats don't matter.

    Each round is written to the shared folder; hubs are settled by partial
    aggregation and by joins whose large keys Spark can split."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = checkpointed(links.where("u <> v").select(u.alias("u"), v.alias("v")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
