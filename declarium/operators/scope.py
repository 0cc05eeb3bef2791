"""Filters over the usage scope, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ordered_union

SCOPES = ("runtime", "build", "test", "dev", "docs", "example", "optional", "environment")
ROLES = ("primary", "sibling_artifact", "cmake_project", "unclassified", "example", "manual_example", "st_test", "experimental", "non_distributable_test")


def drops(scope: Column, excluded: Iterable[str] = (), keep_only: Iterable[str] | None = None) -> Column:
    """Exclusion never drops a null scope; keep-only always does."""
    excluded = list(excluded)
    out = F.coalesce(scope.isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    return out if keep_only is None else out | ~F.coalesce(scope.isin(*list(keep_only)), F.lit(False))


def preset(name: str) -> tuple[set[str], set[str] | None, set[str], bool]:
    """(excluded scopes, kept scopes, excluded roles, without tools) of a view."""
    if name == "all":
        return set(), None, set(), False
    if name == "release":
        return set(SCOPES) - {"runtime", "optional"}, {"runtime"}, {"example", "manual_example", "st_test", "experimental", "non_distributable_test"}, True
    raise ValueError(f"no such view: {name}")


def excluded_token(token: str) -> tuple[str | None, str | None]:
    """(role, scope) that a token of an exclusion list names."""
    t = token.strip().lower().replace("-", "_")
    found = (t if t in ROLES else None, t if t in SCOPES else None)
    if found == (None, None):
        raise ValueError(f"neither a role nor a scope: {token}")
    return found


def filter_observations(observations: DataFrame, excluded: Iterable[str] = (), keep_only: Iterable[str] | None = None, scope: str = "usage_scope") -> DataFrame:
    return observations.where(~drops(F.col(scope), excluded, keep_only))


def apply(components: DataFrame, observations: DataFrame, edges: DataFrame, excluded: Iterable[str] = (), keep_only: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Components that still have observations, with their scopes and depends_on
    made anew; surviving observations and edges; one warning with three counts.

    A component without any observation goes too, as does every edge at a dropped one."""
    excluded, keep = list(excluded), None if keep_only is None else sorted(keep_only)
    kept = filter_observations(observations, excluded, keep)
    scopes = kept.groupBy("component").agg(ordered_union("usage_scope", "seq").alias("scopes"))
    stay = components.drop("scopes").join(scopes, F.col("name") == F.col("component")).drop("component")
    gone = components.join(scopes, F.col("name") == F.col("component"), "left_anti").select(F.col("name").alias("gone"))
    if "depends_on" in components.columns:
        flat = stay.select("name", F.posexplode("depends_on").alias("k", "target")).join(gone, F.col("target") == F.col("gone"), "left_anti")
        pruned = flat.groupBy(F.col("name").alias("p_name")).agg(ordered_union("target", "k").alias("pruned"))
        empty = F.array().cast("array<string>")
        stay = stay.join(pruned, F.col("name") == F.col("p_name"), "left").withColumn("depends_on", F.coalesce("pruned", empty)).drop("p_name", "pruned")
    left = edges.where(~drops(F.col("usage_scope"), excluded, keep))
    for side in ("from", "to"):
        left = left.join(gone, (F.col(f"{side}_kind") == "component") & (F.col(f"{side}_id") == F.col("gone")), "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    numbers = count(observations, "a").crossJoin(count(kept, "b")).crossJoin(count(gone, "c")).crossJoin(count(edges, "d")).crossJoin(count(left, "e"))
    detail = F.format_string("scope filter dropped %d observations, %d components, %d edges", F.col("a") - F.col("b"), F.col("c"), F.col("d") - F.col("e"))
    warning = numbers.select(F.lit("excluded_scope").alias("code"), F.lit(None).cast("string").alias("subject"), detail.alias("detail"))
    return stay, kept, left, warning
