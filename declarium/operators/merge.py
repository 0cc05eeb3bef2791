"""Merging rows of one component into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import first_known, first_map_entries, ordered_union, ordered_union_arrays


def merge_by(
    df: DataFrame,
    key: str,
    seq: str,
    first: Sequence[str] = (),
    unions: Sequence[str] = (),
    array_unions: Sequence[str] = (),
    any_of: Sequence[tuple[str, Column]] = (),
    maps: Sequence[str] = (),
) -> DataFrame:
    """A row for each key: position (of its first row), first known scalars,
    ordered unions, dominating flags and maps whose entries keep their first value."""
    aggregates = [F.min(seq).alias("position")]
    aggregates += [first_known(c, seq).alias(c) for c in first]
    aggregates += [ordered_union(c, seq).alias(c) for c in unions]
    aggregates += [ordered_union_arrays(c, seq).alias(c) for c in array_unions]
    aggregates += [F.coalesce(F.bool_or(condition), F.lit(False)).alias(name) for name, condition in any_of]
    out = df.groupBy(key).agg(*aggregates)
    for column in maps:
        out = out.join(first_map_entries(df, key, column, seq, column), key, "left")
    return out


def components(raw: DataFrame, table: DataFrame) -> DataFrame:
    """Component rows of one canonical name as one, with the other spellings as aliases."""
    from .alias import canonical

    named = canonical(raw, "name", table, "canonical")
    named = named.withColumn("spelling", F.when(F.col("name") != F.col("canonical"), F.col("name")))
    scalars = [c for c in ("source_version", "effective_version", "supplier", "license", "copyright", "purl") if c in raw.columns]
    arrays = [c for c in ("aliases", "languages", "scopes", "depends_on", "integrity_findings") if c in raw.columns]
    maps = [c for c in ("checksums", "completeness") if c in raw.columns]
    kinds = [("is_application", F.col("type") == "application")] if "type" in raw.columns else []
    out = merge_by(named, "canonical", "seq", scalars, ["spelling"], arrays, kinds, maps)
    spellings = F.col("spelling")
    if "aliases" in raw.columns:
        spellings = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "spelling")
    out = out.withColumn("aliases", F.array_except(spellings, F.array("canonical"))).drop("spelling")
    if kinds:
        out = out.withColumn("type", F.when(F.col("is_application"), "application").otherwise("library")).drop("is_application")
    return out.withColumnRenamed("canonical", "name").withColumnRenamed("position", "seq")


def python_requirements(rows: DataFrame) -> DataFrame:
    """Requirements by normalised name: scopes in order, the first exact pin, all constraints."""
    from ..functions.text import pep503
    from ..functions.versions import concrete_pin

    rows = rows.withColumn("name", pep503(F.col("raw"))).withColumn("pin", concrete_pin(F.col("specifier")))
    return merge_by(rows, "name", "seq", first=["pin"], unions=["scope", "specifier"])


def conditions(*lists: Column) -> Column:
    """Ordered union of lists of gates."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in lists]))


def curated(records: DataFrame) -> DataFrame:
    """Two curated sources by component: a list's version is the source version; a
    notice's version that differs becomes the effective version; the list's licence wins."""
    by = lambda c, s: F.expr(f"min_by({c}, seq) FILTER (WHERE source = '{s}' AND {c} IS NOT NULL)")
    out = records.groupBy("component").agg(
        by("version", "list").alias("listed"), by("version", "notice").alias("noticed"), F.coalesce(by("license", "list"), by("license", "notice")).alias("license")
    )
    return out.select("component", F.coalesce("listed", "noticed").alias("source_version"), F.when(F.col("noticed") != F.col("listed"), F.col("noticed")).alias("effective_version"), "license")


def pin_conflicts(observations: DataFrame, component: str = "component", constraint: str = "version_constraint") -> DataFrame:
    """component, pins (sorted) and kept (the lowest in PEP 440 order) where exact pins differ."""
    from ..functions.versions import concrete_pin, pep440_key

    pins = observations.select(component, concrete_pin(F.col(constraint)).alias("pin")).where("pin IS NOT NULL").distinct()
    found = pins.groupBy(component).agg(
        F.array_sort(F.collect_set("pin")).alias("pins"), F.min_by("pin", F.struct(pep440_key(F.col("pin")).alias("key"), F.col("pin").alias("text"))).alias("kept")
    )
    return found.where(F.size("pins") > 1)


def apply_pin_conflicts(comps: DataFrame, conflicts: DataFrame, name: str = "name", key: str = "component") -> DataFrame:
    """Versions that are unset or one of the pins become the pin kept; others stay."""
    joined = comps.join(conflicts, F.col(name) == F.col(key), "left")
    fix = lambda c: F.when(F.col("kept").isNotNull() & (F.col(c).isNull() | F.array_contains("pins", F.col(c))), F.col("kept")).otherwise(F.col(c))
    return joined.withColumns({c: fix(c) for c in ("source_version", "effective_version")}).drop(key, "pins", "kept")


def patched_builds(comps: DataFrame) -> DataFrame:
    """Warnings where source and effective version are set and differ."""
    hit = comps.where("source_version <> effective_version")
    return hit.select(F.lit("patched_build").alias("code"), F.col("name").alias("subject"), F.concat(F.lit("built as "), "effective_version", F.lit(" from "), "source_version").alias("detail"))


def version_completeness(comps: DataFrame) -> DataFrame:
    """Versions that are templates become null and ``unresolved``; components
    without any version are ``unpinned``."""
    from ..functions.text import has_template

    bad = {c: F.coalesce(has_template(F.col(c)), F.lit(False)) for c in ("source_version", "effective_version")}
    out = comps.withColumn("_bad", bad["source_version"] | bad["effective_version"])
    out = out.withColumns({c: F.when(~b, F.col(c)) for c, b in bad.items()})
    none = F.col("source_version").isNull() & F.col("effective_version").isNull()
    return out.withColumn("version_status", F.when(F.col("_bad"), "unresolved").when(none, "unpinned")).drop("_bad")
