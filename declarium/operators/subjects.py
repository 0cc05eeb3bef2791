"""Subjects: roots of the source tree, merges and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import path_role
from .order import first_per_key


def cmake_roots(files: DataFrame) -> DataFrame:
    """Directories with both ``cmake_minimum_required`` and ``project``, by path.
    ``files`` has path and content."""
    text = F.lower(F.col("content").cast("string"))
    named = files.where(F.col("path").endswith("CMakeLists.txt"))
    return named.where(text.rlike(r"(?m)^\s*cmake_minimum_required\s*\(") & text.rlike(r"(?m)^\s*project\s*\(")).select(F.regexp_replace("path", "/?CMakeLists.txt$", "").alias("dir")).distinct()


def with_roles(subjects: DataFrame, rules: Sequence[tuple[str, str]], path: str = "source_path") -> DataFrame:
    return subjects.withColumn("role", path_role(F.col(path), rules))


def colocated_merges(subjects: DataFrame, wheel: str = "sibling_artifact", cmake: str = "cmake_project") -> DataFrame:
    """(keep, absorb): a CMake root at the path of a wheel goes into the first wheel there."""
    path = F.regexp_replace(F.col("source_path"), "/+$", "")
    wheels = first_per_key(subjects.where(F.col("role").isin(wheel, "primary") & (F.col("kind") == "wheel")).withColumn("p", path), ["p"], ["seq"]).select("p", F.col("id").alias("keep"))
    roots = subjects.where((F.col("role") == cmake) & (F.col("kind") == "cmake")).select(path.alias("p"), F.col("id").alias("absorb"))
    return wheels.join(roots, "p").where("keep <> absorb").select("keep", "absorb").distinct()


def apply_merges(subjects: DataFrame, merges: DataFrame) -> DataFrame:
    """Without absorbed subjects; the keeper lists their names as facets. Chains aren't followed."""
    gone = merges.select(F.col("absorb").alias("a_id")).distinct()
    named = subjects.select(F.col("id").alias("a_id"), F.col("name").alias("facet"), F.col("seq").alias("f_seq"))
    facets = merges.join(named, F.col("absorb") == F.col("a_id")).groupBy("keep").agg(F.array_sort(F.collect_set(F.struct("f_seq", "facet"))).alias("fs"))
    facets = facets.select("keep", F.transform("fs", lambda x: x["facet"]).alias("facets"))
    left = subjects.join(gone, F.col("id") == F.col("a_id"), "left_anti")
    return left.join(facets, F.col("id") == F.col("keep"), "left").drop("keep").withColumn("facets", F.coalesce("facets", F.array().cast("array<string>")))


def distinct_subjects(subjects: DataFrame, key: Sequence[str] = ("id", "kind", "name", "version", "role", "source_path")) -> DataFrame:
    return first_per_key(subjects, list(key), ["seq"])


def without_roles(subjects: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return subjects.where(~F.coalesce(F.col("role").isin(*excluded), F.lit(False))) if excluded else subjects


def discover(subjects: DataFrame, rules: Sequence[tuple[str, str]], excluded: Sequence[str] = ()) -> DataFrame:
    """Roles, merges, exclusion and duplicates, in this order."""
    ranked = subjects.withColumn("role", F.coalesce("role", path_role(F.col("source_path"), rules)))
    merged = apply_merges(ranked, colocated_merges(ranked))
    return distinct_subjects(without_roles(merged, excluded))
