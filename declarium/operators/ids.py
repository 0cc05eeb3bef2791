"""Unique ids and file names, fingerprints, ordinals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_slug


def numbered(df: DataFrame, base: Column, seq: str, out: str) -> DataFrame:
    """The base, and from its second occurrence on ``base-2``, ``base-3``, …"""
    marked = df.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("_base").orderBy(seq))
    named = marked.withColumn("_n", n)
    return named.withColumn(out, F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")


def claimed(df: DataFrame, base: Column, seq: str, out: str) -> DataFrame:
    """As ``numbered``, but an id is free only if no earlier row has it, be it made up
    or as given: in order of ``seq``, a row takes its base, or else the first free of
    ``base-2``, ``base-3``, …

    A made-up id can only meet a base that ends in its number. Bases that are alike
    but for such endings are a family; families of one base are numbered by a
    window, and only the others are gone through in order, by name and number alone."""
    from ..session import ship

    ship(df.sparkSession)
    stem = F.regexp_replace("_base", r"(-([2-9]|[1-9][0-9]+))+$", "")
    named = df.withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(seq)))
    bases = df.select(base.alias("_base")).distinct()
    families = bases.groupBy(stem.alias("_family")).agg(F.count(F.lit(1)).alias("_bases")).where("_bases > 1").select("_family")
    disputed = named.select("_base", "_n", F.col(seq).alias("_seq")).withColumn("_family", stem).join(families, "_family")
    claims = disputed.groupBy("_family").applyInPandas(_claim, "_base string, _n int, _id string")
    plain = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))
    return named.join(claims, ["_base", "_n"], "left").withColumn(out, F.coalesce("_id", plain)).drop("_base", "_n", "_id")


def _claim(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["_seq", "_base", "_n"], kind="stable")
    taken: set[str] = set()
    following: dict[str, int] = {}
    got = []
    for name in frame["_base"]:
        made = name
        if name in taken:
            n = following.get(name, 2)
            while (made := f"{name}-{n}") in taken:
                n += 1
            following[name] = n + 1
        taken.add(made)
        got.append(made)
    return frame.assign(_id=got)[["_base", "_n", "_id"]]


def safe_basenames(df: DataFrame, subject_id: str, out: str) -> DataFrame:
    """A file name of safe characters; where several ids give one, 8 digits of the id's digest follow."""
    base = F.regexp_replace(F.regexp_replace(F.col(subject_id), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    base = F.when(base == "", "subject").otherwise(base)
    named = df.withColumn("_base", base)
    n = F.count(F.lit(1)).over(Window.partitionBy("_base"))
    short = F.substring(F.sha2(F.col(subject_id), 256), 1, 8)
    return named.withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, F.concat("_base", F.lit("-"), short)).otherwise(F.col("_base"))).drop("_base", "_n")


def occurrences(df: DataFrame, key: str, location: str, seq: str) -> DataFrame:
    """key, location and n: distinct locations of a key, numbered from 0 in order."""
    first = df.groupBy(key, location).agg(F.min(seq).alias("_seq"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_seq", location)) - 1
    return first.withColumn("n", n).drop("_seq")


def fingerprint(df: DataFrame, parts: Column, order: Column) -> DataFrame:
    """One row: SHA-256 of the rows' digests in order. A row adds 64 characters."""
    return df.select(order.alias("o"), F.sha2(parts, 256).alias("d")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint")
    )


def subject_slug(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("-"), id_slug(name))
