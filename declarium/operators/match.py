"""Joins that are not plain equality: longest prefix, best version, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..functions.versions import dotted, match_score
from .order import top_one


def ancestors(path: Column) -> Column:
    """Every leading part of a path, the root (an empty string) and the path included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(files: DataFrame, owners: DataFrame, path: str, prefix: str, owner: str, seq: str, key: str) -> DataFrame:
    """key and owner: the owner of the deepest prefix; of equals the first.

    An equi-join on exploded ancestors; each file gives as many rows as it has parts."""
    each = files.select(key, F.posexplode(ancestors(F.col(path))).alias("depth", "part"))
    owned = each.join(owners.select(F.col(prefix).alias("part"), F.col(owner).alias("owner"), F.col(seq).alias("o_seq")), "part")
    return top_one(owned, [key], ["owner", "depth"], [-F.col("depth"), F.col("o_seq")])


def best_version(wanted: DataFrame, offered: DataFrame, key: str, want: str, label: str) -> DataFrame:
    """key, want and the best label of the same key: the most shared numbers, then
    no suffix, then the shortest, then by name; only labels one of which is a
    prefix of the other's numbers match."""
    pairs = wanted.join(offered, key)
    scored = pairs.withColumn("score", match_score(dotted(F.col(want)), dotted(F.col(label)))).where("score IS NOT NULL")
    suffix = F.col(label).contains("-") | F.col(label).contains("_")
    return top_one(scored, [key, want], [label, "score"], [-F.col("score"), suffix, F.length(label), F.col(label)])


def latest(offered: DataFrame, key: str, label: str) -> DataFrame:
    """key and the numerically greatest version among its labels."""
    numbers = F.transform(F.split(dotted(F.col(label)), r"\."), lambda p: p.cast("decimal(38,0)"))
    return offered.where(dotted(F.col(label)) != "").groupBy(key).agg(F.max_by(dotted(F.col(label)), F.struct(numbers.alias("n"), F.col(label).alias("l"))).alias("latest"))


def _append(suffix: str):
    return lambda s: F.concat(s, F.lit(suffix))


def find_entry(wanted: DataFrame, entries: DataFrame, suffixes: tuple[str, ...] = ("", ".tar.gz", ".zip", ".tgz")) -> DataFrame:
    """name and entry: candidates by name, then name-version, with archive suffixes,
    then by squeezed name; ``wanted`` has name, aliases, versions; ``entries`` has entry."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    tagged = F.flatten(F.transform(names, lambda n: F.transform(F.coalesce("versions", F.array().cast("array<string>")), lambda v: F.concat(n, F.lit("-"), v))))
    stems = F.concat(names, tagged)
    full = F.flatten(F.array(*[F.transform(stems, _append(x)) for x in suffixes]))
    exact = wanted.select("name", F.posexplode(full).alias("rank", "entry")).join(entries, "entry").select("name", "entry", "rank")
    loose = wanted.select("name", F.posexplode(names).alias("rank", "n")).select("name", (F.col("rank") + 1_000_000).alias("rank"), squeezed(F.col("n")).alias("k"))
    loose = loose.join(entries.select("entry", squeezed(F.col("entry")).alias("k")), "k").select("name", "entry", "rank")
    return top_one(exact.unionByName(loose), ["name"], ["entry"], [F.col("rank"), F.col("entry")])
