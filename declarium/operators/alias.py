"""Alias layers: one spelling table from several sources, and canonical names by lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_if_empty, upstream_name
from .order import first_per_key

# Keys of an observation's data that may hold its name, in order; a site puts its own first.
NAME_KEYS = ("name", "component", "canonical_name", "program", "link_target", "target")


def layer(df: DataFrame, spelling: str, canonical: str, seq: str, prio: int) -> DataFrame:
    return df.select(F.col(spelling).alias("spelling"), F.col(canonical).alias("canonical"), F.col(seq).alias("seq"), F.lit(prio).alias("prio"))


def resolve_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """(key, canonical): lower prio wins; within a layer the last spelling does."""
    every = reduce(DataFrame.unionByName, layers).withColumn("key", F.lower("spelling"))
    return first_per_key(every, ["key"], ["prio", F.col("seq").desc()]).select("key", "canonical")


def with_derived(curated: DataFrame, derived: DataFrame) -> DataFrame:
    """Curated table plus derived spellings that it lacks; a derived target goes
    through the curated table once."""
    d = derived.select(F.lower("spelling").alias("key"), F.col("canonical").alias("target"))
    d = d.join(curated.select("key"), "key", "left_anti")
    c = curated.select(F.col("key").alias("k"), F.col("canonical").alias("better"))
    d = d.join(c, F.lower("target") == F.col("k"), "left").select("key", F.coalesce("better", "target").alias("canonical"))
    return curated.unionByName(d)


def canonical(df: DataFrame, column: str, table: DataFrame, out: str, when: Column | None = None) -> DataFrame:
    """``out``: the canonical name, case-insensitively; a name without an entry
    stays as it is. ``when`` limits the lookup to some rows."""
    key = F.lower(column) if when is None else F.when(when, F.lower(column))
    t = table.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
    return df.join(t, key == F.col("_key"), "left").withColumn(out, F.coalesce("_canonical", column)).drop("_key", "_canonical")


def canonical_edges(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Component endpoints of edges through the table; subjects stay."""
    for side in ("from", "to"):
        edges = canonical(edges, f"{side}_id", table, f"{side}_id", F.col(f"{side}_kind") == "component")
    return edges


def observation_name(data: str = "ecosystem_data", keys: Sequence[str] = NAME_KEYS) -> Column:
    """The first value of the map's naming keys that isn't empty."""
    return F.coalesce(*[null_if_empty(F.try_element_at(F.col(data), F.lit(k))) for k in keys])


def derived_aliases(observations: DataFrame, name: str, url: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """((spelling, canonical) from each component's first archive URL, and the
    upstream names that several URLs claim, which give no alias)."""
    found = observations.withColumn("upstream", upstream_name(F.col(url))).where(F.col("upstream").isNotNull() & (F.col("upstream") != F.lower(name)))
    first = found.groupBy(name).agg(F.min_by(F.struct("upstream", F.col(url).alias("url")), seq).alias("f")).select(F.col(name).alias("spelling"), F.col("f.upstream").alias("canonical"), F.col("f.url").alias("url"))
    clash = first.groupBy("canonical").agg(F.countDistinct("url").alias("n")).where("n > 1").select("canonical")
    return first.join(clash, "canonical", "left_anti").select("spelling", "canonical"), clash


def attach(observations: DataFrame, components: DataFrame, table: DataFrame, link_kind: str = "cmake_link_library") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations with their component; components that observations add;
    warnings for nameless ones and for link tokens that nothing covers.

    ``observations`` has seq, raw_name, source_kind; ``components`` has name."""
    named = canonical(observations.where("raw_name IS NOT NULL"), "raw_name", table, "canonical")
    have = components.select(F.col("name").alias("have"))
    hit = named.join(have.select(F.col("have").alias("by_canonical")), F.col("canonical") == F.col("by_canonical"), "left")
    hit = hit.join(have.select(F.col("have").alias("by_raw")), F.col("raw_name") == F.col("by_raw"), "left")
    known = table.select(F.col("key").alias("_known"))
    hit = hit.join(known, F.lower("raw_name") == F.col("_known"), "left")
    target = F.coalesce("by_canonical", "by_raw")
    unmapped = target.isNull() & (F.col("source_kind") == link_kind) & F.col("_known").isNull()
    # an unmapped token is dropped unless another observation makes its component
    others = hit.where(target.isNull() & ~unmapped).select(F.col("canonical").alias("_other")).distinct()
    hit = hit.withColumn("component", target).withColumn("unmapped", unmapped).join(others, F.col("canonical") == F.col("_other"), "left")
    lost = F.col("unmapped") & F.col("_other").isNull()
    placed = hit.where(~lost).withColumn("component", F.coalesce("component", "canonical"))
    attached = placed.select(*observations.columns, "component")
    added = placed.where(target.isNull()).groupBy("component").agg(F.min("seq").alias("seq")).withColumnRenamed("component", "name")
    warn = hit.where(lost).select(F.lit("unmapped_link_library").alias("code"), F.col("raw_name").alias("subject"), F.lit("no component and no alias has this link token").alias("detail"))
    nameless = observations.where("raw_name IS NULL").select(F.lit("unattached_observation").alias("code"), F.lit(None).cast("string").alias("subject"), F.concat(F.lit("no component name: "), F.col("source_kind")).alias("detail"))
    return attached, added, warn.unionByName(nameless)


def config_layer(spark, aliases: Mapping[str, str]) -> DataFrame:
    rows = [(k, v, i) for i, (k, v) in enumerate(aliases.items()) if k and v]
    return spark.createDataFrame(rows, "spelling string, canonical string, seq int")
