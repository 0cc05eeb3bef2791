"""Filling fields from prioritised sources, with provenance, and comparing sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_emittable_url, null_if_empty, purl, upstream_name, url_host
from .order import top_one

NONE = "NOASSERTION"


def layered(df: DataFrame, layers: Sequence[tuple[str, Column]], out: str) -> DataFrame:
    """``out`` (first layer that has a value, else NOASSERTION), its source, and
    whether layers disagree. Layers come in order of priority."""
    known = F.filter(F.array(*[F.struct(v.alias("value"), F.lit(n).alias("source")) for n, v in layers]), lambda s: s["value"].isNotNull())
    df = df.withColumn("_known", known)
    return df.select(
        *[c for c in df.columns if c != "_known"],
        F.coalesce(F.get("_known", F.lit(0))["value"], F.lit(NONE)).alias(out),
        F.get("_known", F.lit(0))["source"].alias(f"{out}_source"),
        (F.size(F.array_distinct(F.transform("_known", lambda s: s["value"]))) > 1).alias(f"{out}_discrepant"),
    )


def names_with_rank(df: DataFrame, name: str, aliases: str | None = None) -> DataFrame:
    """A row for the name and each alias, in order, as ``spelling`` with ``rank``."""
    every = F.array(name) if aliases is None else F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return df.select(name, F.posexplode(every).alias("rank", "spelling"))


def lookup_by_names(df: DataFrame, table: DataFrame, name: str, aliases: str | None, key: str, values: Sequence[str]) -> DataFrame:
    """name and the values of the first of its spellings that the table has, case-insensitively."""
    wanted = names_with_rank(df, name, aliases).withColumn("_k", F.lower("spelling"))
    found = wanted.join(table.select(F.lower(key).alias("_k"), *values), "_k")
    return top_one(found, [name], list(values), [F.col("rank"), *[F.col(v) for v in values]])


def fill(df: DataFrame, found: DataFrame, name: str, columns: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """Nulls of ``columns`` from ``found``; columns in ``overwrite`` take the found value where there is one."""
    f = found.select(F.col(name).alias("_name"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(f, F.col(name) == F.col("_name"), "left")
    both = {c: F.coalesce(f"_{c}", c) if c in overwrite else F.coalesce(c, f"_{c}") for c in columns}
    return joined.withColumns(both).drop("_name", *[f"_{c}" for c in columns])


def last_curated(records: DataFrame, key: str, seq: str, values: Sequence[str]) -> DataFrame:
    """The last record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("r")).select(key, "r.*")


def unresolved(df: DataFrame, name: str, column: str) -> DataFrame:
    hit = df.where(F.col(column).isNull() | (F.col(column) == NONE))
    return hit.select(F.lit(f"{column}_unresolved").alias("code"), F.col(name).alias("subject"), F.lit("no source names it").alias("detail"))


def crosscheck(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right and agree; a missing side counts as NOASSERTION."""
    a = left.select(F.col(key).alias("a_key"), F.col(value).alias("left"))
    b = right.select(F.col(key).alias("b_key"), F.col(value).alias("right"))
    out = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    agree = F.coalesce("left", F.lit(NONE)) == F.coalesce("right", F.lit(NONE))
    return out.select(F.coalesce("a_key", "b_key").alias(key), "left", "right", agree.alias("agree"))


def licence_of_directory(files: DataFrame, directory: str, file: str, spdx: str) -> DataFrame:
    """directory and license: unanimous files, else the file with a canonical name, else null."""
    canonical = F.upper(file).isin("LICENSE", "LICENSE.TXT", "LICENSE.MD", "LICENSE.RST", "LICENCE", "LICENCE.TXT", "COPYING", "COPYING.TXT")
    rows = files.where(F.col(spdx).isNotNull()).withColumn("_main", F.when(canonical, F.col(file)))
    out = rows.groupBy(directory).agg(F.countDistinct(spdx).alias("n"), F.min(spdx).alias("any"), F.expr(f"min_by(`{spdx}`, `{file}`) FILTER (WHERE _main IS NOT NULL)").alias("main"))
    return out.select(directory, F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("main")).alias("license"))


def best_detection(detections: DataFrame, target: str, file: str, expression: str, score: str, is_licence_file: str, seq: str, threshold: float = 80.0) -> DataFrame:
    """target and license, in two steps: the best detection of each file, then the
    best file; a licence file outranks any score, the first wins ties, and below the
    threshold or for an unknown reference there is no assertion."""
    per_file = top_one(detections, [target, file], [expression, score, is_licence_file, seq], [-F.col(score), F.col(seq)])
    best = top_one(per_file, [target], [expression, score], [~F.col(is_licence_file), -F.col(score), F.col(seq)])
    known = (F.col(score) >= threshold) & ~F.lower(expression).contains("unknown")
    return best.select(target, F.when(known, F.col(expression)).alias("license"))


def copyright_summary(holders: Column, most: int = 2000) -> Column:
    """Distinct holders, joined, of at most ``most`` characters; null if there are none."""
    return null_if_empty(F.substring(F.array_join(F.array_distinct(holders), "; "), 1, most))


def upstream_facts(observations: DataFrame, key: str, url: str, is_vcs: str, seq: str, index_hosts: Sequence[str] = ("pypi.org", "files.pythonhosted.org")) -> DataFrame:
    """Per component: has_download, first_download, vcs_reference (if every
    observation is one) and unverified_url (if all are direct and off the indexes)."""
    real = is_emittable_url(F.col(url))
    foreign = real & ~F.coalesce(url_host(F.col(url)).isin(*index_hosts), F.lit(False))
    marked = observations.withColumns({"_real": F.when(real, F.col(url)), "_foreign": F.coalesce(foreign, F.lit(False))})
    out = marked.groupBy(key).agg(
        F.bool_or(F.col("_real").isNotNull()).alias("has_download"),
        F.expr(f"min_by(_real, `{seq}`) FILTER (WHERE _real IS NOT NULL)").alias("first_download"),
        F.bool_and(F.coalesce(is_vcs, F.lit(False))).alias("_vcs"),
        F.bool_and("_foreign").alias("_direct"),
        F.min_by(url, seq).alias("_first"),
    )
    return out.select(key, "has_download", "first_download", F.when(F.col("_vcs"), F.col("_first")).alias("vcs_reference"), F.when(F.col("_direct") & ~F.col("_vcs"), F.col("_first")).alias("unverified_url"))


def component_purls(components: DataFrame, coordinates: DataFrame, downloads: DataFrame) -> DataFrame:
    """purl: curated coordinate, else generic with the first download; Python rows by name and version."""
    c = coordinates.select(F.lower("key").alias("c_key"), F.col("purl").alias("c_purl"))
    d = downloads.select(F.col("name").alias("d_name"), F.col("first_download").alias("d_url"))
    out = components.join(c, F.lower("name") == F.col("c_key"), "left").join(d, F.col("name") == F.col("d_name"), "left")
    none = F.lit(None).cast("string")
    version = F.coalesce("source_version", "effective_version")
    generic = F.concat(purl(F.lit("generic"), none, F.coalesce(upstream_name(F.col("d_url")), F.col("name")), version), F.lit("?download_url="), F.url_encode("d_url"))
    chosen = F.when(F.col("is_python"), purl(F.lit("pypi"), none, F.col("name"), version)).otherwise(F.coalesce("c_purl", F.when(F.col("d_url").isNotNull(), generic)))
    return out.withColumn("purl", chosen).drop("c_key", "c_purl", "d_name", "d_url")


def coordinate_key(provider: Column, namespace: Column, name: Column, revision: Column) -> Column:
    """``git/github/owner/name/revision`` and the like; null if a part is missing."""
    kind = F.when(provider == "pypi", "pypi").otherwise("git")
    return F.concat(kind, F.lit("/"), provider, F.lit("/"), F.coalesce(namespace, F.lit("-")), F.lit("/"), name, F.lit("/"), revision)


def suppliers(components: DataFrame, first_party: Column, supplier: str) -> DataFrame:
    """A first-party component's supplier is overwritten; others keep theirs."""
    return components.withColumn("supplier", F.when(F.coalesce(first_party, F.lit(False)), F.lit(supplier)).otherwise(F.col("supplier")))
