"""Version strings and their three orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import item_at


def without_v(c: Column) -> Column:
    """Trimmed, without a ``v`` or ``V`` before a digit."""
    return F.regexp_replace(F.trim(c), r"^[vV](?=\d)", "")


def dotted(c: Column) -> Column:
    """The first dotted run of numbers, or an empty string."""
    return F.regexp_extract(c, r"\d+(\.\d+)*", 0)


def match_score(want: Column, have: Column) -> Column:
    """Shared leading numbers where one dotted version is a prefix of the other, else null."""
    a, b = (F.filter(F.split(x, r"\."), lambda p: p != "") for x in (want, have))
    n = F.least(F.size(a), F.size(b))
    equal = F.forall(F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1))), lambda x, y: x.eqNullSafe(y)), lambda e: e)
    return F.when((n > 0) & equal, n)


def mixed_key(version: Column) -> Column:
    """A sortable key: numbers before words, numbers by value."""
    return F.transform(
        F.split(version, r"\."),
        lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.cast("decimal(38,0)")).alias("number"), p.alias("text")),
    )


_PEP440 = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:(?:-(\d+))|(?:[-_.]?(post|rev|r)[-_.]?(\d*)))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def pep440_key(version: Column) -> Column:
    """A struct that sorts as PEP 440 does; strings that aren't versions come last.

    Release numbers lose trailing zeros; dev sorts before pre, pre before final,
    final before post; local parts sort last, numbers after words."""
    v = F.lower(version)
    part = lambda i: F.regexp_extract(v, _PEP440, i)
    number = lambda c: F.coalesce(F.when(c != "", c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    ok = v.rlike(_PEP440)
    has_pre, has_post, has_dev, local = part(3) != "", (part(5) != "") | (part(6) != ""), part(8) != "", part(10)
    pre = F.when(part(3).isin("a", "alpha"), 1).when(part(3).isin("b", "beta"), 2).otherwise(3)
    pre_rank = F.when(has_pre, pre).when(has_dev & ~has_post, 0).otherwise(4)
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda p: p.cast("decimal(38,0)"))
    local_key = F.transform(
        F.filter(F.split(local, "[-_.]"), lambda p: p != ""),
        lambda p: F.struct(p.rlike(r"^\d+$").alias("n"), F.when(p.rlike(r"^\d+$"), p.cast("decimal(38,0)")).alias("v"), p.alias("t")),
    )
    return F.struct(
        (~ok).alias("invalid"),
        F.when(ok, number(part(1))).alias("epoch"),
        F.when(ok, release).alias("release"),
        F.when(ok, pre_rank).alias("pre"),
        F.when(ok & has_pre, number(part(4))).alias("pre_n"),
        F.when(ok & has_post, number(F.concat(part(5), part(7)))).alias("post"),
        F.when(ok, ~has_dev).alias("final"),
        F.when(ok & has_dev, number(part(9))).alias("dev"),
        F.when(ok, local_key).alias("local"),
    )


def concrete_pin(specifier: Column) -> Column:
    """The version of a specifier that is one ``==`` or ``===`` clause without ``*``, else null."""
    pin = F.regexp_extract(specifier, r"^\s*={2,3}\s*([^\s,;*]+)\s*$", 1)
    return F.when(pin != "", pin)


def version_in_archive(url: Column) -> Column:
    """Version in an archive's file name, or null."""
    file = item_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)
    stem = F.regexp_replace(file, r"(?i)\.(tar\.(gz|xz|bz2|zst)|tgz|tbz2|txz|zip)$", "")
    found = F.regexp_extract(stem, r"(?:^|[-_])v?(\d+(?:\.\d+)*[\w.]*)$", 1)
    return F.when(found != "", found)


def looks_like_release(label: Column, informational: tuple[str, ...] = ("master", "main", "trunk", "develop", "dev", "head")) -> Column:
    """A branch label that starts with a version and isn't an informational branch."""
    return ~F.lower(label).isin(*informational) & F.trim(label).rlike(r"^v?\d+(\.\d+)*")
