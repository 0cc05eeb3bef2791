"""File tables: repo, path (relative), content, seq (place in the sorted list)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import item_at
from ..session import ship

VENDOR_SKIP = (".git", "build", "out", "node_modules", "__pycache__")


def scan(spark: SparkSession, root: str, glob: str | None = None, repo: str = "repo", most_bytes: int | None = None) -> DataFrame:
    """All files below ``root``; ``glob`` and ``most_bytes`` are pushed to the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    inside = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://")[-1].replace(".", r"\.") + "/?", "")
    return sequenced(df.select(F.lit(repo).alias("repo"), inside.alias("path"), "content"))


def sequenced(files: DataFrame) -> DataFrame:
    return files.withColumn("seq", F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1)


def requirements_files(files: DataFrame) -> DataFrame:
    """Files that pip reads, by name."""
    name = F.lower(F.substring_index("path", "/", -1))
    in_folder = F.lower("path").rlike(r"(^|/)requirements/[^/]+\.(txt|in)$")
    return files.where(name.rlike(r"^(requirements|constraints)([-_.][\w.-]*)?\.(txt|in)$") | name.rlike(r"^[\w.-]+[-_.]requirements\.(txt|in)$") | in_folder)


def licence_files(files: DataFrame) -> DataFrame:
    return files.where(F.upper(F.substring_index("path", "/", -1)).rlike("^(LICENSE|LICENCE|COPYING|COPYRIGHT)"))


def vendored(files: DataFrame, vendor_roots: tuple[str, ...] = ("third_party", "vendor", "open_source")) -> DataFrame:
    """(repo, name, version, dir): folders right below a vendor root; the version is
    that of the highest version-like folder below it, or of the name's tail."""
    from ..functions.versions import mixed_key

    parts = F.split("path", "/")
    rows = files.select("repo", parts.alias("p")).where(~F.arrays_overlap("p", F.array(*map(F.lit, VENDOR_SKIP))))
    at = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: item_at("p", i).isin(*vendor_roots))
    rows = rows.withColumn("at", F.get(at, F.lit(0))).where(F.col("at").isNotNull() & (F.size("p") > F.col("at") + 1))
    folder, below = item_at("p", F.col("at") + 1), F.get("p", F.col("at") + 1)
    tail = F.regexp_extract(folder, r"[-_]v?(\d+(\.\d+)*)$", 1)
    named = rows.select(
        "repo",
        F.lower(F.regexp_replace(folder, r"[-_]v?\d+(\.\d+)*$", "")).alias("name"),
        F.array_join(F.slice("p", 1, F.col("at") + 1), "/").alias("dir"),
        F.coalesce(F.when(below.rlike(r"^v?\d+(\.\d+)*$") & (F.size("p") > F.col("at") + 2), F.regexp_replace(below, "^v", "")), F.when(tail != "", tail)).alias("version"),
    ).distinct()
    key = F.struct(F.col("version").isNotNull().alias("k"), mixed_key(F.coalesce("version", F.lit("0"))).alias("v"))
    return named.groupBy("repo", "name").agg(F.max_by(F.struct("version", "dir"), key).alias("b")).select("repo", "name", "b.version", "b.dir")


def parse(files: DataFrame, function: Callable[[str, str], list[dict]], schema: str, most_rows: int = 10_000) -> DataFrame:
    """One Python call for each file: (path, text) to rows; repo and path are put in front.
    A worker holds the rows of one file, and sends at most ``most_rows`` at once."""
    ship(files.sparkSession)
    names = [x.strip().split()[0].strip("`") for x in _top_level(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for frame in frames:
            for repo, path, content in frame[["repo", "path", "content"]].itertuples(index=False):
                text = bytes(content or b"").decode("utf-8", "replace")
                for row in function(path, text):
                    out.append((repo, path, *[row.get(n) for n in names]))
                    if len(out) == most_rows:
                        yield pd.DataFrame(out, columns=["repo", "path", *names], dtype=object)
                        out = []
        yield pd.DataFrame(out, columns=["repo", "path", *names], dtype=object)

    return files.select("repo", "path", "content").mapInPandas(run, f"repo string, path string, {schema}")


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
