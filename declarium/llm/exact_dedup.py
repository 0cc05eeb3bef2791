"""Exact deduplication by a heavy-hitter split.

A Misra-Gries summary (Spark's mergeable frequent-items sketch, whose counters
are decremented as in Misra and Gries) names at most ``candidates`` digests.
A second pass counts those exactly; the ones that really hold more than
``1/candidates`` of the rows are the winners. Their list is bounded by
``candidates`` rows whatever the input, so it is broadcast and the copies are
settled on the map side. All other digests have groups below that share and
take one ordinary shuffle. Only DataFrame functions are used.

Defined results
---------------
* null text counts as empty; the empty text is a text like any other.
* of equal texts the row with the largest id stays; a null id is smaller than
  every other id.
* rows that repeat both id and text are one document: ``annotate`` flags all
  of them alike, ``deduplicate`` returns one of them.
* an empty table gives an empty result; extra columns are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh


@dataclass(frozen=True)
class Columns:
    """Names of the columns that ``annotate`` adds."""

    keep_id: str = "keep_id"
    group_size: str = "group_size"
    kept: str = "kept"
    digest: str = "text_sha256"


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def heavy_digests(df: DataFrame, id_col: str, text_col: str, candidates: int = 1024) -> list[tuple]:
    """(digest, group size, id that stays, rows with that id) of each digest held
    by more than 1/candidates of the rows; at most ``candidates`` entries."""
    tracked = 8 * candidates
    rows = df.select(F.col(id_col).alias("_x_id"), digest(text_col).alias("_x_digest"))
    sketch = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(hex(_x_digest), {candidates}, {tracked})").alias("top"),
    ).first()
    floor = sketch.n / candidates
    named = [(bytearray.fromhex(t["item"]),) for t in sketch.top or [] if t["count"] > max(floor, 1)]
    if not named:
        return []
    named = F.broadcast(df.sparkSession.createDataFrame(named, "_x_digest binary"))
    ids = rows.join(named, "_x_digest").groupBy("_x_digest", "_x_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("_x_id").isNotNull().alias("set"), F.col("_x_id").alias("id"), F.col("n").alias("n")))
    found = ids.groupBy("_x_digest").agg(F.sum("n").alias("n"), best.alias("best")).where(F.col("n") > floor)
    return [(r["_x_digest"], r["n"], r["best"]["id"], r["best"]["n"]) for r in found.collect()]


def _split(df: DataFrame, id_col: str, text_col: str, candidates: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of the winners, all other rows, and the names of what is added: digest, size, keep, ties."""
    names = of, size, keep, ties = fresh(df, "digest", "size", "keep", "ties")
    heavy = heavy_digests(df, id_col, text_col, candidates)
    kind = df.schema[id_col].dataType.simpleString()
    table = df.sparkSession.createDataFrame(heavy, f"{of} binary, {size} bigint, {keep} {kind}, {ties} bigint")
    rows = df.withColumn(of, digest(text_col))
    marked = rows.join(F.broadcast(table), of, "left")
    return marked.where(F.col(size).isNotNull()), marked.where(F.col(size).isNull()).drop(size, keep, ties), names


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = 1024, names: Columns = Columns()) -> DataFrame:
    """``df`` without its text, with the id that stays, the group's size, whether
    this row stays, and the SHA-256 of the text, for every row."""
    heavy, light, (of, size, keep, _) = _split(df.select(id_col, text_col), id_col, text_col, candidates)
    group = Window.partitionBy(of)
    light = light.drop(text_col).select(id_col, of, F.count(F.lit(1)).over(group).alias(size), F.max(id_col).over(group).alias(keep))
    both = heavy.select(id_col, of, size, keep).unionByName(light)
    return both.select(
        F.col(id_col),
        F.col(keep).alias(names.keep_id),
        F.col(size).alias(names.group_size),
        F.col(id_col).eqNullSafe(F.col(keep)).alias(names.kept),
        F.lower(F.hex(of)).alias(names.digest),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = 1024) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Copies of a winner other than the one that stays are dropped on the map side,
    before any shuffle."""
    heavy, light, (of, size, keep, ties) = _split(df, id_col, text_col, candidates)
    first = F.row_number().over(Window.partitionBy(of).orderBy(F.col(id_col).desc_nulls_last()))
    light = light.withColumn(keep, first).where(F.col(keep) == 1).drop(keep)
    staying = heavy.where(F.col(id_col).eqNullSafe(F.col(keep)))
    # rows that also repeat the id: the partial aggregation leaves one for each task
    tied = staying.where(F.col(ties) > 1).drop(size, keep, ties).dropDuplicates([of])
    staying = staying.where(F.col(ties) == 1).drop(size, keep, ties)
    return light.unionByName(staying).unionByName(tied).select(df.columns)
