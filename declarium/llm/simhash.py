"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most 3 bits differ in at most one bit in one segment, so every
fingerprint is entered in a table for each segment, and probes each table with
the 33 values of the Hamming ball of radius 1 around its own segment; complete
distances of the matches are verified. Equal fingerprints are one entry, so
copies never meet in pairs.

A table key with more than ``dense`` entries would yield pairs with the square
of its size. Such keys take an exact way of linear size instead: every entry of
the key names the values z of the other segment within one bit of its own, of
which each z keeps one entry; every probe that lands on the key looks up the z
that its remaining distance allows, and links to the entry kept there. Two
fingerprints link by the key exactly if such a z exists.

Defined results
---------------
* null text and text without words have fingerprint 0 and link like any other.
* fewer words than a shingle: the whole sequence is the one shingle.
* repeated rows and ties: component ids depend on sets of ids only. A null id
  is no candidate for component_id unless a component has no other.
* an empty table gives an empty result; other columns are kept by ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, fresh, map_arrow

BITS, HALF, DISTANCE = 64, 32, 3
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and \\x20 \\x09-\\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width + 1, 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n)
        shingles = [joined[a:b] for a, b in zip(starts[lo:hi].tolist(), last[lo:hi].tolist(), strict=True)]
        h = np.fromiter(map(digest, shingles, repeat(seed)), np.uint64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["id", "key", "fp"])

    return run


def _ball(radius: int) -> list[int]:
    """The masks of up to ``radius`` bits of a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(HALF), r)]


def _masks(radius: int) -> Column:
    return F.array(*[F.lit(m).cast("bigint") for m in _ball(radius)])


def _segments(entries: DataFrame) -> DataFrame:
    """(fp, j, seg, rest): both segments of each fingerprint with the other one."""
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned("fp", HALF)
    parts = F.array(
        F.struct(F.lit(0).alias("j"), low.alias("seg"), high.alias("rest")),
        F.struct(F.lit(1).alias("j"), high.alias("seg"), low.alias("rest")),
    )
    return entries.select("fp", F.explode(parts).alias("p")).select("fp", "p.j", "p.seg", "p.rest")


def _probes(index: DataFrame) -> DataFrame:
    """(fp, j, seg, rest, off): the keys that each fingerprint looks up, and the
    bits of the segment that are changed."""
    out = index.select("fp", "j", "seg", "rest", F.explode(_masks(1)).alias("mask"))
    return out.select("fp", "j", F.col("seg").bitwiseXOR(F.col("mask")).alias("seg"), "rest", F.when(F.col("mask") == 0, 0).otherwise(1).alias("off"))


def _sparse_links(index: DataFrame, probes: DataFrame) -> DataFrame:
    found = probes.select(F.col("fp").alias("u"), "j", "seg").join(index.select(F.col("fp").alias("v"), "j", "seg").hint("merge"), ["j", "seg"])
    return found.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")


def _dense_links(index: DataFrame, probes: DataFrame) -> DataFrame:
    named = index.select("fp", "j", "seg", F.explode(F.transform(_masks(1), lambda m: F.col("rest").bitwiseXOR(m))).alias("z"))
    kept = named.groupBy("j", "seg", "z").agg(F.min("fp").alias("v"))
    near = F.when(F.col("off") == 0, _masks(DISTANCE - 1)).otherwise(_masks(DISTANCE - 2))
    looked = probes.select("fp", "j", "seg", F.explode(F.transform(near, lambda m: F.col("rest").bitwiseXOR(m))).alias("z"))
    return looked.join(kept.hint("merge"), ["j", "seg", "z"]).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(entries: DataFrame, dense: int = 256) -> DataFrame:
    """(u, v): links between the distinct fingerprints fp of ``entries``, so
    that two are connected exactly if a chain of distances of 3 or less joins them.

    Spark takes exploded rows for as many as they come from, 66 times too few here, and
    would broadcast them; so their joins are merges, or can build on ``large`` only."""
    index = _segments(entries)
    probes = _probes(index)
    large = index.groupBy("j", "seg").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("j", "seg")
    large = checkpointed(large)
    if not large.take(1):
        return _sparse_links(index, probes)
    sparse = _sparse_links(index.join(large, ["j", "seg"], "left_anti"), probes.join(large, ["j", "seg"], "left_anti"))
    return sparse.unionByName(_dense_links(index.join(large, ["j", "seg"], "left_semi"), probes.join(large, ["j", "seg"], "left_semi")))


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, dense: int = 256) -> DataFrame:
    """(id, key, fp, component_id, stays) for each row of ``df``; key is a hash of
    the text, and ``stays`` marks the smallest (id, key) of each component."""
    rows = df.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    kind = df.schema[id_col].dataType.simpleString()
    rows = checkpointed(map_arrow(rows, _fingerprints(width), f"id {kind}, key bigint, fp bigint"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    entries = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(entries.select("fp"), dense))
    linked = roots.withColumnRenamed("node", "fp").join(entries, "fp")
    firsts = linked.groupBy("root").agg(F.min("first").alias("of_all"))
    named = linked.join(firsts, "root").select("fp", "of_all")
    table = checkpointed(entries.join(named, "fp", "left").select("fp", F.coalesce("of_all", "first").alias("first")))
    out = rows.join(table, "fp")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    return out.select("id", "key", "fp", F.col("first.id").alias("component_id"), stays.alias("stays"))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, dense: int = 256) -> DataFrame:
    """One row of each group: that with the smallest id (of rows that repeat it,
    one); columns as in ``df``."""
    groups = group(df, id_col, text_col, width, dense).where("stays")
    stay = checkpointed(groups.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")))
    return only(df, id_col, text_col, stay.select("id", "key"), bool(stay.where("n > 1").take(1)))


def only(df: DataFrame, id_col: str, text_col: str, stay: DataFrame, repeated: bool) -> DataFrame:
    """The rows of ``df`` that ``stay`` (id, hash of the text) names; if some are
    ``repeated``, one of each."""
    of, own_id, own_key = fresh(df, "key", "stay_id", "stay_key")
    rows = df.withColumn(of, F.xxhash64(text_col))
    stay = stay.select(F.col("id").alias(own_id), F.col("key").alias(own_key))
    rows = rows.join(stay, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(of) == F.col(own_key)), "left_semi")
    if repeated:
        rows = rows.dropDuplicates([id_col, of])
    return rows.select(df.columns)
