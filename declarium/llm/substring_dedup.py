"""Substring deduplication by level-wise doubling.

A window of ``size`` words is repeated only if the shorter windows in it are.
Lengths double from ``size / 4``: only places whose short window is repeated are
looked at with twice the length, until windows of ``size`` words remain.

The first level is thinned without losing a repeat: of the short windows inside
a window of ``size`` words, the one with the smallest hash (the leftmost of
equals) is its anchor. Equal windows have their anchor at the same distance
from their start, so only anchors, about two in ``size`` words, are compared.
An anchor stands for the run of windows it is the anchor of. The next level
compares the windows of twice the length to the right and to the left of the
anchor; every window of the run contains one of the two. Runs that survive are
expanded to their full windows, which are compared by 96 bits of hash, and
every window but the first in (document, position) is marked.

Defined results
---------------
* null text has no words; texts shorter than a window are left as they are.
* where ids repeat or are null, the hash of the text tells rows apart and
  orders them; rows that repeat id and text are one document, and get the same
  result.
* a null id is larger than every other id.
* an empty table gives an empty result.

Shuffles carry anchors and surviving windows, not every window, and the texts
twice. A passage that many documents share is one hash in many rows: hashes in
more than 1/1024 of the rows are named by a Misra-Gries summary, whose list is
bounded, and settled on the map side; all other groups are below that share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import discard, map_arrow, written

SIZE = 20


def _first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``width`` neighbours."""
    n = len(values) - width + 1
    best = np.arange(n)
    low = values[:n].copy()
    for k in range(1, width):
        other = values[k : k + n]
        less = other < low
        low[less] = other[less]
        best[less] += k - (best[less] - np.flatnonzero(less))
    return best


def _both(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tk.grams(h, n), tk.grams(tk.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), n, 0xC2B2AE3D27D4EB4F)


def anchor_runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of all windows inside the rows: row, first and last window of each run with
    one anchor (both counted from the first word of all), and the anchor."""
    short = size // 4
    none = np.zeros(0, np.int64)
    if len(words) < size:
        return none, none, none, none
    rows = len(first) - 1
    at = _first_minima(tk.grams(words, short), size - short + 1)
    of_word = np.repeat(np.arange(rows), np.diff(first))
    n = len(at)
    inside = np.flatnonzero(of_word[:n] == of_word[size - 1 :])
    if not len(inside):
        return none, none, none, none
    row, anchor = of_word[inside], at[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(inside)) - 1
    return row[begin], inside[begin], inside[end], anchor[begin]


def _anchors(size: int):
    """Keys and text to keys, h (of the anchor), place (first window, run, anchor)
    and wide (32 bits of hash of the windows to the right and left of the anchor)."""
    short, double = size // 4, size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            for lo, hi, data, offsets in tk.pieces(batch.column(len(names))):
                starts, ends, first = tk.spans(data, offsets)
                words = tk.span_hash(data, starts, ends)
                row, begin, end, anchor = anchor_runs(words, first, size)
                if not len(row):
                    continue
                h, two = tk.grams(words, short)[anchor], tk.grams(words, double) >> np.uint64(32)
                right = two[np.minimum(anchor, len(two) - 1)]
                left = two[np.maximum(anchor - (double - short), 0)]
                place = ((begin - first[:-1][row]) << 16) | ((end - begin) << 8) | (anchor - begin)
                at = pa.array(row, pa.int64())
                keys = [batch.column(i).slice(lo, hi - lo).take(at) for i in range(len(names))]
                own = [h.view(np.int64), place, ((right << np.uint64(32)) | left).view(np.int64)]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(x) for x in own], [*names, "h", "place", "wide"])

    return run


def _windows(size: int):
    """Keys, text and runs to keys, start, h1, h2 of the runs' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-2]
            k = len(names)
            for lo, hi, data, offsets in tk.pieces(batch.column(k)):
                starts, ends, first = tk.spans(data, offsets)
                words = tk.span_hash(data, starts, ends)
                runs = batch.column(k + 1).slice(lo, hi - lo)
                of_run = np.repeat(np.arange(hi - lo), np.diff(runs.offsets.to_numpy()))
                begin, end = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
                if not len(begin):
                    continue
                n = (end - begin + 1).astype(np.int64)
                of_window = np.repeat(of_run, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                where = np.unique(first[:-1][of_window] + at)
                of_window = np.searchsorted(first, where, "right") - 1
                one, two = _both(words, size)
                same = pa.array(of_window + lo)
                keys = [batch.column(i).take(same) for i in range(k)]
                own = [(where - first[of_window]).astype(np.int32), one[where].view(np.int64), (two[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(x) for x in own], [*names, "start", "h1", "h2"])

    return run


def keep_mask(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """False for words covered by the windows at ``starts``."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n_words), -1)
    return np.cumsum(step[:-1]) == 0


def _remove(size: int, digest: bool):
    """id, text and repeats (starts) to id and the cleaned text, or its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n_words, n_removed, out = [], [], []
                for text, repeats in zip(part.column(1), part.column(2), strict=True):
                    words = (text.as_py() or "").encode().split()  # bytes: \\x20 \\x09-\\x0D only
                    n_words.append(len(words))
                    if repeats.is_valid and len(repeats):
                        stay = keep_mask(len(words), repeats.values.to_numpy(zero_copy_only=False).astype(np.int64), size)
                        words = [words[i] for i in np.flatnonzero(stay)]
                    n_removed.append(n_words[-1] - len(words))
                    kept = b" ".join(words)
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                    ["id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
                )

    return run


def _frequent(rows: DataFrame, column: str, most: int) -> list[int]:
    """Values of ``column`` that a Misra-Gries summary finds in more than 1/most
    of the rows: at most ``most`` of them, so they may go into the plan."""
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({column}, {most}, {8 * most})").alias("top")).first()
    return [t["item"] for t in top.top or [] if t["count"] > max(top.n / most, 1)]


def _same(a: str, b: str, keys: list[str]):
    """Equality of the keys of two tables; a lone id is neither null nor repeated."""
    if len(keys) == 1:
        return F.col(f"{a}.id") == F.col(f"{b}.id")
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def surviving_runs(texts: DataFrame, keys: list[str], kinds: str, size: int, most: int) -> DataFrame:
    """keys and runs (first and last window) whose windows of size/4 and size/2 words are repeated."""
    anchors = map_arrow(texts.select(*keys, "text"), _anchors(size), f"{kinds}, h bigint, place bigint, wide bigint")
    # a hash in so many rows is repeated: its rows pass, and are dealt out by place
    hot = F.col("h").isin(_frequent(anchors, "h", most))
    marked = anchors.withColumn("hot", hot).withColumn("salt", F.when(F.col("hot"), F.xxhash64(*keys, "place")).otherwise(F.lit(0)))
    count = lambda *by: F.count(F.lit(1)).over(Window.partitionBy("h", "salt", *by))
    rest = marked.withColumn("n", count()).where("n > 1 OR hot")
    rest = rest.withColumn("r", F.shiftright("wide", 32)).withColumn("l", F.col("wide").bitwiseAND(F.lit(0xFFFFFFFF)))
    # a run may have only one of the two, so the sides are counted apart
    rest = rest.withColumn("n_r", count("r")).withColumn("n_l", count("l"))
    both = rest.select(*keys, "place", F.expr("n_r > 1 OR hot").alias("on_r"), F.expr("n_l > 1 OR hot").alias("on_l"))
    begin = F.shiftright("place", 16).cast("int")
    both = both.select(
        *keys,
        "on_r",
        "on_l",
        begin.alias("b"),
        (begin + F.shiftright("place", 8).bitwiseAND(F.lit(255))).cast("int").alias("e"),
        (begin + F.col("place").bitwiseAND(F.lit(255))).cast("int").alias("a"),
    )
    double, back = size // 2, size // 2 - size // 4
    right = F.struct(F.greatest("b", F.col("a") - double).alias("b"), F.col("e").alias("e"))
    left = F.struct(F.col("b").alias("b"), F.least("e", F.col("a") - back).alias("e"))
    sides = F.filter(F.array(F.when(F.col("on_r"), right), F.when(F.col("on_l"), left)), lambda x: x.isNotNull() & (x["b"] <= x["e"]))
    return both.select(*keys, F.explode(sides).alias("run")).groupBy(*keys).agg(F.collect_list("run").alias("runs"))


def repeats(texts: DataFrame, keys: list[str], kinds: str, size: int = SIZE, most: int = 1024) -> DataFrame:
    """keys and repeats (in the shared folder): starts of the windows that are not the first of their kind.

    ``texts`` has a row for each combination of ``keys``, and its text."""
    spark = texts.sparkSession
    runs = written(surviving_runs(texts, keys, kinds, size, most), "runs")
    full = texts.alias("t").join(runs.alias("r"), _same("t", "r", keys)).select(*[f"t.{k}" for k in keys], "text", "runs")
    windows = written(map_arrow(full, _windows(size), f"{kinds}, start int, h1 bigint, h2 int"), "windows")
    discard(runs)
    names = [*keys, "start"]
    place = F.struct(F.col("id").isNull().alias("none"), *names)
    firsts = windows.where(F.col("h1").isin(_frequent(windows, "h1", most))).groupBy("h1", "h2").agg(F.min(place).alias("first"))
    # bounded by the summary, but for hashes that agree in h1 alone
    table = spark.createDataFrame(firsts.collect(), firsts.schema)
    # one row at most for each window: the winners' hashes are distinct
    heavy = windows.join(F.broadcast(table), ["h1", "h2"], "left")
    later = heavy.where(F.coalesce(place != F.col("first"), F.lit(False))).select(*names)
    order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), *names[1:]))
    rest = heavy.where(F.col("first").isNull()).withColumn("k", order).where("k > 1").select(*names)
    out = written(later.unionByName(rest).groupBy(*keys).agg(F.collect_list("start").alias("repeats")), "repeats")
    discard(windows)
    return out


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, digest: bool = False, most: int = 1024) -> DataFrame:
    """id, n_words, n_removed and kept_text (or with ``digest`` kept_sha256) for
    each row of ``df``; words are joined by one space."""
    if size % 4 or size > 252:
        raise ValueError("size must be a multiple of 4, at most 252")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys, kinds, texts = ["id"], f"id {kind}", rows
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").take(1):
        keys, kinds, texts = ["id", "key"], f"id {kind}, key bigint", rows.dropDuplicates(["id", "key"])
    found = repeats(texts, keys, kinds, size, most)
    joined = rows.alias("t").join(found.alias("f"), _same("t", "f", keys), "left").select("t.id", "text", "repeats")
    name = "kept_sha256" if digest else "kept_text"
    return map_arrow(joined, _remove(size, digest), f"id {kind}, n_words bigint, n_removed bigint, {name} string")
