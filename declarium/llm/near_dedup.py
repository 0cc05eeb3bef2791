"""Near-duplicates by SimHash and by verified similarity of shingles.

Two texts link if their SimHash fingerprints do (``simhash``: shingles of three
words, at most 3 of 64 bits), or if the Jaccard similarity of their sets of
five-word shingles is 0.8 or more and one is the first of the texts that share one
of its bands. A band is 5 of 130 MinHash values, and the first text is that with the
smallest hash; a pair at 0.8 shares none of 26 bands with probability 3e-5, and less
above. So each text is compared with at most 26 others, however many share its
bands, and a text reaches its group through the first ones.

Most comparisons end with the share of equal MinHash values: below 0.64, which is 4.5
standard deviations under 0.8, the pair is left. The others are verified on the
whole sets of both texts: each text with the first text it agrees with most, then with
those of its other first texts that it isn't joined to through that one, so a large group of
near copies isn't verified 26 times over.

Defined results
---------------
* rows of equal text are one node; text without words links by fingerprint only.
* fewer words than a shingle: the whole sequence is the one shingle.
* an empty table gives an empty result; columns are as in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import textkit as tk
from .components import components
from .shared import checkpointed, discard, map_arrow, written

WIDTH, BANDS, ROWS, LIKELY = 5, 26, 5, 0.64
_BLOCK = 1 << 12
_draw = np.random.RandomState(20250301)
_XOR, _TIMES = (_draw.randint(0, 2**63, (BANDS * ROWS, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each text, in order of the text."""
    for _, _, data, offsets in tk.pieces(texts):
        starts, ends, first = tk.spans(data, offsets)
        words = tk.span_hash(tk.LOWER[data], starts, ends)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield tk.grams(words[lo:hi], min(WIDTH, hi - lo)) if hi > lo else words[:0]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a text with words."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), _BLOCK):
        np.minimum(least, tk.mix((hashes[None, lo : lo + _BLOCK] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The value of each band."""
    out = _SALT.copy()
    for values in least.reshape(BANDS, ROWS).T:
        out = tk.mix(out + values)
    return out.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text, key to id, key, fp, bands, and a byte of each MinHash value; no bands and bytes without words."""
    for batch in batches:
        fps = np.fromiter((simhash.fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, len(batch))
        least = [minima(h) if len(h) else None for h in shingles(batch.column(1))]
        made = _lists([np.zeros(0, np.int64) if x is None else bands(x) for x in least])
        low = pa.array([b"" if x is None else x.astype(np.uint8).tobytes() for x in least], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64)), made, low], ["id", "key", "fp", "bands", "low"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, text to key, shingles (distinct, in order)."""
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            made = _lists([np.unique(h).view(np.int64) for h in shingles(part.column(1))])
            yield pa.RecordBatch.from_arrays([part.column(0), made], ["key", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, low of a, low of b to a, b, agree of the pairs that have enough equal MinHash values."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), BANDS * ROWS) for k in (2, 3))
        agree = (one == two).sum(axis=1, dtype=np.int32)
        good = pa.array(agree >= LIKELY * BANDS * ROWS)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(agree).filter(good)], ["a", "b", "agree"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, set of a, set of b to the a and b that are similar: 10 common of 8 in both, in whole numbers."""
    for batch in batches:
        good = []
        for i in range(len(batch)):
            a, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(10 * common >= 8 * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["a", "b"])


def _probable(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, agree): the ``pairs`` (a, b) of text keys that may be similar."""
    low = texts.select("key", "low")
    both = pairs.join(low.withColumnsRenamed({"key": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"key": "b", "low": "y"}), "b")
    return checkpointed(map_arrow(both.select("a", "b", "x", "y"), _likely, "a bigint, b bigint, agree int"))


def _verified(df: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of text keys that are similar."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = df.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(needed, "key", "left_semi")
    made = written(map_arrow(rows, _sets, "key bigint, shingles array<bigint>"), "shingles")
    sets = made.groupBy("key").agg(F.first("shingles").alias("shingles")) if made.groupBy("key").count().where("count > 1").take(1) else made
    sets = sets.hint("merge")  # as files, sets of like texts are far smaller than as rows to broadcast
    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    out = checkpointed(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), _similar, "a bigint, b bigint"))
    discard(made)
    return out


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of text keys to which ``of`` (key, label) doesn't give one label;
    a key that it doesn't have is its own label."""
    x, y = of.withColumnsRenamed({"key": "a", "label": "x"}), of.withColumnsRenamed({"key": "b", "label": "y"})
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def labels(df: DataFrame, text_col: str, rows: DataFrame) -> DataFrame:
    """(key, label) of each text: those that a chain of links joins have one label."""
    texts = written(rows.groupBy("key").agg(F.first("fp").alias("label"), F.first("bands").alias("bands"), F.first("low").alias("low")), "bands")
    nodes = checkpointed(texts.select("key", "label"))
    held = texts.select("key", F.explode("bands").alias("band"))
    firsts = checkpointed(held.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a")).where("n > 1").select("band", "a"))
    # a merge, as Spark takes the exploded bands for one row a text and would broadcast them
    star = held.withColumnRenamed("key", "b").join(firsts.hint("merge"), "band").where("a <> b").select("a", "b").distinct()
    pairs = _probable(texts, _apart(star, nodes))
    discard(texts)
    best = checkpointed(pairs.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best")).select("best.a", "b"))
    near = _verified(df, text_col, best)
    # each text's first text or that one's own, so that most pairs of a group are known to be joined
    up = near.withColumnsRenamed({"a": "up", "b": "a"})
    known = checkpointed(near.join(up, "a", "left").select(F.col("b").alias("key"), F.coalesce("up", "a").alias("label")))
    others = pairs.join(best.withColumnRenamed("a", "tried"), "b").where("a <> tried").select("a", "b")
    near = near.unionByName(_verified(df, text_col, checkpointed(_apart(others, known))))
    of = lambda key, label: nodes.select(F.col("key").alias(key), F.col("label").alias(label))
    links = near.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v")
    roots = components(links.unionByName(simhash.links(nodes.select(F.col("label").alias("fp")).distinct()).select("u", "v"))).withColumnRenamed("node", "label")
    return checkpointed(nodes.join(roots, "label", "left").select("key", F.coalesce("root", "label").alias("label")))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id (of rows that repeat it,
    one); columns as in ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    rows = written(map_arrow(keyed, _measure, f"id {kind}, key bigint, fp bigint, bands array<bigint>, low binary"), "measures")
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = rows.groupBy("key").agg(order.alias("first")).join(labels(df, text_col, rows), "key")
    stay = checkpointed(firsts.groupBy("label").agg(F.min("first").alias("first")).select("first.id", "first.key"))
    repeated = bool(rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))
    discard(rows)
    return simhash.only(df, id_col, text_col, stay, repeated)
