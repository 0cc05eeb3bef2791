"""Quality rules: base rules on each text, then cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space between words collapsed) and
hashed. Distinct documents per host are counted for each line, where exact
copies of a text count as one document. A line is over its limit when more
than ``max(host_docs_floor, host_share * documents of the host)`` documents of
the host have it; it is removed from all of these but the one with the smallest
id and the exact copies of its text. A document is depleted, and rejected, when fewer than ``min_left`` of its
words are left.

Defined results
---------------
* null text has no words and fails the base rules; null hosts are one host.
* repeated rows get equal verdicts; copies of a text count once for each host.
* a null id is never the first holder of a line unless all holders' ids are null.
* an empty table gives an empty result; other columns are kept by ``apply``.

The per-document measures come from one pass of vectorised code whose memory is
bounded by ``textkit.CHUNK`` or the longest text. Line counts are aggregated
in two steps, so a host or a line that a third of the rows share is
pre-aggregated by the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import checkpointed, fresh, map_arrow

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    host_docs_floor: int = 20
    host_share: float = 0.05
    min_left: float = 0.5


def _line_words(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the word hashes from ``lo`` to ``hi``, for each line."""
    n = len(hashes)
    up = tk._table("up")[:n] if n <= tk.CHUNK else tk._powers(tk._BASE, n)
    down = tk._table("down")[: n + 1] if n <= tk.CHUNK else tk._powers(pow(tk._BASE, -1, 2**64), n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return tk.mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def measure_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each row, and of its distinct normalised lines: hashes, words, bounds by row."""
    rows = len(offsets) - 1
    starts, ends, first = tk.spans(data, offsets)
    n_words = np.diff(first)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~tk.SPACE[data], out=lead[1:])
    symbols = np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[data]), offsets))

    words = tk.span_hash(data, starts, ends)
    of_word = np.repeat(np.arange(rows), n_words)
    covered = np.zeros(len(words), bool)
    triples = tk.grams(words, 3)
    if len(triples):
        m = len(triples)
        inside = of_word[:m] == of_word[2:]
        keys = tk.mix(triples + of_word[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys = keys[inside]
        order = np.sort(keys)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.searchsorted(twice, keys)
            at[at == len(twice)] = 0
            hit = np.zeros(m, bool)
            hit[inside] = twice[at] == keys
            covered[:m] |= hit
            covered[1 : m + 1] |= hit
            covered[2 : m + 2] |= hit
    repeat = tk.sums(covered, first)

    l_start, l_end, before = tk.lines(data, offsets)
    lo, hi = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    of_line = np.repeat(np.arange(rows), np.diff(before))
    full = hi > lo
    l_start, l_end, lo, hi, of_line = l_start[full], l_end[full], lo[full], hi[full], of_line[full]
    exact = tk.span_hash(data, l_start, l_end)
    order = np.lexsort((exact, of_line))
    new = np.ones(len(order), bool)
    new[1:] = (exact[order][1:] != exact[order][:-1]) | (of_line[order][1:] != of_line[order][:-1])
    dup = np.bincount(of_line[order][~new], minlength=rows)

    normal = _line_words(tk.span_hash(tk.LOWER[data], starts, ends), lo, hi)
    order = np.lexsort((normal, of_line))
    normal, of_line, size = normal[order], of_line[order], (hi - lo)[order]
    new = np.ones(len(order), bool)
    new[1:] = (normal[1:] != normal[:-1]) | (of_line[1:] != of_line[:-1])
    begin = np.flatnonzero(new)
    size = np.add.reduceat(size, begin) if len(begin) else size[:0]
    bounds = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(of_line[new], minlength=rows), out=bounds[1:])
    measures = dict(zip(MEASURES, (n_words, lead[offsets[1:]] - lead[offsets[:-1]], symbols, dup, repeat), strict=True))
    return measures, normal[new].view(np.int64), size.astype(np.int32), bounds


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, host, key, text to id, host, key, measures, lines."""
    for batch in batches:
        for lo, hi, data, offsets in tk.pieces(batch.column(3)):
            got, hashes, words, bounds = measure_piece(data, offsets)
            lines = pa.ListArray.from_arrays(
                pa.array(bounds), pa.StructArray.from_arrays([pa.array(hashes), pa.array(words)], ["h", "w"])
            )
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
            columns += [pa.array(got[k].astype(np.int64)) for k in MEASURES] + [lines]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "key", *MEASURES, "lines"])


def _keys(df: DataFrame, id_col: str, text_col: str, host_col: str) -> list:
    host = F.col(host_col).cast("string")
    return [
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("+"), host), F.lit("")).alias("host"),
        F.xxhash64(text_col).alias("key"),
    ]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, key (hash of the text), the base measures, and the distinct
    normalised lines (hash, words), written to the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, host string, key bigint, {', '.join(f'{k} bigint' for k in MEASURES)}, lines array<struct<h:bigint,w:int>>"
    return checkpointed(map_arrow(df.select(*_keys(df, id_col, text_col, host_col), text_col), _measure, schema))


def frequent_lines(base: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, h, holder): the lines over their host's limit and the text (its hash) that keeps them."""
    lines = base.select("host", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("no"), F.explode("lines.h").alias("h"))
    texts = lines.groupBy("host", "h", "no.key").agg(F.min("no").alias("no"))
    held = texts.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no")).withColumn("holder", F.col("no.key"))
    held = held.where(F.col("n") > rules.host_docs_floor)
    hosts = base.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return held.join(hosts, "host").where(F.col("n") > rules.host_share * F.col("docs")).select("host", "h", "holder")


def verdicts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """A row for each document: id, host, key, the measures, base_failed,
    n_removed_words, drop (hashes of its lines that go), kept."""
    base = measure(df, id_col, text_col, host_col)
    lines = base.select("host", "id", "key", F.explode("lines").alias("line")).select("host", "id", "key", "line.h", "line.w")
    going = lines.join(frequent_lines(base, rules), ["host", "h"]).where("key <> holder")
    going = going.groupBy("host", "key", "id").agg(F.collect_set(F.struct("h", "w")).alias("gone"))
    going = going.select(F.col("host").alias("g_host"), F.col("key").alias("g_key"), F.col("id").alias("g_id"), "gone")
    same = (F.col("host") == F.col("g_host")) & (F.col("key") == F.col("g_key")) & F.col("id").eqNullSafe(F.col("g_id"))
    both = base.drop("lines").join(going, same, "left")
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("bigint"), lambda a, x: a + x["w"]), F.lit(0))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    both = both.withColumn("n_removed_words", removed).withColumn("base_failed", failed)
    fine = F.col("n_words") - F.col("n_removed_words") >= rules.min_left * F.col("n_words")
    return both.select(
        "id", "host", "key", *MEASURES, "base_failed", "n_removed_words", F.col("gone.h").alias("drop"), (~F.col("base_failed") & fine).alias("kept")
    )


def _strip(text: str, drop: np.ndarray) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    starts, ends, _ = tk.spans(data, offsets)
    l_start, l_end, _ = tk.lines(data, offsets)
    lo, hi = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    normal = _line_words(tk.span_hash(tk.LOWER[data], starts, ends), lo, hi).view(np.int64)
    stay = ~(np.isin(normal, drop) & (hi > lo))
    raw = data.tobytes()
    return b"\n".join(raw[a:b] for a, b in zip(l_start[stay], l_end[stay], strict=True)).decode()


def _cleaner(text_at: int, names: list[str]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = batch.column(len(names))
            columns = [batch.column(i) for i in range(len(names))]
            if drop.null_count < len(batch):
                texts = columns[text_at].to_pylist()
                for i, gone in enumerate(drop):
                    if gone.is_valid and texts[i] is not None:
                        texts[i] = _strip(texts[i], gone.values.to_numpy(zero_copy_only=False))
                columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return clean


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The kept documents, without their lines over the limits; columns as in ``df``."""
    host, key, own, kept, drop, host1, key1, own1 = fresh(df, "host", "key", "id", "kept", "drop", "host1", "key1", "id1")
    out = verdicts(df, id_col, text_col, host_col, rules).where(~F.col("kept") | F.col("drop").isNotNull())
    out = out.groupBy(F.col("host").alias(host), F.col("key").alias(key), F.col("id").alias(own)).agg(F.first("kept").alias(kept), F.first("drop").alias(drop))
    keyed = df.select(*df.columns, *[c.alias(n) for c, n in zip(_keys(df, id_col, text_col, host_col), (own1, host1, key1), strict=True)])
    same = (F.col(host1) == F.col(host)) & (F.col(key1) == F.col(key)) & F.col(own1).eqNullSafe(F.col(own))
    staying = keyed.join(out, same, "left").where(F.coalesce(kept, F.lit(True))).select(*df.columns, drop)
    return map_arrow(staying, _cleaner(df.columns.index(text_col), df.columns), df.schema)
