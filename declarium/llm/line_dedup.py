"""Line deduplication by pairwise alignment.

The *long* lines of a document, those of at least ``min_words`` words, are hashed
(white space at both ends is trimmed) and form its sequence. Documents that share
a long line are aligned by patience diff, and a long line goes if the alignment
with any earlier document matches it. Every pair is judged on the texts as they
came. The short lines between two long ones form a stretch; it goes along with a
block: if both long lines are matched side by side, and the stretch is the same,
in the first document that holds one of the lines (at the ends of a document, if
both documents begin or end so).

Which pairs are aligned
-----------------------
A document whose sequence is that of an earlier one is aligned with the first of
those alone, as all its long lines go. For all others:

1. each is aligned with the first holder of each of its lines, so the pairs are
   linear in the lines at any frequency;
2. the lines that this leaves although an earlier document has them are *open*.
   Documents with open lines are aligned with all earlier documents that share a
   line of at most ``rare`` holders, and, for a frequent open line, with one of
   each class of its holders that shares a second line: a class has one order of
   frequent lines, gaps and ends, and documents that share only frequent lines
   align alike with all of it. Where the first of a class also shares a rare line,
   the first that doesn't stands for it. A class that shares the open line alone
   counts only if the line is there once, or begins or ends the later document;
   elsewhere patience diff has no anchor for it. So nothing is lost to all pairs,
   whatever ``rare`` is.

Defined results
---------------
* the later of two documents is the one with the larger id (null is the
  largest), then the larger hash of the text.
* rows that repeat id and text are one document and get the same result.
* null text has one empty line, as has the empty text; texts without long lines
  are left as they are.
* an empty table gives an empty result; other columns are ignored.

Texts are read once for the hashes and shuffled once for the result. Pairs carry
the lines that other documents have as well, and those only.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import checkpointed, map_arrow, written

_U = np.uint64
_BLANK_LINE = _U(0x51F2A9D3C4B58E67)


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched positions (i of ``a``, j of ``b``) of two sequences: lines unique
    to both sides and in common order anchor the match, equal neighbours extend
    it, and the stretches between anchors are aligned in turn."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        once_a, once_b = Counter(a[i:i2]), Counter(b[j:j2])
        where = {x: k for k, x in enumerate(a[i:i2], i) if once_a[x] == 1}
        pairs = [(where[x], k) for k, x in enumerate(b[j:j2], j) if once_b[x] == 1 and x in where]
        if not pairs:
            continue
        tails: list[int] = []  # longest rising run of positions in a
        ends: list[int] = []
        back: list[int] = []
        for n, (p, _) in enumerate(pairs):
            k = bisect.bisect_left(tails, p)
            back.append(ends[k - 1] if k else -1)
            if k == len(tails):
                tails.append(p)
                ends.append(n)
            else:
                tails[k], ends[k] = p, n
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        edge_i, edge_j = i, j
        for p, q in [*chain, (i2, j2)]:
            if p > edge_i and q > edge_j:
                todo.append((edge_i, p, edge_j, q))
            if p < i2:
                out.append((p, q))
            edge_i, edge_j = p + 1, q + 1
    return sorted(out)


def _spread(place: Sequence[int], hashes: Sequence[int], ended: bool, gap: object) -> tuple[list, list[int]]:
    """The sequence with a ``gap`` wherever lines of the document are missing, and its places."""
    out, at, before = [], [], -1
    for p, h in zip(place, hashes, strict=True):
        if p != before + 1:
            out.append(gap)
            at.append(-1)
        out.append(h)
        at.append(p)
        before = p
    return (out, at) if ended else ([*out, gap], [*at, -1])


def matched(a: tuple, b: tuple) -> tuple[list[int], list[int]]:
    """Places of the long lines of ``b`` that align with ``a``, and the stretches
    (numbered by the long line behind them) that are the same at that place. Both
    are (places, hashes, stretches before, stretch behind the last line or 0)."""
    one, at_a = _spread(a[0], a[1], a[3] != 0, "a")
    two, at_b = _spread(b[0], b[1], b[3] != 0, "b")
    pairs = patience(one, two)
    before_a, before_b = dict(zip(a[0], a[2], strict=True)), dict(zip(b[0], b[2], strict=True))
    lines, stretches, last = [], [], (-1, -1)
    for i, j in pairs:
        p, q = at_a[i], at_b[j]
        lines.append(q)
        if last == (p - 1, q - 1) and before_a[p] == before_b[q]:
            stretches.append(q)
        last = (p, q)
    if pairs and a[3] and a[3] == b[3] and last == (a[0][-1], b[0][-1]):
        stretches.append(b[0][-1] + 1)
    return lines, stretches


def _hashes(min_words: int):
    """Columns none, id, key, text to none, id, key, lines, stretches (one more than lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.pieces(batch.column(3)):
                rows = hi - lo
                starts, ends, _ = tk.spans(data, offsets)
                l_start, l_end, before = tk.lines(data, offsets)
                first, after = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
                n_words = after - first
                full = n_words > 0
                h = np.full(len(l_start), _BLANK_LINE)
                h[full] = tk.span_hash(data, starts[first[full]], ends[after[full] - 1])
                of_line = np.repeat(np.arange(rows), np.diff(before))
                long = n_words >= min_words
                n_long = np.bincount(of_line[long], minlength=rows)
                # stretch k of a row has its short lines behind its k-th long line; each row has n_long + 1
                ahead = np.concatenate([[0], np.cumsum(n_long + 1)])
                rank = np.cumsum(long) - np.concatenate([[0], np.cumsum(n_long)])[of_line]
                short = ~long
                slot = (ahead[:-1][of_line] + rank)[short]
                own = np.arange(len(slot)) - np.searchsorted(slot, slot)
                stretch = np.zeros(ahead[-1], _U)
                np.add.at(stretch, slot, tk.mix(h[short]) * tk._powers(tk._BASE, int(own.max(initial=0)) + 1)[own])
                stretch = tk.mix(stretch + np.bincount(slot, minlength=ahead[-1]).astype(_U)) | _U(1)
                bounds = np.concatenate([[0], np.cumsum(n_long)]).astype(np.int32)
                columns = [batch.column(i).slice(lo, rows) for i in range(3)]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[long].view(np.int64))))
                columns.append(pa.ListArray.from_arrays(pa.array(ahead.astype(np.int32)), pa.array(stretch.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["none", "id", "key", "lines", "stretches"])

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns b, b_seq, a_seq to b, lines, stretches."""

    def parts(seq: pa.StructScalar) -> tuple:
        place, h, s, e = (c.to_numpy(zero_copy_only=False).tolist() for c in seq.values.flatten())
        return place, h, s, e[-1]

    for batch in batches:
        found = [matched(parts(batch.column(2)[i]), parts(batch.column(1)[i])) for i in range(len(batch))]
        columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["b", "lines", "stretches"])


def _remove(digest: bool, min_words: int):
    def strip(text: str, gone: set[int], stretches: set[int]) -> list[str]:
        k, kept = 0, []
        for line in text.split("\n"):
            if len(line.encode().split()) >= min_words:
                if k not in gone:
                    kept.append(line)
                k += 1
            elif k not in stretches:
                kept.append(line)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n_lines, n_removed, out = [], [], []
                for text, gone, stretches in zip(*(part.column(k) for k in (1, 2, 3)), strict=True):
                    text = text.as_py() or ""
                    n, kept = text.count("\n") + 1, None
                    if gone.is_valid and len(gone):
                        kept = strip(text, set(gone.as_py()), set(stretches.as_py()))
                        text = "\n".join(kept)
                    n_lines.append(n)
                    n_removed.append(0 if kept is None else n - len(kept))
                    out.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                columns = [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_removed", "kept_sha256" if digest else "kept_text"])

    return run


def documents(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """A row for each distinct document with a long line: no (a struct that orders
    them), lines and stretches (hashes), and the first with these lines: first,
    first_stretches. Kept in the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = map_arrow(slim, _hashes(min_words), f"none boolean, id {kind}, key bigint, lines array<bigint>, stretches array<bigint>")
    rows = rows.where(F.size("lines") > 0).select(F.struct("none", "id", "key").alias("no"), "lines", "stretches", F.xxhash64("lines").alias("of"))
    rows = written(rows, "lines")
    if rows.groupBy("no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        rows = rows.dropDuplicates(["no"])
    firsts = rows.groupBy("of").agg(F.min(F.struct("no", "stretches")).alias("f"))
    firsts = firsts.select("of", F.col("f.no").alias("first"), F.col("f.stretches").alias("first_stretches"))
    return written(rows.join(firsts, "of").drop("of"), "classes")


def sequences(docs: DataFrame) -> DataFrame:
    """(no, seq): for the first of each class, its lines that others have too, in
    order: place, h, s (stretch before), e (stretch behind if it is the last line,
    or 0), n (holders) and first (holder)."""
    reps = docs.where("no = first")
    places = F.transform(
        "lines",
        lambda h, i: F.struct(i.alias("place"), h.alias("h"), F.get("stretches", i).alias("s"), F.when(i + 1 == F.size("lines"), F.get("stretches", i + 1)).otherwise(F.lit(0)).alias("e")),
    )
    rows = reps.select("no", F.explode(places).alias("x")).select("no", "x.*")
    held = reps.select("no", F.explode(F.array_distinct("lines")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("first"))
    held = checkpointed(held.where("n > 1"))  # by itself, so that Spark can split the join on a hot line
    seq = rows.join(held, "h").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "h", "s", "e", "n", "first"))).alias("seq"))
    return written(seq, "sequences")


def _slim(name: str):
    return F.transform(name, lambda x: F.struct(x["place"], x["h"], x["s"], x["e"]))


def _aligned(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(no, lines, stretches) of the ``pairs`` (a, b, b_seq)."""
    kind = seqs.schema["no"].dataType.simpleString()
    both = pairs.join(seqs.select(F.col("no").alias("a"), _slim("seq").alias("a_seq")), "a").select("b", "b_seq", "a_seq")
    return _union([map_arrow(both, _align, f"b {kind}, lines array<int>, stretches array<int>").withColumnRenamed("b", "no")])


def with_first_holders(seqs: DataFrame) -> DataFrame:
    """(no, lines, stretches) from the alignments with the first holders of the lines."""
    others = F.array_distinct(F.transform(F.filter("seq", lambda x: x["first"] != F.col("no")), lambda x: x["first"]))
    return _aligned(seqs.select(F.explode(others).alias("a"), F.col("no").alias("b"), _slim("seq").alias("b_seq")), seqs)


def _open(seqs: DataFrame, done: DataFrame) -> DataFrame:
    """(no, seq, left): documents with lines that an earlier one has, but ``done`` leaves."""
    both = seqs.join(done.select("no", "lines"), "no", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))
    left = F.filter("seq", lambda x: (x["first"] != F.col("no")) & ~F.array_contains("lines", x["place"]))
    return checkpointed(both.select("no", "seq", left.alias("left")).where(F.size("left") > 0))


def _union(parts: list[DataFrame]) -> DataFrame:
    """Removals (no, lines, stretches) of the same documents put together."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return reduce(DataFrame.unionByName, parts).groupBy("no").agg(union("lines"), union("stretches"))


def _stand_ins(asked: DataFrame, near: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) for each (b, class): the first of the class that shares no rare line with b, if it is earlier."""
    firsts = classes.groupBy("class").agg(F.min("no").alias("a"))
    asked = checkpointed(asked.join(firsts, "class").where("a < b").join(near.withColumn("also", F.lit(True)), ["a", "b"], "left"))
    chosen, again = asked.where("also IS NULL").select("a", "b"), asked.where("also").select("b", "class")
    if again.take(1):
        members = classes.select(F.col("no").alias("a"), "class")
        skip = checkpointed(near.join(members, "a").join(again, ["b", "class"]).groupBy("b", "class").agg(F.count(F.lit(1)).alias("skip")))
        most = skip.agg(F.max("skip")).first()[0]
        ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("a"))).where(F.col("rank") <= most + 1)
        free = skip.join(ranked, "class").where((F.col("rank") <= F.col("skip") + 1) & (F.col("a") < F.col("b"))).join(near, ["a", "b"], "left_anti")
        chosen = chosen.unionByName(free.groupBy("b", "class").agg(F.min("a").alias("a")).select("a", "b"))
    return chosen


def with_all_holders(seqs: DataFrame, done: DataFrame, rare: int) -> DataFrame:
    """``done`` and what alignments with all earlier holders of the lines it leaves add."""
    open_ = _open(seqs, done)
    if not open_.take(1):
        return done
    b_seq = lambda rows: rows.select(F.col("no").alias("b"), _slim("seq").alias("b_seq"))
    more = lambda pairs, rows: _aligned(pairs.distinct().join(b_seq(rows), "b"), seqs).withColumn("stretches", F.array().cast("array<int>"))
    # all that share a rare line
    holders = seqs.select("no", F.explode(F.array_distinct(F.transform("seq", lambda x: F.struct(x["h"], x["n"])))).alias("x")).select("no", "x.h", "x.n").where(F.col("n") <= rare)
    wanted = open_.select(F.col("no").alias("b"), F.explode("seq").alias("x")).where(F.col("x.n") <= rare).select("b", "x.h").distinct()
    near = checkpointed(holders.select(F.col("no").alias("a"), "h").join(wanted, "h").where("a < b").select("a", "b").distinct())
    # classes of the order of frequent lines; of each, one for every two lines it shares
    often = F.filter("seq", lambda x: x["n"] > rare)
    order = F.transform("often", lambda x, i: F.struct(x["h"], (i > 0) & (F.get("often.place", i - 1) == x["place"] - 1), x["place"] == 0, x["e"] != 0))
    classes = seqs.select("no", often.alias("often")).where(F.size("often") > 0).select("no", F.array_distinct("often.h").alias("h"), F.xxhash64(order).alias("class"))
    classes = checkpointed(classes)
    lines_of = checkpointed(classes.dropDuplicates(["class"]).select("class", "h"))
    hot = lambda name: F.array_distinct(F.transform(F.filter(name, lambda x: x["n"] > rare), lambda x: x["h"]))
    asking = open_.select(F.col("no").alias("b"), F.explode(hot("left")).alias("line"), hot("seq").alias("h"))
    asked_lines = asking.select("line").distinct()
    twos = lambda rows, key: rows.select(key, "line", F.explode("h").alias("other")).where("line <> other")
    of_class = twos(lines_of.select("class", F.explode("h").alias("line"), "h").join(asked_lines, "line", "left_semi"), "class")
    by_two = checkpointed(twos(asking, "b").join(of_class, ["line", "other"]).select("b", "class").distinct())
    pairs = near.unionByName(_stand_ins(by_two, near, classes))
    # and the first documents with the same line at their beginning or end
    for end, where in ((1, "x.place = 0"), (-1, "x.e <> 0")):
        edge = lambda rows: rows.select("no", F.element_at("seq", end).alias("x")).where(where).select("no", "x.h")  # noqa: B023, E731
        firsts = edge(seqs).groupBy("h").agg(F.min("no").alias("a"))
        pairs = pairs.unionByName(edge(open_).withColumnRenamed("no", "b").join(firsts, "h").where("a < b").select("a", "b"))
    done = checkpointed(_union([done, more(pairs, open_)]))
    # documents that share one line alone can match it only if it is there once, or begins or ends the later one
    open_ = _open(seqs, done)
    alone = lambda x: (F.size(F.filter("seq", lambda y: y["h"] == x["h"])) == 1) | ((F.get("seq", 0)["h"] == x["h"]) & (F.get("seq", 0)["place"] == 0)) | ((F.element_at("seq", -1)["h"] == x["h"]) & (F.element_at("seq", -1)["e"] != 0))
    single = open_.withColumn("left", F.filter("left", lambda x: (x["n"] > rare) & alone(x)))
    single = single.select(F.col("no").alias("b"), F.explode(F.array_distinct(F.transform("left", lambda x: x["h"]))).alias("line"))
    rest = single.join(lines_of.select("class", F.explode("h").alias("line")), "line").select("b", "class").distinct().join(by_two, ["b", "class"], "left_anti")
    rest = checkpointed(rest)
    return _union([done, more(_stand_ins(rest, near, classes), open_)]) if rest.take(1) else done


def removals(docs: DataFrame, rare: int) -> DataFrame:
    """(no, lines, stretches): places of the long lines, and numbers of the stretches, that go."""
    seqs = sequences(docs)
    done = with_all_holders(seqs, checkpointed(with_first_holders(seqs)), rare)
    all_lines = F.transform("lines", lambda _, i: i)
    same = F.filter(F.transform("stretches", lambda s, i: F.when(s == F.get("first_stretches", i), i)), lambda i: i.isNotNull())
    return done.unionByName(docs.where("no <> first").select("no", all_lines.alias("lines"), same.alias("stretches")))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4, rare: int = 32, digest: bool = False) -> DataFrame:
    """id, n_lines, n_removed and kept_text (or with ``digest`` kept_sha256) for each
    row of ``df``. ``rare`` changes the work, not the result."""
    gone = removals(documents(df, id_col, text_col, min_words), rare)
    gone = gone.where(F.size("lines") > 0).select(F.col("no.id").alias("g_id"), F.col("no.key").alias("g_key"), "lines", "stretches")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")), "left").select("id", "text", "lines", "stretches")
    name = "kept_sha256" if digest else "kept_text"
    return map_arrow(out, _remove(digest, min_words), f"id {df.schema[id_col].dataType.simpleString()}, n_lines bigint, n_removed bigint, {name} string")
