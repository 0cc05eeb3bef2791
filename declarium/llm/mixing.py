"""Mixing sources to target weights by entropy balancing.

Document rates minimise the entropy of the mixed word mass relative to the
corpus, subject to a word total for each constraint; the solution is an
exponential tilt ``exp(sum of the multipliers of a document's constraints)``.
The multipliers come from Newton steps on the convex dual.

If each document is under one constraint, its source, the Hessian is diagonal and
the dual falls into one problem for each source: gradient, Hessian and step stay in
the row of the source, and only the largest error reaches the driver
(``balance_sources``). With several constraint columns (``entropy_balance``) Spark
sums gradient and Hessian over the cells of the columns, and the driver holds one
number for each pair of the caller's constraints that meet in a cell.

Sources are ranked, weighed and filled up to their caps in Spark as well, so their
number is not bounded. Rates become whole copies by error diffusion in blocks: a
source is dealt by hash into blocks of about ``BLOCK`` documents, and in each, from
the longest document to the shortest, the copies follow the words still owed. No
block holds a whole source, and results depend on the rows alone, so reruns agree.

Defined results
---------------
* null text and text without words have size 0; they are taken ``round(rate)``
  times, 0 words.
* a null source is a source of its own, last in order.
* rows that repeat id, source and size are treated alike.
* sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import checkpointed, fresh, map_arrow

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 1000
SMALL = 10_000  # sources whose plan is broadcast; more are joined by shuffling


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tk.pieces(batch.column(2)):
            size = np.diff(tk.spans(data, offsets)[2]).astype(np.int64)
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(2)] + [pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "source", "size"])


def sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, size in words, and the number n of rows alike, in the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_col)
    rows = map_arrow(slim, _counts, f"id {kind}, source string, size bigint")
    return checkpointed(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")))


def sources(sized: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, docs, total (of words) and weight of each source; weights go round
    in order of the sources: by code point, null last."""
    totals = sized.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).cast("bigint").alias("total"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = checkpointed(ranked.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    before, base = 0, []
    for part, n in sorted(map(tuple, ranked.groupBy("part").count().collect())):  # one row for each partition
        base.append((part, before))
        before += n
    if not base:
        return ranked.withColumn("weight", F.lit(0.0)).drop("part", "at")
    rank = F.col("at") + F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in base]), F.array(*[F.lit(n) for _, n in base])), F.col("part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("part", "at")


def water_fill(table: DataFrame, cap: float = MOST_COPIES) -> DataFrame:
    """``table`` with each source's target: shares of all words by weight, none above
    ``cap`` times its total; the excess is shared again by weight among the others.
    One aggregation for each round of capping."""
    level, closed = 0.0, -1
    over = lambda: F.col("weight") * F.lit(level) > F.lit(float(cap)) * F.col("total")
    while True:
        r = table.agg(
            F.sum("total").alias("all"), F.sum(F.when(over(), F.col("total"))).alias("in_closed"), F.sum(F.when(~over(), F.col("weight"))).alias("open"), F.count(F.when(over(), 1)).alias("closed")
        ).first()
        if r["closed"] == closed or not r["open"]:
            break
        closed, level = r["closed"], (r["all"] - cap * (r["in_closed"] or 0)) / r["open"]
    return table.withColumn("target", F.when(over(), F.lit(float(cap)) * F.col("total")).otherwise(F.col("weight") * F.lit(level)))


def balance_sources(table: DataFrame, rounds: int = 30, steps: int = 8, tolerance: float = 1e-10) -> DataFrame:
    """``table`` with rate, the tilt of each source, by Newton steps from 0.

    For one source the dual is total * exp(lam) - target * lam; each step moves lam by
    gradient over Hessian, 1 - target / (total * exp(lam)). It is convex and its first
    step never falls short, so the steps need no damping."""
    ratio = F.when((F.col("total") > 0) & (F.col("target") > 0), F.col("target") / F.col("total"))
    table = table.withColumn("ratio", ratio).withColumn("lam", F.lit(0.0))
    error = F.max(F.abs(F.exp("lam") / F.col("ratio") - 1))
    for _ in range(rounds):
        move = lambda lam, _: lam - 1 + F.col("ratio") * F.exp(-lam)
        table = checkpointed(table.withColumn("lam", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("lam"), move)))
        if (table.agg(error).first()[0] or 0.0) <= tolerance:
            return table.withColumn("rate", F.coalesce(F.exp("lam"), F.lit(0.0))).drop("ratio", "lam")
    raise RuntimeError("no balance after all steps")


def entropy_balance(cells: DataFrame, constraints: Sequence[str], targets: dict[tuple[str, str | None], float], mass: str = "mass", steps: int = 100, tolerance: float = 1e-10) -> dict[tuple[str, str | None], float]:
    """Multipliers of the constraints (column, value) whose targets are given.

    ``cells`` has a row for each combination of the constraint columns, and its
    word mass. Every Newton step is one Spark aggregation over ``cells``, and its
    linear system is solved by conjugate gradients on the pairs that occur."""
    names = [k for k, t in targets.items() if t > 0]
    at = {k: i for i, k in enumerate(names)}
    goal = np.array([targets[k] for k in names])
    columns = list(constraints)

    def moments(lam: np.ndarray) -> tuple[float, np.ndarray, tuple[np.ndarray, ...]]:
        def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts: dict[tuple[int, int], float] = {}
            for frame in frames:
                for *values, m in frame[[*columns, mass]].itertuples(index=False):
                    on = [at[k] for k in zip(columns, (None if v is None or v != v else v for v in values), strict=True) if k in at]
                    w = m * float(np.exp(sum(lam[i] for i in on)))
                    for i in on:
                        for j in on:
                            parts[i, j] = parts.get((i, j), 0.0) + w
                    parts[-1, -1] = parts.get((-1, -1), 0.0) + w
            yield pd.DataFrame([(i, j, w) for (i, j), w in parts.items()], columns=["i", "j", "w"])

        summed = cells.select(*columns, mass).mapInPandas(local, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w"))
        rows = sorted(map(tuple, summed.collect()))
        dual = sum(w for i, _, w in rows if i < 0)
        i, j, w = (np.array([r[k] for r in rows if r[0] >= 0]) for k in range(3))
        own = np.zeros(len(names))
        own[i[i == j].astype(int)] = w[i == j]
        return dual - float(lam @ goal), own - goal, (i.astype(int), j.astype(int), w, np.maximum(own, 1e-300))

    def solved(hess: tuple[np.ndarray, ...], right: np.ndarray) -> np.ndarray:
        """Conjugate gradients, scaled by the diagonal; constraints may depend on each other."""
        i, j, w, own = hess
        x, r = np.zeros(len(right)), right.copy()
        z = r / own
        p, rz, end = z.copy(), float(r @ z), 1e-26 * float(r @ (r / own))
        for _ in range(10 * len(right)):
            if rz <= end:
                break
            q = np.bincount(i, w * p[j], minlength=len(right))
            step = rz / max(float(p @ q), 1e-300)
            x, r = x + step * p, r - step * q
            z = r / own
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        return x

    lam = np.zeros(len(names))
    value, slope, hess = moments(lam) if len(names) else (0.0, lam, None)
    for _ in range(steps):
        if not len(names) or np.all(np.abs(slope) <= tolerance * goal):
            break
        move = solved(hess, slope)
        share = 1.0
        while True:  # halve the step until the dual falls
            trial = moments(lam - share * move)
            if trial[0] <= value + 1e-12 * abs(value) or share < 1e-6:
                break
            share /= 2
        lam = lam - share * move
        value, slope, hess = trial
    return dict(zip(names, lam.tolist(), strict=True))


def _round(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each document of a block: the words owed pass to the next shorter one."""
    frame = frame.sort_values(["size", "hash", "id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    owed, copies = 0.0, []
    for size, n, rate in zip(frame["size"], frame["n"], frame["rate"], strict=True):
        rate = min(rate, most)
        words = int(size) * int(n)
        want = rate + (owed / words if words else 0.0)
        c = int(min(max(np.floor(want + 0.5), np.floor(rate)), np.ceil(rate)))
        owed += (rate - c) * words
        copies.append(c)
    frame["copies"] = copies
    return frame[["id", "source", "size", "n", "copies", "source_size", "target"]]


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """id, source, size, n, copies, source_size, target for each distinct document."""
    sized = sizes(df, id_col, source_col, text_col)
    table = balance_sources(water_fill(sources(sized, weights), most))
    plan = checkpointed(table.select(F.col("source").alias("t_source"), F.col("total").alias("source_size"), "target", "rate", F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("int").alias("blocks")))
    plan = F.broadcast(plan) if plan.limit(SMALL + 1).count() <= SMALL else plan
    marked = sized.withColumn("hash", F.xxhash64("id", "size", F.lit("mix"))).join(plan, F.col("source").eqNullSafe(F.col("t_source")))
    marked = marked.withColumn("block", F.pmod("hash", F.col("blocks")).cast("int")).drop("blocks", "t_source")
    kind = sized.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, size bigint, n bigint, copies int, source_size bigint, target double"
    return marked.groupBy("source", "block").applyInPandas(lambda frame: _round(frame, most), schema)


def apply(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix: every document as often as its copies say; columns as in ``df``."""
    own_id, own_source, own_size, own_copies, words, k = fresh(df, "id", "source", "size", "copies", "words", "k")
    copies = mix(df, id_col, source_col, text_col, **options)
    copies = copies.select(F.col("id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("copies").alias(own_copies))
    kind = {**{f.name: f.dataType for f in df.schema.fields}}
    names = df.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for lo, hi, data, offsets in tk.pieces(batch.column(at)):
                size = np.diff(tk.spans(data, offsets)[2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(size)], [*names, words])

    schema = ", ".join(f"`{c}` {kind[c].simpleString()}" for c in names) + f", {words} bigint"
    rows = map_arrow(df, counted, schema)
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).cast("string").eqNullSafe(F.col(own_source)) & (F.col(words) == F.col(own_size))
    out = rows.join(copies, same).where(F.col(own_copies) > 0)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(own_copies)))).select(*names)
