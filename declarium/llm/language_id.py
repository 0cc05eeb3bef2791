"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` UTF-16 units over lower-cased text in
which everything but letters is a single space. All models share sorted arrays
of hashes of n-grams, with a column of log-probabilities for each language, and
of contexts, with their back-off weights. A text gets the language with the lowest
cross-entropy per unit; ``rejected`` says that this is above what calibration
texts of that language show, and ``score`` is a posterior whose sharpness is
fitted on the same texts.

The models are fitted on a bounded sample of labelled rows: about
``rows_per_lang`` of each language, chosen by a hash of the id, and none of more
than ``most_chars`` characters. A fifth of it is the calibration set. Every
whole text is scored.

Defined results
---------------
* null text and text without letters: language ``und``, score 0, rejected.
* rows with null text or null label teach nothing; without any labelled row
  every prediction is ``und``.
* ties go to the smallest language name; repeated rows get equal predictions.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import map_arrow

ORDER = 4
UND = "und"
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Unit to itself if it is (part of) a letter, else to a space."""
    if "letters" not in _tables:
        out = np.arange(65536, dtype=np.uint16)
        for i in range(1, 65536):
            if not (0xD800 <= i < 0xE000 or chr(i).isalpha()):
                out[i] = 0x20
        _tables["letters"] = out
    return _tables["letters"]


def units(texts: list[str | None]) -> np.ndarray:
    """Units of all texts, with ``ORDER - 1`` zeros before each text and at the end."""
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join((t or "").lower().replace("\0", " ") for t in texts) + gap
    if _ASTRAL.search(joined):
        joined = _ASTRAL.sub(lambda m: m[0] if m[0].isalpha() else " ", joined)
    u = _letters()[np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), "<u2")]
    space = u == 0x20
    drop = np.zeros(len(u), bool)
    drop[1:] = space[1:] & (space[:-1] | (u[:-1] == 0))
    return u[~drop]


def _grams(u: np.ndarray) -> np.ndarray:
    """The ``ORDER`` units that end at each unit from ``ORDER - 1`` on, in 64 bits."""
    w = u.astype(np.uint64)
    n = len(w) - ORDER + 1
    out = w[:n].copy()
    for k in range(1, ORDER):
        out = (out << np.uint64(16)) | w[k : k + n]
    return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, text to lang, gram, n."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array([x == lang for x in langs])).to_pylist()
            u = units(texts)
            grams, n = np.unique(_grams(u)[u[ORDER - 1 :] != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Table:
    """Values of hashed keys, sorted by hash; the hash is a bijection of 64 bits."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        h = tk.mix(keys)
        order = np.argsort(h, kind="stable")
        return cls(h[order], values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the keys, and which keys are there."""
        h = tk.mix(keys)
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == h


@dataclass
class Models:
    langs: list[str]
    grams: list[Table]  # by order, from 1
    weights: list[Table]  # back-off weights of the contexts, by the order of the gram, from 2
    unknown: np.ndarray
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def logs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log-probability of each gram's last unit in each language."""
        if order == 1:
            at, there = self.grams[0].find(grams)
            out = self.grams[0].values[at] if len(self.grams[0].hashes) else np.tile(self.unknown, (len(grams), 1))
            out[~there] = self.unknown
            return out
        table = self.grams[order - 1]
        at, there = table.find(grams)
        out = table.values[at] if len(table.hashes) else np.zeros((len(grams), len(self.langs)), np.float32)
        rest = np.flatnonzero(~there)
        if len(rest):
            g = grams[rest]
            low = self.logs(g & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
            at, there = self.weights[order - 2].find(g >> np.uint64(16))
            if there.any():
                low[there] += self.weights[order - 2].values[at[there]]
            out[rest] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: nats per unit in each language, units, letters."""
        u = units(texts)
        zero = u == 0
        text = np.cumsum(zero) // (ORDER - 1) - 1
        step = max(1 << 12, (1 << 20) // max(len(self.langs), 1))
        total = np.zeros((len(texts), len(self.langs)))
        grams, scored = _grams(u), ~zero[ORDER - 1 :]
        own = text[ORDER - 1 :]
        for lo in range(0, len(grams), step):
            on = scored[lo : lo + step]
            g, t = grams[lo : lo + step][on], own[lo : lo + step][on]
            if len(g):
                begin = np.flatnonzero(np.diff(t, prepend=-1))
                total[t[begin]] += np.add.reduceat(self.logs(g), begin, axis=0, dtype=np.float64)
        size = np.bincount(own[scored], minlength=len(texts))
        letters = np.bincount(own[scored & (u[ORDER - 1 :] != 0x20)], minlength=len(texts))
        return -total / np.maximum(size, 1)[:, None], size, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        nats, size, letters = self.entropies(texts)
        best = nats.argmin(axis=1)
        low = nats[np.arange(len(best)), best]
        score = 1 / np.exp(-self.sharpness * (nats - low[:, None]) * np.minimum(size, 1000)[:, None]).sum(axis=1)
        none = letters == 0
        rejected = none | (low > (self.limits[best] if self.limits is not None else np.inf))
        return [UND if no else self.langs[b] for b, no in zip(best, none, strict=True)], np.where(none, 0.0, score), rejected


def _group(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of values, numbers of rows."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values, begin) if len(begin) else values[:0]
    return keys[begin], sums, np.diff(np.append(begin, len(keys)))


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's distinct grams of ``ORDER`` units and their counts."""
    langs = sorted(counts)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language, by order from ORDER down
    for lang in langs:
        keys, n = counts[lang]
        order = np.argsort(keys)
        own = [(keys[order], n[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # lower orders count how many grams they end
            mask = np.uint64((1 << (16 * k)) - 1)
            keys, _, n = _group(own[-1][0] & mask, np.ones(len(own[-1][0])))
            own.append((keys, n.astype(np.float64)))
        levels.append(own[::-1])

    def discount(n: np.ndarray) -> float:
        one, two = (n == 1).sum(), (n == 2).sum()
        return float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))

    def at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[i] == wanted, values[i], default) if len(keys) else np.full(len(wanted), default)

    union = [np.unique(np.concatenate([own[k][0] for own in levels])) if levels else np.zeros(0, np.uint64) for k in range(ORDER)]
    vocabulary = len(union[0]) + 1
    p = np.zeros((len(union[0]), len(langs)))
    unknown = np.zeros(len(langs))
    for j, own in enumerate(levels):
        keys, n = own[0]
        d, total = discount(n), max(n.sum(), 1.0)
        rest = d * len(keys) / total / vocabulary
        p[:, j] = at(keys, union[0], np.maximum(n - d, 0) / total, 0.0) + rest
        unknown[j] = rest
    probabilities, weights = [p], []
    for k in range(2, ORDER + 1):
        keys_all, low = union[k - 1], np.uint64((1 << (16 * (k - 1))) - 1)
        below = probabilities[-1][np.searchsorted(union[k - 2], keys_all & low)]
        contexts = np.unique(keys_all >> np.uint64(16))
        p, g = np.zeros((len(keys_all), len(langs))), np.ones((len(contexts), len(langs)))
        for j, own in enumerate(levels):
            keys, n = own[k - 1]
            d = discount(n)
            ctx, total, kinds = _group(keys >> np.uint64(16), n)
            gamma = d * kinds / total
            g[:, j] = at(ctx, contexts, gamma, 1.0)
            here = keys_all >> np.uint64(16)
            first = at(keys, keys_all, np.maximum(n - d, 0), 0.0) / at(ctx, here, total, 1.0)
            p[:, j] = first + at(ctx, here, gamma, 1.0) * below[:, j]
        probabilities.append(p)
        weights.append(Table.of(contexts, np.log(g).astype(np.float32)))
    grams = [Table.of(u, np.log(q).astype(np.float32)) for u, q in zip(union, probabilities, strict=True)]
    return Models(langs, grams, weights, np.log(unknown).astype(np.float32))


def calibrate(models: Models, langs: list[str], texts: list[str], quantile: float = 0.995, slack: float = 0.25) -> None:
    """Fit the sharpness of the score and each language's limit of cross-entropy."""
    known = {lang: j for j, lang in enumerate(models.langs)}
    rows = [i for i, lang in enumerate(langs) if lang in known]
    if not rows:
        return
    nats, size, letters = models.entropies([texts[i] for i in rows])
    truth = np.array([known[langs[i]] for i in rows])
    on = letters > 0
    nats, size, truth = nats[on], size[on], truth[on]
    if not len(truth):
        return
    losses = {}
    for b in np.geomspace(0.003, 3, 31):
        z = -b * nats * np.minimum(size, 1000)[:, None]
        z -= z.max(axis=1, keepdims=True)
        losses[b] = -(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
    models.sharpness = float(min(losses, key=losses.get))
    limits = np.full(len(models.langs), np.inf)
    for j in range(len(models.langs)):
        own = nats[truth == j, j]
        if len(own):
            limits[j] = np.quantile(own, quantile) + slack
    models.limits = limits


def train(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column | None = None, rows_per_lang: int = 600, most_chars: int = 200_000
) -> Models:
    """Models from a bounded sample of the labelled rows for which ``learn`` holds."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit("sample")).alias("dice"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Models([], [], [], np.zeros(0))
    share = [(lang, min(1.0, rows_per_lang / k)) for lang, k in n.items()]
    shares = F.broadcast(df.sparkSession.createDataFrame(share, "lang string, share double"))
    even = F.pmod("dice", F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(shares, "lang").where((even < F.col("share")) & (F.length("text") <= most_chars))
    fifth = F.pmod(F.shiftright("dice", 44), F.lit(5)) == 0
    counted = map_arrow(sample.where(~fifth).select("lang", "text"), _counter, "lang string, gram bigint, n bigint")
    frame = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {str(lang): (part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy()) for lang, part in frame.groupby("lang")}
    models = fit(counts)
    held = sample.where(fifth).select("lang", "text").collect()
    calibrate(models, [r["lang"] for r in held], [r["text"] for r in held])
    return models


def predict(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, _, _ in tk.pieces(batch.column(1), 1 << 19):
                part = batch.slice(lo, hi - lo)
                langs, score, rejected = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, lang_pred string, score double, rejected boolean")
