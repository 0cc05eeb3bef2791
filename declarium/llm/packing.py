"""Best-fit packing with large-item matching.

A plan is made on the histogram of piece lengths, whose size is bounded by the
capacity and not by the number of documents. Full pieces are sequences of their
own. Pieces above one third of the capacity are matched greedily, the longest
with the longest that still fits, at most two in a sequence. Smaller pieces, in
falling order of length, go to the smallest gap that holds them, or open a new
sequence. All pieces of one length that meet the same kind of gap are placed at
once; a placement is a range of ranks within a length and a range of sequences.

Ranks are given without gathering a length in one task: every task numbers the
pieces of each length it makes, and the tasks' counts are summed up in order.

Defined results
---------------
* null text is empty; an empty document is the end token alone.
* documents longer than the capacity are cut into full pieces and a rest.
* repeated rows are documents of their own.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import checkpointed, map_arrow

CAPACITY, END = 4096, 1
CACHE = 1_400_000
_SLOTS = 21  # bits
_END_BYTES = END.to_bytes(4, "little")

#: Words whose parts can be told here: no special tokens, combining marks or context-dependent case.
_PLAIN = re.compile("(?!.*<\\|)[!-~\xa1-\u02af\u0400-\u052f]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LETTER, _SIGN, _ODD = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_ODD[[*range(0xCB, 0xD0), *range(0xD5, 0x100)]] = True  # first bytes of characters that are not plain


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes, starts, ends and bounds by row of what is tokenized by itself: words,
    in lower case where that can't matter; signs behind the last letter, if that is
    ASCII, are a unit of their own."""
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # "<|", as special tokens have
    low, odd, whole = tk.LOWER[data], np.concatenate([np.flatnonzero(_ODD[data]), special]), np.zeros(len(starts), bool)
    if len(odd):
        whole[np.searchsorted(starts, special, "right") - 1] = True
        step = np.zeros(len(data) + 1, np.int8)
        own = np.unique(np.searchsorted(starts, odd, "right") - 1)
        step[starts[own]] += 1
        step[ends[own]] -= 1
        raw = np.cumsum(step[:-1], dtype=np.int8) > 0
        low[raw] = data[raw]
    last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data)))) if len(data) else data
    stem = last[ends - 1]
    cut = (stem >= starts) & (stem < ends - 1) & ~whole
    cut[cut] = _LETTER[data[stem[cut]]]
    n = np.cumsum(cut)
    at = np.arange(len(starts)) + n  # of the last unit of each word
    new_starts, new_ends = np.empty(len(starts) + int(n[-1] if len(n) else 0), np.int64), np.empty(len(starts) + int(n[-1] if len(n) else 0), np.int64)
    new_starts[at], new_ends[at] = np.where(cut, stem + 1, starts), ends
    new_starts[at[cut] - 1], new_ends[at[cut] - 1] = starts[cut], stem[cut] + 1
    return low, new_starts, new_ends, first + np.concatenate([[0], n])[first]


class Encoder:
    """Token ids of whole texts, for vocabularies of at most 65,536 ids whose
    pre-tokenizer parts text at white space and into runs of letters, single digits
    and runs of signs, after lower-casing.

    The ids of a text are those of its words. The words of many texts are found and
    hashed (64 bits) at once and looked up in an open table; what it doesn't have is
    tokenized and entered. Plain words consist of parts that go straight to the
    merges; words with unusual characters go to the tokenizer whole. The table is
    emptied when it has more than ``CACHE`` words, so memory stays bounded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the letters that stand for the bytes of UTF-8 in byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, np.uint64)  # hashes, 0 where a slot is free
        self.word = np.zeros(1 << _SLOTS, np.int32)  # number of the word in each slot
        self.known = 0
        self.start = np.zeros(1 << 14, np.int64)  # where the ids of each word are in pool
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _of_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_part(self, part: str) -> list[int]:
        """Plain parts go straight to the merges, the rest to the whole tokenizer."""
        if not part.isascii():
            if not _PLAIN.fullmatch(part):
                return self._of_texts([part])[0]
            part = "".join([self.letters[b] for b in part.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(part)]

    def _of_word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [t.id for t in self.tokenizer.model.tokenize(word.lower())]
        parts = _PARTS.findall(word.lower()) if _PLAIN.fullmatch(word) else None
        return self._of_texts([word])[0] if parts is None else list(chain.from_iterable(map(self._of_part, parts)))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Enter words whose distinct hashes the table doesn't have."""
        ids = [self._of_word(w.decode()) for w in words]
        n, sizes = self.known, np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
        while n + len(ids) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.start[n : n + len(ids) + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known += len(ids)
        slot, left = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = hashes[left[free]]  # of several for a slot, one stays
            done = self.keys[slot[left]] == hashes[left]
            self.word[slot[left[done]]] = n + left[done]
            left = left[~done]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        while len(left):
            at = slot[left]
            key = self.keys[at]
            hit = key == hashes[left]
            out[left[hit]] = self.word[at[hit]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) % len(self.keys)
        return out

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = np.maximum(tk.span_hash(data, starts, ends), np.uint64(1))
        if self.known + len(hashes) > CACHE + tk.CHUNK // 2:
            self._forget()
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            some, at = np.unique(hashes[new], return_index=True)
            raw, at = data.tobytes(), new[at]
            self._learn(some, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[new] = self._find(hashes[new])
        return found

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts without end tokens, and the bounds of each text's ids."""
        for _, _, data, offsets in tk.pieces(texts):
            low, starts, ends, first = units(data, *tk.spans(data, offsets))
            bounds, parts, most = [np.zeros(1, np.int64)], [], tk.CHUNK // 2
            for lo in range(0, max(len(starts), 1), most):  # of a very long text, so that the table holds its words
                word = self._numbers(low, starts[lo : lo + most], ends[lo : lo + most])
                size = self.start[word + 1] - self.start[word]
                after = np.cumsum(size)
                parts.append(self.pool[np.repeat(self.start[word] - after + size, size) + np.arange(size.sum())].astype("<u4"))
                bounds.append(after + bounds[-1][-1])
            yield np.concatenate(parts), np.concatenate(bounds)[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cutter(path: str, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        tokens = encoder(path)
        for batch in batches:
            at = 0
            for found, bounds in tokens.encode(batch.column(1)):
                rows, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                raw = memoryview(found.tobytes())
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for k, own in enumerate(range(lo, hi + 1, capacity)):
                        n = min(capacity, hi + 1 - own)
                        ended = own + n > hi  # the end token is the last id
                        body = raw[4 * own : 4 * (own + n - ended)]
                        rows.append(at)
                        piece.append(k)
                        start.append(own - lo)
                        length.append(n)
                        crc.append(zlib.crc32(_END_BYTES, zlib.crc32(body)) if ended else zlib.crc32(body))
                        rank.append(ranks[n])
                        ranks[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(bytes(body) + _END_BYTES * ended, "<u4").astype(np.int32))
                    at += 1
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc)] + [pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def cut(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in the shared folder: id, piece, start, length,
    ids_crc32, and with ``with_ids`` the ids themselves; task and rank number the
    pieces of one length that a task made."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + ", ids array<int>" * with_ids
    return checkpointed(map_arrow(df.select(id_col, text_col), _cutter(path, capacity, with_ids), schema))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, number, first sequence, offset) of all
    pieces of a histogram of lengths."""
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap: ranges of sequences
    sizes: list[int] = []  # of the gaps, sorted

    def put(length: int, number: int, first: int, offset: int) -> None:
        out.append((length, taken[length], number, first, offset))
        taken[length] += number
        left[length] -= number

    def gap(size: int, first: int, number: int) -> None:
        if size > 0 and number > 0:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, number))

    third = capacity // 3
    large = sorted(n for n in left if n > third)
    while large:
        x = large[-1]
        if not left[x]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - x) - 1
        while at >= 0 and (not left[large[at]] or large[at] == x and left[x] < 2):
            at -= 1
        if at < 0:
            number = left[x]
            put(x, number, bins, 0)
            gap(capacity - x, bins, number)
        else:
            y = large[at]
            number = left[x] // 2 if x == y else min(left[x], left[y])
            put(x, number, bins, 0)
            put(y, number, bins, x)
            gap(capacity - x - y, bins, number)
        bins += number
        large = [n for n in large if left[n]]
    for s in sorted((n for n in left if left[n]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(sizes, s)
            if at == len(sizes):
                number = -(-left[s] // (capacity // s))
                gap(capacity, bins, number)
                bins += number
                continue
            size = sizes[at]
            first, number = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            use = min(number, left[s])
            put(s, use, first, capacity - size)
            gap(size - s, first, use)
            gap(size, first + use, number - use)
    return out


def _placer(rows: list[tuple[int, int, int, int, int]], capacity: int, columns: list[str]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    key = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            own = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(own, [*columns, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``cut``) with sequence_id and offset, without task and rank."""
    counts = checkpointed(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    columns = [c for c in pieces.columns if c not in ("task", "rank")]
    fields = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(ranked, _placer(plan(histogram, capacity), capacity, columns), f"{fields}, sequence_id bigint, offset bigint")


def apply(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places."""
    return pack(cut(df, path, id_col, text_col, capacity, with_ids), capacity)
