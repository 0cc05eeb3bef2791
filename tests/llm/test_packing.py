from collections import Counter, defaultdict

import brute
import pyarrow as pa
import pytest
from conftest import DOCS
from hypothesis import given, settings
from hypothesis import strategies as st

from declarium.llm import packing
from declarium.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check_places(rows):
    """rows (length, sequence, offset): gapless from 0, at most the capacity; the number of sequences."""
    by = defaultdict(list)
    for n, s, at in rows:
        by[s].append((at, n))
    for own in by.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= packing.CAPACITY
    return len(by)


def best_fit(lengths, capacity=4096):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def test_all_documents(query, real, tokenizer):
    got = query("op5_best_fit_packing")
    want = []
    for i, text, _, _ in real:
        want += [(i, k, *p) for k, p in enumerate(brute.pieces(tokenizer.encode(text or "", add_special_tokens=False).ids))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    used = check_places(got[["length", "sequence_id", "offset"]].itertuples(index=False, name=None))
    assert used <= best_fit([p[3] for p in want])


def test_edge_cases(docs, none, tokenizer):
    rows = packing.apply(docs, tokenizer_path(), with_ids=True).collect()
    want = Counter()
    for d in DOCS:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids
        want.update((d[0], k, *p) for k, p in enumerate(brute.pieces(ids)))
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(len(r.ids) == r.length for r in rows)
    check_places((r.length, r.sequence_id, r.offset) for r in rows)
    assert packing.apply(none, tokenizer_path()).collect() == []


@settings(deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sTtLl .,!?<|>_09 \t\n\x0b\x1c\x85\xa0　​Äßéİıŉ中日ελ😀́"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_ids_are_the_tokenizers(texts):
    tokens = packing.encoder(tokenizer_path())
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(tokens, texts) == want


def encoded(tokens, texts):
    return [ids[lo:hi].tolist() for ids, bounds in tokens.encode(pa.array(texts, pa.string())) for lo, hi in zip(bounds, bounds[1:])]


@given(st.lists(st.integers(1, 60), max_size=60))
def test_plan_places_each_piece_once(lengths):
    left, seen, by = Counter(lengths), Counter(), defaultdict(list)
    for n, first, number, sequence, at in packing.plan(left, 60):
        assert first == seen[n]
        seen[n] += number
        for k in range(number):
            by[sequence + k].append((at, n))
    assert seen == left
    for own in by.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 60 and sum(n > 20 for _, n in own) <= 2
    assert len(by) <= 1.25 * max(1, best_fit(lengths, 60)) + 1


def test_table_renews_itself(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    monkeypatch.setattr(packing.tk, "CHUNK", 64)
    tokens = packing.Encoder(tokenizer_path())
    texts = [" ".join(f"word{k}x{i}" for k in range(30)) for i in range(9)]
    assert encoded(tokens, texts) == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.known <= 50 + 32
