import random

import brute
import pytest
from conftest import DOCS
from hypothesis import given
from hypothesis import strategies as st

from declarium.llm import line_dedup


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_patience_is_an_alignment(a, b):
    got = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def test_patience_keeps_unique_anchors_in_order():
    a, b = [1, 2, 3, 9, 4, 5], [7, 1, 2, 8, 4, 5, 9]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (4, 4), (5, 5)]


def expected(rows):
    """Aligned by the operator's own patience diff (tested above) with all earlier documents."""
    out = []
    for (i, t), gone in zip(rows, brute.line_removals(rows, line_dedup.patience)):
        lines = (t or "").split("\n")
        out.append((i, len(lines), len(gone), brute.sha("\n".join(x for k, x in enumerate(lines) if k not in gone))))
    return out


def show(frame):
    return sorted((None if i is None or i != i else int(i), int(a), int(b), s) for i, a, b, s in frame.itertuples(index=False))


def test_all_documents(query, real):
    want = expected(sorted((i, t) for i, t, _, _ in real))
    assert show(query("op1_line_dedup")) == sorted(want)
    assert any(n for _, _, n, _ in want)


def test_edge_cases(docs):
    rows = [tuple(r) for r in line_dedup.deduplicate(docs, digest=True).collect()]
    # the two texts of id 9 share no long line, so their order doesn't matter
    own = sorted({(d[0], d[1]) for d in DOCS}, key=lambda r: (brute.order(r[0]), r[1] or ""))
    want = {(i, t): w for (i, t), w in zip(own, expected(own))}
    assert len(rows) == len(DOCS)
    assert sorted(map(repr, rows)) == sorted(repr(want[d[0], d[1]]) for d in DOCS)


def test_empty(none):
    assert line_dedup.deduplicate(none).collect() == []


def removed(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.n_removed for r in sorted(line_dedup.deduplicate(frame, **options).collect())]


@pytest.mark.parametrize("copies", [8, 9, 100])
def test_as_many_lines_go_at_any_frequency(spark, copies):
    lines = [f"line number {k} with words" for k in range(3)]
    assert removed(spark, ["\n".join(lines)] + ["\n".join(lines[::-1])] * (copies - 1)) == [0, 1, *[3] * (copies - 2)]


def made_up(seed, n=60):
    """Texts of few lines, so that they are frequent, out of order and repeated."""
    draw = random.Random(seed)
    pool = [f"frequent line {k} of many" for k in range(7)] + [f"rarer line {k} of some" for k in range(60)] + ["short", "", "- 3 -"]
    weights = [9] * 7 + [1] * 60 + [6, 12, 4]
    return ["\n".join(draw.choices(pool, weights, k=draw.randint(1, 9)) + [f"line of text {i} alone"] * draw.randint(0, 1)) for i in range(n)]


@pytest.mark.parametrize("rare", [1, 3, 8])
def test_frequent_lines_lose_no_pair(spark, rare):
    texts = [t for seed in range(3) for t in made_up(seed)]
    want = [len(g) for g in brute.line_removals(list(enumerate(texts)), line_dedup.patience)]
    assert removed(spark, texts, rare=rare) == want


def test_stretches_go_with_their_block(spark):
    a = "Title\nthe first line of all\n\nthe second line of all\n- 1 -\nthe third line of all\nend"
    b = a.replace("- 1 -", "- 2 -")
    frame = spark.createDataFrame([(0, a), (1, b), (2, "other\n" + a + "\nmore")], "doc_id bigint, text string")
    got = {r.id: r.kept_text for r in line_dedup.deduplicate(frame).collect()}
    assert got == {0: a, 1: "- 2 -", 2: "other\nTitle\nend\nmore"}
