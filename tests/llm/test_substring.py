import random

import brute
from conftest import DOCS
from hypothesis import given, settings
from hypothesis import strategies as st

from declarium.llm import substring_dedup as sd


def test_planted_repeats(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(50)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [make(rng.choice([20, 21, 24, 39, 40, 41, 80])) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [make(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), make(rng.randrange(25))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "x " * 70), (201, "a b " * 50), (202, " ".join("pq" * 19)), (203, make(19)), (204, "a b " * 9 + "c")]
    want = sorted((i, *v) for (i, _), v in brute.substrings(rows).items())
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for most in (1024, 16):  # few rows make every repeated hash a winner of the summary
        assert sorted(map(tuple, sd.deduplicate(df, most=most).collect())) == want


def test_edge_cases(docs, none):
    rows = sd.deduplicate(docs).collect()
    want = brute.substrings({(d[0], d[1]) for d in DOCS if d[0] is not None and d[0] != 9})
    got = {r.id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(DOCS)
    assert got[1] == want[1, DOCS[0][1]] and got[1][1] == 0
    assert got[2][2] == "" and got[8][1] >= 90
    assert got[3] == got[4] == got[5] == (0, 0, "")
    assert got[7][1] > 100_000 and got[12] == (1, 0, "é" * 70_000)
    last = [r for r in rows if r.id is None and r.n_words]
    assert [r.kept_text for r in last] == [""]
    assert sd.deduplicate(none).collect() == []


def test_repeated_rows_get_one_result(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert sorted((r.id, r.n_removed) for r in sd.deduplicate(df).collect()) == [(1, 0), (1, 0), (2, 30)]


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=70), min_size=1, max_size=6))
def test_anchors_cover_every_window(texts):
    import pyarrow as pa

    from declarium.llm import textkit as tk

    array = pa.array([" ".join(t) for t in texts])
    ((_, _, data, offsets),) = list(tk.pieces(array))
    starts, ends, first = tk.spans(data, offsets)
    row, begin, end, anchor = sd.anchor_runs(tk.span_hash(data, starts, ends), first, 20)
    got = sorted((r, k - first[r]) for r, b, e in zip(row, begin, end) for k in range(b, e + 1))
    assert got == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 19)]
    assert all(b <= a <= b + 15 and a <= e + 15 and e <= a for b, e, a in zip(begin, end, anchor))
