"""The pipeline, stage by stage, against brute force."""

import brute
import corpus_pipeline
import pytest
from test_near_dedup import survivors

from declarium.llm import quality
from declarium.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    from declarium.llm.shared import written

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == columns
        out.append((name, docs.collect(), made.collect()))
        docs = written(made, name) if k < len(corpus_pipeline.STAGES) - 1 else made
    return {name: (before, after) for name, before, after in out}


def test_quality(stages):
    before, after = stages["quality_rules"]
    want = {k[0]: v[7] for k, v in brute.quality([(r.doc_id, r.text, r.source) for r in before]).items()}
    assert {r.doc_id for r in after} == {i for i, kept in want.items() if kept}
    assert all(r.n_chars == len(r.text) for r in after)


def test_exact(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_near(stages):
    before, after = stages["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == survivors([(r.doc_id, r.text) for r in before])


def test_mixing(stages):
    before, after = stages["mixing"]
    total, taken = {}, {}
    size = {r.doc_id: len(brute.words(r.text)) for r in before}
    for rows, into in ((before, total), (after, taken)):
        for r in rows:
            into[r.source] = into.get(r.source, 0) + size[r.doc_id]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, brute.water([total[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        assert abs(taken.get(s, 0) - goal) <= 0.05 * goal + 100


def test_packing(stages):
    from collections import Counter

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    before, after = stages["best_fit_packing"]
    want = Counter()
    for r in before:
        want.update((r.doc_id, k, *p) for k, p in enumerate(brute.pieces(tokenizer.encode(r.text or "", add_special_tokens=False).ids)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want


def test_run_is_the_stages(spark, sf, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert got == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages["best_fit_packing"][1])


def test_stages_take_any_rows(spark, docs, none):
    for frame in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, "")
            assert out.columns == docs.columns, name
            rows = out.count()
            assert rows == 0 if frame is none else rows > 0, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, "").count()
        assert pieces == 0 if frame is none else pieces > 0


def test_thresholds_are_documented():
    assert quality.Rules().min_words == 50
