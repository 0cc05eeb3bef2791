from collections import Counter

import brute
import pytest
from conftest import DOCS

from declarium.llm import exact_dedup


def expected(rows):
    ids = {}
    for d in rows:
        ids.setdefault(d[1] or "", []).append(d[0])
    best = {t: max((x for x in i if x is not None), default=None) for t, i in ids.items()}
    return Counter((d[0], best[d[1] or ""], len(ids[d[1] or ""]), d[0] == best[d[1] or ""], brute.sha(d[1] or "")) for d in rows)


@pytest.mark.parametrize("candidates", [1, 4, 1024])
def test_edge_cases(docs, none, candidates):
    assert Counter(map(tuple, exact_dedup.annotate(docs, candidates=candidates).collect())) == expected(DOCS)
    kept = exact_dedup.deduplicate(docs, candidates=candidates)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(brute.sha(r.text or "") for r in rows) == sorted({brute.sha(d[1] or "") for d in DOCS})
    best = {k[4]: k[1] for k in expected(DOCS)}
    assert all(r.doc_id == best[brute.sha(r.text or "")] for r in rows)
    assert exact_dedup.annotate(none).collect() == [] and exact_dedup.deduplicate(none).collect() == []


def test_heavy_digests_are_exact(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(900)] + [(5000 + i, "warm") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = {bytes(r[0]).hex(): r[1:] for r in exact_dedup.heavy_digests(df, "doc_id", "text", candidates=32)}
    assert found == {brute.sha("hot"): (300, 897, 1), brute.sha("warm"): (50, 5049, 1)}
    assert Counter(map(tuple, exact_dedup.annotate(df, candidates=32).collect())) == expected(rows)


def test_main_path_has_no_python(docs):
    for out in (exact_dedup.annotate(docs), exact_dedup.deduplicate(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
