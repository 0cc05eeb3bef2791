"""Groups of the pipeline's near-dedup stage against all pairs."""

from itertools import combinations

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_simhash import broadcast

from declarium.llm import near_dedup


def shingle_set(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in brute.words(text)]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def survivors(rows):
    """Smallest id of each component of the links, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, fps = {i: shingle_set(t) for i, t in rows}, {i: brute.fingerprint(t) for i, t in rows}
    for (i, _), (j, _) in combinations(rows, 2):
        common = len(sets[i] & sets[j])
        if (fps[i] ^ fps[j]).bit_count() <= 3 or (common and common >= 0.8 * len(sets[i] | sets[j])):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted({find(i) for i in root})


def test_similar_texts_beyond_three_bits(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in (10, 40, 75, 100)]
    texts += [" ".join(base), " ".join(base[::-1]), " ".join(x if k % 15 else f"far{k}" for k, x in enumerate(base)), "a b", "A  b", "", "c d"]
    rows = list(enumerate(texts))
    assert any((brute.fingerprint(texts[0]) ^ brute.fingerprint(t)).bit_count() > 3 for t in texts[1:5])
    got = near_dedup.apply(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect()) == survivors(rows)


def test_bands_and_sets_are_not_broadcast(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(0, 60, 10)]
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: list(map((found := store.executionsList()).apply, range(found.size())))
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    try:
        done = max((x.executionId() for x in listed()), default=-1)
        near_dedup.apply(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        plans = [x.physicalPlanDescription() for x in listed() if x.executionId() > done]
    finally:
        spark.conf.unset("spark.sql.ui.explainMode")
    for column in ("band#", "shingles#"):
        assert any(column in p for p in plans)
        assert not [x for p in plans for x in broadcast(p) if column in x]


def test_stage_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.where(F.length("text") > 0)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert got == survivors([(r.doc_id, r.text) for r in docs.collect()])
