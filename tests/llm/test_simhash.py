import random
import re

import brute
from conftest import DOCS

from declarium.llm import simhash


def test_all_documents(query, real):
    fps = {i: brute.fingerprint(t) for i, t, _, _ in real}
    groups = brute.classes(fps.values())
    least = {}
    for i in sorted(fps, reverse=True):
        least[fps[i]] = i
    want = sorted((i, f"{f:016x}", min(least[x] for x in groups[f])) for i, f in fps.items())
    got = query("op3_simhash_near_dedup")
    assert sorted(got[["doc_id", "fingerprint", "component_id"]].itertuples(index=False, name=None)) == want


def test_links_of_dense_and_sparse_keys(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    same_half = [(rng.getrandbits(32) << 32) | (seeds[0] & 0xFFFFFFFF) for _ in range(60)]
    fps = set(same_half)
    for s in [*seeds, *same_half[:10]]:
        for _ in range(12):
            x = s
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    entries = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    groups = brute.classes(fps)
    for dense in (2, 8, 256):
        found = simhash.links(entries, dense).collect()
        near = lambda u, v: ((u ^ v) & (2**64 - 1)).bit_count() <= 3
        if dense == 256:
            assert all(near(u, v) for u, v in found)
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in found:
            parent[root(u % 2**64)] = root(v % 2**64)
        for x in fps:
            assert root(x) == root(next(iter(groups[x])))
            assert all(groups[y] is groups[x] for y in fps if root(y) == root(x))


def broadcast(plan):
    """The lines of a plan that stand below a broadcast."""
    below, out = None, []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+|-]*", line)[0])
        if below is not None and depth > below:
            out.append(line)
        else:
            below = depth if "BroadcastExchange" in line else None
    return out


def test_exploded_rows_are_not_broadcast(spark):
    rng = random.Random(6)
    entries = spark.createDataFrame([((k % 3 << 32) | rng.getrandbits(32),) for k in range(300)], "fp bigint")
    for dense in (8, 256):
        found = simhash.links(entries, dense)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode" in plan
        assert not [x for x in broadcast(plan) if "Generate" in x]


def test_edge_cases(docs, none):
    rows = simhash.group(docs).collect()
    assert len(rows) == len(DOCS)
    empty = {r.id for r in rows if r.fp == 0}
    assert {3, 4, 5, 11} <= empty and all(r.component_id == 3 for r in rows if r.fp == 0)
    assert all(r.component_id == 1 for r in rows if r.id in (1, 2))
    kept = simhash.apply(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None not in ids and ids.count(3) == 1
    assert sorted(ids) == [1, 3, 6, 8, 9, 9, 10, 12]  # two texts have the id 9
    assert simhash.group(none).collect() == [] and simhash.apply(none).collect() == []


def test_lone_null_id_names_its_own_component(spark):
    df = spark.createDataFrame([(None, "only text of its kind"), (None, "only text of its kind")], "doc_id bigint, text string")
    assert [r.component_id for r in simhash.group(df).collect()] == [None, None]
    assert simhash.apply(df).count() == 1
