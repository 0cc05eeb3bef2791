"""Ids that rows claim in order, against a plain loop."""

import random

from pyspark.sql import functions as F

from declarium.operators import ids


def claim_all(bases):
    used, out = set(), []
    for b in bases:
        made, n = b, 1
        while made in used:
            n += 1
            made = f"{b}-{n}"
        used.add(made)
        out.append(made)
    return out


def test_claims_in_order(spark):
    rng = random.Random(1)
    names = ["x", "x-2", "x-3", "x-2-2", "x-02", "x-1", "y", "y-10", "z-2", "lone"]
    bases = [rng.choice(names) for _ in range(200)] + ["y"] * 12 + ["lone", "z"]
    rows = [(i, b, "kept") for i, b in enumerate(bases)]
    df = spark.createDataFrame(rows, "seq bigint, base string, other string").repartition(5)
    out = ids.claimed(df, F.col("base"), "seq", "id")
    assert out.columns == ["seq", "base", "other", "id"]
    assert [r.id for r in sorted(out.collect(), key=lambda r: r.seq)] == claim_all(bases)


def test_many_rows_of_one_base(spark):
    df = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") == 1500, "a-700").otherwise("a").alias("base"))
    got = [r.made for r in sorted(ids.claimed(df, F.col("base"), "seq", "made").collect(), key=lambda r: r.seq)]
    assert got == claim_all(["a-700" if i == 1500 else "a" for i in range(3000)])


def test_ids_of_all_documents(spark, sf):
    from declarium.queries import QUERIES

    rows = sorted(QUERIES["q_claimed_ids"](spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.id for r in rows] == claim_all([r.base for r in rows])


def test_basenames_that_collide(spark):
    urls = ["https://h/a b", "https://h/a_b", "https://h/c"]
    got = {r.url: r.file for r in ids.safe_basenames(spark.createDataFrame([(u,) for u in urls], "url string"), "url", "file").collect()}
    assert got[urls[2]] == "https_h_c" and len(set(got.values())) == 3
    assert all(got[u].startswith("https_h_a_b-") and len(got[u]) == len("https_h_a_b-") + 8 for u in urls[:2])
