import pytest
from pyspark.sql import functions as F

from declarium.functions import licences, rules, text, versions


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_pep440_order(spark):
    order = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+abc", "1.0+5", "1.0.post1.dev3", "1.0.post1", "1.1", "1.10", "1!0.1", "not-a-version"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(versions.pep440_key(F.col("v"))).collect()] == order


def test_pep440_order_like_packaging(spark):
    packaging = pytest.importorskip("packaging.version")
    vs = [f"{a}{b}{c}" for a in ("1.0", "1.0.1", "2") for b in ("", "a1", "b2", "rc3") for c in ("", ".post1", ".dev2", ".post1.dev2")]
    got = [r.v for r in spark.createDataFrame([(v,) for v in vs], "v string").orderBy(versions.pep440_key(F.col("v")), "v").collect()]
    assert got == sorted(vs, key=lambda v: (packaging.Version(v), v))


def test_match_score_and_mixed_key(spark):
    rows = [("3.11", "3.11.3"), ("5.0.0", "5.0.0"), ("1.2", "1.3"), ("", "1"), ("1", None)]
    assert values(spark, rows, "a string, b string", versions.match_score(F.col("a"), F.col("b"))) == [2, 3, None, None, None]
    df = spark.createDataFrame([("1.10",), ("1.9",), ("1.x",)], "v string")
    assert [r.v for r in df.orderBy(versions.mixed_key(F.col("v"))).collect()] == ["1.9", "1.10", "1.x"]


@pytest.mark.parametrize(
    "spec, pin", [("==1.0", "1.0"), ("===1.0", "1.0"), ("==1.*", None), (">=1", None), ("==1,==2", None), (" == 2.1 ", "2.1"), (None, None)]
)
def test_concrete_pin(spark, spec, pin):
    assert values(spark, [(spec,)], "s string", versions.concrete_pin(F.col("s"))) == [pin]


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://h/o/corelib/releases/corelib-7.1.tar.gz", "corelib"),
        ("https://h/team/Fast_Codec/archive/refs/tags/v2.4.tgz", "fast_codec"),
        ("https://h/o/a/releases/b-1.0.zip", None),
        ("https://h/x.html", None),
        ("https://h/${V}/a-1.zip", None),
        ("https://h", None),
        (None, None),
    ],
)
def test_upstream_name(spark, url, name):
    assert values(spark, [(url,)], "u string", text.upstream_name(F.col("u"))) == [name]


def test_licences(spark):
    rows = [("SPDX-License-Identifier: MIT",), ("Permission is hereby granted, free of charge",), ("The Apache License,\nVersion 2.0",), ("nothing",), (None,)]
    assert values(spark, rows, "t string", licences.classify(F.col("t"))) == ["MIT", "MIT", "Apache-2.0", None, None]
    exprs = [("MIT",), ("MIT AND",), ("A B",), ("(MIT OR LicenseRef-x)",), ("MPL2",), ("((MIT)",), ("MIT WITH",), ("NONE",), ("",), (None,)]
    assert values(spark, exprs, "e string", licences.is_expression(F.col("e"))) == [True, False, False, True, False, False, False, True, False, False]
    assert values(spark, [("Team Open v1.0",), ("许可证",)], "n string", text.licence_ref(F.col("n")))[0] == "LicenseRef-Team-Open-v1-0"


def test_definitions_answer(spark):
    j = '{"described": {"projectWebsite": "w", "sourceLocation": {"url": "u"}}, "licensed": {"declared": "MIT", "facets": {"core": {"attribution": {"parties": ["a", "", "b"]}}}}}'
    got = values(spark, [(j,), ("broken",)], "j string", licences.from_definitions_api(F.col("j")))
    assert tuple(got[0]) == ("w", "a; b", "u", "MIT")
    assert tuple(got[1]) == (None, None, None, None)


def test_tri_state_and_keywords(spark):
    rows = [(["TLS_VERIFY", "OFF"],), (["TLS_VERIFY", "ON"],), (["x"],), (["TLS_VERIFY"],)]
    assert values(spark, rows, "a array<string>", rules.tls_verify(F.col("a"))) == [False, True, None, None]


def test_programs(spark):
    rows = [("/usr/bin/git",), ("${PY}",), ("${X}",), ("tool.exe",), ("",)]
    assert values(spark, rows, "p string", text.program_name(F.col("p"), {"PY": "python3"})) == ["git", "python3", None, "tool", None]


def test_owned_url(spark):
    rows = [("https://h.example/Team/x",), ("https://h.example/other/x",), (None,)]
    assert values(spark, rows, "u string", text.is_owned_url(F.col("u"), "h.example", ["team"])) == [True, False, False]
