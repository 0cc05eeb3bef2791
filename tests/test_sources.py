import io
import tarfile

import pytest
from pyspark.sql import functions as F

from declarium.sources import archives, cmake, files, notices, packages, requirements, toolout


def tree(spark, **texts):
    rows = [("r", p.replace("__", "/"), t.encode() if isinstance(t, str) else t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def table(spark, items):
    return spark.createDataFrame([("r", p, t.encode() if isinstance(t, str) else t) for p, t in items.items()], "repo string, path string, content binary")


def test_scan_lists_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("1")
    (tmp_path / "b.txt").write_text("22")
    got = files.scan(spark, str(tmp_path), glob="*.txt")
    assert [(r.path, r.seq) for r in got.orderBy("path").collect()] == [("a/x.txt", 0), ("b.txt", 1)]


def test_logical_lines():
    text = "# head\na==1 \\\n  --hash=sha256:x\n\nb>=2 # tail\nc \\\n"
    assert requirements.logical_lines(text) == [(2, "a==1", ["sha256:x"]), (5, "b>=2", []), (6, "c", [])]


def test_line_numbers_take_one_pass(monkeypatch):
    counted = []

    class Text(str):
        def count(self, sub, start=0, end=None):
            counted.append((len(self) if end is None else end) - start)
            return str.count(self, sub, start, len(self) if end is None else end)

    text = "# head\n\nset(A 1) set(B 2)\n" + "if(X)\n  set(C\n 3)\nendif()\n" * 50
    monkeypatch.setattr(cmake, "without_comments", lambda t: Text(t))
    rows = cmake.parse_commands("CMakeLists.txt", text)
    assert [r["line"] for r in rows] == [3, 3] + [4 + 4 * i + n for i in range(50) for n in (0, 1, 3)]
    assert sum(counted) <= len(text)


def test_parsed_rows_come_in_pieces(spark):
    df = table(spark, {f"{i}/CMakeLists.txt": "set(A 1)\n" * i for i in range(5)})
    pieces = files.parse(df.coalesce(1), cmake.parse_commands, cmake.COMMANDS, most_rows=3)
    assert sorted((r.path, r.pos) for r in pieces.collect()) == [(f"{i}/CMakeLists.txt", n) for i in range(5) for n in range(i)]


def test_requirements_constraints_and_includes(spark):
    df = table(spark, {
        "requirements.txt": "Foo_Bar[x]>=1 ; python_version > '3'\n-r sub/requirements-dev.txt\n-c constraints.txt\n-e git+https://h/x.git#egg=x\nbaz @ https://h/baz.whl\n",
        "sub/requirements-dev.txt": "foo-bar\n-r ../requirements.txt\n",
        "constraints.txt": "foo.bar==1.5\n",
    })
    got = {(r.path, r.name or r.url): (r.specifier, r.pin) for r in requirements.requirements(df).collect()}
    assert got[("requirements.txt", "foo-bar")] == (">=1", "1.5")
    assert got[("sub/requirements-dev.txt", "foo-bar")] == (None, None)  # a parent's constraints aren't seen
    assert ("requirements.txt", "baz") in got
    rows = requirements.lines(df)
    seen = requirements.expand(rows, df.where("path = 'requirements.txt'"))
    assert {(r.path, r.depth) for r in seen.collect()} == {("requirements.txt", 0), ("sub/requirements-dev.txt", 1)}


@pytest.mark.parametrize(
    "texts, name, version",
    [
        ({"setup.py": "from setuptools import setup\nsetup(name='a', version='1.0')"}, "a", "1.0"),
        ({"setup.py": "import os\nV = os.getenv('X', '2.0')\nsetup(name='a', version=V)"}, "a", "2.0"),
        ({"setup.py": "def v():\n    with open('VERSION') as f:\n        return f.read().strip()\nsetup(name='a', version=v())", "VERSION": "3.1\n"}, "a", "3.1"),
        ({"setup.py": "setup(name='a', version=None or '4')"}, "a", "4"),
        ({"setup.py": "setup(name='a', version=compute())"}, "a", None),
        ({"pyproject.toml": "[project]\nname='b'\nversion='5'"}, "b", "5"),
        ({"pyproject.toml": "[project]\nname='b'\ndynamic=['version']\n[tool.setuptools.dynamic]\nversion={attr='p.__version__'}", "p/__init__.py": "__version__ = '6'"}, "b", "6"),
        ({"setup.cfg": "[metadata]\nname = c\nversion = file: V.txt", "V.txt": "7"}, "c", "7"),
        ({"setup.py": "syntax error here ("}, None, None),
    ],
)
def test_metadata(texts, name, version):
    got = packages.metadata("", texts)
    assert (got["name"], got["version"]) == (name, version)
    assert (got["warning"] is None) == (version is not None)


def test_package_metadata_and_declared(spark):
    df = table(spark, {
        "p/setup.py": "import pybind11\nsetup(name='a', version='1', install_requires=['x>=1'])",
        "q/pyproject.toml": "[project]\nname='q'\nversion='2'\ndependencies=['y[z]==3']\n[build-system]\nrequires=['wheel']",
    })
    assert {(r.dir, r.name, r.version) for r in packages.package_metadata(df).collect()} == {("p", "a", "1"), ("q", "q", "2")}
    got = {(r.path, r.kind, r.name, r.specifier) for r in packages.declared(df).collect()}
    assert got == {("p/setup.py", "install", "x", ">=1"), ("p/setup.py", "build", "pybind11", None), ("q/pyproject.toml", "install", "y", "==3"), ("q/pyproject.toml", "build", "wheel", None)}


CM = """cmake_minimum_required(VERSION 3.1) # set(A 1)
project(${P}demo VERSION ${V})
set(LIBS one two)
if(WIN32)
  find_package(Foo 1.2 REQUIRED)
elseif(APPLE)
  include(cmake/dep.cmake)
else()
  target_link_libraries(app PRIVATE ${LIBS} -lthree local $<X:y>)
endif()
add_library(local a.cpp)
add_dependencies(app local other)
find_program(TOOL NAMES clang gcc)
execute_process(COMMAND A=1 git describe && python3 x.py > out)
#[[ find_package(Hidden) ]]
ExternalProject_Add(ep URL https://h/ep-1.2.3.tar.gz TLS_VERIFY OFF PATCH_COMMAND patch -p1 < ${D}/fix.patch DEPENDS local)
"""


@pytest.fixture(scope="module")
def tree_cmds(spark):
    t = table(spark, {"CMakeLists.txt": CM, "cmake/dep.cmake": "find_package(Bar)\n", "fix.patch": "diff"})
    return t, cmake.commands(t).cache()


def test_cmake_records(tree_cmds):
    t, cmds = tree_cmds
    packages_ = {r.name: (r.gates, r.effective_required, r.version) for r in cmake.find_packages(cmds).collect()}
    assert packages_ == {"Foo": (["WIN32"], True, "1.2"), "Bar": ([], False, None)}
    tokens = {(r.token, r.kind) for r in cmake.link_tokens(cmds).collect()}
    assert tokens == {("one", "external"), ("two", "external"), ("three", "external"), ("local", "local"), ("$<X:y>", "drop")}
    assert cmake.link_tokens(cmds).first().gates == ["NOT (WIN32)", "NOT (APPLE)"]
    assert {r.to_id for r in cmake.target_edges(cmds).collect()} == {"local", "other"}
    assert {r.program for r in cmake.imported_programs(cmds).collect()} == {"clang", "gcc"}
    assert {r.program for r in cmake.program_calls(cmds).collect()} == {"git", "python3", "patch"}
    d = cmake.downloads(cmds).first()
    assert (d.canonical_url, d.version, d.tls_verify, d.findings, d.depends) == ("https://h/ep-1.2.3.tar.gz", "1.2.3", False, ["no_hash", "tls_verification_disabled"], ["local"])
    p = cmake.patches(cmake.downloads(cmds), t).first()
    assert p.file == "fix.patch" and p.sha256
    assert tuple(cmake.projects(cmds).select("name", "version").first()) == ("demo", None)


def test_cmake_includes_and_walk(spark, tree_cmds):
    t, cmds = tree_cmds
    links = cmake.includes(cmds, t)
    assert [(r.target, r.exists) for r in links.collect()] == [("cmake/dep.cmake", True)]
    got = {r.path: (r.visit, r.chain) for r in cmake.reached(links, t.where("path = 'CMakeLists.txt'")).collect()}
    assert got == {"CMakeLists.txt": (0, []), "cmake/dep.cmake": (1, ["CMakeLists.txt"])}


def test_walk_is_last_in_first_out():
    links = {"a": [(0, "b", []), (1, "c", ["G"])], "b": [(0, "d", [])], "c": [(0, "d", ["H"])]}
    assert cmake.visit(links, "a") == [(0, "a", [], []), (1, "c", ["a"], ["G"]), (2, "d", ["a", "c"], ["G", "H"]), (3, "b", ["a"], [])]


def test_fragments_and_roots(spark, tree_cmds):
    from declarium.operators import subjects

    t, cmds = tree_cmds
    assert [r.dir for r in subjects.cmake_roots(t).collect()] == [""]
    calls = cmake.commands(table(spark, {"CMakeLists.txt": "add_third(zlib)\nadd_third(gone)"}))
    have = table(spark, {"cmake/zlib.cmake": ""})
    assert [r.subject for r in cmake.missing_fragments(calls, have, {"add_third": "cmake/{}.cmake"}).collect()] == ["gone"]
    two = cmake.commands(table(spark, {"CMakeLists.txt": "if(L)\nExternalProject_Add(e SOURCE_DIR /x)\nelse()\nExternalProject_Add(e URL https://h/e.zip)\nendif()"}))
    assert [r.target for r in cmake.local_source_unverified(two).collect()] == ["e"]


def test_notices():
    text = "Software: zlib 1.3.1\nCopyright notice:\nCopyright A\nCopyright B\n\nLicense: MIT License\nSoftware: plain\n"
    assert notices.parse_notice("", text) == [
        {"component": "zlib", "version": "1.3.1", "license": "MIT", "copyright": "Copyright A\nCopyright B"},
        {"component": "plain", "version": None, "license": None, "copyright": None},
    ]
    assert notices.parse_list("", "- {name: a, version: 1}\n- {other: x}")[0]["component"] == "a"
    assert notices.parse_manifest("", '[{"Name": "a", "License": "MIT"}]')[0]["license"] == "MIT"
    assert notices.parse_manifest("", "License: BSD\nCopyright (c) X")[0]["copyright"] == "Copyright (c) X"
    assert notices.parse_cache("", "broken") == [] and notices.parse_map("", "A: MIT") == [{"key": "a", "value": "MIT"}]


def test_version_declarations(spark):
    t = table(spark, {"version.cmake": 'set_package(acl VERSION "8.5.0")\nset_dependency(ops ">=8.1")'})
    assert [(r.kind, r.name, r.value) for r in notices.version_declarations(t).orderBy("n").collect()] == [("package", "acl", "8.5.0"), ("dependency", "ops", ">=8.1")]
    assert notices.version_declarations(t, strict=True).count() == 1


def test_archives_are_bounded(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for name in ("a/LICENSE", "../LICENSE", "a/b/c/d/LICENSE", "a/code.c"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"MIT"))
    df = table(spark, {"x.tar.gz": raw.getvalue(), "broken.zip": b"no", "lfs.zip": b"version https://git-lfs.github.com/spec/v1"})
    assert [(r.member, bytes(r.content)) for r in archives.contents(df).collect()] == [("a/LICENSE", b"MIT")]
    refs = spark.createDataFrame([("r", "origin/1.2.x", False), ("r", "origin/master", False), ("q", None, True)], "repo string, ref string, failed boolean")
    assert {(r.repo, r.label) for r in archives.release_refs(refs).collect()} == {("r", "1.2.x"), ("q", None)}


def test_tool_output(spark):
    j = '{"files": [{"path": "LICENSE", "type": "file", "license_detections": [{"license_expression_spdx": "MIT", "matches": [{"score": 90.0}, {"score": 95.5}]}], "holders": [{"holder": "A"}]}]}'
    found, holders = toolout.detections(spark.createDataFrame([("t", j)], "target string, json string"))
    assert tuple(found.select("file", "expression", "score", "is_licence_file").first()) == ("LICENSE", "MIT", 95.5, True)
    assert holders.first().holder == "A"
    t, e = toolout.targets(spark.createDataFrame([('{"id": "a::1", "name": "a", "dependencies": [{"id": "b::1"}]}',), ('{"id": "b::1", "name": "b"}',)], "json string"))
    assert t.count() == 2 and tuple(e.first()) == ("a", "b::1", "b")
    ev = toolout.trace_events(spark.createDataFrame([('{"cmd": "find_package", "args": ["X"], "file": "f", "line": 3}',), ("junk",)], "value string"))
    assert cmake.find_packages(toolout.reconstructed(ev)).first().name == "X"
    plain = toolout.text_trace_events(spark.createDataFrame([("/a/f.cmake(12):  set(A b )",)], "value string")).first()
    assert (plain.cmd, plain.args, plain.line) == ("set", ["A", "b"], 12)


def test_vendored(spark):
    t = table(spark, {"third_party/zlib/1.2/a.c": "", "third_party/zlib/1.10/a.c": "", "third_party/foo-2.0/a.c": "", "src/a.c": ""})
    assert {(r.name, r.version) for r in files.vendored(t).collect()} == {("zlib", "1.10"), ("foo", "2.0")}
    assert files.licence_files(table(spark, {"a/LICENSE.txt": "", "b.c": ""})).count() == 1
    assert files.requirements_files(table(spark, {"requirements-dev.txt": "", "x.txt": "", "requirements/a.txt": ""})).select(F.count("*")).first()[0] == 2
