import json

from pyspark.sql import functions as F

from declarium.operators import closure, edges, merge, resolve, scope, subjects
from declarium.plans import config, emit, reconcile
from declarium.sources import cmake, files, requirements

FILES = {
    "CMakeLists.txt": "ExternalProject_Add(external_eigen URL https://h/o/eigen/releases/eigen-5.0.0.tar.gz)\ntarget_link_libraries(app external_eigen unknown_lib)\n",
    "requirements.txt": "Numpy==1.26\nnumpy==1.25\nscipy>=1\n",
    "tests/requirements.txt": "pytest\n",
}


def document(spark, **options):
    t = spark.createDataFrame([("r", p, x.encode()) for p, x in FILES.items()], "repo string, path string, content binary")
    profile = config.Profile()
    doc = reconcile.gather([reconcile.from_cmake(t, cmake.commands(t), profile, "app"), reconcile.from_requirements(t, profile, "app")])
    subs = spark.createDataFrame([(0, "app", "wheel", "app", "1.0", "primary", True, None, "MIT", "")], reconcile.SUBJECTS)
    licences = spark.createDataFrame([("NumPy", "BSD-3-Clause")], "key string, license string")
    return reconcile.reconcile(reconcile.Document(subs, doc.components, doc.observations, doc.edges, doc.tools, doc.warnings), config.Config(**options), profile, licences)


def test_reconcile(spark):
    doc = document(spark, view="all")
    got = {r["name"]: r for r in doc.components.collect()}
    assert set(got) == {"eigen", "numpy", "scipy", "pytest"}
    assert got["eigen"]["aliases"] == ["external_eigen"] and got["eigen"]["source_version"] == "5.0.0" and got["eigen"]["origin"] == "third-party"
    assert got["numpy"]["source_version"] == "1.25" and got["numpy"]["license"] == "BSD-3-Clause" and got["numpy"]["license_source"] == "known_map"
    assert got["scipy"]["version_status"] == "unpinned" and got["pytest"]["scopes"] == ["test"]
    codes = {(r.code, r.subject) for r in doc.warnings.collect()}
    assert {("version_pin_conflict", "numpy"), ("unmapped_link_library", "unknown_lib"), ("license_unresolved", "eigen")} <= codes


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "calls")

    def told(parse):
        def run(path, text):
            with open(log, "a") as f:
                f.write(path + "\n")
            return parse(path, text)

        return run

    t = spark.createDataFrame([("r", p, x.encode()) for p, x in FILES.items()], "repo string, path string, content binary")
    profile = config.Profile()
    monkeypatch.setattr(requirements, "parse_requirements", told(requirements.parse_requirements))
    commands = files.parse(t.where("path = 'CMakeLists.txt'"), told(cmake.parse_commands), cmake.COMMANDS)
    doc = reconcile.reconcile(reconcile.gather([reconcile.from_cmake(t, commands, profile, "app"), reconcile.from_requirements(t, profile, "app")]), config.Config(view="all"), profile)
    assert emit.elements(doc).count() and doc.warnings.count()
    with open(log) as f:
        assert sorted(f.read().split()) == sorted(FILES)


def test_release_view_and_emission(spark):
    doc = document(spark, view="release", subjects=("app",))
    assert {r["name"] for r in doc.components.collect()} == {"eigen", "numpy", "scipy"}
    one, two = emit.cyclonedx(doc), emit.cyclonedx(doc)
    assert one == two and emit.validate(one) == []
    body = json.loads(one)
    assert [c["name"] for c in body["components"]] == sorted(c["name"] for c in body["components"])
    assert body["metadata"]["component"]["name"] == "app" and body["serialNumber"].startswith("urn:uuid:")
    text = emit.spdx(doc)
    assert emit.validate(text) == [] and {p["name"] for p in json.loads(text)["packages"]} == {"eigen", "numpy", "scipy"}
    parts = {(r.basename, r.section): json.loads(r.json) for r in emit.split(doc).collect()}
    assert {c["name"] for c in parts["app", "components"]} == {"eigen", "numpy", "scipy"}


def test_validate_tells_faults():
    assert emit.validate("x")[0][0] == "invalid_json" and emit.validate("{}")[0][0] == "unknown_format"
    dup = {"bomFormat": "CycloneDX", "specVersion": "1.5", "serialNumber": "s", "components": [{"bom-ref": "a", "type": "library", "name": "a"}] * 2}
    assert ("duplicate_ref", "a bom-ref occurs twice") in emit.validate(json.dumps(dup))


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('view = "all"\ndetail = "full"\nexclude = ["st-test", "docs"]\n')
    c = config.parse_args(["--config", str(tmp_path / "c.toml"), "--detail", "compact"])
    assert (c.view, c.detail) == ("all", "compact")
    assert c.filters() == ({"docs"}, None, {"st_test"}, False)
    assert emit.stamp(True) == "1970-01-01T00:00:00Z" and emit.stamp(False, 86400) == "1970-01-02T00:00:00Z"


def test_profiles(spark):
    t = spark.createDataFrame([("r", "version.cmake", b"")], "repo string, path string, content binary")
    assert config.choose(t).name == "accelerator"
    assert config.choose(t.where("false")).name == "default"
    assert config.data_sources([config.DataSource("a", "alias", "x")], config.Profile())[0][0] == 0


def test_null_scopes(spark):
    df = spark.createDataFrame([(None,), ("test",), ("runtime",)], "usage_scope string")
    assert {r[0] for r in scope.filter_observations(df, excluded=["test"]).collect()} == {None, "runtime"}
    assert {r[0] for r in scope.filter_observations(df, keep_only=["runtime"]).collect()} == {"runtime"}


def test_ownership(spark):
    rows = [(None, "subject", "app1", "component", "shared"), ("app2", "component", "shared", "component", "app2_only"), ("app2", "subject", "app2", "component", "shared"), (None, "component", "shared", "component", "shared")]
    e = spark.createDataFrame(rows, "root string, from_kind string, from_id string, to_kind string, to_id string")
    roots = spark.createDataFrame([(a, "subject", a, a) for a in ("app1", "app2")], "group string, kind string, id string, owner string")
    got = {(r.group, r.id) for r in closure.reachable(e, roots).where("kind = 'component'").collect()}
    assert got == {("app1", "shared"), ("app2", "shared"), ("app2", "app2_only")}


def test_edge_identities(spark):
    base = ("r", "subject", "a", "component", "b", "links", "runtime", "reachable")
    rows = [(0, *base, "f1", None), (1, *base, "f2", None), (2, *base, "f1", None)]
    e = spark.createDataFrame(rows, reconcile.EDGES)
    assert [r.seq for r in edges.deduplicate(e).collect()] == [0]
    assert {r.seq for r in edges.deduplicate(e, edges.EXACT).collect()} == {0, 1}


def test_curated(spark):
    rows = [("a", "25.1", "BSD", "list", 0), ("a", "3.13", None, "notice", 1), ("b", "1", "MIT", "notice", 2)]
    got = {r.component: (r.source_version, r.effective_version, r.license) for r in merge.curated(spark.createDataFrame(rows, "component string, version string, license string, source string, seq int")).collect()}
    assert got == {"a": ("25.1", "3.13", "BSD"), "b": ("1", None, "MIT")}


def test_fill_and_suppliers(spark):
    c = spark.createDataFrame([("a", None, "x"), ("b", "1", "y")], "name string, version string, supplier string")
    f = spark.createDataFrame([("a", "9", "s"), ("b", "9", "s")], "name string, version string, supplier string")
    got = {r["name"]: (r.version, r.supplier) for r in resolve.fill(c, f, "name", ["version", "supplier"], overwrite=["supplier"]).collect()}
    assert got == {"a": ("9", "s"), "b": ("1", "s")}
    assert {r.supplier for r in resolve.suppliers(c, F.col("name") == "a", "me").collect()} == {"me", "y"}


def test_subjects_empty(spark):
    s = spark.createDataFrame([], reconcile.SUBJECTS)
    assert subjects.discover(s, (("tests", "st_test"),), ["example"]).count() == 0
    assert closure.pick_primary(s).count() == 0
