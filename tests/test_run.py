"""A whole run over a small tree, by the command line."""

import json

import pytest

from declarium.plans import config, run

TREE = {
    "CMakeLists.txt": "cmake_minimum_required(VERSION 3.16)\nproject(top VERSION 2.1)\nExternalProject_Add(external_zlib URL https://h/o/zlib/releases/zlib-1.3.1.tar.gz)\ntarget_link_libraries(app external_zlib)\n",
    "pyproject.toml": '[project]\nname = "main-pkg"\nversion = "1.0"\ndependencies = ["NumPy==1.26.4", "scipy>=1"]\n[build-system]\nrequires = ["setuptools>=60"]\n',
    "sub/pkg/setup.py": 'from setuptools import setup\nsetup(name="sub-pkg", version="0.2", install_requires=["requests==2.0", "numpy==1.25"])\n',
    "tests/requirements.txt": "pytest\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.fixture(scope="module")
def document(spark, tree):
    return run.run(spark, config.Config(view="all", repo_root=str(tree)))


def test_subjects_and_owners(document):
    subjects = {r.id: r.role for r in document.subjects.collect()}
    assert subjects == {"wheel:main-pkg": "primary", "wheel:sub-pkg": "sibling_artifact"}
    owner = {(r.component, r.source_file): r.root_artifact_id for r in document.observations.collect()}
    assert owner["requests", "sub/pkg/setup.py"] == "wheel:sub-pkg"
    assert owner["numpy", "pyproject.toml"] == "wheel:main-pkg"


def test_components(document):
    got = {r["name"]: r for r in document.components.collect()}
    assert {"zlib", "numpy", "scipy", "requests", "setuptools", "pytest"} == set(got)
    assert got["setuptools"]["scopes"] == ["build"] and got["zlib"]["source_version"] == "1.3.1"
    assert ("version_pin_conflict", "numpy") in {(w.code, w.subject) for w in document.warnings.collect()}


def test_command_line(spark, tree, tmp_path, capsys):
    args = ["--repo-root", str(tree), "--out-dir", str(tmp_path), "--scope", "release", "--reproducible"]
    assert run.main(args, spark) == 0
    body = json.loads((tmp_path / "sbom.cdx.json").read_text())
    names = {c["name"] for c in body["components"]}
    assert {"zlib", "numpy", "requests"} <= names and not {"pytest", "setuptools"} & names
    assert {p["name"] for p in json.loads((tmp_path / "sbom.spdx.json").read_text())["packages"]} >= {"zlib", "scipy"}
    assert json.loads(capsys.readouterr().err.splitlines()[-1])["components"] == 4
    first = (tmp_path / "sbom.cdx.json").read_text()
    assert run.main([*args, "--format", "cyclonedx", "--format", "other"], spark) == 1
    assert (tmp_path / "sbom.cdx.json").read_text() == first
    assert run.main(["--repo-root", str(tree / "nowhere"), "--out-dir", str(tmp_path)], spark) == 2


def test_split(spark, tree, tmp_path):
    assert run.main(["--repo-root", str(tree), "--out-dir", str(tmp_path), "--scope", "all", "--split-subjects", "--format", "cyclonedx"], spark) == 0
    parts = {p.name: {c["name"] for c in json.loads(p.read_text())["components"]} for p in tmp_path.glob("*.cdx.json")}
    assert set(parts) == {"wheel_main-pkg.cdx.json", "wheel_sub-pkg.cdx.json"}
    assert "requests" in parts["wheel_sub-pkg.cdx.json"] and "scipy" not in parts["wheel_sub-pkg.cdx.json"]
