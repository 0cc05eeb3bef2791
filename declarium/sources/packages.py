"""Python package metadata, read without running any of it."""

from __future__ import annotations

import ast
import configparser
import posixpath
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import parse

DEPTH = 6
SMALL = 64 * 1024
BUILD_TOOLS = ("cmake", "ninja", "make", "pybind11", "cython", "swig", "setuptools_scm", "wheel", "setuptools", "scikit_build_core", "torch", "numpy")


class Evaluator:
    """Values of simple expressions in a module: literals, module constants,
    ``getenv`` defaults, ``or``, formatted strings, helpers without arguments, reads of files."""

    def __init__(self, tree: ast.Module, files: dict[str, str], folder: str = ""):
        self.files, self.folder = files, folder
        self.constants = {t.id: n.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        self.helpers = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef)}

    def value(self, node: ast.AST | None, depth: int = 0):
        """The value, or None if it can't be told."""
        if node is None or depth > DEPTH:
            return None
        again = lambda n: self.value(n, depth + 1)
        match node:
            case ast.Constant():
                return node.value
            case ast.Name():
                return again(self.constants.get(node.id))
            case ast.List() | ast.Tuple():
                return [v for v in map(again, node.elts) if v is not None]
            case ast.BoolOp(op=ast.Or()):
                return next((v for v in map(again, node.values) if v), None)
            case ast.BinOp(op=ast.Add()):
                a, b = again(node.left), again(node.right)
                return a + b if isinstance(a, (str, list)) and type(a) is type(b) else None
            case ast.JoinedStr():
                parts = [again(v.value) if isinstance(v, ast.FormattedValue) else again(v) for v in node.values]
                return None if None in parts else "".join(map(str, parts))
            case ast.Call():
                return self._call(node, depth)
            case _:
                return None

    def _call(self, node: ast.Call, depth: int):
        name = ast.unparse(node.func)
        if name.endswith(("getenv", "environ.get")):
            return self.value(node.args[1], depth + 1) if len(node.args) > 1 else None
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("strip", "rstrip", "lstrip") and not node.args:
            inner = self.value(node.func.value, depth + 1)
            return inner.strip() if isinstance(inner, str) else None
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("read", "read_text"):
            inner = node.func.value
            args = inner.args if isinstance(inner, ast.Call) else []
            return next((self.files[p] for a in args for p in self._paths(a)), None)
        if isinstance(node.func, ast.Name) and node.func.id in self.helpers and not node.args and not node.keywords:
            body = self.helpers[node.func.id]
            local = Evaluator(ast.Module(body=[s for s in ast.walk(body) if isinstance(s, ast.Assign)], type_ignores=[]), self.files, self.folder)
            local.constants, local.helpers = self.constants | local.constants, self.helpers
            for item in (w for s in ast.walk(body) if isinstance(s, ast.With) for w in s.items):
                if isinstance(item.optional_vars, ast.Name):
                    local.constants[item.optional_vars.id] = item.context_expr
            found = (local.value(s.value, depth + 1) for s in ast.walk(body) if isinstance(s, ast.Return))
            return next((v for v in found if v is not None), None)
        return None

    def _paths(self, node: ast.AST) -> list[str]:
        """Files that the strings in an expression name, from the package's folder."""
        words = [n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        names = [n for n in ast.walk(node) if isinstance(n, ast.Name) and n.id in self.constants]
        words += [n.value for x in names for n in ast.walk(self.constants[x.id]) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        tried = [posixpath.normpath(posixpath.join(self.folder, w)) for w in ("/".join(words), *words) if w]
        return [p for p in tried if p in self.files]


def _setup_call(tree: ast.Module) -> ast.Call | None:
    calls = (n for n in ast.walk(tree) if isinstance(n, ast.Call) and ast.unparse(n.func).split(".")[-1] == "setup")
    return next(calls, None)


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _attribute(spec: str, files: dict[str, str], folder: str) -> str | None:
    """``package.module.name`` from the module's constants."""
    module, _, name = spec.rpartition(".")
    for stem in (module.replace(".", "/") + ".py", module.replace(".", "/") + "/__init__.py", "src/" + module.replace(".", "/") + "/__init__.py"):
        path = posixpath.normpath(posixpath.join(folder, stem))
        if path in files and (tree := _tree(files[path])):
            found = Evaluator(tree, files, folder)
            return found.value(found.constants.get(name))
    return None


def metadata(folder: str, files: dict[str, str]) -> dict:
    """name, version, the file each comes from, and a warning; by pyproject,
    setup.cfg, setup.py, then the usual version files."""
    at = lambda n: posixpath.normpath(posixpath.join(folder, n))
    out: dict = {"name": None, "version": None, "name_source": None, "version_source": None}

    def take(source: str, name=None, version=None) -> None:
        for key, v in (("name", name), ("version", version)):
            if out[key] is None and isinstance(v, str) and v.strip():
                out[key], out[f"{key}_source"] = v.strip(), source

    if (p := at("pyproject.toml")) in files:
        data = _toml(files[p])
        project = data.get("project", {})
        version = project.get("version")
        if "version" in project.get("dynamic", []):
            rule = data.get("tool", {}).get("setuptools", {}).get("dynamic", {}).get("version", {})
            if "attr" in rule:
                version = _attribute(rule["attr"], files, folder)
            elif "file" in rule:
                names = [rule["file"]] if isinstance(rule["file"], str) else rule["file"]
                version = next((files[at(n)].strip() for n in names if at(n) in files), None)
        take("pyproject.toml", project.get("name"), version)
    if (p := at("setup.cfg")) in files:
        cfg = configparser.ConfigParser(interpolation=None)
        try:
            cfg.read_string(files[p])
        except configparser.Error:
            pass
        version = cfg.get("metadata", "version", fallback=None)
        if version and version.startswith("attr:"):
            version = _attribute(version[5:].strip(), files, folder)
        elif version and version.startswith("file:"):
            version = files.get(at(version[5:].strip()))
        take("setup.cfg", cfg.get("metadata", "name", fallback=None), version)
    if (p := at("setup.py")) in files and (tree := _tree(files[p])) and (call := _setup_call(tree)):
        values, given = Evaluator(tree, files, folder), {k.arg: k.value for k in call.keywords}
        take("setup.py", values.value(given.get("name")), values.value(given.get("version")))
    for name in ("VERSION", "version.txt", "VERSION.txt"):
        if at(name) in files and len(files[at(name)]) <= SMALL:
            take(name, None, files[at(name)].strip().split("\n")[0])
    out["warning"] = None if out["version"] else "version_unresolved"
    return out


def package_metadata(files: DataFrame) -> DataFrame:
    """repo, dir and metadata of every folder with a package file; a folder's files
    (bounded by the size of one package's small text files) meet in one task."""
    import pandas as pd

    from ..session import ship

    ship(files.sparkSession)
    heads = files.where(F.substring_index("path", "/", -1).isin("pyproject.toml", "setup.cfg", "setup.py"))
    dirs = heads.select("repo", F.regexp_replace("path", "/?[^/]+$", "").alias("dir")).distinct()
    small = files.where((F.octet_length("content") <= SMALL) & F.col("path").rlike(r"(\.(py|toml|cfg|txt)|VERSION)$"))
    own = small.join(dirs, "repo").where((F.col("dir") == "") | F.col("path").startswith(F.concat("dir", F.lit("/"))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = {p: bytes(c or b"").decode("utf-8", "replace") for p, c in zip(frame["path"], frame["content"], strict=True)}
        repo, folder = frame["repo"].iloc[0], frame["dir"].iloc[0]
        return pd.DataFrame([{"repo": repo, "dir": folder, **metadata(folder, texts)}])

    return own.select("repo", "dir", "path", "content").groupBy("repo", "dir").applyInPandas(run, "repo string, dir string, name string, version string, name_source string, version_source string, warning string")


def parse_setup(path: str, text: str) -> list[dict]:
    """install_requires of a setup.py, and build tools that it imports or runs."""
    tree = _tree(text)
    if tree is None:
        return []
    rows, call = [], _setup_call(tree)
    if call:
        given = {k.arg: k.value for k in call.keywords}
        rows += [{"kind": "install", "requirement": r} for r in Evaluator(tree, {}).value(given.get("install_requires")) or [] if isinstance(r, str)]
    used = set()
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""]
            used |= {x.split(".")[0] for x in names}
        elif isinstance(n, ast.Call) and ast.unparse(n.func).split(".")[-1] in ("check_call", "run", "call", "check_output", "spawn", "Popen"):
            first = n.args[0] if n.args else None
            head = first.elts[0] if isinstance(first, ast.List) and first.elts else first
            if isinstance(head, ast.Constant) and isinstance(head.value, str):
                used.add(posixpath.basename(head.value.split()[0]) if head.value.split() else "")
    return rows + [{"kind": "build", "requirement": x} for x in sorted(used & set(BUILD_TOOLS))]


def parse_pyproject(path: str, text: str) -> list[dict]:
    """PEP 621 dependencies, optional ones with their extra, and build requirements."""
    data = _toml(text)
    project = data.get("project", {})
    rows = [{"kind": "install", "requirement": r} for r in project.get("dependencies", [])]
    rows += [{"kind": f"extra:{k}", "requirement": r} for k, v in project.get("optional-dependencies", {}).items() for r in v]
    return rows + [{"kind": "build", "requirement": r} for r in data.get("build-system", {}).get("requires", [])]


def declared(files: DataFrame) -> DataFrame:
    """repo, path, kind, requirement, pos, name, specifier of setup.py and pyproject.toml files."""
    schema = "kind string, requirement string, pos bigint"

    def placed(function):
        return lambda path, text: [{**row, "pos": i} for i, row in enumerate(function(path, text))]

    name = F.substring_index("path", "/", -1)
    both = parse(files.where(name == "setup.py"), placed(parse_setup), schema).unionByName(parse(files.where(name == "pyproject.toml"), placed(parse_pyproject), schema))
    name = F.regexp_extract("requirement", r"^\s*([A-Za-z0-9][\w.-]*)", 1)
    spec = F.regexp_extract("requirement", r"^\s*[A-Za-z0-9][\w.-]*\s*(?:\[[^\]]*\])?\s*([^;]*)", 1)
    return both.withColumn("name", name).withColumn("specifier", F.nullif(F.trim(spec), F.lit("")))


