"""Curated texts: notices, component lists, manifests, version declarations."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import parse

RECORD = "component string, version string, license string, copyright string"
_NOTICE_LICENCES = {"apache license v2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "mit license": "MIT", "bsd 3-clause": "BSD-3-Clause", "boost software license": "BSL-1.0", "mpl v2.0": "MPL-2.0"}


def notice_licence(raw: str | None) -> str | None:
    """SPDX id of a notice's licence words, or the words."""
    if not raw or not raw.strip():
        return None
    low = raw.strip().lower()
    return next((v for k, v in _NOTICE_LICENCES.items() if k in low), raw.strip())


def parse_notice(path: str, text: str) -> list[dict]:
    """``Software: name version`` opens a block; copyright lines follow their header
    until another field or an empty line."""
    rows: list[dict] = []
    copyright: list[str] | None = None
    for line in text.splitlines():
        field = re.match(r"^\s*(Software|Copyright notice|Copyright|License|Licence)\s*:\s*(.*)$", line, re.I)
        kind = field[1].lower() if field else ""
        if kind == "software":
            m = re.match(r"^(.*?)[ _-]+v?(\d[\w.\-]*)$", field[2].strip())
            rows.append({"component": (m[1] if m else field[2]).strip(), "version": m[2] if m else None, "license": None, "copyright": None})
            copyright = None
        elif not rows:
            continue
        elif kind.startswith("copyright"):
            copyright = [field[2].strip()] if field[2].strip() else []
        elif field:
            rows[-1]["license"], copyright = notice_licence(field[2]), None
        elif copyright is not None and line.strip():
            copyright.append(line.strip())
        if rows and copyright:
            rows[-1]["copyright"] = "\n".join(copyright)
    return rows


def parse_list(path: str, text: str) -> list[dict]:
    """Records of a YAML list (or of the lists in a mapping)."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    groups = data.values() if isinstance(data, dict) else [data]
    records = [r for g in groups if isinstance(g, list) for r in g if isinstance(r, dict)]
    word = lambda r, *ks: next((str(r[k]) for k in ks if r.get(k) is not None), None)
    return [{"component": n, "version": word(r, "version"), "license": word(r, "license"), "copyright": word(r, "copyright")} for r in records if (n := word(r, "name", "software", "component"))]


def parse_map(path: str, text: str) -> list[dict]:
    """A flat YAML mapping, keys lower-cased."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    return [{"key": str(k).lower(), "value": str(v)} for k, v in data.items() if v is not None] if isinstance(data, dict) else []


def parse_cache(path: str, text: str) -> list[dict]:
    """Entries of a JSON cache; a broken file has none."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    return [{"key": k, "entry": {str(a): str(b) for a, b in v.items() if b is not None}} for k, v in data.items() if isinstance(v, dict)] if isinstance(data, dict) else []


def parse_manifest(path: str, text: str) -> list[dict]:
    """First licence and all copyright lines of a JSON or a line-oriented manifest."""
    try:
        data = json.loads(text)
        found = data[0] if isinstance(data, list) and data else data
        if isinstance(found, dict):
            get = lambda *ks: next((found[k] for k in ks if found.get(k)), None)
            rights = get("Copyright", "copyright")
            return [{"component": get("Name", "name"), "version": get("Version Number", "version"), "license": get("License", "license"), "copyright": "\n".join(rights) if isinstance(rights, list) else rights}]
    except ValueError:
        pass
    licence = re.search(r"^\s*licen[sc]e\s*:\s*(.+)$", text, re.I | re.M)
    rights = re.findall(r"^\s*(?:copyright\s*:\s*)?(copyright\b.*|\(c\).*)$", text, re.I | re.M)
    return [{"component": None, "version": None, "license": licence[1].strip() if licence else None, "copyright": "\n".join(r.strip() for r in rights) or None}]


def notices(files: DataFrame) -> DataFrame:
    return parse(files, parse_notice, RECORD)


def component_lists(files: DataFrame) -> DataFrame:
    return parse(files, parse_list, RECORD)


def lookup_map(files: DataFrame) -> DataFrame:
    return parse(files, parse_map, "key string, value string")


def caches(files: DataFrame) -> DataFrame:
    return parse(files, parse_cache, "key string, entry map<string,string>")


def manifests(files: DataFrame) -> DataFrame:
    return parse(files, parse_manifest, RECORD)


def version_declarations(files: DataFrame, strict: bool = False) -> DataFrame:
    """repo, path, kind, name, value of package and dependency declarations such as
    ``set_package(name VERSION "1.2")``; ``strict`` wants a value that starts with a digit."""
    value = r"\d[^\"\s)]*" if strict else r"[^\"\s)]+"
    pattern = rf'(?i)set_(package|dependency|build_dependencies|run_dependencies)\s*\(\s*([\w.-]+)\s+(?:VERSION\s+)?"?({value})"?'
    text = F.col("content").cast("string")
    got = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("kind", "name", "value"), 1)])
    return files.select("repo", "path", F.posexplode(got).alias("n", "d")).select("repo", "path", "n", F.lower("d.kind").alias("kind"), "d.name", "d.value")
