"""pip requirement files."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pep503
from ..functions.versions import concrete_pin
from ..session import checkpointed
from .files import parse

SCHEMA = "line int, kind string, raw string, extras array<string>, specifier string, marker string, url string, hashes array<string>, target string, editable boolean"
_NAME = re.compile(r"^([A-Za-z0-9][\w.-]*)\s*(?:\[([^\]]*)\])?\s*(.*)$")


def logical_lines(text: str) -> list[tuple[int, str, list[str]]]:
    """(first line number, text, hashes): comments go, backslashes join, ``--hash`` parts split off."""
    out, held, first = [], "", 0
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not held:
            first = number
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        whole, held = (held + line).strip(), ""
        if whole:
            hashes = re.findall(r"--hash[= ]\s*(\S+)", whole)
            out.append((first, re.sub(r"\s*--hash[= ]\s*\S+", "", whole).strip(), hashes))
    if held.strip():
        out.append((first, held.strip(), []))
    return out


def parse_requirements(path: str, text: str) -> list[dict]:
    rows = []
    for number, line, hashes in logical_lines(text):
        row = {"line": number, "kind": "option", "hashes": hashes, "editable": False, "extras": []}
        option = re.match(r"^(-r|--requirement|-c|--constraint|-e|--editable)(?:\s+|=)(.+)$", line)
        if option and option[1] in ("-r", "--requirement", "-c", "--constraint"):
            row |= {"kind": "include" if "r" in option[1].strip("-")[:1] else "constraint", "target": posixpath.normpath(posixpath.join(posixpath.dirname(path), option[2].strip()))}
        elif line.startswith("-") and not option:
            row["raw"] = line
        else:
            if option:
                row["editable"], line = True, option[2].strip()
            body, _, marker = line.partition(";") if not re.match(r"^\S+://|^\w+\+", line) else (line, "", "")
            row["marker"] = marker.strip() or None
            named = re.match(r"^([A-Za-z0-9][\w.-]*)\s*(?:\[([^\]]*)\])?\s*@\s*(\S+)", body)
            if named or re.match(r"^(\w+\+)?[a-z]+://|^\w+\+", body.strip()):
                row |= {"kind": "direct_url", "raw": named[1] if named else None, "url": named[3] if named else body.strip()}
                row["extras"] = [x.strip() for x in (named[2] or "").split(",") if x.strip()] if named else []
            elif m := _NAME.match(body.strip()):
                row |= {"kind": "requirement", "raw": m[1], "extras": [x.strip() for x in (m[2] or "").split(",") if x.strip()]}
                row["specifier"] = m[3].strip().strip("()") or None
            else:
                row["raw"] = body
        rows.append(row)
    return rows


def lines(files: DataFrame) -> DataFrame:
    return parse(files, parse_requirements, SCHEMA)


def expand(rows: DataFrame, entries: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(repo, entry, path, depth): the files that each entry takes in by ``-r``, each once."""
    links = rows.where("kind = 'include'").select("repo", "path", F.col("target").alias("to")).distinct()
    seen = entries.select("repo", F.col("path").alias("entry"), "path", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, most_rounds + 1):
        found = frontier.join(links, ["repo", "path"]).select("repo", "entry", F.col("to").alias("path"), F.lit(depth).alias("depth")).distinct()
        frontier = checkpointed(found.join(seen, ["repo", "entry", "path"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(frontier))
    raise RuntimeError("includes are nested too deeply")


def requirements(files: DataFrame) -> DataFrame:
    """Requirements of every file with its own constraints applied: name, specifier,
    constraint, pin. A file that ``-r`` takes in doesn't see its parent's constraints."""
    rows = checkpointed(lines(files))  # read three times, parsed once
    wanted = rows.where("kind IN ('requirement', 'direct_url')").withColumn("name", pep503(F.col("raw")))
    uses = rows.where("kind = 'constraint'").select("repo", "path", F.col("target").alias("c_path")).distinct()
    limits = rows.where("kind = 'requirement'").select("repo", F.col("path").alias("c_path"), pep503(F.col("raw")).alias("name"), F.col("line").alias("c_line"), F.col("specifier").alias("limit"))
    limits = uses.join(limits, ["repo", "c_path"]).groupBy("repo", "path", "name").agg(F.min_by("limit", F.struct("c_path", "c_line")).alias("constraint"))
    out = wanted.join(limits, ["repo", "path", "name"], "left")
    return out.withColumn("pin", F.coalesce(concrete_pin(F.col("specifier")), concrete_pin(F.col("constraint"))))
