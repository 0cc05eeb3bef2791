"""Output of other tools: licence scanner, CMake file API, CMake traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN = (
    "files array<struct<path:string,type:string,detected_license_expression_spdx:string,"
    "license_detections:array<struct<license_expression_spdx:string,matches:array<struct<score:double>>>>,"
    "copyrights:array<struct<copyright:string>>,holders:array<struct<holder:string>>>>"
)
TARGET = "id string, name string, type string, dependencies array<struct<id:string>>, link struct<commandFragments:array<struct<fragment:string,role:string>>>"
TRACE = "cmd string, args array<string>, file string, line bigint, frame int, time double"


def detections(scans: DataFrame, target: str = "target", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(detections, holders) of scanner answers: target, file, expression, score,
    is_licence_file, seq; and target, holder, seq."""
    files = scans.select(target, F.posexplode(F.from_json(json, SCAN)["files"]).alias("f", "x")).where("x.type = 'file'")
    name = F.upper(F.substring_index("x.path", "/", -1))
    each = files.select(target, F.col("x.path").alias("file"), name.rlike("^(LICEN[SC]E|COPYING)").alias("is_licence_file"), "f", F.posexplode("x.license_detections").alias("d", "det"))
    found = each.select(target, "file", F.col("det.license_expression_spdx").alias("expression"), F.coalesce(F.array_max(F.transform("det.matches", lambda m: m["score"])), F.lit(0.0)).alias("score"), "is_licence_file", (F.col("f") * 10_000 + F.col("d")).alias("seq"))
    holders = files.select(target, "f", F.posexplode(F.coalesce("x.holders", F.array().cast("array<struct<holder:string>>"))).alias("h", "v")).select(target, F.col("v.holder").alias("holder"), (F.col("f") * 10_000 + F.col("h")).alias("seq"))
    return found, holders


def targets(replies: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(targets, edges) of CMake file-API target replies; dependency ids stay raw,
    with the name where the reply has that target."""
    rows = replies.select(F.from_json(json, TARGET).alias("t")).select("t.*").where("id IS NOT NULL")
    edges = rows.select(F.col("name").alias("from_name"), F.explode("dependencies.id").alias("to_id"))
    names = rows.select(F.col("id").alias("n_id"), F.col("name").alias("to_name"))
    return rows.select("id", "name", "type"), edges.join(names, F.col("to_id") == F.col("n_id"), "left").drop("n_id")


def trace_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of a JSON trace; lines that aren't events are left out."""
    rows = lines.select(F.from_json(column, TRACE).alias("e")).select("e.*")
    return rows.where("cmd IS NOT NULL AND file IS NOT NULL")


def text_trace_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of a plain trace: ``path(line):  command(args )``."""
    pattern = r"^(.+?)\((\d+)\):\s+(\w+)\((.*)\)\s*$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    rows = lines.where(F.col(column).rlike(pattern))
    return rows.select(part(3).alias("cmd"), F.filter(F.split(F.trim(part(4)), r"\s+"), lambda a: a != "").alias("args"), part(1).alias("file"), part(2).cast("long").alias("line"))


def reconstructed(events: DataFrame) -> DataFrame:
    """A command table as ``cmake.commands`` gives it, from trace events."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("file").orderBy("line", "cmd")) - 1
    none = F.array().cast("array<string>")
    return events.select(F.lit("trace").alias("repo"), F.col("file").alias("path"), pos.cast("int").alias("pos"), F.col("line").cast("int").alias("line"), F.lower("cmd").alias("command"), "args", none.alias("gates"), F.lit(False).alias("fatal_near"))
