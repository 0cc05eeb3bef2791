"""A whole run: a source tree to a document, and the document to files."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import path_role
from ..operators import closure, subjects as subject_ops
from ..operators.caches import warning_summary
from ..operators.match import longest_prefix
from ..session import checkpointed
from ..sources import cmake, files as file_ops, packages
from . import emit
from .config import Config, Profile, choose, parse_args
from .reconcile import SUBJECTS, Document, from_cmake, from_packages, from_requirements, gather, reconcile

OK, INVALID, FATAL = 0, 1, 2
#: Format to file extension and emitter.
FORMATS = {"cyclonedx": "cdx.json", "spdx": "spdx.json"}


def discover_subjects(files: DataFrame, commands: DataFrame, profile: Profile, excluded: Sequence[str] = ()) -> DataFrame:
    """Packages and CMake roots of a tree, in order of path; the package at the top is primary."""
    wheels = packages.package_metadata(files).select(F.lit(0).alias("rank"), F.col("dir"), "name", "version", F.lit("wheel").alias("kind"))
    named = cmake.projects(commands).select(F.regexp_replace("path", "/?[^/]+$", "").alias("p_dir"), "pos", "name", "version")
    named = named.groupBy("p_dir").agg(F.min_by(F.struct("name", "version"), "pos").alias("p"))
    roots = subject_ops.cmake_roots(files).join(named, F.col("dir") == F.col("p_dir"), "left")
    roots = roots.select(F.lit(1).alias("rank"), "dir", F.col("p.name").alias("name"), F.col("p.version").alias("version"), F.lit("cmake").alias("kind"))
    place = F.col("dir") == ""
    general = F.when(F.col("kind") == "cmake", "cmake_project").when(place, "primary").otherwise("sibling_artifact")
    role = F.coalesce(F.nullif(path_role(F.col("dir"), profile.role_rules), F.lit("unclassified")), general)
    own = F.coalesce("name", F.nullif(F.substring_index("dir", "/", -1), F.lit("")), F.lit("root"))
    # as many rows as the tree has packages: numbered by path
    order = F.row_number().over(Window.orderBy("dir", "rank"))
    rows = wheels.unionByName(roots).withColumn("role", role).withColumn("seq", (order - 1).cast("bigint"))
    found = rows.select("seq", F.concat("kind", F.lit(":"), own).alias("id"), "kind", own.alias("name"), "version", "role", (place | (F.col("role") != "cmake_project")).alias("emit_as_subject"), F.lit(profile.supplier).cast("string").alias("supplier"), F.lit(profile.subject_licence).cast("string").alias("license"), F.col("dir").alias("source_path"))
    found = checkpointed(found)
    return subject_ops.discover(found, profile.role_rules, excluded)


def collect(files: DataFrame, profile: Profile, excluded: Sequence[str] = ()) -> Document:
    """What all collectors find; every file belongs to the subject of the deepest
    folder above it, or else to the primary one."""
    commands = checkpointed(cmake.commands(files))
    subjects = checkpointed(discover_subjects(files, commands, profile, excluded))
    primary = [r["id"] for r in closure.pick_primary(subjects).select("id").collect()]
    if not primary:  # a tree without a package file is a subject itself
        subjects = files.sparkSession.createDataFrame([(0, "root", "root", "root", None, "primary", True, profile.supplier, profile.subject_licence, "")], SUBJECTS)
        primary = ["root"]
    owners = longest_prefix(files.select("path"), subjects, "path", "source_path", "id", "seq", "path").select(F.col("path").alias("o_path"), "owner")
    owned = checkpointed(files.join(owners, F.col("path") == F.col("o_path"), "left").drop("o_path"))
    doc = gather([from_cmake(owned, commands, profile, primary[0]), from_requirements(owned, profile, primary[0]), from_packages(owned, profile, primary[0])])
    return replace(doc, subjects=subjects)


def run(spark: SparkSession, config: Config, known_licences: DataFrame | None = None) -> Document:
    """Scan, collect, reconcile and filter the tree at ``config.repo_root``."""
    files = checkpointed(file_ops.scan(spark, config.repo_root))
    profile = choose(files, config.profile)
    _, _, roles, _ = config.filters()
    return reconcile(collect(files, profile, sorted(roles)), config, profile, known_licences, profile.curated_records(files))


def texts(doc: Document, config: Config) -> dict[str, str]:
    """File name to text of every output; one document's JSON is bounded by its tree."""
    out = {}
    for name in config.formats:
        if name not in FORMATS:
            continue
        emitter = emit.cyclonedx if name == "cyclonedx" else emit.spdx
        options = {"detail": config.detail} if name == "cyclonedx" else {}
        if config.split_subjects:
            for base, part in each_subject(doc).items():
                out[f"{base}.{FORMATS[name]}"] = emitter(part, config.reproducible, config.epoch, **options)
        else:
            out[f"sbom.{FORMATS[name]}"] = emitter(doc, config.reproducible, config.epoch, **options)
    return out


def each_subject(doc: Document) -> dict[str, Document]:
    """Base name to the document of each emittable subject over its own closure."""
    from ..operators.ids import safe_basenames

    out = {}
    for r in safe_basenames(doc.subjects.where("emit_as_subject"), "id", "base").select("id", "base").collect():
        own, comps, edges, tools = closure.apply(doc.subjects, doc.components, doc.edges, doc.tools, [r["id"]])
        kept = doc.observations.join(comps.select(F.col("name").alias("component")), "component", "left_semi")
        out[r["base"]] = Document(own, comps, kept, edges, tools, doc.warnings)
    return out


def write(spark: SparkSession, folder: str, outputs: dict[str, str]) -> None:
    """Files of ``folder``, by Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in outputs.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command line. Returns 0, or 1 if an output is invalid or a format unknown, or 2 if the run failed."""
    config = parse_args(sys.argv[1:] if argv is None else argv)
    try:
        spark = spark or SparkSession.builder.appName("declarium").getOrCreate()
        doc = run(spark, config)
        outputs = texts(doc, config)
        write(spark, config.out_dir, outputs)
    except Exception as e:  # the process ends here, with a code for its caller
        print(f"declarium: {type(e).__name__}: {e}", file=sys.stderr)
        return FATAL
    findings = [f for text in outputs.values() for f in emit.validate(text)] + [("unknown_format", x) for x in config.formats if x not in FORMATS]
    counts = {k: getattr(doc, k).count() for k in ("subjects", "components", "edges", "tools")}
    codes = {r["code"]: r["n"] for r in warning_summary(doc.warnings).collect()}
    for code, _ in findings:
        codes[code] = codes.get(code, 0) + 1
    print(json.dumps({**counts, "files": sorted(outputs), "warnings": dict(sorted(codes.items()))}), file=sys.stderr)
    return INVALID if findings else OK
