"""From scanned records to one consistent document of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import licences, rules
from ..functions.text import pep503
from ..operators import alias, closure, edges as edge_ops, merge, resolve, scope
from ..session import checkpointed
from .config import Config, Profile


@dataclass(frozen=True)
class Document:
    subjects: DataFrame
    components: DataFrame
    observations: DataFrame
    edges: DataFrame
    tools: DataFrame
    warnings: DataFrame


OBSERVATIONS = "seq bigint, raw_name string, source_kind string, source_file string, root_artifact_id string, usage_scope string, version_constraint string, canonical_url string, is_vcs boolean"
COMPONENTS = "seq bigint, name string, aliases array<string>, type string, scopes array<string>, source_version string, effective_version string, supplier string, license string, copyright string, checksums map<string,string>, integrity_findings array<string>"
EDGES = "seq bigint, root string, from_kind string, from_id string, to_kind string, to_id string, relation string, usage_scope string, reachability string, source_file string, source_revision string"
SUBJECTS = "seq bigint, id string, kind string, name string, version string, role string, emit_as_subject boolean, supplier string, license string, source_path string"
TOOLS = "seq bigint, name string, path string, version string, required boolean, source_file string, root_artifact_id string"
WARNINGS = "code string, subject string, detail string"


def gather(parts: list[Document]) -> Document:
    """Collectors one after the other: a collector's sequence numbers follow those before it."""

    def join(name: str) -> DataFrame:
        frames = [getattr(p, name) for p in parts]
        if "seq" in frames[0].columns:
            frames = [f.withColumn("seq", F.col("seq") + F.lit(i) * F.lit(1 << 52)) for i, f in enumerate(frames)]
        return reduce(DataFrame.unionByName, frames)

    return Document(*[join(n) for n in ("subjects", "components", "observations", "edges", "tools", "warnings")])


def _placed(rows: DataFrame, files: DataFrame, owner: str) -> DataFrame:
    """``rows`` with _site, the file's place in the sorted list, and _owner, the
    subject that ``files`` names for the file or else ``owner``."""
    from ..sources.files import sequenced

    files = files if "seq" in files.columns else sequenced(files)
    own = F.coalesce("owner", F.lit(owner)) if "owner" in files.columns else F.lit(owner)
    return rows.join(files.select("repo", "path", (F.col("seq") * F.lit(1 << 24)).cast("bigint").alias("_site"), own.alias("_owner")), ["repo", "path"])


def from_cmake(files: DataFrame, commands: DataFrame, profile: Profile, owner: str) -> Document:
    """Observations, components, edges and tools of CMake commands."""
    from ..sources import cmake

    spark = files.sparkSession
    commands = checkpointed(commands)  # read many times over, parsed once
    site, own = F.col("_site"), F.col("_owner")
    hints = F.coalesce(rules.first_hint(F.concat(F.lit("/"), "path"), profile.scope_hints), F.lit("runtime"))
    none = F.lit(None).cast("string")

    def observe(rows: DataFrame, name: str, kind: str, constraint=none, url=none, vcs=F.lit(False)) -> DataFrame:
        return rows.select((site + F.col("pos")).alias("seq"), F.col(name).alias("raw_name"), F.lit(kind).alias("source_kind"), F.col("path").alias("source_file"), own.alias("root_artifact_id"), hints.alias("usage_scope"), constraint.alias("version_constraint"), url.alias("canonical_url"), vcs.alias("is_vcs"))

    placed = lambda rows: _placed(rows, files, owner)
    loads = placed(cmake.downloads(commands))
    tokens = placed(cmake.link_tokens(commands).where("kind = 'external'"))
    packages = placed(cmake.find_packages(commands))
    obs = observe(loads, "target", "cmake_external_project", url=F.coalesce("canonical_url", "location"), vcs=F.col("git_repository").isNotNull())
    obs = obs.unionByName(observe(tokens, "token", "cmake_link_library")).unionByName(observe(packages, "name", "cmake_find_package", constraint=F.col("version")))
    comps = loads.select(
        (site + F.col("pos")).alias("seq"), F.col("target").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("library").alias("type"), F.array(hints).alias("scopes"),
        F.col("version").alias("source_version"), none.alias("effective_version"), none.alias("supplier"), none.alias("license"), none.alias("copyright"),
        F.when(F.col("sha256").isNotNull(), F.create_map(F.lit("sha256"), "sha256")).alias("checksums"), F.col("findings").alias("integrity_findings"),
    )
    subject = tokens.select((site + F.col("pos")).alias("seq"), own.alias("root"), F.lit("subject").alias("from_kind"), own.alias("from_id"), F.lit("component").alias("to_kind"), F.col("token").alias("to_id"), F.lit("links").alias("relation"), hints.alias("usage_scope"), rules.reachability(F.col("gates"), profile.dead_flags or ("\0",))["reachability"].alias("reachability"), F.col("path").alias("source_file"), none.alias("source_revision"))
    depends = placed(cmake.target_edges(commands)).select((site + F.col("pos")).alias("seq"), own.alias("root"), F.lit("component").alias("from_kind"), "from_id", F.lit("component").alias("to_kind"), "to_id", F.lit("depends_on").alias("relation"), hints.alias("usage_scope"), F.lit("reachable").alias("reachability"), F.col("path").alias("source_file"), none.alias("source_revision"))
    programs = placed(cmake.imported_programs(commands).unionByName(cmake.program_calls(commands)))
    kind = rules.classify_program(F.col("program"), F.lit(None).cast("string"), profile.tooling)
    tools = programs.where(kind == "environment_tool").select((site + F.col("pos")).alias("seq"), F.col("program").alias("name"), none.alias("path"), none.alias("version"), (F.size("gates") == 0).alias("required"), F.col("path").alias("source_file"), own.alias("root_artifact_id"))
    return Document(spark.createDataFrame([], SUBJECTS), comps, obs, edge_ops.deduplicate(subject.unionByName(depends)), tools, spark.createDataFrame([], WARNINGS))


def from_requirements(files: DataFrame, profile: Profile, owner: str) -> Document:
    """Observations, components and edges of requirement files."""
    from ..sources import requirements
    from ..sources.files import requirements_files

    none = F.lit(None).cast("string")
    rows = requirements.requirements(requirements_files(files)).where("name IS NOT NULL")
    file, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]+$", "")
    rows = rows.withColumn("scope", rules.file_scope(profile.file_scope(F.col("path")), none, file, folder))
    rows = _placed(rows, files, owner).withColumn("seq", F.col("_site") + F.col("line"))
    return _of_requirements(rows.withColumnRenamed("specifier", "own_specifier").withColumn("specifier", F.coalesce("own_specifier", "constraint")), "python_requirement")


def from_packages(files: DataFrame, profile: Profile, owner: str) -> Document:
    """Observations, components and edges of setup.py and pyproject.toml files."""
    from ..functions.text import pep503
    from ..functions.versions import concrete_pin
    from ..sources.packages import declared

    rows = _placed(declared(files).where("name <> ''"), files, owner)
    file, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]+$", "")
    installed = rules.file_scope(profile.file_scope(F.col("path")), F.lit(None).cast("string"), file, folder)
    scope_ = F.when(F.col("kind") == "build", "build").when(F.col("kind").startswith("extra:"), "optional").otherwise(installed)
    url = F.nullif(F.regexp_extract("requirement", r"@\s*(\S+)", 1), F.lit(""))
    spec = F.when(url.isNull(), F.col("specifier"))
    rows = rows.select("path", "_owner", (F.col("_site") + F.col("pos")).alias("seq"), pep503(F.col("name")).alias("name"), spec.alias("specifier"), concrete_pin(spec).alias("pin"), url.alias("url"), scope_.alias("scope"))
    return _of_requirements(rows, "python_package")


def _of_requirements(rows: DataFrame, kind: str) -> Document:
    """Rows (seq, _owner, path, name, specifier, pin, url, scope) as a document."""
    spark, none = rows.sparkSession, F.lit(None).cast("string")
    rows = checkpointed(rows)
    obs = rows.select("seq", F.col("name").alias("raw_name"), F.lit(kind).alias("source_kind"), F.col("path").alias("source_file"), F.col("_owner").alias("root_artifact_id"), F.col("scope").alias("usage_scope"), F.col("specifier").alias("version_constraint"), F.col("url").alias("canonical_url"), F.coalesce(F.col("url").rlike(r"^(git|hg|svn|bzr)\+"), F.lit(False)).alias("is_vcs"))
    merged = merge.merge_by(rows, "name", "seq", first=["pin"], unions=["scope"])
    comps = merged.select(F.col("position").alias("seq"), "name", F.array().cast("array<string>").alias("aliases"), F.lit("library").alias("type"), F.col("scope").alias("scopes"), F.col("pin").alias("source_version"), none.alias("effective_version"), none.alias("supplier"), none.alias("license"), none.alias("copyright"), F.lit(None).cast("map<string,string>").alias("checksums"), F.array().cast("array<string>").alias("integrity_findings"))
    edges = rows.select("seq", F.col("_owner").alias("root"), F.lit("subject").alias("from_kind"), F.col("_owner").alias("from_id"), F.lit("component").alias("to_kind"), F.col("name").alias("to_id"), F.lit("requires").alias("relation"), F.col("scope").alias("usage_scope"), F.lit("reachable").alias("reachability"), F.col("path").alias("source_file"), none.alias("source_revision"))
    return Document(spark.createDataFrame([], SUBJECTS), comps, obs, edge_ops.deduplicate(edges, edge_ops.PYTHON), spark.createDataFrame([], TOOLS), spark.createDataFrame([], WARNINGS))


def reconcile(doc: Document, config: Config = Config(), profile: Profile | None = None, known_licences: DataFrame | None = None, curated: DataFrame | None = None, coordinates: DataFrame | None = None) -> Document:
    """Aliases, merged components, attached observations, clean edges, versions,
    licences, provenance, then the view that ``config`` asks for.

    ``known_licences`` has key (a name or an alias) and license; ``curated`` component,
    version, license, copyright, source and seq; ``coordinates`` key and purl."""
    profile = profile or Profile()
    # the tables are used many times over: each is computed once
    doc = replace(doc, components=checkpointed(doc.components), observations=checkpointed(doc.observations), edges=checkpointed(doc.edges))
    spark = doc.components.sparkSession
    own = alias.config_layer(spark, config.aliases).withColumn("prio", F.lit(0))
    site = alias.config_layer(spark, profile.aliases).withColumn("prio", F.lit(1))
    table = alias.resolve_layers([own.select("spelling", "canonical", "seq", "prio"), site.select("spelling", "canonical", "seq", "prio")])
    named = doc.observations.where("canonical_url IS NOT NULL")
    derived, clash = alias.derived_aliases(named, "raw_name", "canonical_url", "seq")
    table = checkpointed(alias.with_derived(table, derived))
    warnings = [doc.warnings, clash.select(F.lit("derived_alias_collision").alias("code"), F.col("canonical").alias("subject"), F.lit("several URLs give this name").alias("detail"))]

    comps = checkpointed(merge.components(doc.components, table))
    observed, added, lost = alias.attach(doc.observations, comps, table)
    observed = checkpointed(observed)
    warnings.append(lost)
    comps = comps.unionByName(added, allowMissingColumns=True).withColumn("type", F.coalesce("type", F.lit("library")))
    scopes = observed.groupBy("component").agg(merge.ordered_union("usage_scope", "seq").alias("o_scopes"))
    comps = comps.join(scopes, F.col("name") == F.col("component"), "left").withColumn("scopes", F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("scopes", "o_scopes")]))).drop("component", "o_scopes")

    edges = edge_ops.deduplicate(alias.canonical_edges(doc.edges, table), edge_ops.EXACT)
    rolled = edge_ops.depends_on(edges).withColumnRenamed("name", "d_name")
    comps = comps.join(rolled, F.col("name") == F.col("d_name"), "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))).drop("d_name")

    comps = checkpointed(comps)
    if curated is not None:
        c = merge.curated(alias.canonical(curated, "component", table, "component"))
        found = c.withColumnRenamed("component", "name").withColumnRenamed("license", "curated_license")
        comps = resolve.fill(comps, found, "name", ["source_version", "effective_version"], overwrite=["effective_version"])
        comps = comps.join(found.select(F.col("name").alias("c_name"), "curated_license"), F.col("name") == F.col("c_name"), "left").drop("c_name")
    else:
        comps = comps.withColumn("curated_license", F.lit(None).cast("string"))
    conflicts = merge.pin_conflicts(observed)
    conflicts = checkpointed(conflicts)
    comps = merge.apply_pin_conflicts(comps, conflicts)
    warnings.append(conflicts.select(F.lit("version_pin_conflict").alias("code"), F.col("component").alias("subject"), F.concat(F.lit("pins "), F.array_join("pins", ", "), F.lit("; kept "), "kept").alias("detail")))
    warnings.append(merge.patched_builds(comps))
    comps = merge.version_completeness(comps)

    if known_licences is not None:
        k = resolve.lookup_by_names(comps.select("name", "aliases"), known_licences.select("key", "license"), "name", "aliases", "key", ["license"])
        comps = comps.join(k.select(F.col("name").alias("k_name"), F.col("license").alias("known_license")), F.col("name") == F.col("k_name"), "left").drop("k_name")
    else:
        comps = comps.withColumn("known_license", F.lit(None).cast("string"))
    default = F.when(profile.first_party(F.col("name")), F.lit(profile.dependency_licence)) if profile.dependency_licence else F.lit(None).cast("string")
    comps = comps.withColumnRenamed("license", "declared_license")
    comps = resolve.layered(comps, [("default", default), ("declared", F.col("declared_license")), ("curated", F.col("curated_license")), ("known_map", F.col("known_license"))], "license")
    # only a curated and a known licence that differ are at odds
    at_odds = F.col("curated_license").isNotNull() & F.col("known_license").isNotNull() & (F.col("curated_license") != F.col("known_license"))
    comps = comps.withColumn("license_discrepant", at_odds)
    warnings.append(resolve.unresolved(comps, "name", "license"))
    warnings.append(comps.where("license_discrepant").select(F.lit("license_discrepancy").alias("code"), F.col("name").alias("subject"), F.lit("sources disagree").alias("detail")))

    comps = checkpointed(comps)
    facts = resolve.upstream_facts(observed, "component", "canonical_url", F.col("is_vcs"), "seq")
    python = observed.groupBy("component").agg(F.bool_or(F.col("source_kind").startswith("python_")).alias("is_python"))
    facts = facts.join(python, "component").withColumnRenamed("component", "u_name")
    comps = comps.join(facts, F.col("name") == F.col("u_name"), "left").drop("u_name")
    warnings.append(comps.where("unverified_url IS NOT NULL AND is_python").select(F.lit("unverified_direct_url").alias("code"), F.col("name").alias("subject"), F.col("unverified_url").alias("detail")))
    comps = comps.withColumn("origin", rules.provenance_class(profile.provenance(F.col("name")), F.col("is_python"), F.col("has_download"), licences.has_concrete(F.col("license"))))
    if profile.supplier:
        comps = resolve.suppliers(comps, profile.first_party(F.col("name")), profile.supplier)
    comps = checkpointed(comps)
    coordinates = coordinates if coordinates is not None else spark.createDataFrame([], "key string, purl string")
    comps = resolve.component_purls(comps.withColumn("is_python", F.coalesce("is_python", F.lit(False))), coordinates, comps.select("name", "first_download"))
    every = reduce(DataFrame.unionByName, warnings)
    return transform(replace(doc, components=comps, observations=observed, edges=edges, warnings=every), config)


def transform(doc: Document, config: Config) -> Document:
    """Scope filter, then closure on what it leaves, then tools."""
    excluded, keep, roles, bare = config.filters()
    if roles:
        doc = replace(doc, subjects=doc.subjects.where(~F.coalesce(F.col("role").isin(*sorted(roles)), F.lit(False))))
    if excluded or keep is not None:
        comps, obs, edges, warning = scope.apply(doc.components, doc.observations, doc.edges, excluded, keep)
        doc = replace(doc, components=comps, observations=obs, edges=edges, warnings=doc.warnings.unionByName(warning))
    if config.subjects:
        subjects, comps, edges, tools = closure.apply(doc.subjects, doc.components, doc.edges, doc.tools, list(config.subjects))
        doc = replace(doc, subjects=subjects, components=comps, edges=edges, tools=tools)
    return replace(doc, tools=doc.tools.limit(0)) if bare else doc


def python_names(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, pep503(F.col(column)))
