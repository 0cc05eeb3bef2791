"""Emission of a document as CycloneDX 1.5 or SPDX 2.3 JSON, whole or one for each subject.

Every element becomes JSON on the executors. ``elements`` gives them as rows
(group, section, ord, json), for documents of any size; ``assemble`` joins the
rows of a group into one text, in which a document must fit.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import licences, rules
from ..functions.text import id_slug, is_emittable_url, licence_ref
from ..operators import closure, ids
from .reconcile import Document

EPOCH = 0


def stamp(reproducible: bool, epoch: int | None = None, now: datetime.datetime | None = None) -> str:
    """The only time in a document: the given epoch, a fixed one, or now."""
    if epoch is None and not reproducible:
        at = now or datetime.datetime.now(datetime.UTC)
    else:
        at = datetime.datetime.fromtimestamp(epoch or EPOCH, datetime.UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def licence_choice(c: Column) -> Column:
    """An expression verbatim, other words as a LicenseRef, nothing for no assertion."""
    fine = licences.is_expression(c)
    return F.when(c.isNull() | c.isin("NOASSERTION", "NONE"), None).when(fine, c).otherwise(licence_ref(c))


def _property(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))


def cyclonedx_components(components: DataFrame, occurrences: DataFrame, detail: str = "compact") -> DataFrame:
    """(ord, json) of each component; ``occurrences`` has component, location, n."""
    where = occurrences.groupBy(F.col("component").alias("o_name")).agg(F.array_sort(F.collect_list(F.struct("n", "location"))).alias("at"))
    rows = components.join(where, F.col("name") == F.col("o_name"), "left")
    places = F.coalesce(F.transform("at", lambda x: F.struct(F.concat(F.lit("site:"), x["n"].cast("string")).alias("name"), x["location"].alias("value"))), F.array().cast("array<struct<name:string,value:string>>"))
    version = F.coalesce("effective_version", "source_version")
    properties = F.array_compact(F.array(_property("origin", F.col("origin")), _property("license_source", F.col("license_source")), _property("version_status", F.col("version_status")), _property("scopes", F.nullif(F.array_join("scopes", ","), F.lit("")))))
    if detail == "full":
        properties = F.concat(properties, places)
    licence = licence_choice(F.col("license"))
    pedigree = F.when(F.col("source_version") != F.col("effective_version"), F.struct(F.array(F.struct("name", F.col("source_version").alias("version"))).alias("ancestors")))
    body = F.struct(
        F.concat(F.lit("component:"), "name").alias("bom-ref"),
        F.col("type").alias("type"),
        "name",
        version.alias("version"),
        F.when(F.col("supplier").isNotNull(), F.struct(F.col("supplier").alias("name"))).alias("supplier"),
        rules.component_scope(F.col("scopes")).alias("scope"),
        F.when(licence.isNotNull(), F.array(F.struct(licence.alias("expression")))).alias("licenses"),
        F.col("copyright"),
        F.when(F.try_element_at("checksums", F.lit("sha256")).isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.try_element_at("checksums", F.lit("sha256")).alias("content")))).alias("hashes"),
        F.col("purl"),
        F.when(is_emittable_url(F.col("first_download")), F.array(F.struct(F.lit("distribution").alias("type"), F.col("first_download").alias("url")))).alias("externalReferences"),
        pedigree.alias("pedigree"),
        F.struct(F.transform(places, lambda p: F.struct(p["value"].alias("location"))).alias("occurrences")).alias("evidence"),
        properties.alias("properties"),
    )
    return rows.select(F.col("name").alias("ord"), F.to_json(body).alias("json"))


def cyclonedx_dependencies(edges: DataFrame) -> DataFrame:
    """(ord, json): each node with what it leads to, sorted."""
    ref = lambda side: F.concat(F.col(f"{side}_kind"), F.lit(":"), F.col(f"{side}_id"))
    rows = edges.groupBy(ref("from").alias("ref")).agg(F.array_sort(F.collect_set(ref("to"))).alias("dependsOn"))
    return rows.select(F.col("ref").alias("ord"), F.to_json(F.struct("ref", "dependsOn")).alias("json"))


def cyclonedx_tools(tools: DataFrame) -> DataFrame:
    """Environment tools, by root, name and file."""
    order = F.concat_ws("\0", F.coalesce("root_artifact_id", F.lit("")), "name", F.coalesce("source_file", F.lit("")))
    body = F.struct("name", "version", F.array_compact(F.array(_property("required", F.col("required")), _property("declared_in", F.col("source_file")))).alias("properties"))
    return tools.select(order.alias("ord"), F.to_json(body).alias("json"))


def _subject_json(subjects: DataFrame) -> DataFrame:
    named = ids.claimed(subjects, id_slug(F.col("id")), "seq", "ref")
    licence = licence_choice(F.col("license"))
    body = F.struct(F.concat(F.lit("subject:"), "id").alias("bom-ref"), F.lit("application").alias("type"), "name", "version", F.when(licence.isNotNull(), F.array(F.struct(licence.alias("expression")))).alias("licenses"), F.array_compact(F.array(_property("role", F.col("role")), _property("slug", F.col("ref")))).alias("properties"))
    return named.select(F.lpad(F.col("seq").cast("string"), 20, "0").alias("ord"), F.to_json(body).alias("json"))


def elements(doc: Document, detail: str = "compact") -> DataFrame:
    """(section, ord, json) of a whole document in CycloneDX form."""
    where = ids.occurrences(doc.observations.where("source_file IS NOT NULL"), "component", "source_file", "seq").withColumnRenamed("source_file", "location")
    parts = {
        "components": cyclonedx_components(doc.components, where, detail),
        "dependencies": cyclonedx_dependencies(doc.edges),
        "tools": cyclonedx_tools(doc.tools),
        "subjects": _subject_json(doc.subjects),
    }
    return reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("section"), "ord", "json") for k, p in parts.items()])


def assemble(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The group columns and, for each section, a JSON array in order."""
    arrays = rows.groupBy(*group, "section").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["json"]), ","), F.lit("]"))
    return arrays.select(*group, "section", text.alias("json"))


def cyclonedx(doc: Document, reproducible: bool = True, epoch: int | None = None, detail: str = "compact") -> str:
    """One CycloneDX 1.5 text; a reproducible one takes its serial number from its content."""
    sections = {r["section"]: json.loads(r["json"]) for r in assemble(elements(doc, detail)).collect()}
    root = closure.pick_primary(doc.subjects).select("id").collect()
    subjects = sections.get("subjects", [])
    main = next((s for s in subjects if root and s["bom-ref"] == f"subject:{root[0]['id']}"), None)
    body = {
        "bomFormat": "CycloneDX",
        "specVersion": "1.5",
        "version": 1,
        "metadata": {"timestamp": stamp(reproducible, epoch), **({"component": main} if main else {}), "tools": {"components": [{"type": "application", "name": "declarium"}]}},
        "components": [*(s for s in subjects if s is not main), *sections.get("components", [])],
        "dependencies": sections.get("dependencies", []),
        "properties": [{"name": "environment_tool", "value": json.dumps(t, sort_keys=True)} for t in sections.get("tools", [])],
    }
    text = json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False)
    serial = uuid.UUID(bytes=hashlib.sha256(text.encode()).digest()[:16], version=4) if reproducible else uuid.uuid4()
    return json.dumps({**body, "serialNumber": f"urn:uuid:{serial}"}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def spdx_packages(components: DataFrame) -> DataFrame:
    """(ord, json, spdx_id, ref): packages with unique ids; ``ref`` is the LicenseRef of a free-text licence."""
    named = ids.claimed(components, F.concat(F.lit("SPDXRef-"), id_slug(F.col("name"))), "seq", "spdx_id")
    licence = F.coalesce(licence_choice(F.col("license")), F.lit("NOASSERTION"))
    body = F.struct(
        F.col("spdx_id").alias("SPDXID"),
        "name",
        F.coalesce("effective_version", "source_version").alias("versionInfo"),
        F.when(is_emittable_url(F.col("first_download")), F.col("first_download")).otherwise("NOASSERTION").alias("downloadLocation"),
        F.lit(False).alias("filesAnalyzed"),
        licence.alias("licenseConcluded"),
        licence.alias("licenseDeclared"),
        F.coalesce("copyright", F.lit("NOASSERTION")).alias("copyrightText"),
        F.when(F.col("supplier").isNotNull(), F.concat(F.lit("Organization: "), "supplier")).alias("supplier"),
        F.when(F.col("purl").isNotNull(), F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))).alias("externalRefs"),
    )
    return named.select(F.col("name").alias("ord"), F.to_json(body).alias("json"), "spdx_id", F.when(licence.startswith("LicenseRef-"), F.struct(licence.alias("licenseId"), F.col("license").alias("extractedText"))).alias("ref"))


def spdx_relationships(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(ord, json): edges as relationships, each once; a build edge is inverted."""
    p = packages.select(F.col("ord").alias("p_name"), "spdx_id")
    end = lambda side: F.when(F.col(f"{side}_kind") == "component", F.col(f"{side}_spdx")).otherwise(F.concat(F.lit("SPDXRef-"), id_slug(F.col(f"{side}_id"))))
    for side in ("from", "to"):
        edges = edges.join(p.select(F.col("p_name").alias(f"{side}_p"), F.col("spdx_id").alias(f"{side}_spdx")), F.col(f"{side}_id") == F.col(f"{side}_p"), "left")
    build = F.col("usage_scope") == "build"
    rows = edges.select(
        F.when(build, end("to")).otherwise(end("from")).alias("spdxElementId"), F.when(build, "BUILD_DEPENDENCY_OF").otherwise("DEPENDS_ON").alias("relationshipType"), F.when(build, end("from")).otherwise(end("to")).alias("relatedSpdxElement")
    ).distinct()
    rows = rows.where("spdxElementId IS NOT NULL AND relatedSpdxElement IS NOT NULL")
    return rows.select(F.concat_ws("\0", "spdxElementId", "relationshipType", "relatedSpdxElement").alias("ord"), F.to_json(F.struct("spdxElementId", "relationshipType", "relatedSpdxElement")).alias("json"))


def document_fingerprint(doc: Document) -> str:
    """Digest of components and edges in order: the document's namespace."""
    a = doc.components.select(F.lit("c").alias("k"), F.col("name").alias("o"), F.concat_ws("|", "name", F.coalesce("source_version", F.lit("")), F.coalesce("effective_version", F.lit(""))).alias("v"))
    b = doc.edges.select(F.lit("e").alias("k"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("o"), F.concat_ws("|", "from_id", "relation", "to_id").alias("v"))
    return ids.fingerprint(a.unionByName(b), F.col("v"), F.struct("k", "o", "v")).collect()[0]["fingerprint"]


def spdx(doc: Document, reproducible: bool = True, epoch: int | None = None, name: str = "document") -> str:
    """One SPDX 2.3 text."""
    packages = spdx_packages(doc.components)
    rows = packages.select(F.lit("packages").alias("section"), "ord", "json")
    rows = rows.unionByName(spdx_relationships(doc.edges, packages).select(F.lit("relationships").alias("section"), "ord", "json"))
    refs = packages.where("ref IS NOT NULL").select("ref.*").groupBy("licenseId").agg(F.min("extractedText").alias("extractedText"))
    rows = rows.unionByName(refs.select(F.lit("extracted").alias("section"), F.col("licenseId").alias("ord"), F.to_json(F.struct("licenseId", "extractedText")).alias("json")))
    got = {r["section"]: json.loads(r["json"]) for r in assemble(rows).collect()}
    body = {
        "spdxVersion": "SPDX-2.3",
        "dataLicense": "CC0-1.0",
        "SPDXID": "SPDXRef-DOCUMENT",
        "name": name,
        "documentNamespace": f"https://spdx.example/{name}-{document_fingerprint(doc)[:32]}",
        "creationInfo": {"created": stamp(reproducible, epoch), "creators": ["Tool: declarium"]},
        "packages": got.get("packages", []),
        "relationships": got.get("relationships", []),
        "hasExtractedLicensingInfos": got.get("extracted", []),
    }
    return json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def split(doc: Document) -> DataFrame:
    """(basename, section, json) of one document for each emittable subject over its
    own closure: all closures are found at once."""
    subjects = ids.safe_basenames(doc.subjects.where("emit_as_subject"), "id", "basename")
    roots = subjects.select(F.col("basename").alias("group"), F.lit("subject").alias("kind"), "id", F.col("id").alias("owner"))
    nodes = closure.reachable(doc.edges, roots)
    where = ids.occurrences(doc.observations.where("source_file IS NOT NULL"), "component", "source_file", "seq").withColumnRenamed("source_file", "location")
    comps = cyclonedx_components(doc.components, where)
    own = nodes.where("kind = 'component'").join(comps, F.col("id") == F.col("ord")).select(F.col("group").alias("basename"), F.lit("components").alias("section"), "ord", "json")
    a = nodes.select(F.col("group").alias("a_group"), F.col("kind").alias("a_kind"), F.col("id").alias("a_id"))
    b = nodes.select(F.col("group").alias("b_group"), F.col("kind").alias("b_kind"), F.col("id").alias("b_id"))
    kept = doc.edges.join(a, (F.col("from_kind") == F.col("a_kind")) & (F.col("from_id") == F.col("a_id"))).join(b, (F.col("to_kind") == F.col("b_kind")) & (F.col("to_id") == F.col("b_id")) & (F.col("a_group") == F.col("b_group")))
    ref = lambda side: F.concat(F.col(f"{side}_kind"), F.lit(":"), F.col(f"{side}_id"))
    deps = kept.groupBy(F.col("a_group").alias("basename"), ref("from").alias("ref")).agg(F.array_sort(F.collect_set(ref("to"))).alias("dependsOn"))
    deps = deps.select("basename", F.lit("dependencies").alias("section"), F.col("ref").alias("ord"), F.to_json(F.struct("ref", "dependsOn")).alias("json"))
    return assemble(own.unionByName(deps), ["basename"])


def validate(text: str) -> list[tuple[str, str]]:
    """Structural findings (code, detail) of a CycloneDX or SPDX text."""
    out: list[tuple[str, str]] = []
    try:
        d = json.loads(text)
    except ValueError as e:
        return [("invalid_json", str(e))]
    if d.get("bomFormat") == "CycloneDX":
        refs = [c.get("bom-ref") for c in d.get("components", [])] + [d.get("metadata", {}).get("component", {}).get("bom-ref")]
        known = {r for r in refs if r}
        if len([r for r in refs if r]) != len(known):
            out.append(("duplicate_ref", "a bom-ref occurs twice"))
        out += [("missing_field", f"component without {k}") for c in d.get("components", []) for k in ("type", "name") if not c.get(k)]
        if d.get("specVersion") != "1.5" or "serialNumber" not in d:
            out.append(("header", "specVersion or serialNumber"))
    elif str(d.get("spdxVersion", "")).startswith("SPDX-"):
        refs = [p.get("SPDXID") for p in d.get("packages", [])]
        if len(refs) != len(set(refs)):
            out.append(("duplicate_ref", "an SPDXID occurs twice"))
        out += [("missing_field", f"package without {k}") for p in d.get("packages", []) for k in ("name", "SPDXID", "downloadLocation") if not p.get(k)]
    else:
        out.append(("unknown_format", "neither of the two formats"))
    return out
