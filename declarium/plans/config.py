"""Configuration, registries of lookup files, and profiles of site policy."""

from __future__ import annotations

import argparse
import dataclasses
import importlib.metadata
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scope import excluded_token, preset


@dataclass(frozen=True)
class Config:
    view: str = "release"
    exclude: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict)
    reproducible: bool = False
    epoch: int | None = None
    detail: str = "compact"
    homepage: str | None = None
    profile: str | None = None
    repo_root: str = "."
    out_dir: str = "."
    formats: tuple[str, ...] = ("cyclonedx", "spdx")
    split_subjects: bool = False
    env_tools: bool = True

    def filters(self) -> tuple[set[str], set[str] | None, set[str], bool]:
        """Excluded scopes, kept scopes, excluded roles, without tools."""
        scopes, keep, roles, bare = preset(self.view)
        named = [excluded_token(t) for t in self.exclude]
        return scopes | {s for _, s in named if s}, keep, roles | {r for r, _ in named if r}, bare or not self.env_tools


def parse_args(argv: Sequence[str]) -> Config:
    """Command line over file over defaults."""
    p = argparse.ArgumentParser(prog="declarium", argument_default=argparse.SUPPRESS)
    p.add_argument("--config", default=None)
    p.add_argument("--view", "--scope", dest="view", choices=("release", "all"))
    p.add_argument("--exclude", "--exclude-scope", dest="exclude", action="append")
    p.add_argument("--subjects", action="append")
    p.add_argument("--detail", choices=("compact", "full"))
    p.add_argument("--epoch", type=int)
    p.add_argument("--profile", "--repo-profile", dest="profile")
    p.add_argument("--repo-root")
    p.add_argument("--out-dir")
    p.add_argument("--format", dest="formats", action="append")
    p.add_argument("--split-subjects", action="store_true")
    p.add_argument("--no-env-tools", dest="env_tools", action="store_false")
    p.add_argument("--homepage")
    p.add_argument("--reproducible", action="store_true")
    given = vars(p.parse_args(list(argv)))
    base: dict = {}
    if path := given.pop("config", None):
        with open(path, "rb") as f:
            base = {k.replace("-", "_"): v for k, v in tomllib.load(f).items()}
    known = {f.name for f in dataclasses.fields(Config)}
    merged = {k: v for k, v in (base | given).items() if k in known}
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items()})


@dataclass(frozen=True)
class DataSource:
    name: str
    kind: str
    path: str


class Profile:
    """Site policy as tables and column rules: subclasses override what they need."""

    name = "default"
    role_rules: Sequence[tuple[str, str]] = (("tests", "st_test"), ("test", "st_test"), ("examples", "example"), ("samples", "example"), ("experimental", "experimental"))
    scope_hints: Sequence[tuple[str, str]] = (("/tests/", "test"), ("/test/", "test"), ("/examples/", "example"), ("/docs/", "docs"))
    dead_flags: Sequence[str] = ()
    tooling: Sequence[str] = ()  # programs that the site ships
    macros: dict[str, str] = {}
    aliases: dict[str, str] = {}
    supplier: str | None = None
    subject_licence: str | None = None
    dependency_licence: str | None = None

    def detect(self, files: DataFrame) -> bool:
        return False

    def first_party(self, name: Column) -> Column:
        return F.lit(False)

    def provenance(self, name: Column) -> Column:
        """Class of a component, or null to leave it to the general rules."""
        return F.lit(None).cast("string")

    def file_scope(self, path: Column) -> Column:
        return F.lit(None).cast("string")

    def curated_records(self, files: DataFrame) -> DataFrame | None:
        return None

    def data_sources(self) -> list[DataSource]:
        return []

    def repo_origin(self) -> str | None:
        return None

    def facets(self, subjects: DataFrame) -> DataFrame:
        return subjects


class AcceleratorProfile(Profile):
    """A device tool kit: packages by macro, first-party names by prefix, notices as curated records."""

    name = "accelerator"
    macros = {"add_third_party": "cmake/third_party/{}.cmake"}
    first_party_prefixes: Sequence[str] = ("acl_", "ops_", "runtime_")

    def detect(self, files: DataFrame) -> bool:
        return not files.where(F.col("path").rlike(r"(^|/)version\.cmake$")).isEmpty()

    def first_party(self, name: Column) -> Column:
        return F.coalesce(*[F.when(name.startswith(p), True) for p in self.first_party_prefixes], F.lit(False))

    def provenance(self, name: Column) -> Column:
        return F.when(self.first_party(name), "first_party")

    def curated_records(self, files: DataFrame) -> DataFrame:
        from ..sources.notices import component_lists, notices

        both = notices(files.where(F.col("path").rlike("(?i)notice"))).withColumn("source", F.lit("notice"))
        return both.unionByName(component_lists(files.where(F.col("path").rlike(r"(?i)list\.ya?ml$"))).withColumn("source", F.lit("list")))


class VendoredProfile(Profile):
    """A tree with vendored sources: components are the folders below a vendor root."""

    name = "vendored"

    def detect(self, files: DataFrame) -> bool:
        return not files.where(F.col("path").rlike("(^|/)(third_party|open_source)/")).isEmpty()

    def provenance(self, name: Column) -> Column:
        return F.lit(None).cast("string")

    def components(self, files: DataFrame) -> DataFrame:
        from ..sources.files import vendored

        return vendored(files)


def profiles() -> tuple[dict[str, Profile], list[tuple[str, str]]]:
    """Built-in and installed profiles, and warnings for those that can't be loaded."""
    out: dict[str, Profile] = {p.name: p() for p in (Profile, AcceleratorProfile, VendoredProfile)}
    warnings = []
    for point in importlib.metadata.entry_points(group="declarium.profiles"):
        try:
            out[point.name] = point.load()()
        except Exception as e:  # a broken plug-in is told, and the others go on
            warnings.append(("profile_load_failed", f"{point.name}: {e}"))
    return out, warnings


def choose(files: DataFrame, name: str | None = None) -> Profile:
    found, _ = profiles()
    if name:
        return found[name]
    return next((p for p in found.values() if p.detect(files)), found["default"])


def data_sources(core: Sequence[DataSource], profile: Profile, override: Sequence[DataSource] = ()) -> list[tuple[int, DataSource]]:
    """Sources with their priority: core, then profile, then override; later ones win."""
    return list(enumerate([*core, *profile.data_sources(), *override]))
