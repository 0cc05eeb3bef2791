"""Rule ladders: integrity, tokens, programs, scopes, reachability, roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import item_at

# Programs that packages provide, and programs of the build host.
PACKAGED_PROGRAMS = ("cmake", "ninja", "protoc")
HOST_PROGRAMS = (
    "awk", "bash", "cat", "ccache", "cd", "chmod", "chown", "cp", "curl", "echo", "env", "export", "false", "find", "git", "gzip", "ln", "make", "mkdir", "mv", "patch", "perl",
    "pwd", "python", "python3", "rm", "sed", "sh", "tar", "touch", "true", "unset", "unzip", "wget", "xargs",
)


def is_pinned_ref(tag: Column) -> Column:
    """A git reference that can't move: a commit id of 7 to 40 hex digits."""
    return F.coalesce(tag.rlike("^[0-9a-fA-F]{7,40}$"), F.lit(False))


def integrity_findings(url_hash: Column, tls_verify: Column, git_repository: Column, git_tag: Column, location: Column) -> Column:
    """Findings of one download, in order; ``tls_verify`` has three states."""
    unhashed = url_hash.isNull() & git_repository.isNull()
    local = (location != "") & ~location.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.array_compact(
        F.array(
            F.when(unhashed, "no_hash"),
            F.when(tls_verify.eqNullSafe(F.lit(False)), "tls_verification_disabled"),
            F.when(git_repository.isNotNull() & ~is_pinned_ref(git_tag), "unpinned_git"),
            F.when(unhashed & F.coalesce(local, F.lit(False)), "local_source_unverified"),
        )
    )


def tls_verify(args: Column) -> Column:
    """The value after TLS_VERIFY, or null if it isn't given or isn't a constant."""
    at = F.array_position(args, "TLS_VERIFY")
    value = F.upper(F.when(at > 0, F.get(args, at.cast("int"))))
    return F.when(value.isin("ON", "TRUE", "YES", "1", "Y"), True).when(value.isin("OFF", "FALSE", "NO", "0", "N"), False)


def url_hash(args: Column) -> Column:
    """The sha256 of a URL_HASH argument, lower-cased, or null."""
    at = F.array_position(args, "URL_HASH")
    pair = F.when(at > 0, F.get(args, at.cast("int")))
    joined = item_at(F.filter(args, lambda a: a.rlike(r"(?i)^SHA256=[0-9a-f]{64}$")), 1)
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(F.when(pair.rlike("(?i)^SHA256="), pair), joined), r"(?i)^SHA256=([0-9a-f]{64})$", 1), F.lit("")))


def keyword_values(args: Column, keyword: str, others: Sequence[str]) -> Column:
    """Arguments after ``keyword`` up to the next of ``others``."""
    at = F.array_position(args, keyword).cast("int")
    rest = F.when(at > 0, F.slice(args, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(args) - at, F.lit(0))))
    ends = F.filter(F.sequence(F.lit(1), F.size(rest)), lambda i: item_at(rest, i).isin(*others))
    ends = F.when(F.size(rest) > 0, ends).otherwise(F.array().cast("array<int>"))
    return F.slice(rest, 1, F.coalesce(F.array_min(ends) - 1, F.size(rest)))


def classify_link_token(token: Column, is_local: Column) -> Column:
    """``drop`` for flags and for what holds a variable or a generator expression,
    ``local`` for targets of this build, else ``external``."""
    t = F.trim(token)
    drop = (t == "") | t.startswith("-") | t.contains("$<") | t.contains("${")
    return F.when(drop, "drop").when(F.coalesce(is_local, F.lit(False)), "local").otherwise("external")


def classify_program(name: Column, first_argument: Column, tooling: Sequence[str]) -> Column:
    """``component`` for the site's ``tooling`` and for programs that packages
    provide, ``environment_tool`` for programs of the host, ``ignore`` for flags,
    variables, internal commands of the build tool and unknown words."""
    n = F.trim(name)
    low = F.lower(n)
    no_program = n.isNull() | (n == "") | n.startswith("-") | n.contains("${") | ((low == "cmake") & F.coalesce(first_argument == "-E", F.lit(False)))
    return (
        F.when(no_program, "ignore")
        .when(n.isin(*tooling) | low.isin(*tooling, *PACKAGED_PROGRAMS), "component")
        .when(low.isin(*HOST_PROGRAMS, "$(make)"), "environment_tool")
        .otherwise("ignore")
    )


def first_hint(path: Column, hints: Sequence[tuple[str, str]]) -> Column:
    """Scope of the first fragment that the path contains, else null."""
    return F.coalesce(*[F.when(path.contains(fragment), scope) for fragment, scope in hints])


def chain_scope(chain: Column, own: Column, role_scope: Column, hints: Sequence[tuple[str, str]], default: str = "runtime") -> Column:
    """Scope of the nearest includer that has one, else of the own path, else of the role, else the default."""
    nearest = item_at(F.filter(F.transform(F.reverse(chain), lambda p: first_hint(p, hints)), lambda s: s.isNotNull()), 1)
    return F.coalesce(nearest, first_hint(own, hints), role_scope, F.lit(default))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def reachability(conditions: Column, dead: Sequence[str]) -> Column:
    """Struct (reachability, reason): unreachable if a gate names a dead flag."""
    reasons = F.filter(conditions, lambda c: F.exists(F.array(*map(F.lit, dead)), lambda d: c.contains(d)))
    reason = F.get(reasons, F.lit(0))
    return F.struct(
        F.when(reason.isNotNull(), "unreachable").when(F.size(conditions) > 0, "conditional").otherwise("reachable").alias("reachability"), reason.alias("reason")
    )


def file_scope(hook: Column, configured: Column, file: Column, directory: Column) -> Column:
    """Scope of a requirements file: hook, configuration, tag in its name, directory, else runtime."""
    tag = F.lower(file)
    by_name = F.when(tag.rlike(r"(^|[-_.])(test|tests|ut|st)([-_.]|$)"), "test").when(tag.rlike(r"(^|[-_.])(dev|develop|lint)([-_.]|$)"), "dev").when(tag.rlike(r"(^|[-_.])(doc|docs)([-_.]|$)"), "docs").when(tag.rlike(r"(^|[-_.])build([-_.]|$)"), "build")
    by_dir = F.when(directory.rlike(r"(^|/)(test|tests)(/|$)"), "test").when(directory.rlike(r"(^|/)(example|examples|sample|samples)(/|$)"), "example").when(directory.rlike(r"(^|/)docs?(/|$)"), "docs")
    return F.coalesce(hook, configured, by_name, by_dir, F.lit("runtime"))


def path_role(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Role of the first rule whose segment the path has, else ``unclassified``."""
    parts = F.split(path, "/")
    return F.coalesce(*[F.when(F.array_contains(parts, segment), role) for segment, role in rules], F.lit("unclassified"))


def component_scope(scopes: Column) -> Column:
    """``required`` if any scope ships, ``optional`` if there are only others, else null."""
    return F.when(F.arrays_overlap(scopes, F.array(F.lit("runtime"), F.lit("build"))), "required").when(F.size(scopes) > 0, "optional")


def provenance_class(hook: Column, is_python: Column, has_download: Column, licence_is_oss: Column) -> Column:
    """Hook's word first; third party if Python, downloaded or under an open licence; else unknown."""
    return F.coalesce(hook, F.when(F.coalesce(is_python, F.lit(False)) | F.coalesce(has_download, F.lit(False)) | F.coalesce(licence_is_oss, F.lit(False)), "third-party"), F.lit("unknown"))
