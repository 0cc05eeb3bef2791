"""CMake files: commands with their gates, and records made of them."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import item_at
from ..functions import rules
from ..functions.text import null_if_empty
from ..functions.versions import version_in_archive
from ..session import ship
from .files import parse

KEYWORDS = (
    "URL URL_HASH GIT_REPOSITORY GIT_TAG PATCH_COMMAND CONFIGURE_COMMAND BUILD_COMMAND INSTALL_COMMAND TEST_COMMAND UPDATE_COMMAND "
    "DOWNLOAD_COMMAND DEPENDS PREFIX SOURCE_DIR BINARY_DIR INSTALL_DIR CMAKE_ARGS TLS_VERIFY DOWNLOAD_DIR BUILD_IN_SOURCE EXCLUDE_FROM_ALL "
    "SOURCE_SUBDIR COMMAND WORKING_DIRECTORY OUTPUT COMMENT BYPRODUCTS VERBATIM RESULT_VARIABLE OUTPUT_VARIABLE"
).split()
LINK_WORDS = ("PUBLIC", "PRIVATE", "INTERFACE", "LINK_PUBLIC", "LINK_PRIVATE", "debug", "optimized", "general")
COMMANDS = "pos int, line int, command string, args array<string>, gates array<string>, fatal_near boolean"


def without_comments(text: str) -> str:
    """Line and bracket comments as spaces, so that positions stay; quotes protect ``#``."""
    pattern = re.compile(r'"(?:\\.|[^"\\])*"|#\[(=*)\[.*?\]\1\]|#[^\n]*|\[(=*)\[.*?\]\2\]', re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith("#") else m[0], text)


def split_args(body: str) -> list[str]:
    """Arguments: quoted, bracketed, or up to white space, ``;`` or a parenthesis."""
    out = []
    for m in re.finditer(r'"((?:\\.|[^"\\])*)"|\[(=*)\[(.*?)\]\2\]|((?:\\.|\$\{[^}]*\}|[^\s()";])+)', body, re.S):
        out.append(m[1] if m[1] is not None else m[3] if m[3] is not None else m[4])
    return out


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """(name, text between the parentheses, start, end) of each command."""
    out, at = [], 0
    head = re.compile(r"([A-Za-z_]\w*)[ \t]*\(")
    while m := head.search(text, at):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            if text[i] == '"':
                end = re.compile(r'(?:\\.|[^"\\])*"', re.S).match(text, i + 1)
                i = end.end() if end else len(text)
                continue
            depth += (text[i] == "(") - (text[i] == ")")
            i += 1
        out.append((m[1], text[m.end() : i - 1 if not depth else i], m.start(), i))
        at = i
    return out


def parse_commands(path: str, text: str) -> list[dict]:
    """Every command with the conditions it stands under, outermost first."""
    clean, gates, rows = without_comments(text), [], []
    line, counted = 1, 0
    for pos, (name, body, start, end) in enumerate(lex(clean)):
        line, counted = line + clean.count("\n", counted, start), start
        low, args = name.lower(), split_args(body)
        said = " ".join(body.split())
        if low == "if":
            gates.append([said])
        elif low == "elseif" and gates:
            gates[-1] = [*(g if g.startswith("NOT (") else f"NOT ({g})" for g in gates[-1]), said]
        elif low == "else" and gates:
            gates[-1] = [g if g.startswith("NOT (") else f"NOT ({g})" for g in gates[-1]]
        elif low == "endif" and gates:
            gates.pop()
        near = "FATAL_ERROR" in clean[end : end + 1500]
        rows.append({"pos": pos, "line": line, "command": low, "args": args, "gates": [g for level in gates for g in level], "fatal_near": near})
    return rows


def commands(files: DataFrame) -> DataFrame:
    """repo, path, pos, line, command, args, gates of all CMake files."""
    named = files.where(F.col("path").rlike(r"(^|/)CMakeLists\.txt$|\.cmake$"))
    return parse(named, parse_commands, COMMANDS)


def variables(cmds: DataFrame) -> DataFrame:
    """(repo, path, var, values, last): all values that ``set`` gives a variable of a file."""
    own = cmds.where("command = 'set' AND size(args) > 1").select("repo", "path", "pos", item_at("args", 1).alias("var"), F.slice("args", 2, 10_000).alias("vs"))
    cut = F.array_position("vs", "CACHE")
    own = own.withColumn("vs", F.when(cut > 1, F.slice("vs", 1, (cut - 1).cast("int"))).otherwise(F.col("vs")))
    out = own.groupBy("repo", "path", "var").agg(F.array_sort(F.collect_list(F.struct("pos", "vs"))).alias("all"))
    values = F.flatten(F.transform("all", lambda x: x["vs"]))
    return out.select("repo", "path", "var", values.alias("values"), item_at(values, -1).alias("last"))


def expand_variable(df: DataFrame, column: str, cmds: DataFrame) -> DataFrame:
    """``${VAR}`` as one row for each value of the file; an unknown variable stays."""
    v = variables(cmds).select(F.col("repo").alias("v_repo"), F.col("path").alias("v_path"), F.col("var"), F.col("values"))
    name = F.regexp_extract(column, r"^\$\{([^}]+)\}$", 1)
    joined = df.join(v, (F.col("repo") == F.col("v_repo")) & (F.col("path") == F.col("v_path")) & (name == F.col("var")), "left")
    return joined.withColumn(column, F.explode(F.coalesce("values", F.array(column)))).drop("v_repo", "v_path", "var", "values")


def _value(keyword: str):
    return F.get(rules.keyword_values(F.col("args"), keyword, KEYWORDS), F.lit(0))


def downloads(cmds: DataFrame) -> DataFrame:
    """ExternalProject_Add and FetchContent_Declare as records with integrity findings."""
    rows = cmds.where("command IN ('externalproject_add', 'fetchcontent_declare')").withColumn("url_arg", _value("URL"))
    v = variables(cmds).select(F.col("repo").alias("v_repo"), F.col("path").alias("v_path"), "var", "values")
    name = F.regexp_extract("url_arg", r"^\$\{([^}]+)\}$", 1)
    rows = rows.join(v, (F.col("repo") == F.col("v_repo")) & (F.col("path") == F.col("v_path")) & (name == F.col("var")), "left")
    candidates = F.coalesce("values", rules.keyword_values(F.col("args"), "URL", KEYWORDS))
    urls = F.filter(candidates, lambda c: c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    rows = rows.select(
        "repo", "path", "pos", "line", "command", "args", "gates",
        item_at("args", 1).alias("target"),
        F.get(urls, F.lit(0)).alias("canonical_url"),
        F.get(candidates, F.size(candidates) - 1).alias("location"),
        rules.url_hash(F.col("args")).alias("sha256"),
        _value("GIT_REPOSITORY").alias("git_repository"),
        _value("GIT_TAG").alias("git_tag"),
        rules.tls_verify(F.col("args")).alias("tls_verify"),
        rules.keyword_values(F.col("args"), "DEPENDS", KEYWORDS).alias("depends"),
        F.array_join(rules.keyword_values(F.col("args"), "PATCH_COMMAND", KEYWORDS), " ").alias("patch_command"),
    )
    found = rules.integrity_findings(F.col("sha256"), F.col("tls_verify"), F.col("git_repository"), F.col("git_tag"), F.coalesce("canonical_url", "location"))
    return rows.withColumns({"version": version_in_archive(F.coalesce("canonical_url", "location")), "findings": found})


def patches(loads: DataFrame, files: DataFrame) -> DataFrame:
    """Patch files in patch commands with the digest of their content, where the tree has them."""
    names = F.regexp_extract_all("patch_command", F.lit(r"([^\s\"'<>|&;]+\.(?:patch|diff))"), F.lit(1))
    each = loads.select("repo", "path", "target", F.posexplode(names).alias("n", "raw"))
    each = each.withColumn("file", F.regexp_replace(F.regexp_replace("raw", r"\$\{[^}]*\}/?", ""), r"^(\./)+", "")).withColumn("base", F.substring_index("file", "/", -1))
    have = files.where(F.col("path").rlike(r"\.(patch|diff)$")).select(F.col("repo").alias("f_repo"), F.col("path").alias("f_path"), F.substring_index("path", "/", -1).alias("f_base"), F.sha2("content", 256).alias("sha256"))
    hit = each.join(have, (F.col("repo") == F.col("f_repo")) & (F.col("base") == F.col("f_base")) & F.col("f_path").endswith(F.col("file")), "left")
    return hit.groupBy("repo", "path", "target", "n", "file").agg(F.min("sha256").alias("sha256"))


def find_packages(cmds: DataFrame) -> DataFrame:
    required, quiet = F.array_contains("args", "REQUIRED"), F.array_contains("args", "QUIET")
    return cmds.where("command = 'find_package'").select(
        "repo", "path", "pos", "gates", item_at("args", 1).alias("name"), required.alias("required"), quiet.alias("quiet"), (required | F.col("fatal_near")).alias("effective_required"),
        F.when(F.get("args", F.lit(1)).rlike(r"^\d"), F.get("args", F.lit(1))).alias("version"),
    )


def link_tokens(cmds: DataFrame) -> DataFrame:
    """Linked libraries, variables expanded, and what kind each is."""
    rows = cmds.where("command IN ('target_link_libraries', 'link_libraries')")
    args = F.when(F.col("command") == "link_libraries", F.col("args")).otherwise(F.slice("args", 2, 10_000))
    each = rows.select("repo", "path", "pos", "gates", F.when(F.col("command") != "link_libraries", item_at("args", 1)).alias("target"), F.explode(args).alias("token")).where(~F.col("token").isin(*LINK_WORDS))
    each = expand_variable(each, "token", cmds).withColumn("token", F.regexp_replace("token", "^-l", ""))
    local = cmds.where("command IN ('add_library', 'add_executable', 'add_custom_target')").select(F.col("repo").alias("l_repo"), item_at("args", 1).alias("l_name")).distinct()
    hit = each.join(local, (F.col("repo") == F.col("l_repo")) & (F.col("token") == F.col("l_name")), "left")
    return hit.withColumn("kind", rules.classify_link_token(F.col("token"), F.col("l_name").isNotNull())).drop("l_repo", "l_name")


def target_edges(cmds: DataFrame) -> DataFrame:
    rows = cmds.where("command = 'add_dependencies'")
    return rows.select("repo", "path", "pos", item_at("args", 1).alias("from_id"), F.explode(F.slice("args", 2, 10_000)).alias("to_id"))


def imported_programs(cmds: DataFrame) -> DataFrame:
    """Programs that find_program names."""
    rows = cmds.where("command = 'find_program'").withColumn("names", rules.keyword_values(F.col("args"), "NAMES", ("PATHS", "HINTS", "DOC", "REQUIRED", "NO_DEFAULT_PATH")))
    given = F.when(F.size("names") > 0, F.col("names")).otherwise(F.slice("args", 2, 1))
    return rows.select("repo", "path", "pos", "gates", F.lit("find_program").alias("context"), F.explode(given).alias("program"))


def shell_commands(raw: str) -> list[list[str]]:
    """Words of each simple command: split at ``&&``, ``||``, ``;`` and ``|``;
    redirections, assignments in front and CMake's own keywords go."""
    tokens = re.findall(r"\"(?:\\.|[^\"\\])*\"|'[^']*'|&&|\|\||[;|]|\d*>>?&?\d*|<|[^\s;|&<>\"']+", raw)
    out, now, skip = [], [], False
    for t in tokens:
        if skip:
            skip = False
        elif t in ("&&", "||", ";", "|"):
            out.append(now)
            now = []
        elif re.fullmatch(r"\d*>>?|<", t):
            skip = True
        elif re.fullmatch(r"\d*>>?&\d*", t):
            continue
        elif not now and re.match(r"^\w+=", t):
            continue
        else:
            now.append(t.strip("\"'") if t[0] in "\"'" else t)
    return [c for c in [*out, now] if c]


def program_calls(cmds: DataFrame) -> DataFrame:
    """Programs that process, custom and external-project commands run."""
    ship(cmds.sparkSession)
    split = F.udf(shell_commands, "array<array<string>>")
    words = ("COMMAND", "CONFIGURE_COMMAND", "BUILD_COMMAND", "INSTALL_COMMAND", "PATCH_COMMAND", "TEST_COMMAND", "UPDATE_COMMAND", "DOWNLOAD_COMMAND")
    rows = cmds.where("command IN ('execute_process', 'add_custom_command', 'add_custom_target', 'externalproject_add')")
    every = F.array(*[F.struct(F.lit(w).alias("context"), F.array_join(rules.keyword_values(F.col("args"), w, KEYWORDS), " ").alias("raw")) for w in words])
    each = rows.select("repo", "path", "pos", "gates", F.explode(F.filter(every, lambda x: x["raw"] != "")).alias("c"))
    each = each.select("repo", "path", "pos", "gates", "c.context", F.explode(split("c.raw")).alias("argv"))
    return each.select("repo", "path", "pos", "gates", "context", item_at("argv", 1).alias("program"))


def includes(cmds: DataFrame, files: DataFrame, cmake_root: str = "") -> DataFrame:
    """(repo, path, pos, gates, raw, target): the first candidate that exists, else the
    first; directory variables are the file's folder, the root or its cmake folder."""
    rows = cmds.where("command IN ('include', 'add_subdirectory')").select("repo", "path", "pos", "gates", "command", item_at("args", 1).alias("raw"))
    here = F.regexp_replace("path", "/?[^/]+$", "")
    bases = {"CMAKE_CURRENT_LIST_DIR": here, "CMAKE_CURRENT_SOURCE_DIR": here, "CMAKE_SOURCE_DIR": F.lit(cmake_root), "PROJECT_SOURCE_DIR": F.lit(cmake_root), "CMAKE_MODULE_PATH": F.lit(f"{cmake_root}/cmake".strip("/"))}
    filled = F.col("raw")
    for var, base in bases.items():
        filled = F.replace(filled, F.lit("${" + var + "}"), base)
    tail = F.when(F.col("command") == "add_subdirectory", F.concat(filled, F.lit("/CMakeLists.txt"))).when(filled.rlike(r"\.cmake$|\.txt$"), filled).otherwise(F.concat(filled, F.lit(".cmake")))
    rooted = F.col("raw").startswith("${")
    candidates = F.when(rooted, F.array(tail)).otherwise(F.array(*[F.concat_ws("/", null_if_empty(b), tail) for b in (here, F.lit(cmake_root), F.lit(f"{cmake_root}/cmake".strip("/")))]))
    tidy = F.udf(lambda p: posixpath.normpath(p).lstrip("/") if p else p, "string")
    each = rows.select("repo", "path", "pos", "gates", "raw", F.posexplode(candidates).alias("rank", "c")).withColumn("target", tidy("c"))
    have = files.select(F.col("repo").alias("f_repo"), F.col("path").alias("f_path"))
    hit = each.join(have, (F.col("repo") == F.col("f_repo")) & (F.col("target") == F.col("f_path")), "left").withColumn("exists", F.col("f_path").isNotNull())
    best = F.min_by(F.struct("target", "exists"), F.struct(~F.col("exists"), F.col("rank"))).alias("b")
    return hit.groupBy("repo", "path", "pos", "gates", "raw").agg(best).select("repo", "path", "pos", "gates", "raw", "b.target", "b.exists")


def visit(links: dict[str, list[tuple[int, str, list[str]]]], entry: str) -> list[tuple[int, str, list[str], list[str]]]:
    """(order, path, chain, gates): files from ``entry`` on a last-in-first-out stack;
    a file keeps the chain and gates of the route that is taken from the stack first."""
    stack, seen, out = [(entry, [], [])], set(), []
    while stack:
        path, chain, gates = stack.pop()
        if path in seen:
            continue
        seen.add(path)
        out.append((len(out), path, chain, gates))
        for _, target, own in sorted(links.get(path, []), key=lambda x: x[0]):
            if target not in seen:
                stack.append((target, [*chain, path], list(dict.fromkeys([*gates, *own]))))
    return out


def reached(links: DataFrame, entries: DataFrame) -> DataFrame:
    """repo, entry, visit, path, chain, gates for every entry. The order of a
    last-in-first-out walk is that of one tree, so a repository's include table
    (one row for each include) is one group."""
    import pandas as pd

    ship(links.sparkSession)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        table: dict = {}
        for path, pos, target, gates in left[["path", "pos", "target", "gates"]].itertuples(index=False):
            table.setdefault(path, []).append((pos, target, list(gates)))
        rows = [(key[0], e, n, p, chain, gates) for e in sorted(right["path"]) for n, p, chain, gates in visit(table, e)]
        return pd.DataFrame(rows, columns=["repo", "entry", "visit", "path", "chain", "gates"])

    both = links.where("exists").select("repo", "path", "pos", "target", "gates").groupBy("repo").cogroup(entries.select("repo", "path").groupBy("repo"))
    return both.applyInPandas(run, "repo string, entry string, visit int, path string, chain array<string>, gates array<string>")


def projects(cmds: DataFrame) -> DataFrame:
    """(repo, path, name, version) of project(): a name drops an unknown variable and
    keeps the rest, a version with one is null as a whole."""
    rows = cmds.where("command = 'project'").select("repo", "path", "pos", item_at("args", 1).alias("raw_name"), F.get(rules.keyword_values(F.col("args"), "VERSION", ("LANGUAGES", "DESCRIPTION", "HOMEPAGE_URL")), F.lit(0)).alias("raw_version"))
    v = variables(cmds).groupBy("repo", "path").agg(F.map_from_entries(F.collect_list(F.struct("var", "last"))).alias("vars"))
    rows = rows.join(v, ["repo", "path"], "left").withColumn("vars", F.coalesce("vars", F.create_map().cast("map<string,string>")))
    fill = lambda c, unknown: F.aggregate(F.regexp_extract_all(c, F.lit(r"\$\{([^}]+)\}"), F.lit(1)), c, lambda acc, n: F.replace(acc, F.concat(F.lit("${"), n, F.lit("}")), F.coalesce(F.try_element_at("vars", n), unknown(n))))
    name = null_if_empty(fill(F.col("raw_name"), lambda n: F.lit("")))
    version = fill(F.col("raw_version"), lambda n: F.concat(F.lit("${"), n, F.lit("}")))
    return rows.select("repo", "path", "pos", name.alias("name"), F.when(~version.contains("${"), version).alias("version"))


def missing_fragments(cmds: DataFrame, files: DataFrame, macros: dict[str, str]) -> DataFrame:
    """Warnings for macro calls whose fragment isn't in the tree, by name."""
    table = cmds.sparkSession.createDataFrame([(k.lower(), v) for k, v in macros.items()], "command string, template string")
    calls = cmds.join(F.broadcast(table), "command").select("repo", F.replace("template", F.lit("{}"), item_at("args", 1)).alias("path"), item_at("args", 1).alias("subject"))
    lost = calls.join(files.select("repo", "path"), ["repo", "path"], "left_anti").distinct()
    return lost.select(F.lit("unresolved_macro").alias("code"), "subject", F.concat(F.lit("no file "), F.col("path")).alias("detail"))


def local_source_unverified(cmds: DataFrame) -> DataFrame:
    """Targets that take a local folder under one gate and a download under its
    negation: the local content isn't verified."""
    rows = cmds.where("command IN ('externalproject_add', 'fetchcontent_declare')").withColumn("target", item_at("args", 1))
    local = F.array_contains("args", "SOURCE_DIR") & ~F.array_contains("args", "URL") & ~F.array_contains("args", "GIT_REPOSITORY")
    out = rows.groupBy("repo", "path", "target").agg(F.bool_or(local & (F.size("gates") > 0)).alias("local"), F.bool_or(~local & (F.size("gates") > 0)).alias("remote"))
    return out.where("local AND remote").select("repo", "path", "target", F.lit("local_source_unverified").alias("finding"))
