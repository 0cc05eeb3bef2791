"""The engine's operators as queries on general tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import licences, rules, text, versions
from .operators import alias, caches, closure, edges, ids, match, merge, order, resolve, scope, segments, subjects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEQ = "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey"


@query(f"""
WITH r AS (SELECT *, {SEQ} AS seq, nullif(l_returnflag, 'N') AS flag FROM lineitem),
u AS (SELECT l_partkey, string_agg(l_shipyear, ',' ORDER BY s) AS years FROM
      (SELECT l_partkey, year(l_shipdate)::VARCHAR AS l_shipyear, min(seq) AS s FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT r.l_partkey AS part, min(seq) AS position, arg_min(flag, seq) FILTER (flag IS NOT NULL) AS first_flag,
       arg_min(l_suppkey, seq) AS first_supplier, any_value(u.years) AS years, bool_or(l_quantity > 45) AS is_large
FROM r JOIN u USING (l_partkey) GROUP BY r.l_partkey
""")
def q_merge_first_wins(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.expr(SEQ).alias("seq"), F.nullif("l_returnflag", F.lit("N")).alias("first_flag"), F.col("l_suppkey").alias("first_supplier"), F.year("l_shipdate").cast("string").alias("years"), "l_quantity")
    out = merge.merge_by(rows, "part", "seq", first=["first_flag", "first_supplier"], unions=["years"], any_of=[("is_large", F.col("l_quantity") > 45)])
    return out.withColumn("years", F.array_join("years", ","))


@query(f"""
WITH r AS (SELECT l_suppkey, {SEQ} AS seq, unnest([('flag', l_returnflag), ('status', l_linestatus)]) AS kv FROM lineitem)
SELECT supplier, string_agg(k || '=' || v, ';' ORDER BY k) AS entries FROM
  (SELECT l_suppkey AS supplier, kv[1] AS k, arg_min(kv[2], seq) AS v FROM r GROUP BY 1, 2) GROUP BY supplier
""")
def q_merge_map_entries(spark, sf):
    m = F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus")
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.expr(SEQ).alias("seq"), m.alias("m"))
    out = order.first_map_entries(rows, "supplier", "m", "seq")
    return out.select("supplier", F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


_LAYERS = [(0, 0, "nation_3", "Three"), (0, 1, "NATION_3", "three_again"), (1, 0, "nation_3", "shadowed"), (1, 1, "Nation_7", "seven"), (2, 0, "nation_7", "shadowed"), (2, 1, "nation_9", "nine")]
_LAYERS_SQL = ", ".join(f"({p}, {s}, '{a}', '{c}')" for p, s, a, c in _LAYERS)
_ALIAS_SQL = f"""
layers AS (SELECT * FROM (VALUES {_LAYERS_SQL}) AS v (prio, seq, spelling, canonical)),
names AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'NATION_' ELSE 'nation_' END || n_nationkey AS raw FROM nation),
alias AS (SELECT lower(spelling) AS key, canonical FROM layers QUALIFY row_number() OVER (PARTITION BY lower(spelling) ORDER BY prio, seq DESC) = 1)
"""


def _aliases(spark) -> DataFrame:
    return alias.resolve_layers([spark.createDataFrame(_LAYERS, "prio int, seq int, spelling string, canonical string").select("spelling", "canonical", "seq", "prio")])


def _nations(spark, sf) -> DataFrame:
    prefix = F.when(F.col("n_nationkey") % 2 == 0, "NATION_").otherwise("nation_")
    return _t(spark, sf, "nation").withColumn("raw", F.concat(prefix, F.col("n_nationkey").cast("string")))


@query(f"WITH {_ALIAS_SQL} SELECT n_nationkey, raw, coalesce(canonical, raw) AS canonical FROM names LEFT JOIN alias ON lower(raw) = key")
def q_alias_canonical(spark, sf):
    return alias.canonical(_nations(spark, sf), "raw", _aliases(spark), "canonical").select("n_nationkey", "raw", "canonical")


@query(f"""WITH {_ALIAS_SQL}, derived AS (SELECT raw, CASE WHEN n_nationkey < 5 THEN 'nation_9' ELSE 'region_' || n_regionkey END AS target FROM names)
SELECT key, canonical FROM alias UNION ALL
SELECT lower(raw), coalesce(b.canonical, target) FROM derived LEFT JOIN alias b ON lower(target) = b.key WHERE lower(raw) NOT IN (SELECT key FROM alias)""")
def q_alias_derived_layer(spark, sf):
    target = F.when(F.col("n_nationkey") < 5, "nation_9").otherwise(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")))
    derived = _nations(spark, sf).select(F.col("raw").alias("spelling"), target.alias("canonical"))
    return alias.with_derived(_aliases(spark), derived)


@query(f"""WITH {_ALIAS_SQL}, e AS (SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 3 = 0 THEN 'subject' ELSE 'component' END AS from_kind, raw AS from_id, 'component' AS to_kind, 'nation_' || ((n_nationkey + 3) % 25) AS to_id FROM names)
SELECT seq, from_kind, CASE WHEN from_kind = 'component' THEN coalesce(a.canonical, from_id) ELSE from_id END AS from_id, to_kind, coalesce(b.canonical, to_id) AS to_id
FROM e LEFT JOIN alias a ON lower(from_id) = a.key LEFT JOIN alias b ON lower(to_id) = b.key""")
def q_edges_canonical(spark, sf):
    e = _nations(spark, sf).select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") % 3 == 0, "subject").otherwise("component").alias("from_kind"), F.col("raw").alias("from_id"), F.lit("component").alias("to_kind"), F.concat(F.lit("nation_"), ((F.col("n_nationkey") + 3) % 25).cast("string")).alias("to_id"))
    return alias.canonical_edges(e, _aliases(spark)).select("seq", "from_kind", "from_id", "to_kind", "to_id")


def _line_edges(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        F.expr(SEQ).alias("seq"), F.when(F.col("l_orderkey") % 7 != 0, F.concat(F.lit("root"), (F.col("l_orderkey") % 3).cast("string"))).alias("root"), F.lit("component").alias("from_kind"), F.concat(F.lit("c"), (F.col("l_suppkey") % 40).cast("string")).alias("from_id"),
        F.lit("component").alias("to_kind"), F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("to_id"), F.lit("depends_on").alias("relation"), F.nullif("l_returnflag", F.lit("N")).alias("usage_scope"), F.lit("reachable").alias("reachability"), F.col("l_linestatus").alias("source_file"), F.lit(None).cast("string").alias("source_revision"),
    )


_EDGE_SQL = f"""e AS (SELECT {SEQ} AS seq, CASE WHEN l_orderkey % 7 <> 0 THEN 'root' || (l_orderkey % 3) END AS root, 'component' AS from_kind, 'c' || (l_suppkey % 40) AS from_id, 'component' AS to_kind,
 'c' || (l_partkey % 50) AS to_id, 'depends_on' AS relation, nullif(l_returnflag, 'N') AS usage_scope, 'reachable' AS reachability, l_linestatus AS source_file FROM lineitem)"""


@query(f"WITH {_EDGE_SQL} SELECT seq, root, from_id, to_id, usage_scope FROM e WHERE from_id <> to_id QUALIFY row_number() OVER (PARTITION BY root, from_id, to_id, usage_scope ORDER BY seq) = 1")
def q_edge_dedup_semantic(spark, sf):
    return edges.deduplicate(_line_edges(spark, sf)).select("seq", "root", "from_id", "to_id", "usage_scope")


@query(f"WITH {_EDGE_SQL} SELECT seq, root, from_id, to_id, usage_scope, source_file FROM e WHERE from_id <> to_id QUALIFY row_number() OVER (PARTITION BY root, from_id, to_id, usage_scope, source_file ORDER BY seq) = 1")
def q_edge_dedup_exact(spark, sf):
    return edges.deduplicate(_line_edges(spark, sf), edges.EXACT).select("seq", "root", "from_id", "to_id", "usage_scope", "source_file")


@query(f"WITH {_EDGE_SQL} SELECT name, string_agg(to_id, ',' ORDER BY s) AS depends_on FROM (SELECT from_id AS name, to_id, min(seq) AS s FROM e WHERE from_id <> to_id GROUP BY 1, 2) GROUP BY name")
def q_depends_on(spark, sf):
    return edges.depends_on(_line_edges(spark, sf)).withColumn("depends_on", F.array_join("depends_on", ","))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_returnflag, 'N') IS NULL OR l_returnflag NOT IN ('R')")
def q_scope_exclude(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("scope", F.nullif("l_returnflag", F.lit("N")))
    return scope.filter_observations(rows, excluded=["R"], scope="scope").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(nullif(l_returnflag, 'N') IN ('A'), false)")
def q_scope_keep(spark, sf):
    rows = _t(spark, sf, "lineitem").withColumn("scope", F.nullif("l_returnflag", F.lit("N")))
    return scope.filter_observations(rows, keep_only=["A"], scope="scope").select("l_orderkey", "l_linenumber")


_SCOPED_SQL = """
o AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'c' || (l_suppkey % 40) AS component, CASE l_returnflag WHEN 'A' THEN 'runtime' WHEN 'R' THEN 'test' END AS usage_scope FROM lineitem WHERE l_suppkey % 40 <> 5 OR l_returnflag = 'R'),
comp AS (SELECT 'c' || k AS name, ['c' || ((k + 1) % 40), 'c5'] AS depends_on FROM range(0, 41) r (k)),
k AS (SELECT * FROM o WHERE coalesce(usage_scope IN ('runtime'), false)),
stay AS (SELECT name, depends_on FROM comp WHERE name IN (SELECT component FROM k)),
gone AS (SELECT name FROM comp WHERE name NOT IN (SELECT component FROM k))
"""


def _scoped(spark, sf):
    o = _t(spark, sf, "lineitem").where("l_suppkey % 40 <> 5 OR l_returnflag = 'R'").select(F.expr(SEQ).alias("seq"), F.expr("concat('c', l_suppkey % 40)").alias("component"), F.expr("CASE l_returnflag WHEN 'A' THEN 'runtime' WHEN 'R' THEN 'test' END").alias("usage_scope"))
    c = spark.range(41).select(F.expr("concat('c', id)").alias("name"), F.expr("array(concat('c', (id + 1) % 40), 'c5')").alias("depends_on"))
    e = spark.range(41).select(F.lit("component").alias("from_kind"), F.expr("concat('c', id)").alias("from_id"), F.lit("component").alias("to_kind"), F.expr("concat('c', (id + 1) % 40)").alias("to_id"), F.expr("CASE WHEN id % 4 <> 0 THEN 'runtime' END").alias("usage_scope"))
    _, keep, _, _ = scope.preset("release")
    return scope.apply(c, o, e, (), keep)


@query(f"WITH {_SCOPED_SQL}, d AS (SELECT s.name, i, depends_on[i] AS t FROM stay s, range(1, 3) r (i)) SELECT name, coalesce(string_agg(t, ',' ORDER BY i) FILTER (t NOT IN (SELECT name FROM gone)), '') AS depends_on, 'runtime' AS scopes FROM d GROUP BY name")
def q_release_view_components(spark, sf):
    comps, _, _, _ = _scoped(spark, sf)
    return comps.select("name", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("scopes", ",").alias("scopes"))


@query(f"""WITH {_SCOPED_SQL}, e AS (SELECT 'c' || k AS f, 'c' || ((k + 1) % 40) AS t FROM range(0, 41) r (k) WHERE k % 4 <> 0),
l AS (SELECT * FROM e WHERE f NOT IN (SELECT name FROM gone) AND t NOT IN (SELECT name FROM gone))
SELECT 'excluded_scope' AS code, 'scope filter dropped ' || ((SELECT count(*) FROM o) - (SELECT count(*) FROM k)) || ' observations, ' || (SELECT count(*) FROM gone) || ' components, ' || (41 - (SELECT count(*) FROM l)) || ' edges' AS detail""")
def q_release_view_warning(spark, sf):
    return _scoped(spark, sf)[3].select("code", "detail")


_GRAPH_SQL = """
e AS (SELECT CASE WHEN n_nationkey % 6 <> 0 THEN 'r' || n_regionkey END AS root, 'n' || n_nationkey AS f, 'n' || ((n_nationkey * 7 + 3) % 25) AS t FROM nation
      UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'n' || ((n_nationkey + 5) % 25) FROM nation
      UNION ALL SELECT 'r' || n_regionkey, 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey < 10)
"""


def _graph(spark, sf) -> DataFrame:
    n = _t(spark, sf, "nation").withColumn("r", F.expr("concat('r', n_regionkey)")).withColumn("n", F.expr("concat('n', n_nationkey)"))
    kinds = lambda df, k: df.withColumn("from_kind", F.lit(k)).withColumn("to_kind", F.lit("component"))
    a = kinds(n.select(F.expr("CASE WHEN n_nationkey % 6 <> 0 THEN r END").alias("root"), F.col("n").alias("from_id"), F.expr("concat('n', (n_nationkey * 7 + 3) % 25)").alias("to_id")), "component")
    b = kinds(n.select(F.col("r").alias("root"), F.col("n").alias("from_id"), F.expr("concat('n', (n_nationkey + 5) % 25)").alias("to_id")), "component")
    c = kinds(n.where("n_nationkey < 10").select(F.col("r").alias("root"), F.col("r").alias("from_id"), F.col("n").alias("to_id")), "subject")
    return a.unionByName(b).unionByName(c)


@query(f"WITH RECURSIVE {_GRAPH_SQL}, walk (g, id) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT g, t FROM walk JOIN e ON e.f = walk.id AND (e.root IS NULL OR e.root = walk.g)) SELECT g AS \"group\", id FROM walk")
def q_closure_of_each_root(spark, sf):
    roots = _t(spark, sf, "region").select(F.expr("concat('r', r_regionkey)").alias("group"), F.lit("subject").alias("kind"), F.expr("concat('r', r_regionkey)").alias("id"), F.expr("concat('r', r_regionkey)").alias("owner"))
    return closure.reachable(_graph(spark, sf), roots).select("group", "id")


@query(f"WITH RECURSIVE {_GRAPH_SQL}, walk (id) AS (SELECT * FROM (VALUES ('r0'), ('r2')) UNION SELECT t FROM walk JOIN e ON e.f = walk.id AND (e.root IS NULL OR e.root IN ('r0', 'r2'))) SELECT e.root, e.f AS from_id, e.t AS to_id FROM e WHERE f IN (SELECT id FROM walk) AND t IN (SELECT id FROM walk)")
def q_closure_edges(spark, sf):
    subs = _t(spark, sf, "region").select(F.expr("concat('r', r_regionkey)").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("seq"), F.lit("example").alias("role"), F.lit(True).alias("emit_as_subject"))
    comps = _t(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("name"))
    tools = spark.createDataFrame([], "root_artifact_id string")
    return closure.apply(subs, comps, _graph(spark, sf), tools, ["r0", "r2"])[2].select("root", "from_id", "to_id")


_PATH_SQL = "p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)"


@query(f"""WITH {_PATH_SQL}, o AS (SELECT * FROM (VALUES ('', 'root', 0), ('en', 'english', 1), ('fr', 'french', 2), ('en/853', 'special', 3), ('fr', 'later', 4)) v (prefix, owner, seq))
SELECT page_id, owner FROM p JOIN o ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, seq) = 1""")
def q_longest_prefix(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    owners = spark.createDataFrame([("", "root", 0), ("en", "english", 1), ("fr", "french", 2), ("en/853", "special", 3), ("fr", "later", 4)], "prefix string, owner string, seq int")
    return match.longest_prefix(pages, owners, "path", "prefix", "owner", "seq", "page_id").select("page_id", "owner")


_VERSION_SQL = """
w AS (SELECT p_partkey AS k, 'v' || (p_partkey % 5) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 4) END AS want FROM part),
o AS (SELECT p_partkey AS k, unnest([(p_partkey % 5) || '.' || (p_partkey % 4) || '.x', (p_partkey % 5) || '.' || (p_partkey % 4) || '.1-h' , (p_partkey % 5) || '', ((p_partkey + 1) % 5) || '.0']) AS label FROM part),
n AS (SELECT w.k, want, label, string_split(regexp_extract(want, '\\d+(\\.\\d+)*'), '.') AS a, string_split(regexp_extract(label, '\\d+(\\.\\d+)*'), '.') AS b FROM w JOIN o USING (k)),
s AS (SELECT *, least(len(a), len(b)) AS score FROM n WHERE list_slice(a, 1, least(len(a), len(b))) = list_slice(b, 1, least(len(a), len(b))))
"""


def _offers(spark, sf):
    part = _t(spark, sf, "part")
    want = part.select(F.col("p_partkey").alias("k"), F.expr("concat('v', p_partkey % 5, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 4) END)").alias("want"))
    offered = part.select(F.col("p_partkey").alias("k"), F.explode(F.expr("array(concat(p_partkey % 5, '.', p_partkey % 4, '.x'), concat(p_partkey % 5, '.', p_partkey % 4, '.1-h'), concat(p_partkey % 5, ''), concat((p_partkey + 1) % 5, '.0'))")).alias("label"))
    return want, offered


@query(f"WITH {_VERSION_SQL} SELECT k, want, label, score FROM s QUALIFY row_number() OVER (PARTITION BY k, want ORDER BY score DESC, CASE WHEN label LIKE '%-%' OR label LIKE '%\\_%' ESCAPE '\\' THEN 1 ELSE 0 END, length(label), label) = 1")
def q_best_version_match(spark, sf):
    return match.best_version(*_offers(spark, sf), "k", "want", "label")


@query(f"WITH {_VERSION_SQL}, d AS (SELECT k, label, regexp_extract(label, '\\d+(\\.\\d+)*') AS v FROM o) SELECT k, v AS latest FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY list_transform(string_split(v, '.'), lambda x: x::BIGINT) DESC, label DESC) = 1")
def q_latest_version(spark, sf):
    return match.latest(_offers(spark, sf)[1], "k", "label")


def _phrase_sql(phrases: tuple[str, ...]) -> str:
    one, *two = [p.replace("'", "''") for p in phrases]
    return " AND ".join([f"contains(w, '{one}')", *[f"contains(substr(w, instr(w, '{one}'), {licences.NEAR}), '{p}')" for p in two]])


_HINTS = "CASE " + " ".join(f"WHEN {_phrase_sql(w)} THEN '{spdx}'" for spdx, ways in licences.PHRASES for w in ways) + " END"
_NAMED = "trim(regexp_extract(text, '(?i)SPDX-License-Identifier:\\s*([A-Za-z0-9\\-.+ ()]+)', 1))"
_CLASSIFIED = f"""SELECT *, coalesce(CASE WHEN {_NAMED} NOT IN ('', 'NOASSERTION', 'NONE') THEN {_NAMED} END, {_HINTS}) AS spdx
FROM (SELECT *, ' ' || lower(regexp_replace(text, '[\\x09-\\x0d ]+', ' ', 'g')) || ' ' AS w FROM documents)"""


@query(f"SELECT doc_id, spdx AS license FROM ({_CLASSIFIED})")
def q_license_classify(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", licences.classify(F.col("text")).alias("license"))


@query(f"""WITH d AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'LICENSE' WHEN doc_id % 9 = 1 THEN 'COPYING.BSD' ELSE 'LICENSE.' || doc_id END AS file, spdx FROM ({_CLASSIFIED})),
r AS (SELECT * FROM d WHERE spdx IS NOT NULL)
SELECT source, CASE WHEN count(DISTINCT spdx) = 1 THEN min(spdx) ELSE min(spdx) FILTER (file = 'LICENSE') END AS license FROM r GROUP BY source""")
def q_license_pick(spark, sf):
    d = _t(spark, sf, "documents")
    file = F.expr("CASE WHEN doc_id % 9 = 0 THEN 'LICENSE' WHEN doc_id % 9 = 1 THEN 'COPYING.BSD' ELSE concat('LICENSE.', doc_id) END")
    # of equal names the smallest id, as a directory has a name once
    rows = d.select("source", file.alias("file"), licences.classify(F.col("text")).alias("spdx")).where("spdx IS NOT NULL").groupBy("source", "file", "spdx").agg(F.lit(1).alias("one"))
    first = rows.groupBy("source", "file").agg(F.min("spdx").alias("low"))
    named = rows.join(first, ["source", "file"]).where("file <> 'LICENSE' OR spdx = low")
    extra = rows.join(first, ["source", "file"]).where("file = 'LICENSE' AND spdx <> low").select("source", F.lit("LICENSE.OTHER").alias("file"), "spdx")
    return resolve.licence_of_directory(named.select("source", "file", "spdx").unionByName(extra), "source", "file", "spdx")


_SLUG_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(t, '[\\s/_.]+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-')"


@query("SELECT doc_id, 'LicenseRef-' || CASE WHEN s = '' THEN 'unknown-' || substr(sha1(line), 1, 8) ELSE s END AS ref FROM (SELECT doc_id, line, " + _SLUG_SQL.replace("(t,", "(line,") + " AS s FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '??' ELSE text END AS line FROM documents))")
def q_licenseref_slug(spark, sf):
    line = F.when(F.col("doc_id") % 10 == 0, "??").otherwise(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", text.licence_ref(line).alias("ref"))


_EXPRESSIONS = {
    "MIT": True, "MIT AND Apache-2.0": True, "(MIT OR BSD-3-Clause)": True, "GPL v2": False, "NOASSERTION": True, "AND MIT": False, "": False, "MPL2": False,
    "LicenseRef-own OR (ISC AND Zlib)": True, "(MIT": False, "MIT OR OR ISC": False, "GPL-2.0-only WITH Classpath-exception-2.0": True, "MIT) OR (ISC": False, "A B C": False,
}
_EXPR = f"CASE p_partkey % {len(_EXPRESSIONS) + 1} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_EXPRESSIONS)) + " ELSE p_type END"


@query(f"SELECT p_partkey, p_partkey % {len(_EXPRESSIONS) + 1} IN ({', '.join(str(k) for k, fine in enumerate(_EXPRESSIONS.values()) if fine)}) AS is_expression FROM part")
def q_is_license_expression(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", licences.is_expression(F.expr(_EXPR)).alias("is_expression"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS pep503, lower(replace(replace(replace(p_brand, '-', ''), '_', ''), '.', '')) AS squeezed,
CASE WHEN regexp_matches(v, '^[vV][0-9]') THEN v[2:] ELSE v END AS bare, regexp_extract(v, '[0-9]+([.][0-9]+)*') AS dotted, contains(d, '${') OR contains(d, '$<') OR contains(d, '$(') AS template
FROM (SELECT *, 'v' || p_size || '.' || (p_partkey % 7) || '-x' AS v, CASE p_partkey % 3 WHEN 0 THEN '${X}' WHEN 1 THEN '$<Y>' ELSE p_type END AS d FROM part)""")
def q_names_and_versions(spark, sf):
    v, d = F.expr("concat('v', p_size, '.', p_partkey % 7, '-x')"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '$' || '{X}' WHEN 1 THEN '$<Y>' ELSE p_type END")
    return _t(spark, sf, "part").select("p_partkey", text.pep503(F.col("p_name")).alias("pep503"), text.squeezed(F.col("p_brand")).alias("squeezed"), versions.without_v(v).alias("bare"), versions.dotted(v).alias("dotted"), text.has_template(d).alias("template"))


@query("""WITH r AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'git@host.example:team/' || lower(n_name) || '.git' WHEN 1 THEN 'https://user@Host.Example:8080/team/' || n_nationkey || '/' WHEN 2 THEN 'ssh://git@host.example/team/x.git' WHEN 3 THEN '/local/path' ELSE '' END AS raw FROM nation)
SELECT k, CASE k % 5 WHEN 0 THEN 'https://host.example/team/' || regexp_extract(raw, 'team/(.*)[.]git', 1) WHEN 1 THEN 'https://host.example/team/' || k WHEN 2 THEN 'https://host.example/team/x' END AS web,
 CASE k % 5 WHEN 0 THEN 'git+https://host.example/team/' || regexp_extract(raw, 'team/(.*)', 1) WHEN 1 THEN 'git+https://host.example/team/' || k || '.git' WHEN 2 THEN 'git+https://host.example/team/x.git' END AS vcs FROM r""")
def q_url_origin(spark, sf):
    raw = F.expr("CASE n_nationkey % 5 WHEN 0 THEN concat('git@host.example:team/', lower(n_name), '.git') WHEN 1 THEN concat('https://user@Host.Example:8080/team/', n_nationkey, '/') WHEN 2 THEN 'ssh://git@host.example/team/x.git' WHEN 3 THEN '/local/path' ELSE '' END")
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), text.remote_web_url(raw).alias("web"), text.remote_vcs_url(raw).alias("vcs"))


_URLS = {
    0: "https://host.example/team/eigen/releases/download/5.0/eigen-5.0.0.tar.gz",
    1: "https://host.example/team/zlib/archive/refs/tags/v1.3.1.tar.gz",
    2: "https://host.example/team/other/releases/eigen-5.0.0.zip",
    3: "https://host.example/files/makeself-release-2.5.0.tar.xz",
    4: "https://host.example/page.html",
    5: "https://host.example/${X}/a-1.zip",
}
_UPSTREAM = {0: "eigen", 1: "zlib", 2: None, 3: "makeself", 4: None, 5: None}
_URL_SPARK = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{u}'" for k, u in _URLS.items()) + " END"


@query("SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {repr(v) if v else 'NULL'}" for k, v in _UPSTREAM.items()) + " END AS upstream, p_partkey % 6 <> 5 AS emittable, CASE p_partkey % 6 WHEN 0 THEN '5.0.0' WHEN 1 THEN '1.3.1' WHEN 2 THEN '5.0.0' WHEN 3 THEN '2.5.0' WHEN 5 THEN '1' END AS version FROM part")
def q_upstream_name(spark, sf):
    url = F.coalesce(*[F.when(F.col("p_partkey") % 6 == k, u) for k, u in _URLS.items()])
    return _t(spark, sf, "part").select("p_partkey", text.upstream_name(url).alias("upstream"), text.is_emittable_url(url).alias("emittable"), versions.version_in_archive(url).alias("version"))


@query("SELECT p_partkey, 'pkg:pypi/' || replace(lower(regexp_replace(p_name, '[-_.]+', '-', 'g')), ' ', '%20') || CASE WHEN p_size % 2 = 0 THEN '@' || p_size ELSE '' END AS python, 'pkg:generic/team/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '@1%2B' || p_size AS generic FROM part")
def q_package_url(spark, sf):
    none = F.lit(None).cast("string")
    return _t(spark, sf, "part").select("p_partkey", text.purl(F.lit("pypi"), none, F.col("p_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN string(p_size) END")).alias("python"), text.purl(F.lit("generic"), F.lit("team"), F.col("p_brand"), F.expr("concat('1+', p_size)")).alias("generic"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lib' || p_size WHEN 1 THEN 'egg' || p_size WHEN 2 THEN 'repo' ELSE 'pkg-1' END AS name, CASE WHEN p_partkey % 4 IN (0, 1, 2) THEN 'git' END AS vcs,
CASE p_partkey % 4 WHEN 0 THEN 'git+https://h.example/a/b.git@v1' WHEN 1 THEN 'git+ssh://git@h.example/a/c.git' WHEN 2 THEN 'git+https://h.example/a/repo.git' ELSE 'https://h.example/pkg-1.whl' END AS location FROM part""")
def q_direct_reference(spark, sf):
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('lib', p_size, ' @ git+https://h.example/a/b.git@v1') WHEN 1 THEN concat('git+ssh://git@h.example/a/c.git#egg=egg', p_size) WHEN 2 THEN 'git+https://h.example/a/repo.git' ELSE 'https://h.example/pkg-1.whl' END")
    p = text.direct_url_parts(raw)
    return _t(spark, sf, "part").select("p_partkey", p["name"].alias("name"), p["vcs"].alias("vcs"), p["location"].alias("location"))


_L = {"declared": "CASE WHEN c_custkey % 2 = 0 THEN 'L' || (c_custkey % 5) END", "curated": "CASE WHEN c_custkey % 3 = 0 THEN 'L' || (c_nationkey % 5) END", "cache": "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END"}


@query(f"""WITH l AS (SELECT c_custkey, {', '.join(f'{v} AS {k}' for k, v in _L.items())} FROM customer)
SELECT c_custkey, coalesce(declared, curated, cache, 'NOASSERTION') AS license, CASE WHEN declared IS NOT NULL THEN 'declared' WHEN curated IS NOT NULL THEN 'curated' WHEN cache IS NOT NULL THEN 'cache' END AS license_source,
 len(list_distinct(list_filter([declared, curated, cache], lambda x: x IS NOT NULL))) > 1 AS license_discrepant FROM l""")
def q_layered_resolve(spark, sf):
    return resolve.layered(_t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), [(k, F.expr(v)) for k, v in _L.items()], "license").drop("c_nationkey", "c_mktsegment")


@query("""WITH n AS (SELECT s_suppkey, s_name, ['alt' || (s_suppkey % 7), 'x' || s_suppkey] AS a FROM supplier), t AS (SELECT 'ALT' || k AS key, 'lic' || k AS license FROM range(0, 5) r (k) UNION ALL SELECT upper(s_name), 'own' FROM supplier WHERE s_suppkey % 4 = 0),
w AS (SELECT s_name, unnest(list_prepend(s_name, a)) AS sp, unnest([0, 1, 2]) AS rank FROM n)
SELECT s_name, license FROM w JOIN t ON lower(sp) = lower(key) QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY rank, license) = 1""")
def q_lookup_by_names(spark, sf):
    s = _t(spark, sf, "supplier").select("s_name", F.expr("array(concat('alt', s_suppkey % 7), concat('x', s_suppkey))").alias("a"))
    t = spark.range(5).select(F.expr("concat('ALT', id)").alias("key"), F.expr("concat('lic', id)").alias("license")).unionByName(_t(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.upper("s_name").alias("key"), F.lit("own").alias("license")))
    return resolve.lookup_by_names(s, t, "s_name", "a", "key", ["license"])


@query("""WITH a AS (SELECT doc_id, quality::VARCHAR AS v FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, nullif(toxic, 1)::VARCHAR AS v FROM labels WHERE doc_id % 3 <> 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS "left", b.v AS "right", coalesce(a.v, 'NOASSERTION') = coalesce(b.v, 'NOASSERTION') AS agree FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def q_crosscheck(spark, sf):
    rows = _t(spark, sf, "labels")
    a = rows.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").cast("string").alias("v"))
    b = rows.where("doc_id % 3 <> 1").select("doc_id", F.nullif("toxic", F.lit(1)).cast("string").alias("v"))
    return resolve.crosscheck(a, b, "doc_id", "v")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'first-party' WHEN p_size % 4 = 0 OR p_size % 3 = 0 THEN 'third-party' ELSE 'unknown' END AS origin FROM part")
def q_provenance_class(spark, sf):
    hook = F.when(F.col("p_partkey") % 11 == 0, "first-party")
    licence = F.when(F.col("p_size") % 3 == 0, "MIT AND LicenseRef-x").otherwise("LicenseRef-y")
    return _t(spark, sf, "part").select("p_partkey", rules.provenance_class(hook, F.col("p_size") % 4 == 0, F.lit(None).cast("boolean"), licences.has_concrete(licence)).alias("origin"))


@query("""WITH m AS (SELECT conv_id, turn, text, turn % 3 = 0 AS cont FROM conversations), g AS (SELECT *, sum(CASE WHEN coalesce(lag_c, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS line_group FROM (SELECT *, lag(cont) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_c FROM m))
SELECT conv_id, line_group, min(turn) AS first_line, string_agg(text, '' ORDER BY turn) AS logical FROM g GROUP BY 1, 2""")
def q_logical_lines(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\\"))).otherwise(F.col("text")).alias("text"))
    return segments.joined_lines(rows, "conv_id", "turn", "text")


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations")
def q_blocks(spark, sf):
    rows = segments.blocks(_t(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return segments.last_header(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "header").select("conv_id", "turn", "block", "header")


@query("SELECT doc_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM (SELECT doc_id, 'wheel-' || source AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def q_id_disambiguate(spark, sf):
    return ids.numbered(_t(spark, sf, "documents").select("doc_id", "source"), ids.subject_slug(F.lit("wheel"), F.col("source")), "doc_id", "id").select("doc_id", "id")


@query(None)
def q_claimed_ids(spark, sf):
    """Beyond SQL, as each id depends on those claimed before; tests compare it with going through the rows."""
    d = _t(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 50 = 0 THEN 'src1-2' WHEN doc_id % 50 = 1 THEN 'src1-3' ELSE source END").alias("base"))
    return ids.claimed(d, F.col("base"), "doc_id", "id").select("doc_id", "base", "id")


@query("WITH b AS (SELECT url, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS base FROM (SELECT DISTINCT url FROM pages)) SELECT url, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || substr(sha256(url), 1, 8) ELSE base END AS file FROM b")
def q_safe_basenames(spark, sf):
    return ids.safe_basenames(_t(spark, sf, "pages").select("url").distinct(), "url", "file")


@query(f"SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY s, l_suppkey) - 1 AS n FROM (SELECT l_partkey, l_suppkey, min({SEQ}) AS s FROM lineitem GROUP BY 1, 2)")
def q_occurrences(spark, sf):
    return ids.occurrences(_t(spark, sf, "lineitem").withColumn("seq", F.expr(SEQ)), "l_partkey", "l_suppkey", "seq")


@query("SELECT sha256(string_agg(sha256(n_name || '|' || n_regionkey), '' ORDER BY n_nationkey)) AS fingerprint FROM nation")
def q_fingerprint(spark, sf):
    return ids.fingerprint(_t(spark, sf, "nation"), F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")), F.col("n_nationkey"))


_DET = f"SELECT l_suppkey AS target, l_partkey % 20 AS file, CASE WHEN l_returnflag = 'N' THEN 'unknown-ref' ELSE 'lic-' || l_returnflag || l_linestatus END AS expression, l_quantity * 2 AS score, l_partkey % 20 = 3 AS is_license, {SEQ} AS seq FROM lineitem"


@query(f"""WITH d AS ({_DET}), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY target, file ORDER BY score DESC, seq) = 1), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY target ORDER BY is_license DESC, score DESC, seq) = 1)
SELECT target, CASE WHEN score >= 80 AND NOT contains(expression, 'unknown') THEN expression END AS license FROM b""")
def q_best_detection(spark, sf):
    d = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("target"), F.expr("l_partkey % 20").alias("file"), F.expr("CASE WHEN l_returnflag = 'N' THEN 'unknown-ref' ELSE concat('lic-', l_returnflag, l_linestatus) END").alias("expression"), F.expr("l_quantity * 2").alias("score"), F.expr("l_partkey % 20 = 3").alias("is_license"), F.expr(SEQ).alias("seq"))
    return resolve.best_detection(d, "target", "file", "expression", "score", "is_license", "seq")


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN event_type END, ''), CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END) AS name FROM events")
def q_observation_name(spark, sf):
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("program")), F.array(F.expr("CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END"), F.expr("CASE WHEN event_id % 7 <> 0 THEN get_json_object(props, '$.k') END")))
    return _t(spark, sf, "events").select("event_id", m.alias("data")).select("event_id", alias.observation_name("data").alias("name"))


@query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1")
def q_warning_summary(spark, sf):
    return caches.warning_summary(_t(spark, sf, "events").select(F.col("event_type").alias("code")))


@query("""WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, arg_max(nullif(event_type, 'click'), event_id) AS k0, arg_max(event_type, event_id) AS k1, max(event_id) AS last FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(nullif(n.k1, 'click'), o.kind) AS kind, coalesce(n.last, o.last) AS last FROM o FULL JOIN n ON o.user_id = n.user_id""")
def q_cache_upsert(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id")
    old = caches.latest(e.where("event_id % 2 = 0"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("last"))
    new = caches.latest(e.where("event_id % 2 = 1"), ["user_id"], ["event_id"]).select("user_id", F.nullif("event_type", F.lit("click")).alias("kind"), F.col("event_id").alias("last"))
    return caches.upsert(old, new, "user_id")


@query("SELECT key, v FROM (SELECT p_partkey AS key, 'a' || p_size AS v, 0 AS prio FROM part UNION ALL SELECT p_partkey, 'b' || p_size, 1 FROM part WHERE p_size > 20 UNION ALL SELECT -1, 'c', 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio DESC) = 1")
def q_cache_layers(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size")
    named = lambda df, letter: df.select("key", F.concat(F.lit(letter), F.col("p_size").cast("string")).alias("v"))
    return caches.later_wins([named(p, "a"), named(p.where("p_size > 20"), "b"), spark.createDataFrame([(-1, "c")], "key bigint, v string")], "key")


@query(f"WITH {_ALIAS_SQL} SELECT raw FROM names WHERE lower(raw) NOT IN (SELECT lower(spelling) FROM layers)")
def q_alias_suggestions(spark, sf):
    have = spark.createDataFrame(_LAYERS, "prio int, seq int, raw string, canonical string").select("raw")
    return caches.suggestions(_nations(spark, sf).select("raw"), have, "raw")


_PINS = "CASE WHEN l_linenumber % 3 = 0 THEN '>=1' ELSE '==1.' || (l_suppkey % 12) || CASE WHEN l_linenumber % 2 = 0 THEN 'rc1' ELSE '' END END"


@query(f"""WITH p AS (SELECT DISTINCT 'p' || l_partkey AS component, c[3:] AS pin FROM (SELECT l_partkey, {_PINS} AS c FROM lineitem) WHERE c LIKE '==%')
SELECT component, string_agg(pin, ',' ORDER BY pin) AS pins, arg_min(pin, regexp_extract(pin, '[.]([0-9]+)', 1)::INT * 2 + CASE WHEN pin LIKE '%rc1' THEN 0 ELSE 1 END) AS kept FROM p GROUP BY 1 HAVING count(*) > 1""")
def q_pin_conflict(spark, sf):
    pins = "CASE WHEN l_linenumber % 3 = 0 THEN '>=1' ELSE concat('==1.', l_suppkey % 12, CASE WHEN l_linenumber % 2 = 0 THEN 'rc1' ELSE '' END) END"
    o = _t(spark, sf, "lineitem").select(F.expr("concat('p', l_partkey)").alias("component"), F.expr(pins).alias("version_constraint"))
    return merge.pin_conflicts(o).withColumn("pins", F.array_join("pins", ","))


@query("SELECT 'patched_build' AS code, p_name AS subject, 'built as ' || p_size || ' from ' || (p_partkey % 50) AS detail FROM part WHERE p_size <> p_partkey % 50 AND p_partkey % 4 <> 0")
def q_patched_build(spark, sf):
    c = _t(spark, sf, "part").select(F.col("p_name").alias("name"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN string(p_partkey % 50) END").alias("source_version"), F.col("p_size").cast("string").alias("effective_version"))
    return merge.patched_builds(c)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN NULL ELSE p_size::VARCHAR END AS source_version, CASE p_partkey % 5 WHEN 0 THEN 'unpinned' WHEN 1 THEN 'unresolved' END AS version_status FROM part")
def q_version_completeness(spark, sf):
    c = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 1, F.lit("${V}")).when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string")).alias("source_version"), F.lit(None).cast("string").alias("effective_version"))
    return merge.version_completeness(c).select("p_partkey", "source_version", "version_status")


@query("""WITH x AS (SELECT p_partkey, p_partkey % 2 = 0 AS hashed, p_partkey % 3 AS tls, p_partkey % 5 AS git, p_partkey % 7 AS place FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT hashed AND git > 1 THEN 'no_hash' END, CASE WHEN tls = 1 THEN 'tls_verification_disabled' END, CASE WHEN git = 0 THEN 'unpinned_git' END,
 CASE WHEN NOT hashed AND git > 1 AND place = 0 THEN 'local_source_unverified' END], lambda y: y IS NOT NULL), ',') AS findings FROM x""")
def q_integrity_findings(spark, sf):
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    args = F.concat(F.array(F.lit("x"), F.lit("URL"), F.lit("https://h/x.zip")), F.when(k % 2 == 0, F.array(F.lit("URL_HASH"), F.concat(F.lit("SHA256="), F.sha2(k.cast("string"), 256)))).otherwise(none), F.when(k % 3 == 1, F.array(F.lit("TLS_VERIFY"), F.lit("OFF"))).when(k % 3 == 2, F.array(F.lit("TLS_VERIFY"), F.lit("ON"))).otherwise(none))
    repo, tag = F.when(k % 5 < 2, "https://h/x.git"), F.when((k % 5 == 0) & (k % 2 == 0), "v1.0").when(k % 5 == 1, F.sha1(k.cast("string")))
    place = F.when(k % 7 == 0, "files/x.zip").otherwise("https://h/x.zip")
    return _t(spark, sf, "part").select("p_partkey", F.array_join(rules.integrity_findings(rules.url_hash(args), rules.tls_verify(args), repo, tag, place), ",").alias("findings"))


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'component' WHEN 1 THEN 'environment_tool' WHEN 2 THEN 'component' WHEN 8 THEN 'environment_tool' ELSE 'ignore' END AS class FROM part")
def q_classify_program(spark, sf):
    names = ("protoc", "PERL", "sitetool", "-flag", "${ARGN}", " ", "cmake", "unknown_word", "$(MAKE)")
    k = F.col("p_partkey") % len(names)
    return _t(spark, sf, "part").select("p_partkey", rules.classify_program(F.get(F.array(*map(F.lit, names)), k.cast("int")), F.lit("-E"), ("sitetool",)).alias("class"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'a' END AS depends, CASE p_partkey % 6 WHEN 0 THEN 'drop' WHEN 3 THEN 'drop' WHEN 1 THEN 'local' WHEN 4 THEN 'local' ELSE 'external' END AS token FROM part")
def q_keywords_and_tokens(spark, sf):
    args = F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, ("t", "DEPENDS", "a", "b", "URL", "u")))).otherwise(F.array(*map(F.lit, ("t", "URL", "u", "DEPENDS", "a"))))
    k = F.col("p_partkey") % 6
    token = F.when(k == 0, "-Wl,x").when(k == 3, "lib${ARGN}").when(k == 2, "pthread").otherwise(F.col("p_name"))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(rules.keyword_values(args, "DEPENDS", ("URL", "DEPENDS")), ",").alias("depends"), rules.classify_link_token(token, F.col("p_partkey") % 3 == 1).alias("token"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'conditional' ELSE 'reachable' END AS reachability, CASE WHEN p_size % 3 = 0 THEN 'test' WHEN p_size % 3 = 1 THEN 'docs' ELSE 'runtime' END AS scope,
CASE p_size % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' WHEN 2 THEN 'example' ELSE 'runtime' END AS file_scope, CASE p_size % 2 WHEN 0 THEN 'st_test' ELSE 'unclassified' END AS role, CASE p_size % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' END AS component_scope FROM part""")
def q_scope_rules(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    gates = F.when(k % 3 == 0, F.array(F.lit("WIN32"))).when(k % 3 == 1, F.array(F.lit("USE_X"))).otherwise(none)
    chain = F.when(s % 3 == 0, F.array(F.lit("a/docs/x"), F.lit("a/tests/y"))).otherwise(F.array(F.lit("a/x")))
    own = F.when(s % 3 == 1, "p/docs/z").otherwise("p/z")
    file = F.when(s % 4 == 0, "requirements-test.txt").when(s % 4 == 1, "requirements_dev.txt").otherwise("requirements.txt")
    folder = F.when(s % 4 == 2, "a/examples/b").otherwise("a")
    nothing = F.lit(None).cast("string")
    return _t(spark, sf, "part").select(
        "p_partkey", rules.reachability(gates, ("WIN32",))["reachability"].alias("reachability"), rules.chain_scope(chain, own, nothing, (("/tests/", "test"), ("/docs/", "docs"))).alias("scope"), rules.file_scope(nothing, nothing, file, folder).alias("file_scope"),
        rules.path_role(F.when(s % 2 == 0, "x/test/y").otherwise("x/y"), (("test", "st_test"),)).alias("role"), rules.component_scope(F.when(s % 3 == 0, F.array(F.lit("test"), F.lit("runtime"))).when(s % 3 == 1, F.array(F.lit("test"))).otherwise(none)).alias("component_scope"),
    )


@query("""WITH o AS (SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 8 = 7 THEN NULL WHEN n_nationkey < 4 THEN 'Region' || n_regionkey ELSE 'lib' || (n_nationkey % 4) END AS raw, CASE WHEN n_nationkey % 2 = 0 THEN 'cmake_link_library' ELSE 'cmake_find_package' END AS kind FROM nation),
c AS (SELECT 'Region' || r_regionkey AS name FROM region), other AS (SELECT DISTINCT raw FROM o WHERE kind <> 'cmake_link_library' AND raw NOT IN (SELECT name FROM c))
SELECT seq, raw AS component FROM o WHERE raw IS NOT NULL AND (raw IN (SELECT name FROM c) OR raw IN (SELECT raw FROM other))""")
def q_attach_observations(spark, sf):
    o = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("seq"), F.expr("CASE WHEN n_nationkey % 8 = 7 THEN NULL WHEN n_nationkey < 4 THEN concat('Region', n_regionkey) ELSE concat('lib', n_nationkey % 4) END").alias("raw_name"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'cmake_link_library' ELSE 'cmake_find_package' END").alias("source_kind"))
    c = _t(spark, sf, "region").select(F.expr("concat('Region', r_regionkey)").alias("name"))
    return alias.attach(o, c, spark.createDataFrame([], "key string, canonical string"))[0].select("seq", "component")


@query("SELECT 't' || p_partkey AS spelling, 'pkg' || p_partkey AS canonical FROM part WHERE p_partkey % 10 <> 0")
def q_derived_aliases(spark, sf):
    url = F.expr("CASE WHEN p_partkey % 10 = 0 THEN concat('https://h/', p_partkey, '/same-1.0.zip') ELSE concat('https://h/pkg', p_partkey, '-1.0.zip') END")
    o = _t(spark, sf, "part").select(F.expr("concat('t', p_partkey)").alias("name"), url.alias("url"), F.col("p_partkey").alias("seq"))
    return alias.derived_aliases(o, "name", "url", "seq")[0]


@query("""SELECT 'w' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_suppkey ELSE '' END AS facets FROM supplier WHERE s_nationkey < 20 UNION ALL SELECT 'c' || s_suppkey, '' FROM supplier WHERE s_suppkey % 2 = 1 OR s_nationkey >= 20""")
def q_subject_merges(spark, sf):
    s = _t(spark, sf, "supplier")
    w = s.where("s_nationkey < 20").select(F.expr("concat('w', s_suppkey)").alias("id"), F.lit("wheel").alias("kind"), F.expr("concat('w', s_suppkey)").alias("name"), F.lit("1").alias("version"), F.lit("sibling_artifact").alias("role"), F.expr("concat('src/', s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN '/py' ELSE '/' END)").alias("source_path"), F.col("s_suppkey").alias("seq"))
    c = s.select(F.expr("concat('c', s_suppkey)").alias("id"), F.lit("cmake").alias("kind"), F.expr("concat('c', s_suppkey)").alias("name"), F.lit("1").alias("version"), F.lit("cmake_project").alias("role"), F.expr("concat('src/', s_suppkey)").alias("source_path"), (F.col("s_suppkey") + 1000000).alias("seq"))
    return subjects.discover(w.unionByName(c).unionByName(w), ()).select("id", F.array_join("facets", ",").alias("facets"))


@query("""WITH r AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0 ORDER BY s_nationkey, s_suppkey LIMIT 1)
SELECT 's' || s_suppkey AS id, s_suppkey = k AS is_root, s_suppkey % 3 = 0 AS emit_as_subject, CASE WHEN s_suppkey = k THEN (SELECT min(s_suppkey) FROM supplier) - 1 ELSE s_suppkey END AS seq FROM supplier, r""")
def q_promote_root(spark, sf):
    ranks = list(closure.ROLE_RANK)[1:]
    role = F.get(F.array(*map(F.lit, ranks)), F.least(F.col("s_nationkey"), F.lit(99)).cast("int"))
    s = _t(spark, sf, "supplier").select(F.expr("concat('s', s_suppkey)").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"), F.coalesce(role, F.concat(F.lit("other"), F.col("s_nationkey").cast("string"))).alias("role"), (F.col("s_suppkey") % 3 == 0).alias("emit_as_subject"))
    return closure.promote_root(s).select("id", "is_root", "emit_as_subject", "seq")


@query(f"""WITH RECURSIVE {_GRAPH_SQL}, walk (id) AS (SELECT * FROM (VALUES ('r0'), ('r2')) UNION SELECT t FROM walk JOIN e ON e.f = walk.id AND (e.root IS NULL OR e.root IN ('r0', 'r2'))),
c AS (SELECT 'n' || n_nationkey AS name, ['n' || ((n_nationkey + 7) % 25), 'n' || ((n_nationkey + 1) % 25)] AS deps FROM nation)
SELECT name, array_to_string(list_filter(deps, lambda d: list_contains(ids, d)), ',') AS depends_on FROM c, (SELECT list(id) AS ids FROM walk) WHERE list_contains(ids, name)""")
def q_closure_depends_on(spark, sf):
    subs = _t(spark, sf, "region").select(F.expr("concat('r', r_regionkey)").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("seq"), F.lit("example").alias("role"), F.lit(True).alias("emit_as_subject"))
    comps = _t(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("name"), F.expr("array(concat('n', (n_nationkey + 7) % 25), concat('n', (n_nationkey + 1) % 25))").alias("depends_on"))
    kept = closure.apply(subs, comps, _graph(spark, sf), spark.createDataFrame([], "root_artifact_id string"), ["r0", "r2"])[1]
    return kept.select("name", F.array_join("depends_on", ",").alias("depends_on"))


@query("""WITH w AS (SELECT s_suppkey AS k, 'lib' || s_suppkey AS name FROM supplier), e AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'lib' || s_suppkey WHEN 1 THEN 'lib' || s_suppkey || '-1.0.tar.gz' WHEN 2 THEN 'LIB_' || s_suppkey ELSE 'nothing' || s_suppkey END AS entry FROM supplier)
SELECT name, CASE k % 4 WHEN 0 THEN name WHEN 1 THEN name || '-1.0.tar.gz' ELSE 'LIB_' || k END AS entry FROM w WHERE k % 4 <> 3""")
def q_find_entry(spark, sf):
    s = _t(spark, sf, "supplier")
    w = s.select(F.expr("concat('lib', s_suppkey)").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("1.0")).alias("versions"))
    e = s.select(F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('lib', s_suppkey) WHEN 1 THEN concat('lib', s_suppkey, '-1.0.tar.gz') WHEN 2 THEN concat('LIB_', s_suppkey) ELSE concat('nothing', s_suppkey) END").alias("entry"))
    return match.find_entry(w, e)


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Apache-2.0 AND MIT' END AS versions_api, CASE event_id % 5 WHEN 0 THEN 'ISC' WHEN 1 THEN 'MIT' WHEN 2 THEN 'MIT AND Own Label' END AS index_api FROM events""")
def q_registry_answers(spark, sf):
    v = F.when(F.col("event_id") % 2 == 0, '{"licenses": ["MIT", "Apache-2.0", "non-standard"]}').otherwise('{"licenses": []}')
    k = F.col("event_id") % 5
    both = '{"info": {"license": "ISC", "classifiers": ["License :: OSI Approved :: Own Label", "License :: OSI Approved :: MIT License", "License :: Other"]}}'
    i = F.when(k == 0, '{"info": {"license": "ISC", "classifiers": []}}').when(k == 2, both).when(k == 3, '{"info": {"license": "a text\\nof lines"}}').when(k == 1, '{"info": {"license": "UNKNOWN", "classifiers": ["License :: OSI Approved :: MIT License"]}}').otherwise("not json")
    return _t(spark, sf, "events").select("event_id", licences.from_versions_api(v).alias("versions_api"), licences.from_index_api(i).alias("index_api"))


def _files(spark, sf) -> DataFrame:
    """A tree written from the supplier table: a requirements file and a CMake file for each nation."""
    s = _t(spark, sf, "supplier").withColumn("k", F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    by = lambda line: F.array_join(F.array_sort(F.collect_list(F.concat("k", line))), "\n")
    req = s.groupBy("s_nationkey").agg(by(F.expr("concat(' Lib_', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('==1.', s_suppkey) ELSE '>=2' END, '  # note')")).alias("t"))
    cm = s.groupBy("s_nationkey").agg(by(F.expr("concat(' ExternalProject_Add(ep', s_suppkey, ' URL https://h/lib', s_suppkey, '-1.', s_suppkey, '.tar.gz', CASE WHEN s_suppkey % 2 = 0 THEN concat(' URL_HASH SHA256=', sha2(string(s_suppkey), 256)) ELSE '' END, ')\nif(X)\ntarget_link_libraries(app PRIVATE ext', s_suppkey, ')\nendif()')")).alias("t"))
    body = F.regexp_replace("t", "(?m)^[0-9]{9} ", "").cast("binary")
    a = req.select(F.lit("repo").alias("repo"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/requirements.txt")).alias("path"), body.alias("content"))
    b = cm.select(F.lit("repo").alias("repo"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/CMakeLists.txt")).alias("path"), body.alias("content"))
    return a.unionByName(b)


@query("SELECT 'n' || s_nationkey || '/requirements.txt' AS path, 'lib-' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN '==1.' || s_suppkey ELSE '>=2' END AS specifier, CASE WHEN s_suppkey % 2 = 0 THEN '1.' || s_suppkey END AS pin FROM supplier")
def q_scan_requirements(spark, sf):
    from .sources import files, requirements

    return requirements.requirements(files.requirements_files(_files(spark, sf))).select("path", "name", "specifier", "pin")


@query("SELECT 'n' || s_nationkey || '/CMakeLists.txt' AS path, 'ep' || s_suppkey AS target, 'https://h/lib' || s_suppkey || '-1.' || s_suppkey || '.tar.gz' AS canonical_url, '1.' || s_suppkey AS version, CASE WHEN s_suppkey % 2 = 0 THEN sha256(s_suppkey::VARCHAR) END AS sha256, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'no_hash' END AS findings FROM supplier")
def q_scan_cmake_downloads(spark, sf):
    from .sources import cmake

    return cmake.downloads(cmake.commands(_files(spark, sf))).select("path", "target", "canonical_url", "version", "sha256", F.array_join("findings", ",").alias("findings"))


@query("SELECT 'n' || s_nationkey || '/CMakeLists.txt' AS path, 'ext' || s_suppkey AS token, 'external' AS kind, 'X' AS gates FROM supplier")
def q_scan_cmake_links(spark, sf):
    from .sources import cmake

    return cmake.link_tokens(cmake.commands(_files(spark, sf))).select("path", "token", "kind", F.array_join("gates", ",").alias("gates"))


def _document(spark, sf):
    from .plans import config, reconcile
    from .sources import cmake

    files = _files(spark, sf)
    profile = config.Profile()
    doc = reconcile.gather([reconcile.from_cmake(files, cmake.commands(files), profile, "app"), reconcile.from_requirements(files, profile, "app")])
    return reconcile.reconcile(doc, config.Config(view="all"), profile)


@query("""SELECT 'lib' || s_suppkey AS name, '1.' || s_suppkey AS version, 'third-party' AS origin, 'NOASSERTION' AS license FROM supplier
UNION ALL SELECT 'lib-' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '1.' || s_suppkey END, 'third-party', 'NOASSERTION' FROM supplier""")
def q_reconcile_components(spark, sf):
    doc = _document(spark, sf)
    return doc.components.select("name", F.coalesce("effective_version", "source_version").alias("version"), "origin", "license")


@query("SELECT 'unmapped_link_library' AS code, count(*) AS n FROM supplier UNION ALL SELECT 'license_unresolved', 2 * count(*) FROM supplier")
def q_reconcile_warnings(spark, sf):
    return caches.warning_summary(_document(spark, sf).warnings)


@query()
def q_emit_elements(spark, sf):
    from .plans import emit

    return emit.elements(_document(spark, sf), "full")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_windowed_counts(spark, sf):
    """The events as a stream, read to its end; with the watermark past the last row, all windows are there."""
    import uuid

    from .streaming import upsert

    schema = _t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"counts_{uuid.uuid4().hex}"
    out = upsert.windowed_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
