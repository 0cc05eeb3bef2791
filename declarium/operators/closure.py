"""Ownership-scoped reachability, for all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .order import top_one

# Roles from the first choice of a root to the last.
ROLE_RANK = {r: i for i, r in enumerate(("primary", "sibling_artifact", "cmake_project", "unclassified", "example", "manual_example", "st_test", "experimental", "non_distributable_test"))}


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(group, kind, id) reached from each group's roots.

    ``roots`` has group, kind, id and owner (whose edges the group may take, with
    edges without an owner); ``edges`` has root, from_kind, from_id, to_kind, to_id.
    A round joins only the nodes found in the last one; every round is checkpointed."""
    e = edges.select("root", "from_kind", "from_id", "to_kind", "to_id").distinct()
    owners = roots.select(F.col("group").alias("o_group"), "owner").distinct()
    seen = checkpointed(roots.select("group", "kind", "id").distinct())
    frontier = seen
    for _ in range(most_rounds):
        step = frontier.join(e, (F.col("kind") == F.col("from_kind")) & (F.col("id") == F.col("from_id")))
        free = step.where("root IS NULL").select("group", "to_kind", "to_id")
        owned = step.join(owners, (F.col("group") == F.col("o_group")) & (F.col("root") == F.col("owner")), "left_semi").select("group", "to_kind", "to_id")
        found = free.unionByName(owned).distinct().select("group", F.col("to_kind").alias("kind"), F.col("to_id").alias("id"))
        frontier = checkpointed(found.join(seen, ["group", "kind", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(frontier))
    raise RuntimeError(f"no end after {most_rounds} rounds")


def select_subjects(subjects: DataFrame, wanted: list[str]) -> DataFrame:
    """By id or by name."""
    return subjects.where(F.col("id").isin(wanted) | F.col("name").isin(wanted))


def apply(subjects: DataFrame, components: DataFrame, edges: DataFrame, tools: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Subjects wanted, what they reach, edges between kept nodes (whoever owns
    them), tools of kept subjects or of none; a root is promoted if no primary stays."""
    kept = select_subjects(subjects, wanted)
    roots = kept.select(F.lit("all").alias("group"), F.lit("subject").alias("kind"), "id", F.col("id").alias("owner"))
    nodes = reachable(edges, roots).where("kind = 'component'").select(F.col("id").alias("node"))
    comps = components.join(nodes, F.col("name") == F.col("node"), "left_semi")
    if "depends_on" in components.columns:
        comps = _without_dangling(comps, nodes)
    both = nodes.select(F.lit("component").alias("n_kind"), "node").unionByName(kept.select(F.lit("subject").alias("n_kind"), F.col("id").alias("node"))).distinct()
    for side in ("from", "to"):
        edges = edges.join(both, (F.col(f"{side}_kind") == F.col("n_kind")) & (F.col(f"{side}_id") == F.col("node")), "left_semi")
    own = kept.select(F.col("id").alias("node")).distinct()
    free = tools.where("root_artifact_id IS NULL").unionByName(tools.join(own, F.col("root_artifact_id") == F.col("node"), "left_semi"))
    return promote_root(kept), comps, edges, free


def _without_dangling(comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depends_on`` cut down to ``nodes``, in its order."""
    asked = comps.select(F.col("name").alias("d_name"), F.posexplode("depends_on").alias("pos", "d_to"))
    stay = asked.join(nodes.distinct(), F.col("d_to") == F.col("node"), "left_semi")
    stay = stay.groupBy("d_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d_to"))), lambda x: x["d_to"]).alias("d_stay"))
    kept = F.coalesce("d_stay", F.array().cast("array<string>"))
    return comps.join(stay, F.col("name") == F.col("d_name"), "left").withColumn("depends_on", kept).drop("d_name", "d_stay")


def promote_root(subjects: DataFrame) -> DataFrame:
    """Adds is_root: the first primary, else the emittable subject of the best role,
    which becomes emittable and goes ahead of all others."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_RANK.items() for x in kv]), F.col("role")), F.lit(99))
    ranked = subjects.withColumn("_role", rank)
    primary = F.col("_role") == 0
    best = top_one(ranked.withColumn("_g", F.lit(1)), ["_g"], ["id", "seq"], [~primary, ~F.col("emit_as_subject"), F.col("_role"), F.col("seq")])
    best = best.select(F.col("id").alias("b_id"), F.col("seq").alias("b_seq"))
    return subjects.join(F.broadcast(best), (F.col("id") == F.col("b_id")) & (F.col("seq") == F.col("b_seq")), "left").withColumn("is_root", F.col("b_id").isNotNull()).drop("b_id", "b_seq").transform(_promoted)


def _promoted(subjects: DataFrame) -> DataFrame:
    first = subjects.agg(F.min("seq").alias("_first"))
    new = F.col("is_root") & ~F.col("role").eqNullSafe(F.lit("primary"))
    out = subjects.crossJoin(F.broadcast(first))  # one row
    return out.withColumn("emit_as_subject", F.col("emit_as_subject") | new).withColumn("seq", F.when(new, F.col("_first") - 1).otherwise(F.col("seq"))).drop("_first")


def pick_primary(subjects: DataFrame) -> DataFrame:
    """One row: the first primary, else the first emittable, else the first subject."""
    order = [F.col("role") != "primary", ~F.col("emit_as_subject"), F.col("seq")]
    return top_one(subjects.withColumn("_g", F.lit(1)), ["_g"], [c for c in subjects.columns], order).drop("_g")
