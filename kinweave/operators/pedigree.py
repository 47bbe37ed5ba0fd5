"""The ancestor walk: every path from a root upwards, with halving weights, a depth cap and a cycle guard.

A path key ('' for the root, then F or M a step) gives the order of a depth-first, father-first walk: a prefix sorts
first, and F before M. Weights are powers of two and sum to at most 1, so sums are exact in any order up to a cap of 52; beyond
that the least weights may be rounded away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.closure import Ancestors, core, cyclic
from kinweave.operators.shared import checkpoint

#: Visits that there can be, up to which all paths are walked at once by recursion (Spark ends one at a million rows);
#: beyond, generation by generation.
RECURSION_VISITS = 500_000


@dataclass(frozen=True)
class Pedigree:
    """nodes: root_id, id, depths, times_reached, contribution_weight, leaf_weight, is_leaf, path_key. gaps: root_id, id,
    depth, contribution_weight, missing_parent_of, slot, path_key. links: root_id, child_id, parent_id, slot, path_key."""

    nodes: DataFrame
    gaps: DataFrame
    links: DataFrame


def parents(individuals: DataFrame, families: DataFrame) -> DataFrame:
    """id, seq, father, mother: by each person's first family; a parent that is no individual is unknown."""
    known = individuals.select(F.col("id").alias("known_id"))
    own = individuals.select("id", "seq", F.get("famc", F.lit(0)).alias("family"))
    own = own.join(families.select(F.col("id").alias("family"), "husband", "wife"), "family", "left")
    own = own.join(known, F.col("husband") == F.col("known_id"), "left").select("id", "seq", "wife", F.col("known_id").alias("father"))
    return own.join(known, F.col("wife") == F.col("known_id"), "left").select("id", "seq", "father", F.col("known_id").alias("mother"))


def edges(parents_: DataFrame) -> DataFrame:
    """child_id, slot (F or M), parent_id of known parents."""
    slots = F.explode(F.array(F.struct(F.lit("F").alias("slot"), F.col("father").alias("parent_id")), F.struct(F.lit("M").alias("slot"), F.col("mother").alias("parent_id"))))
    return parents_.select(F.col("id").alias("child_id"), slots.alias("s")).select("child_id", "s.slot", "s.parent_id").filter("parent_id is not null")


def _recursive(spark: SparkSession, roots: DataFrame, links: DataFrame, cap: int) -> DataFrame:
    return spark.sql(
        """
        WITH RECURSIVE visit (root_id, id, depth, weight, path, path_key) MAX RECURSION LEVEL {levels} AS (
            SELECT root_id, root_id, 0, CAST(1 AS DOUBLE), array(root_id), '' FROM {roots}
            UNION ALL
            SELECT v.root_id, e.parent_id, v.depth + 1, v.weight / 2, array_append(v.path, e.parent_id), concat(v.path_key, e.slot)
            FROM visit v JOIN {links} e ON v.id = e.child_id
            WHERE v.depth < {cap} AND NOT array_contains(v.path, e.parent_id)
        )
        SELECT root_id, id, depth, weight, 1L AS visits, path, path_key FROM visit""",
        roots=roots, links=links, cap=cap, levels=cap + 2,
    )


def _guarded(links: DataFrame, pooled: bool) -> DataFrame:
    """Links with same (child and parent are on cycles that belong together) and enters (the parent is on a cycle). Without
    pooling everybody counts as being on one cycle, so whole paths are kept."""
    if not pooled:
        return links.withColumns({"same": F.lit(True), "enters": F.lit(True)})
    found = checkpoint(cyclic(links))
    if found.isEmpty():
        return links.withColumns({"same": F.lit(False), "enters": F.lit(False)})
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_of"))
    held = links.join(of("child_id"), "child_id", "left").join(of("parent_id"), "parent_id", "left")
    same = F.coalesce(F.col("child_id_of") == F.col("parent_id_of"), F.lit(False))
    return checkpoint(held.select("child_id", "slot", "parent_id", same.alias("same"), F.col("parent_id_of").isNotNull().alias("enters"), F.col("child_id_of").isNotNull().alias("starts")))


def _frontier(roots: DataFrame, links: DataFrame, cap: int, pooled: bool) -> DataFrame:
    """Generation by generation, each written down. Pooled: a person's paths of one length are one row, but on a cycle one
    row for each set of people that paths have met on it. A path that has left a cycle never comes back to it, so nothing
    before it matters to the guard."""
    links = _guarded(links, pooled)
    at = roots.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("visits"), F.array("root_id").alias("path"), F.lit("").alias("path_key"))
    if "starts" in links.columns:
        inner = links.filter("starts").select(F.col("child_id").alias("on_cycle")).distinct()
        at = at.join(inner, F.col("id") == F.col("on_cycle"), "left").withColumn("path", F.when(F.col("on_cycle").isNotNull(), F.col("path"))).drop("on_cycle")
    elif pooled:
        at = at.withColumn("path", F.lit(None).cast(at.schema["path"].dataType))
    found = at = checkpoint(at)
    for depth in range(1, cap + 1):
        up = at.join(links, at["id"] == links["child_id"]).filter(~(F.col("same") & F.coalesce(F.array_contains("path", F.col("parent_id")), F.lit(False))))
        longer = F.array_append("path", F.col("parent_id"))
        path = F.when(F.col("same"), F.array_sort(longer) if pooled else longer).when(F.col("enters"), F.array("parent_id"))
        up = up.select("root_id", F.col("parent_id").alias("id"), F.lit(depth).alias("depth"), (F.col("weight") / 2).alias("weight"), "visits", path.alias("path"), F.concat("path_key", "slot").alias("path_key"))
        if pooled:
            up = up.groupBy("root_id", "id", "depth", "path").agg(F.sum("weight").alias("weight"), F.sum("visits").alias("visits"), F.min("path_key").alias("path_key"))
        at = checkpoint(up)
        if at.isEmpty():
            break
        found = found.unionByName(at)
    return found


def has_cycle(parents_: DataFrame) -> bool:
    """Whether anyone is an own ancestor."""
    return not core(edges(parents_)).isEmpty()


def walk(parents_: DataFrame, roots: DataFrame, cap: int = 8, mode: str = "auto") -> DataFrame:
    """root_id, id, depth, weight, visits, path, path_key of visits from ``roots`` (root_id).

    Modes: recursive (all paths at once), paths (one generation after the other), pooled (the same with paths merged, but
    for what they have met of a cycle that they are on). auto takes recursion if there can't be many visits, by the number
    of roots and generations, else pools. A root that is no person of the tree raises ValueError.
    """
    if cap < 0:
        raise ValueError("the number of generations is below 0")
    known = parents_.select(F.col("id").alias("known"))
    asked = roots.join(known, F.col("root_id") == F.col("known"), "left").agg(F.count("*").alias("n"), F.min(F.when(F.col("known").isNull(), F.struct("root_id"))).alias("lost")).first()
    if asked["lost"]:
        raise ValueError(f"root {asked['lost']['root_id']} is not in the tree")
    if mode == "auto":
        few = cap < 64 and asked["n"] << (cap + 1) <= RECURSION_VISITS
        mode = "recursive" if few else "pooled"
    if mode == "recursive":
        return _recursive(parents_.sparkSession, roots, edges(parents_), cap)
    return _frontier(roots, edges(parents_), cap, mode == "pooled")


def build(parents_: DataFrame, roots: DataFrame, cap: int = 8, mode: str = "auto") -> Pedigree:
    """Nodes, gaps and links of the walk. A missing parent, or one that closes a cycle, is a gap with the weight of its slot."""
    visit = checkpoint(walk(parents_, roots, cap, mode).join(parents_.select("id", "father", "mother"), "id"))
    known = F.col("father").isNotNull() | F.col("mother").isNotNull()
    visit = visit.withColumn("ends", ~known | (F.col("depth") >= cap))

    by_depth = visit.groupBy("root_id", "id", "depth").agg(F.sum("weight").alias("w"), F.sum("visits").alias("v"), F.sum(F.when(F.col("ends"), F.col("weight")).otherwise(0.0)).alias("leaf"), F.bool_or("ends").alias("ends"), F.min("path_key").alias("path_key"))
    nodes = by_depth.groupBy("root_id", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path_key", "depth"))), lambda x: x["depth"]).alias("depths"),
        F.sum("v").alias("times_reached"), F.sum("w").alias("contribution_weight"), F.sum("leaf").alias("leaf_weight"),
        F.bool_or("ends").alias("is_leaf"), F.min("path_key").alias("path_key"),
    )

    slots = F.explode(F.array(F.struct(F.lit("father").alias("slot"), F.col("father").alias("parent_id")), F.struct(F.lit("mother").alias("slot"), F.col("mother").alias("parent_id"))))
    slot = visit.filter(~F.col("ends")).select("root_id", "id", "depth", "weight", "path", "path_key", slots.alias("s")).select("*", "s.slot", "s.parent_id").drop("s")
    slot = slot.withColumn("path_key", F.concat("path_key", F.upper(F.substring("slot", 1, 1))))
    closed = F.coalesce(F.array_contains("path", F.col("parent_id")), F.lit(False))
    gaps = slot.filter(F.col("parent_id").isNull() | closed).groupBy("root_id", "id", "slot").agg(F.min_by("depth", "path_key").alias("depth"), (F.sum("weight") / 2).alias("contribution_weight"), F.min("path_key").alias("path_key"))
    gaps = gaps.select("root_id", F.concat_ws(":", F.lit("gap"), "id", "slot").alias("id"), (F.col("depth") + 1).alias("depth"), "contribution_weight", F.col("id").alias("missing_parent_of"), "slot", "path_key")
    links = slot.filter("parent_id is not null").groupBy("root_id", F.col("id").alias("child_id"), "parent_id", "slot").agg(F.min("path_key").alias("path_key"))
    return Pedigree(nodes, gaps, links)


def closure(parents_: DataFrame) -> DataFrame:
    """id, ancestor_id of all ancestors at any depth; whoever is on a cycle is an own ancestor."""
    return Ancestors(parents_, edges(parents_)).pairs()


def ancestor_counts(parents_: DataFrame) -> DataFrame:
    """id, seq, ancestors (distinct, at any depth) of everybody."""
    counts = Ancestors(parents_, edges(parents_)).counts()
    return parents_.select("id", "seq").join(counts, "id", "left").select("id", "seq", F.coalesce("ancestors", F.lit(0)).cast("long").alias("ancestors"))


def pick_root(parents_: DataFrame) -> DataFrame:
    """One row: the person with most ancestors, the first of the file on ties. An empty tree raises ValueError.

    Everybody's ancestors are counted exactly, as sets of bits, so collapse and cycles cost no more than other trees.
    """
    if parents_.isEmpty():
        raise ValueError("no individuals in the tree")
    return ancestor_counts(parents_).orderBy(F.col("ancestors").desc(), "seq").limit(1).select(F.col("id").alias("root_id"), "ancestors")
