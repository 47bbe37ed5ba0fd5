"""Cycles of a tree, and the ancestors of everybody as sets of bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.keyed import ranked
from kinweave.operators.shared import checkpoint

#: Rounds between two checkpoints where each round only makes a table smaller.
ROUNDS = 4
#: Ancestors of a word of bits.
WORD = 64


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _only(links: DataFrame, column: str, of: DataFrame, other: str) -> DataFrame:
    """Links whose ``column`` is among the ``other`` column of ``of``."""
    return links.join(of.select(F.col(other).alias("among")).distinct(), F.col(column) == F.col("among"), "left_semi")


def core(links: DataFrame) -> DataFrame:
    """The links (child_id, parent_id) that are left when people without known parents or without children are taken away
    until none is: all cycles, and what connects them. Links of a tree without cycles are none."""
    at = checkpoint(links.select("child_id", "parent_id").distinct())
    n = at.count()
    while n:
        for _ in range(ROUNDS):
            at = _only(_only(at, "parent_id", at, "child_id"), "child_id", at, "parent_id")
        at = checkpoint(at)
        left = at.count()
        if left == n:
            break
        n = left
    return at


def _spread(links: DataFrame, start: DataFrame) -> DataFrame:
    """id, label: each person's least label when labels (id, label of ``start``) are handed from children to parents."""
    at = start
    while True:
        handed = links.join(at, F.col("child_id") == F.col("id")).select(F.col("parent_id").alias("id"), "label")
        new = checkpoint(at.unionByName(handed).groupBy("id").agg(F.min("label").alias("label")))
        if new.join(at.select("id", F.col("label").alias("old")), "id", "left").filter("old is null or label <> old").isEmpty():
            return new
        at = new


def cyclic(links: DataFrame) -> DataFrame:
    """id, component: everybody who is an own ancestor, and the least id of those who are ancestors of each other.

    Strongly connected components by reach: of what is left of ``core``, everybody gets the least id that reaches up to
    them; whoever of a label reaches up to the person of that id in turn is in one component with that person. Those are
    taken away, and what is left goes through it again.
    """
    left, found = core(links), []
    while not left.isEmpty():
        people = left.select(F.col("child_id").alias("id")).union(left.select(F.col("parent_id"))).distinct()
        label = _spread(left, people.withColumn("label", F.col("id")))
        at = lambda end: label.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        inner = checkpoint(left.join(at("child_id"), "child_id").join(at("parent_id"), "parent_id").filter("child_id_label = parent_id_label"))
        back = inner.select(F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id"))
        heads = label.filter("id = label")
        own = checkpoint(_spread(back, heads).select("id", F.col("label").alias("component")))
        looped = inner.join(own.select(F.col("id").alias("child_id"), F.col("component").alias("c1")), "child_id").join(own.select(F.col("id").alias("parent_id"), F.col("component").alias("c2")), "parent_id").filter("c1 = c2")
        found.append(checkpoint(looped.select(F.col("child_id").alias("id"), F.col("c1").alias("component")).distinct()))
        gone = own.select("id")
        left = left.join(gone, F.col("child_id") == F.col("id"), "left_anti").join(gone, F.col("parent_id") == F.col("id"), "left_anti")
        left = core(left)
    return _union(found) if found else left.select(F.col("child_id").alias("id"), F.col("child_id").alias("component"))


def condensed(links: DataFrame, components: DataFrame) -> DataFrame:
    """Links between components (a person on no cycle is one): child_node, parent_node, child_id, parent_id."""
    node = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_of"))
    out = links.join(node("child_id"), "child_id", "left").join(node("parent_id"), "parent_id", "left")
    return out.select(F.coalesce("child_id_of", "child_id").alias("child_node"), F.coalesce("parent_id_of", "parent_id").alias("parent_node"), "child_id", "parent_id")


def levels(links: DataFrame) -> DataFrame | None:
    """node, level (from 1) of everybody with a parent: the greatest number of steps upwards. None if there is a cycle."""
    at = checkpoint(links.select("child_node", "parent_node").distinct())
    n, level, found = at.count(), 0, []
    while n:
        for _ in range(ROUNDS):
            level += 1
            found.append(at.select(F.col("child_node").alias("node"), F.lit(level).alias("level")).distinct())
            at = _only(at, "parent_node", at, "child_node")
        at = checkpoint(at)
        left = at.count()
        if left == n:
            return None
        n = left
    if not found:
        return at.select(F.col("child_node").alias("node"), F.lit(1).alias("level"))
    return checkpoint(_union(found).groupBy("node").agg(F.max("level").alias("level")))


class Ancestors:
    """bits: id, block, bits, a row for each person and block of ``WORD`` ancestors that has one of theirs; number: id, number
    of everybody who is a parent; components: those who are their own ancestors.

    Parents are numbered level by level, then in the order of the file, so that relatives share blocks. Sets are united
    level by level: a person's set is the union of the parents and of their sets, a word of 64 bits at once. A level reads
    the sets of just the levels that its parents are in. People on one cycle have one set.
    """

    def __init__(self, parents: DataFrame, links: DataFrame):
        links = checkpoint(links.select("child_id", "parent_id").distinct())
        own = links.select(F.col("child_id").alias("child_node"), F.col("parent_id").alias("parent_node"), "child_id", "parent_id")
        level = levels(own)
        self.components = None
        if level is None:
            self.components = checkpoint(cyclic(links))
            own = checkpoint(condensed(links, self.components))
            level = levels(own.filter("child_node <> parent_node"))
        known = own.select(F.col("parent_id").alias("id"), F.col("parent_node").alias("node")).distinct()
        known = known.join(level, "node", "left").join(parents.select("id", "seq"), "id")
        order = [(F.coalesce("level", F.lit(0)), False), (F.col("seq"), False), (F.col("id"), False)]
        self.number = checkpoint(ranked(known, [], order, "number").select("id", "number"))
        self.bits = self._united(own, level)

    def _united(self, own: DataFrame, level: DataFrame) -> DataFrame:
        at = own.join(self.number, F.col("parent_id") == F.col("id")).join(level.select(F.col("node").alias("child_node"), F.col("level").alias("child_level")), "child_node", "left")
        bit = F.expr(f"shiftleft(1L, cast(number % {WORD} as int))")
        own_bits = checkpoint(at.select(F.col("child_node").alias("node"), F.coalesce("child_level", F.lit(0)).alias("level"), F.floor(F.col("number") / WORD).alias("block"), bit.alias("bits")).groupBy("node", "level", "block").agg(F.bit_or("bits").alias("bits")))
        up = own.filter("child_node <> parent_node").select("child_node", "parent_node").distinct()
        up = up.join(level.select(F.col("node").alias("child_node"), F.col("level").alias("child_level")), "child_node")
        up = checkpoint(up.join(level.select(F.col("node").alias("parent_node"), F.col("level").alias("parent_level")), "parent_node", "left").withColumn("parent_level", F.coalesce("parent_level", F.lit(0))))
        ties: dict[int, list[int]] = {}
        for r in up.select("child_level", "parent_level").distinct().collect():
            ties.setdefault(r["child_level"], []).append(r["parent_level"])
        sets: dict[int, DataFrame] = {}
        every = sorted({r["level"] for r in own_bits.select("level").distinct().collect()})
        rows = own_bits.filter("false").select("node", "block", "bits", "level")
        for at_once in (every[i : i + ROUNDS] for i in range(0, len(every), ROUNDS)):
            for n in at_once:
                parts = [own_bits.filter(F.col("level") == n).select("node", "block", "bits")]
                for m in sorted(m for m in ties.get(n, []) if m in sets):
                    link = up.filter((F.col("child_level") == n) & (F.col("parent_level") == m)).select("child_node", "parent_node")
                    parts.append(sets[m].join(link, F.col("node") == F.col("parent_node")).select(F.col("child_node").alias("node"), "block", "bits"))
                sets[n] = _union(parts).groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
            done = checkpoint(_union([sets[n].withColumn("level", F.lit(n)) for n in at_once]))
            sets |= {n: done.filter(F.col("level") == n).drop("level") for n in at_once}
            rows = rows.unionByName(done)
        rows = rows.drop("level")
        if self.components is None:
            return rows.withColumnRenamed("node", "id")
        members = self.components.select("id", F.col("component").alias("of"))
        return rows.join(members, F.col("node") == F.col("of"), "left").select(F.coalesce("id", "node").alias("id"), "block", "bits")

    def counts(self) -> DataFrame:
        """id, ancestors of everybody who has one."""
        return self.bits.groupBy("id").agg(F.sum(F.bit_count("bits")).cast("long").alias("ancestors"))

    def pairs(self) -> DataFrame:
        """id, ancestor_id."""
        places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: _bit(F.col("bits"), i))
        held = self.bits.select("id", F.explode(F.transform(places, lambda i: F.col("block") * WORD + i)).alias("at"))
        return held.join(self.number.select(F.col("id").alias("ancestor_id"), "number"), F.col("at") == F.col("number")).select("id", "ancestor_id")


def _bit(bits: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, place).bitwiseAND(1) == 1
