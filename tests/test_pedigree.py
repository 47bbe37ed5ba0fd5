"""The walk against a plain depth-first one, in all modes."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.operators import closure
from kinweave.operators import pedigree as P

SCHEMA = "id string, seq long, father string, mother string"


def brute(parents, root, cap):
    """nodes {id: [weight, visits, leaf, depths]}, gaps {(id, slot): [depth, weight]}, by recursion over all paths."""
    nodes, gaps = {}, {}

    def visit(who, depth, weight, path):
        node = nodes.setdefault(who, [0.0, 0, 0.0, []])
        node[0] += weight
        node[1] += 1
        node[3] += [depth] * (depth not in node[3])
        own = parents.get(who, (None, None))
        if depth >= cap or own == (None, None):
            node[2] += weight
            return
        for slot, up in zip(("father", "mother"), own, strict=True):
            if up is None or up in path:
                gaps.setdefault((who, slot), [depth + 1, 0.0])[1] += weight / 2
            else:
                visit(up, depth + 1, weight / 2, {*path, up})

    visit(root, 0, 1.0, {root})
    return nodes, gaps


def found(spark, parents, root, cap, mode):
    people = sorted({*parents, *(p for own in parents.values() for p in own if p), root})
    table = spark.createDataFrame([(p, i, *parents.get(p, (None, None))) for i, p in enumerate(people)], SCHEMA)
    walked = P.build(table, spark.createDataFrame([(root,)], "root_id string"), cap, mode)
    nodes = {r["id"]: [r["contribution_weight"], r["times_reached"], r["leaf_weight"], r["depths"]] for r in walked.nodes.collect()}
    gaps = {(r["missing_parent_of"], r["slot"]): [r["depth"], r["contribution_weight"]] for r in walked.gaps.collect()}
    return nodes, gaps


COLLAPSE = {"I1": ("A", "B"), "A": ("X", "C"), "B": ("D", "E"), "D": ("X", "G"), "X": ("Y", "Z")}
CYCLE = {"I1": ("P", "Q"), "P": ("I1", "R")}


@pytest.mark.parametrize("mode", ["recursive", "paths", "pooled"])
def test_collapse(spark, mode):
    nodes, gaps = found(spark, COLLAPSE, "I1", 3, mode)
    assert nodes["X"] == [0.375, 2, 0.125, [2, 3]] and sum(n[2] for n in nodes.values()) == 1.0 and not gaps
    assert (nodes, gaps) == brute(COLLAPSE, "I1", 3)


@pytest.mark.parametrize("mode", ["recursive", "paths", "pooled"])
def test_cycle(spark, mode):
    nodes, gaps = found(spark, CYCLE, "I1", 8, mode)
    assert gaps == {("P", "father"): [2, 0.25]} and nodes["Q"][2] == 0.5 and nodes["R"][2] == 0.25


def test_caps_and_errors(spark):
    assert found(spark, COLLAPSE, "I1", 0, "recursive") == brute(COLLAPSE, "I1", 0)
    with pytest.raises(ValueError):
        P.walk(spark.createDataFrame([("a", 0, None, None)], SCHEMA), spark.createDataFrame([("b",)], "root_id string"))
    with pytest.raises(ValueError):
        P.pick_root(spark.createDataFrame([], SCHEMA))


def test_walk_from_many_roots(spark):
    """Over a million visits: more than Spark's recursion bears; what is reached and what is missing make up 1 for each root."""
    n = 120_000
    people = spark.range(n).selectExpr("id", "id AS seq", "CASE WHEN 2 * id + 1 < {n} THEN 2 * id + 1 END AS father".format(n=n), "CASE WHEN id % 7 > 0 AND 2 * id + 2 < {n} THEN 2 * id + 2 END AS mother".format(n=n))
    walked = P.build(people, people.selectExpr("id AS root_id"), 16)
    own = walked.nodes.selectExpr("root_id", "leaf_weight AS w", "times_reached AS n").unionByName(walked.gaps.selectExpr("root_id", "contribution_weight AS w", "0L AS n"))
    sums = own.groupBy("root_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    assert sums.filter("w = 1").count() == n and sums.agg(F.sum("n")).first()[0] > 1_000_000


@pytest.mark.parametrize("seed", [1])
def test_root_of_most_ancestors(spark, seed):
    """Sets of bits as by walking from everybody, ties to the first of the file; with cycles too."""
    rng = random.Random(seed)
    own = {f"p{i:03}": tuple(f"p{rng.randrange(i + 20, min(100, i + 60)):03}" if rng.random() < 0.8 and i < 75 else None for _ in range(2)) for i in range(100)}
    for extra in ({}, {"p099": ("p050", "p003"), "p040": ("p040", "p041"), "p020": ("p001", "p070")}):
        tree = own | extra
        table = spark.createDataFrame([(k, i, *v) for i, (k, v) in enumerate(tree.items())], SCHEMA)
        counts = {}
        for who in tree:
            seen, queue = set(), [who]
            while queue:
                new = {p for p in tree[queue.pop()] if p} - seen
                seen |= new
                queue += new
            counts[who] = len(seen)
        best = max(counts, key=lambda k: (counts[k], -list(tree).index(k)))
        if extra:
            found = P.pick_root(table).first()
            assert (found["root_id"], found["ancestors"]) == (best, counts[best])
        sets = closure.Ancestors(table, P.edges(table))
        assert {r["id"]: r["ancestors"] for r in sets.counts().collect()} == {k: n for k, n in counts.items() if n}
        pairs = sets.pairs().collect()
        assert len(set(map(tuple, pairs))) == len(pairs) == sum(counts.values())


def test_cycles_are_seen(spark):
    table = lambda own: spark.createDataFrame([(k, i, *v) for i, (k, v) in enumerate(own.items())], SCHEMA)
    assert P.has_cycle(table(CYCLE)) and not P.has_cycle(table(COLLAPSE))


@given(st.integers(0, 10**6))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    names = [f"p{i:02}" for i in range(12)]
    parents = {n: tuple(rng.choice([*names[i + 1 :], None]) if names[i + 1 :] else None for _ in range(2)) for i, n in enumerate(names)}
    for mode in ("recursive", "pooled"):
        assert found(spark, parents, "p00", 6, mode) == brute(parents, "p00", 6)
    back = parents | {"p05": ("p00", parents["p05"][1]), "p09": ("p06", "p09")}
    for mode in ("recursive", "pooled"):
        assert found(spark, back, "p00", 6, mode) == brute(back, "p00", 6)


@pytest.mark.parametrize("seed", range(3))
def test_walk_over_cycles_from_everybody(spark, seed):
    """Any graph, cycles within cycles: pooled as by recursion over all paths, from each person."""
    rng = random.Random(seed)
    names = [f"p{i}" for i in range(9)]
    parents = {n: tuple(rng.choice([*names, None, None]) for _ in range(2)) for n in names}
    table = spark.createDataFrame([(n, i, *parents[n]) for i, n in enumerate(names)], SCHEMA)
    walked = P.build(table, table.selectExpr("id AS root_id"), 7, "pooled")
    nodes, gaps = walked.nodes.collect(), walked.gaps.collect()
    for root in names:
        own = {r["id"]: [r["contribution_weight"], r["times_reached"], r["leaf_weight"], r["depths"]] for r in nodes if r["root_id"] == root}
        lost = {(r["missing_parent_of"], r["slot"]): [r["depth"], r["contribution_weight"]] for r in gaps if r["root_id"] == root}
        assert (own, lost) == brute(parents, root, 7)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = {(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randint(10, 24))}
    reach = {a: {b for x, b in links if x == a} for a in range(14)}
    for _ in range(14):
        reach = {a: r | {y for x in r for y in reach[x]} for a, r in reach.items()}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in range(14) if a in reach[a]}
    found = closure.cyclic(spark.createDataFrame(sorted(links), "child_id long, parent_id long"))
    assert {r["id"]: r["component"] for r in found.collect()} == want


def test_people_off_cycles_are_pooled(spark):
    """A cycle somewhere doesn't keep anybody's paths apart but those on it."""
    own = {f"q{i:02}": (f"q{i + 1:02}", f"q{i + 1:02}") for i in range(20)} | {"a": ("b", None), "b": ("a", None)}
    people = [*own, "q20"]
    table = spark.createDataFrame([(p, i, *own.get(p, (None, None))) for i, p in enumerate(people)], SCHEMA)
    walked = P.walk(table, table.selectExpr("id AS root_id"), 20, "pooled")
    assert walked.count() == 21 * 22 // 2 + 4 and walked.filter("root_id = 'q00' and id = 'q20'").first()["visits"] == 2**20
