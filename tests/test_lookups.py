"""Look-ups keep rows: repeated ones, nulls, columns of any name; polygons, snapshots and ranks against plain Python."""

import bisect
import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.functions.text import strip_accents
from kinweave.operators import keyed, layers, resolve, spatial
from kinweave.operators.shared import checkpoint
from kinweave.sources import reference

#: Names that operators use, or used, on the way.
CLASHING = ("name", "ord", "w", "s", "e", "n", "key", "rings", "at", "row", "x", "y", "cell", "boxes", "own", "before", "hash", "value", "bucket", "named_key", "rank", "least")


def with_clashes(spark, rows, schema):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], f"{schema}, {extra}").repartition(3)


POINTS = [(1, 1900, 50.0, 10.0, "Germany"), (1, 1900, 50.0, 10.0, "Germany"), (2, 1930, 60.0, 25.0, "Norway"), (3, None, 60.0, 25.0, None), (4, 1880, None, None, "Norway"), (None, None, None, None, None), (None, None, None, None, None), (5, 1700, 200.0, 500.0, "USA"), (6, 1914, float("nan"), 1.0, "x")]
SCHEMA = "id int, year int, lat double, lng double, country string"


def test_rows_and_columns_stay(spark):
    rows = with_clashes(spark, POINTS, SCHEMA)
    borders, polities = reference.borders(spark), reference.polities(spark)
    before = Counter(repr(r) for r in rows.collect())
    for found, new in (
        (resolve.country_at(rows, borders), ("point_country",)), (resolve.polity_at(rows, polities, "lat", "lng"), ("polity",)), (resolve.snapshot_year(rows, polities), ("snapshot_year",)),
        (resolve.contradicts(rows, borders, "country"), ("point_country", "string_known", "contradicts")),
    ):
        assert found.columns == [*rows.columns, *new]
        assert Counter(repr(r) for r in found.select(rows.columns).collect()) == before
    twice = resolve.country_at(resolve.country_at(rows, borders), borders)
    assert twice.columns == [*rows.columns, "point_country"] and twice.count() == len(POINTS)
    polity = {r["id"]: r["polity"] for r in resolve.polity_at(rows, polities, "lat", "lng").collect()}
    assert polity[1]["name"] == "German Empire" and polity[2]["name"] == "Finland" and polity[3] is None and polity[5] is None


def test_distinct_keys_are_looked_up_once(spark):
    rows = with_clashes(spark, POINTS, SCHEMA)
    found = keyed.look_up(rows, {"place": F.col("country")}, lambda at: at.withColumn("size", F.length("place")), "size")
    assert found.count() == len(POINTS) and {(r["country"], r["size"]) for r in found.collect()} == {("Germany", 7), ("Norway", 6), ("USA", 3), ("x", 1), (None, None)}


def ragged(rng, n, x, y, size):
    """A closed ring of n corners at growing angles, so that it doesn't cross itself."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + rng.uniform(0.6, 1) * size * math.cos(a), y + rng.uniform(0.6, 1) * size * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


@pytest.mark.parametrize("most", [64])
def test_cut_polygons_as_whole_ones(spark, most):
    """Rings of hundreds of corners, holes, parts, boxes on the lines of cells: cut to cells, each point is where it was."""
    rng = random.Random(6)
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    shapes = [
        ("ragged", [[ragged(rng, 600, 5, 5, 60)]]), ("holed", [[box(-64, -48, 64, 48), ragged(rng, 40, 0, 0, 30)]]),
        ("parted", [[ragged(rng, 200, -120, 40, 20)], [ragged(rng, 300, 120, -40, 30)], [box(16, 64, 32, 80)]]), ("tiny", [[box(100.001, 10.001, 100.002, 10.002)]]),
    ]
    borders = reference.borders_from_rings(spark, shapes)
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(500)] + [(rng.choice([-64, -48, 0, 16, 32, 64]), rng.choice([-48, -16, 0, 32, 48, 64, 80])) for _ in range(60)]
    points += [c for _, polygons in shapes for rings in polygons for ring in rings for c in rng.sample(ring, min(9, len(ring)))] + [(100.0015, 10.0015), (-300.0, 0.0), (None, 1.0)]
    rows = spark.createDataFrame([(None if x is None else float(x), float(y)) for x, y in points], "lng double, lat double")
    found = checkpoint(spatial.first_at(rows, borders, F.col("lng"), F.col("lat"), "at", most).select("lng", "lat", F.col("at.name").alias("found")))
    assert found.count() == len(points)
    whole = found.distinct().join(F.broadcast(borders.select("ord", "name", "rings")), resolve.in_rings(F.col("lng"), F.col("lat"), F.col("rings")), "left")
    want = whole.groupBy("lng", "lat", "found").agg(F.min_by("name", "ord").alias("want")).collect()
    assert [r for r in want if r["found"] != r["want"]] == [] and sum(r["want"] is not None for r in want) > 100


def test_as_of_as_by_bisection(spark):
    rng = random.Random(2)
    for snapshots in ([1925, 1880, 1914], [5], sorted(rng.sample(range(-3000, 60_000), 3000))):
        years = [rng.randrange(-4000, 70_000) for _ in range(800)] + snapshots[:50] + [None]
        rows = spark.createDataFrame([(y,) for y in years], "year int")
        held = spark.createDataFrame([(s,) for s in snapshots], "snapshot int")
        order = sorted(snapshots)
        want = Counter((y, None if y is None else order[max(bisect.bisect_right(order, y) - 1, 0)]) for y in years)
        assert Counter(map(tuple, resolve.as_of(rows, held, "year", "found").collect())) == want


def test_ranks_of_a_crowded_group(spark):
    """Most rows in one group: numbered as in order, with the group spread over tasks."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))).alias("of"), (F.col("id") * 7919 % 500).alias("weight"), F.lit(1).alias("part"), F.lit(2).alias("place"))
    found = keyed.ranked(rows, [F.col("of")], [(F.col("weight"), True), (F.col("id"), False)], "rank", 8)
    assert found.columns == [*rows.columns, "rank"]
    groups = {}
    for r in found.collect():
        groups.setdefault(r["of"], []).append((-r["weight"], r["id"], r["rank"]))
    assert sum(map(len, groups.values())) == 20_000 and all([x[2] for x in sorted(g)] == list(range(len(g))) for g in groups.values())
    assert keyed.ranked(rows, [], [(F.col("id"), False)], "n", 8).filter("n <> id").isEmpty()


def test_people_in_one_spot(spark):
    people = spark.range(3000).select(F.lit("r").alias("root_id"), F.col("id").cast("string").alias("id"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"), (1 / (F.col("id") + 1)).alias("contribution_weight"), F.lpad(F.col("id").cast("string"), 6, "0").alias("path_key"), F.lit("own").alias("rank"))
    found = layers.spread_overlaps(people)
    assert found.columns == people.columns and found.select("lat", "lng").distinct().count() == 3000
    assert found.filter("lat = 10 and lng = 20").first()["id"] == "0" and found.filter("rank = 'own'").count() == 3000


def test_all_letters_that_decompose(spark):
    """Every letter of Unicode that has a canonical decomposition, alone and within a word."""
    letters = [chr(c) for c in range(0xC0, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFD", chr(c)) != chr(c)]
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not 0x300 <= ord(c) <= 0x36F)
    rows = spark.createDataFrame([(x,) for x in letters] + [(f"a{x}b{letters[i - 1]}",) for i, x in enumerate(letters)] + [("plain",), ("",), (None,)], "x string")
    wrong = [r for r in rows.select("x", strip_accents("x").alias("found")).collect() if r["found"] != (None if r["x"] is None else bare(r["x"]))]
    assert len(letters) > 13_000 and wrong == []
