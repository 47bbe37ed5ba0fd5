"""A family tree worked out from the customer table, so that the engine has input at every scale.

Person k's parents have greater numbers, so there is no cycle; siblings share parents, some parents are unknown.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = (
    "Albany, Oregon, USA", "Christiania, Norway", "Åbo, Finland", "Lemberg, Austria", "Köln, Germany", "Hinterland", "Pressburg, Hungary",
    "Stockholm, Sweden", None, "", "Turku", "Richmond Virginia USA", "Schweiz", "Edom (Idumaea)", "Oslo, Norge", "Newark, Renfrewshire, Scotland",
    "Scot.", "U.S.A.", "Danzig, Prussia",
)
DATES = ("12 JAN 1850", "ABT 1918", "BET 1840 AND 1850", "1 JAN 99", "500 BC", "é1850", "", "bef 1700", "FROM 1701 TO 1710")
DATES += tuple(a + b + c for a, b, c in product(("", "ABT ", "bef ", "aft", "(CAL) ", "to_"), ("", "3 ", "12 MAR ", "Ä", "x_"), ("7", "85", "850", "1850", "18500", "1850/51", "0900 BET 12")))
COORDS = ("45.5236", "-122.675", "N45.5", "W122.5", "s 12", "W-3.5", "E", "12,5", "", "n90")
COORDS += tuple(a + b + c for a, b, c in product(("", "N", "s", "W ", "e-", "X", "nn", "-"), ("0", "45", "45.5", "-45.25", "90.0001", "180.5", "1e3", ".5", "5."), ("", "x", " 1")))
NAMES = ("Test /Subject/", "Anna", "/Only/", "A /B/ C /D/", "", "  Jo  /  /")
NAMES += tuple(a + b.format(c) for a, b, c in product(("", "Anna", " Jo ", "J.-R. K"), ("/{}/", "/{}", "{}/", " /{}/ jr", "//{}/", "/ {} /", "{}"), ("", "Smith", " O Hara ", "de la Cruz", "Öz")))

#: Polygons with a hole, of several parts, and with slanted edges, for tests: name, polygons of rings of (longitude, latitude).
SHAPES = (
    ("Slanted", (((((30.05, 46.03), (44.97, 50.01), (33.33, 70.07), (30.05, 46.03))),),)),
    ("Holed", ((((0, 46), (20, 46), (20, 70), (0, 70), (0, 46)), ((5, 50), (12, 50), (12, 60), (5, 60), (5, 50))),)),
    ("Parted", ((((7, 52), (10, 52), (10, 58), (7, 58), (7, 52)),), (((15, 40), (26, 40), (26, 48), (15, 48), (15, 40)),))),
)

EXPRESSIONS = {
    "father": "CASE WHEN k % 17 = 13 THEN NULL WHEN 2 * k + 1 < n THEN 2 * k + 1 END",
    "mother": "CASE WHEN k % 19 = 14 THEN NULL WHEN k % 4 = 2 AND 2 * k + 3 < n THEN 2 * k + 3 WHEN k % 4 <> 2 AND 2 * k + 2 < n THEN 2 * k + 2 END",
    "year": "CASE WHEN k % 23 <> 5 THEN CAST(1850 + k % 150 AS INT) END",
    "lat": "CASE WHEN k % 10 = 0 THEN 45 + CAST(k % 300 AS DOUBLE) / 10 WHEN k % 10 = 5 THEN CAST(k * 37 % 1800 AS DOUBLE) / 10 - 90 END",
    "lng": "CASE WHEN k % 10 = 0 THEN CAST(k % 500 AS DOUBLE) / 10 WHEN k % 10 = 5 THEN CAST(k * 53 % 3600 AS DOUBLE) / 10 - 180 END",
    "given": "CASE WHEN k % 11 <> 3 THEN concat('Given', CAST(k AS STRING)) END",
    "surname": "CASE WHEN k % 13 = 4 THEN '' ELSE concat('Name', CAST(k % 97 AS STRING)) END",
}


def pick(values: tuple, number: str = "k"):
    """The value at a number modulo the length."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(number) % len(values)).cast("int") + 1)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, seq, father, mother, place, year, lat, lng, given, surname of every customer."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    rows = customers.withColumn("n", F.lit(customers.count()).cast("long"))
    rows = rows.select("k", F.col("k").alias("id"), F.col("k").alias("seq"), pick(PLACES).alias("place"), *[F.expr(e).alias(c) for c, e in EXPRESSIONS.items()])
    return rows


def cyclic(rows: DataFrame) -> DataFrame:
    """The same tree, but person 1's father is person 0."""
    return rows.withColumn("father", F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(F.col("father")))


def looped(rows: DataFrame) -> DataFrame:
    """The same tree with a cycle of three people here and there: the father of every 256th person is that one's grandchild."""
    return rows.withColumn("father", F.when(F.col("k") % 256 == 7, F.floor(F.col("k") / 4)).otherwise(F.col("father")))


def coasts(rows: DataFrame) -> DataFrame:
    """Three countries (ord, name, key, rings) south of ragged coasts, of which each customer is a corner of one: rings of a third of all customers."""
    x = F.col("j").cast("double") / F.col("m") * 350 - 175
    y = (F.col("k") * 7919 % 997).cast("double") / 997 * 30 + F.col("ord") * 25 - 40
    corner = lambda lng, lat: F.struct(F.lit(lng).cast("double").alias("lng"), F.lit(lat).cast("double").alias("lat"))
    at = rows.select("k", (F.col("k") % 3).cast("int").alias("ord"), F.floor(F.col("k") / 3).alias("j"), F.lit(rows.count()).alias("n")).withColumn("m", F.floor(F.col("n") / 3) + 1)
    tops = at.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct(x.alias("lng"), y.alias("lat")))).alias("top"))
    ring = F.concat(F.array(corner(-175, -85)), F.col("top"), F.array(corner(175, -85), corner(-175, -85)))
    name = F.concat(F.lit("Coast "), F.col("ord").cast("string"))
    return tops.select("ord", name.alias("name"), F.lower(name).alias("key"), F.array(F.array(ring)).alias("rings"))


def records(rows: DataFrame, trees: int = 25) -> DataFrame:
    """The people as stretches of files (tree, record, text), dealt over ``trees`` trees; a family record for each person with a parent."""
    tag = lambda level, name, value: F.concat(F.lit(f"{level} {name} "), value)
    ref = lambda kind, number: F.concat(F.lit(f"@{kind}"), F.col(number).cast("string"), F.lit("@"))
    some = F.col("father").isNotNull() | F.col("mother").isNotNull()
    person = F.array(
        F.concat(F.lit("0 "), ref("I", "k"), F.lit(" INDI")),
        tag(1, "NAME", F.concat(F.coalesce("given", F.lit("")), F.lit(" /"), "surname", F.lit("/"))),
        F.when(F.col("k") % 3 < 2, tag(1, "SEX", F.when(F.col("k") % 3 == 0, "M").otherwise("F"))),
        F.lit("1 BIRT"), tag(2, "DATE", F.col("year").cast("string")), tag(2, "PLAC", F.col("place")), F.when(F.col("lat").isNotNull(), "3 MAP"),
        tag(4, "LATI", F.col("lat").cast("string")), tag(4, "LONG", F.col("lng").cast("string")),
        F.when(some, tag(1, "FAMC", ref("F", "k"))),
    )
    family = F.when(some, F.array(
        F.concat(F.lit("0 "), ref("F", "k"), F.lit(" FAM")), tag(1, "HUSB", ref("I", "father")), tag(1, "WIFE", ref("I", "mother")), tag(1, "CHIL", ref("I", "k")),
    )).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.concat(person, family), lambda x: x.isNotNull())
    return rows.select((F.col("k") % trees).cast("string").alias("tree"), F.col("k").alias("record"), F.array_join(lines, "\n").alias("text"))


def files(rows: DataFrame, trees: int = 25, per_file: int = 100_000) -> DataFrame:
    """The same as whole files (tree, text): ``trees`` of them, or more so that none has over ``per_file`` people."""
    made = records(rows, max(trees, -(-rows.count() // per_file)))
    texts = made.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("record", "text"))).alias("all"))
    return texts.select("tree", F.concat(F.lit("0 HEAD\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n"), F.lit("\n0 TRLR\n")).alias("text"))
