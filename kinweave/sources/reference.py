"""Reference tables: small samples as fixed values, and loaders of full-size ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave import schemas
from kinweave.functions.text import norm_border, norm_place

# Sample gazetteer (names, latitude, longitude, country code, modern country).
GAZETTEER = (
    (("albany",), 44.64, -123.11, "US", "United States"),
    (("portland",), 45.52, -122.68, "US", "United States"),
    (("boise",), 43.62, -116.21, "US", "United States"),
    (("salt lake city",), 40.76, -111.89, "US", "United States"),
    (("oslo", "christiania", "kristiania"), 59.91, 10.75, "NO", "Norway"),
    (("turku", "åbo", "abo"), 60.45, 22.27, "FI", "Finland"),
    (("lviv", "lemberg", "lwów", "lwow"), 49.84, 24.03, "UA", "Ukraine"),
    (("köln", "koln", "cologne"), 50.94, 6.96, "DE", "Germany"),
    (("bergen",), 60.39, 5.32, "NO", "Norway"),
    (("stockholm",), 59.33, 18.07, "SE", "Sweden"),
    (("helsinki", "helsingfors"), 60.17, 24.94, "FI", "Finland"),
    (("bratislava", "pressburg", "pozsony"), 48.15, 17.11, "SK", "Slovakia"),
)

# Sample polities (region, border precision, west, south, east, north) and which hold in a snapshot, in order.
POLITIES = {
    "German Empire": ("Germanic", 2, 6, 47, 15, 55),
    "Austria-Hungary": ("Central Europe", 2, 9, 44, 27, 51),
    "Norway": ("Nordic", 2, 4, 58, 13, 72),
    "Sweden": ("Nordic", 2, 11, 55, 24, 69),
    "Russian Empire": ("Eastern Europe", 2, 20, 54, 60, 71),
    "Germany": ("Germanic", 2, 6, 47, 15, 55),
    "Czechoslovakia": ("Central Europe", 2, 12, 47, 23, 51),
    "Finland": ("Nordic", 2, 19, 59, 32, 71),
}
SNAPSHOTS = {
    1880: ("German Empire", "Austria-Hungary", "Norway", "Sweden", "Russian Empire"),
    1914: ("German Empire", "Austria-Hungary", "Norway", "Sweden", "Russian Empire"),
    1925: ("Germany", "Czechoslovakia", "Norway", "Sweden", "Finland"),
}

# Ancient places (name, words, west, south, east, north) and the slack in degrees.
ANCIENT = (
    ("Edom / Idumaea", "edom|idumaea|idumea", 33, 28, 39, 33),
    ("Judaea", "judaea|judea", 33, 30, 37, 33),
    ("Mesopotamia", "mesopotamia", 38, 29, 49, 38),
    ("Assyria", "assyria", 39, 33, 46, 38),
    ("Babylonia", "babylonia", 43, 30, 47, 34),
    ("Phoenicia", "phoenicia", 34, 32, 37, 35),
)
ANCIENT_MARGIN = 10

# Names that fold into one country.
CANONICAL = {
    "United States": ("united states", "united states of america", "usa", "us", "u s a", "america", "virginia", "virginia usa", "va"),
    "Switzerland": ("switzerland", "schweiz", "suisse", "svizzera"),
    "England": ("england", "eng"),
    "Scotland": ("scotland", "scot"),
    "Wales": ("wales",),
    "Germany": ("germany", "deutschland", "german empire", "deutsches reich"),
    "United Kingdom": ("united kingdom", "uk"),
    "Ireland": ("ireland",),
}
US_SUFFIX = "(^| )(usa|us|united states|united states of america)$"

# Country by name, for the simple resolver, and region by country.
STUB = {
    "prussia": "Germany", "bavaria": "Germany", "saxony": "Germany", "königsberg": "Russia", "koenigsberg": "Russia",
    "danzig": "Poland", "breslau": "Poland", "christiania": "Norway", "kristiania": "Norway", "åbo": "Finland",
    "abo": "Finland", "bohemia": "Czechia", "moravia": "Czechia", "lemberg": "Ukraine", "lwów": "Ukraine", "lwow": "Ukraine",
    "pressburg": "Slovakia", "constantinople": "Turkey", "usa": "United States", "united states": "United States",
    "norway": "Norway", "sweden": "Sweden", "finland": "Finland", "denmark": "Denmark", "germany": "Germany",
    "poland": "Poland", "ukraine": "Ukraine", "england": "United Kingdom", "scotland": "United Kingdom", "ireland": "Ireland",
}
CULTURE = {"Norway": "Nordic", "Sweden": "Nordic", "Finland": "Nordic", "Denmark": "Nordic", "United Kingdom": "British Isles", "Ireland": "British Isles"}

# Comparison keys of today's countries, and pairs that share territory.
MODERN = {
    "scotland": "united kingdom", "england": "united kingdom", "wales": "united kingdom", "northern ireland": "united kingdom",
    "great britain": "united kingdom", "britain": "united kingdom", "united kingdom": "united kingdom", "uk": "united kingdom",
    "united states": "united states", "united states of america": "united states", "usa": "united states", "us": "united states",
}
COMPATIBLE = (("united kingdom", "ireland"),)

#: Hand-made coarse boxes, for use until real borders are loaded with ``borders_from_geojson``; not real borders.
COARSE_BORDERS = (
    ("India", 68, 8, 97, 35), ("United Kingdom", -8, 50, 2, 59), ("Ireland", -10, 51, -6, 55), ("South Africa", 17, -35, 33, -22),
    ("United States of America", -125, 25, -67, 49), ("Norway", 5, 58, 12, 71), ("Germany", 6, 47, 15, 55), ("Finland", 21, 60, 31, 70),
)


def gazetteer(spark: SparkSession, entries=GAZETTEER) -> DataFrame:
    return spark.createDataFrame([(i, list(n), float(a), float(b), c, m) for i, (n, a, b, c, m) in enumerate(entries)], schemas.GAZETTEER)


def gazetteer_index(table: DataFrame) -> DataFrame:
    """One row for each normalised name; a later entry replaces an earlier one of the same name."""
    named = table.select(F.explode("names").alias("name"), F.struct("ord", "lat", "lng", "country_code", "modern_country").alias("entry")).select(norm_place("name").alias("token"), "entry")
    return named.groupBy("token").agg(F.max_by("entry", "entry.ord").alias("entry"))


def gazetteer_from_geonames(spark: SparkSession, places: str, countries: str) -> DataFrame:
    """A gazetteer of any size from a GeoNames dump: the tab-separated table of places and that of countries (countryInfo).

    Of places of one name the most populous counts, then the one of the smallest id. Places whose country isn't in the
    second table are left out, as they would resolve to nothing.
    """
    field = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    named = spark.read.text(countries).filter(~F.col("value").startswith("#")).select(field(0).alias("country_code"), field(4).alias("modern_country"))
    others = F.filter(F.split(F.coalesce(field(3), F.lit("")), ","), lambda x: x != "")
    rank = F.coalesce(field(14).try_cast("long"), F.lit(0)) * (1 << 24) + ((1 << 24) - 1 - field(0).try_cast("long"))
    rows = spark.read.text(places).select(
        rank.alias("ord"), F.array_distinct(F.concat(F.array(field(1), field(2)), others)).alias("names"),
        field(4).try_cast("double").alias("lat"), field(5).try_cast("double").alias("lng"), field(8).alias("country_code"),
    ).filter("lat is not null and lng is not null")
    return rows.join(named, "country_code").select("ord", "names", "lat", "lng", "country_code", "modern_country")


def polities(spark: SparkSession, snapshots=None, known=None) -> DataFrame:
    """Polities with the years [begin, end) in which their snapshot holds; the first one reaches back without end."""
    snapshots, known = snapshots or SNAPSHOTS, known or POLITIES
    rows = [(y, i, n, n, *known[n][:2], *map(float, known[n][2:])) for y, names in snapshots.items() for i, n in enumerate(names)]
    return with_validity(spark.createDataFrame(rows, schemas.POLITIES))


def with_validity(table: DataFrame) -> DataFrame:
    """Adds begin and end from the order of the different snapshot years; the first one reaches back without end."""
    order = Window.orderBy("snapshot_year")
    earlier = F.lag("snapshot_year").over(order)
    spans = table.select("snapshot_year").distinct().select("snapshot_year", F.when(earlier.isNotNull(), F.col("snapshot_year")).alias("begin"), F.lead("snapshot_year").over(order).alias("end"))
    return table.join(spans, "snapshot_year")


def ancient(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, p, *map(float, box)) for i, (n, p, *box) in enumerate(ANCIENT)], schemas.ANCIENT)


def _with_boxes(table: DataFrame) -> DataFrame:
    points = F.flatten(F.flatten("rings"))
    axis = lambda name: F.transform(points, lambda p: p[name])
    boxed = table.select("ord", "name", "rings", F.array_min(axis("lng")).alias("w"), F.array_min(axis("lat")).alias("s"), F.array_max(axis("lng")).alias("e"), F.array_max(axis("lat")).alias("n"))
    return boxed.withColumn("key", norm_border("name"))


def borders(spark: SparkSession, boxes=COARSE_BORDERS) -> DataFrame:
    """Borders from boxes: ord, name, rings (polygons of rings of points), bounding box, comparison key."""
    ring = lambda w, s, e, n: ((w, s), (e, s), (e, n), (w, n), (w, s))
    return borders_from_rings(spark, [(name, [[ring(*box)]]) for name, *box in boxes])


def borders_from_rings(spark: SparkSession, shapes) -> DataFrame:
    """Borders from (name, polygons): a polygon is a list of rings, the first one outside, of (longitude, latitude)."""
    return _with_boxes(spark.createDataFrame([(i, name, [[[(float(x), float(y)) for x, y in ring] for ring in rings] for rings in polygons]) for i, (name, polygons) in enumerate(shapes)], schemas.BORDERS))


def borders_from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Borders from a GeoJSON file of polygons and multipolygons with a ``name`` property, in file order."""
    text = spark.read.text(path, wholetext=True)
    feature = "array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: string>>>"
    found = text.select(F.posexplode(F.from_json("value", f"features {feature}")["features"]).alias("ord", "f"))
    shape = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, "array<array<array<double>>>"))).otherwise(F.from_json(shape, "array<array<array<array<double>>>>"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))
    rings = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return _with_boxes(found.select("ord", F.col("f.properties.name").alias("name"), rings.alias("rings")))
