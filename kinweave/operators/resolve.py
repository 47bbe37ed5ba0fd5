"""Places: from a text, a year and maybe a point to today's country, the polity of the time, and why.

Everything works on distinct keys (place, year, lat, lng) at once. Reference tables are joined on equal columns (names,
cells of the map), so Spark broadcasts them if their size allows and deals both sides otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.text import WORD, country_token, norm_border, norm_country, number_text, tokens, trim
from kinweave.functions.text import norm_place as _norm_place
from kinweave.operators import spatial
from kinweave.operators.keyed import free_names, look_up
from kinweave.sources import reference

KEY = ("place", "year", "lat", "lng")
RESULT = ("raw", "coord_lat", "coord_lng", "modern_country", "modern_country_raw", "historical_polity", "cultural_region", "confidence", "border_precision", "alternatives", "provenance")


class Resolver(Protocol):
    """Turns distinct keys (place, year, lat, lng) into keys with the columns of RESULT."""

    def resolve(self, keys: DataFrame) -> DataFrame: ...


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def canonical_country(raw: Column | str) -> Column:
    """The country a name folds into; unknown names stay as they are."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    name = norm_country(raw)
    known = _map({alias: country for country, aliases in reference.CANONICAL.items() for alias in aliases})
    return F.coalesce(F.try_element_at(known, name), F.when(name.rlike(reference.US_SUFFIX), "United States"), raw)


def ancient_contradiction(place: Column | str, lat: Column | str, lng: Column | str, rules=reference.ANCIENT, margin=reference.ANCIENT_MARGIN) -> Column:
    """Name of the ancient place that a text names if the point is far outside it; only the first rule that fits decides."""
    place, lat, lng = (F.col(x) if isinstance(x, str) else x for x in (place, lat, lng))
    out = F.lit(None).cast("string")
    for name, words, w, s, e, n in reversed(rules):
        inside = lng.between(w - margin, e + margin) & lat.between(s - margin, n + margin)
        out = F.when(place.rlike(f"(?i)(?<![{WORD}])({words})(?![{WORD}])"), F.when(~inside, F.lit(name))).otherwise(out)
    return out


def geocode(keys: DataFrame, index: DataFrame) -> DataFrame:
    """``keys`` (distinct) with hit (token, entry: ord, lat, lng, country_code, modern_country): the first part of the place that is a known name.

    Names are joined by hash and name, by which the index isn't dealt yet, so Spark can split a name that most places have.
    """
    parts = keys.select(*KEY, F.posexplode_outer(F.transform(tokens("place"), _norm_place)).alias("pos", "part")).withColumn("part_hash", F.xxhash64("part"))
    named = index.select("token", "entry", F.xxhash64("token").alias("token_hash"))
    found = parts.join(named, (F.col("part_hash") == F.col("token_hash")) & (F.col("part") == F.col("token")), "left")
    hit = F.min_by(F.when(F.col("entry").isNotNull(), F.struct("token", "entry")), F.when(F.col("entry").isNotNull(), F.col("pos")))
    return found.groupBy(*KEY).agg(hit.alias("hit"))


#: Years of a bucket.
SPAN = 64


def as_of(years: DataFrame, snapshots: DataFrame, year: str, name: str) -> DataFrame:
    """``years`` with column ``name``: the greatest of ``snapshots`` (snapshot) up to the row's year, else the least; null without a year.

    Snapshots lie in buckets of ``SPAN`` years, each with the last one before it, for all years between the first and the
    last. A row looks into its own bucket, so it stays one row, and there is neither a range join nor a window over rows.
    """
    known = snapshots.select(F.col("snapshot").cast("long").alias("s")).distinct()
    ends = known.agg(F.min("s").alias("least"), F.max("s").alias("most"))
    bucket = lambda x: F.floor(x / SPAN)
    every = ends.select("least", "most", F.explode(F.sequence(bucket(F.col("least")), bucket(F.col("most")))).alias("bucket"))
    own = known.groupBy(bucket(F.col("s")).alias("bucket")).agg(F.sort_array(F.collect_list("s")).alias("own"))
    held = every.join(own, "bucket", "left").withColumn("before", F.max(F.array_max("own")).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    held = held.select("bucket", "own", "before", "least", "most")
    at = years.select(F.struct(*[F.col(f"`{c}`") for c in years.columns]).alias("row"), F.col(year).cast("long").alias("year_at")).withColumn("year_bucket", bucket(F.col("year_at")))
    low, high = (known.agg(f("s")).scalar() for f in (F.min, F.max))
    at = at.join(held, F.col("year_bucket") == F.col("bucket"), "left")
    found = F.coalesce(F.array_max(F.filter("own", lambda x: x <= F.col("year_at"))), "before", F.when(F.col("year_at") < low, low).otherwise(high))
    kept = [F.col("row").getField(c).alias(c) for c in years.columns if c != name]
    return at.select(*kept, F.when(F.col("year_at").isNotNull(), found).cast("int").alias(name))


def snapshot_year(years: DataFrame, polities: DataFrame, year: str = "year") -> DataFrame:
    """``years`` with snapshot_year: the snapshot that holds in a year, the latest one up to it, else the earliest; null without a year."""
    return as_of(years, polities.select(F.col("snapshot_year").alias("snapshot")), year, "snapshot_year")


#: Degrees of a cell of the map.
CELL = 10


def _cells(table: DataFrame) -> DataFrame:
    """``table`` (with boxes w, s, e, n) for each cell that a box touches."""
    across = lambda low, high: F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))
    return table.withColumn("cell_x", F.explode(across("w", "e"))).withColumn("cell_y", F.explode(across("s", "n")))


def polity_at(keys: DataFrame, polities: DataFrame, lat: str, lng: str) -> DataFrame:
    """``keys`` (with year) with polity: the first of the snapshot that holds whose box has the point, edges included.

    The polities of a snapshot and cell are one row, so every row of ``keys`` stays one, whatever it holds.
    """
    box = F.struct("ord", "snapshot_year", "name", "subjecto", "part_of", "border_precision", "w", "s", "e", "n")
    held = _cells(polities).groupBy("snapshot_year", "cell_x", "cell_y").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    held = held.withColumn("cell_hash", F.xxhash64("snapshot_year", "cell_x", "cell_y"))
    year, = free_names(keys, "year_of_snapshot")
    at = as_of(keys, polities.select(F.col("snapshot_year").alias("snapshot")), "year", year)
    at = at.select(F.struct(*[F.col(f"`{c}`") for c in keys.columns]).alias("row"), F.col(year).alias("at_year"), F.col(lat).alias("at_lat"), F.col(lng).alias("at_lng"))
    at = at.withColumns({"at_x": F.floor(F.col("at_lng") / CELL), "at_y": F.floor(F.col("at_lat") / CELL)}).withColumn("at_hash", F.xxhash64("at_year", "at_x", "at_y"))
    same = (F.col("at_hash") == F.col("cell_hash")) & (F.col("at_year") == F.col("snapshot_year")) & (F.col("at_x") == F.col("cell_x")) & (F.col("at_y") == F.col("cell_y"))
    inside = lambda b: F.col("at_lng").between(b["w"], b["e"]) & F.col("at_lat").between(b["s"], b["n"])
    polity = F.get(F.filter("boxes", inside), F.lit(0)).dropFields("w", "s", "e", "n")
    return at.join(held, same, "left").select(*[F.col("row").getField(c).alias(c) for c in keys.columns if c != "polity"], polity.alias("polity"))


def in_rings(lng: Column, lat: Column, polygons: Column) -> Column:
    """Whether a point is in one of the polygons: an odd number of the edges of its rings lies east of it. Points on an edge are inside."""
    return F.exists(polygons, lambda rings: spatial.inside(lng, lat, spatial.edges_of(rings)))


def country_at(points: DataFrame, borders: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``points`` with point_country: the first country that has the point."""
    at, = free_names(points, "at")
    found = spatial.first_at(points, borders, F.col(lng), F.col(lat), at)
    return found.select(*[F.col(f"`{c}`") for c in points.columns if c != "point_country"], F.col(at)["name"].alias("point_country"))


def contradicts(keys: DataFrame, borders: DataFrame, country: str) -> DataFrame:
    """``keys`` with point_country (null if the named country is unknown), string_known, contradicts.

    Countries are compared by key: the modern one that a name stands for, else the name's own if it is among the borders.
    """
    modern = lambda key: F.try_element_at(_map(reference.MODERN), key)
    names = borders.select(F.col("key").alias("border_key")).distinct().withColumn("border_hash", F.xxhash64("border_key"))
    held = keys.select(F.struct(*[F.col(f"`{c}`") for c in keys.columns]).alias("row"), norm_border(country).alias("own_key"), F.col("lng").alias("at_lng"), F.col("lat").alias("at_lat"))
    held = held.withColumn("own_hash", F.xxhash64("own_key")).join(names, (F.col("own_hash") == F.col("border_hash")) & (F.col("own_key") == F.col("border_key")), "left")
    held = held.select("row", "at_lng", "at_lat", F.coalesce(modern(F.col("own_key")), F.col("border_key")).alias("named_key"))
    found = spatial.first_at(held, borders, F.col("at_lng"), F.col("at_lat"), "at")
    own, point = F.col("named_key"), F.coalesce(modern(F.col("at.key")), F.col("at.key"))
    same = own == point
    for a, b in reference.COMPATIBLE:
        same = same | ((own == a) & (point == b)) | ((own == b) & (point == a))
    known = own.isNotNull()
    return found.select(
        *[F.col("row").getField(c).alias(c) for c in keys.columns if c not in ("point_country", "string_known", "contradicts")], F.when(known, F.col("at.name")).alias("point_country"), known.alias("string_known"),
        F.coalesce(known & point.isNotNull() & ~same, F.lit(False)).alias("contradicts"),
    )


def _result(**columns: Column) -> list[Column]:
    none = {"coord_lat": "double", "coord_lng": "double", "modern_country": "string", "modern_country_raw": "string", "historical_polity": "string", "cultural_region": "string", "border_precision": "int"}
    base = {k: F.lit(None).cast(t) for k, t in none.items()}
    base |= {"raw": F.coalesce("place", F.lit("")), "confidence": F.lit(0.0), "alternatives": F.array().cast("array<string>")}
    return [(base | columns)[k].alias(k) for k in RESULT]


@dataclass(frozen=True)
class StubResolver:
    """Names alone: the last part of the place that is a known name; no points, no time."""

    spark: SparkSession

    def resolve(self, keys: DataFrame) -> DataFrame:
        countries, cultures = _map(reference.STUB), _map(reference.CULTURE)
        parts = F.reverse(F.transform(tokens("place"), F.lower))
        token = F.try_element_at(F.filter(parts, lambda t: F.map_contains_key(countries, t)), F.lit(1))
        rows = keys.withColumn("token", token)
        rows = rows.withColumn("country", F.try_element_at(countries, F.col("token")))
        blank = F.coalesce(trim("place"), F.lit("")) == ""
        why = F.when(blank, "stub:empty").when(F.col("token").isNull(), "stub:no-alias-match").otherwise(F.concat(F.lit('stub:alias("'), "token", F.lit('")')))
        country = F.col("country")
        return rows.select(*KEY, *_result(modern_country=country, historical_polity=country, cultural_region=F.try_element_at(cultures, country), confidence=F.when(country.isNotNull(), 0.5).otherwise(0.0), provenance=why))


class Geocoder(Protocol):
    """Turns keys (place, year, lat, lng) into keys with hit (token, entry), null if no name is known."""

    def find(self, keys: DataFrame) -> DataFrame: ...


class Boundaries(Protocol):
    """Adds polity (snapshot_year, name, subjecto, part_of, border_precision) that held a point in the row's year, or null."""

    def at(self, rows: DataFrame, lat: str, lng: str) -> DataFrame: ...


class Borders(Protocol):
    """Adds point_country, string_known and contradicts: whether a point (lat, lng) lies in another country than the named one."""

    def check(self, rows: DataFrame, country: str) -> DataFrame: ...


@dataclass(frozen=True)
class GazetteerIndex:
    """The geocoder by a table of names (``reference.gazetteer_index``)."""

    index: DataFrame

    def find(self, keys: DataFrame) -> DataFrame:
        return geocode(keys, self.index)


@dataclass(frozen=True)
class PolityTable:
    """Boundaries by a table of polities (``reference.polities``)."""

    polities: DataFrame

    def at(self, rows: DataFrame, lat: str, lng: str) -> DataFrame:
        return polity_at(rows, self.polities, lat, lng)


@dataclass(frozen=True)
class BorderTable:
    """Borders by a table of polygons (``reference.borders``)."""

    borders: DataFrame

    def check(self, rows: DataFrame, country: str) -> DataFrame:
        return contradicts(rows, self.borders, country)


@dataclass(frozen=True)
class HistoricalResolver:
    """By gazetteer, or by a point that the record has: today's country, then the polity whose borders held the point that year."""

    geocoder: Geocoder
    boundaries: Boundaries
    borders: Borders

    def _in_time(self, rows: DataFrame) -> DataFrame:
        """Fills polity, region, confidence and the rest of the reasons, from base_* columns and the accepted point."""
        timed = self.boundaries.at(rows, "at_lat", "at_lng")
        p, year = F.col("polity"), F.col("year")
        note = (
            F.when(year.isNull(), "; no-date(historical=modern)")
            .when(p.isNull(), F.concat(F.lit("; histbasemaps:no-polygon@"), year.cast("string"), F.lit("(fallback->modern)")))
            .otherwise(F.concat(F.lit("; histbasemaps:"), p["snapshot_year"].cast("string"), F.lit(' "'), p["name"], F.lit('" partOf='), F.coalesce(p["part_of"], F.lit("-")), F.lit(" prec="), p["border_precision"].cast("string")))
        )
        sure = F.when(p.isNull(), F.col("base")).otherwise(F.col("base") * (p["border_precision"] / 3))
        return timed.select(*KEY, *_result(
            coord_lat=F.col("at_lat"), coord_lng=F.col("at_lng"), modern_country=F.col("country"), modern_country_raw=F.col("country_raw"),
            historical_polity=F.when(p.isNull(), F.col("country")).otherwise(p["subjecto"]), cultural_region=p["part_of"],
            confidence=sure, border_precision=p["border_precision"], provenance=F.concat("why", note),
        ))

    def resolve(self, keys: DataFrame) -> DataFrame:
        return self._by_name(keys.filter("lat is null or lng is null")).unionByName(self._by_point(keys.filter("lat is not null and lng is not null")))

    def _by_name(self, keys: DataFrame) -> DataFrame:
        rows = self.geocoder.find(keys)
        entry = F.col("hit.entry")
        missed = rows.filter("hit is null")
        blank = F.coalesce(trim("place"), F.lit("")) == ""
        lost = missed.select(*KEY, *_result(provenance=F.when(blank, "empty").otherwise("geonames:no-match")))
        raw = entry["modern_country"]
        hit = rows.filter("hit is not null").select(*KEY, entry["lat"].alias("at_lat"), entry["lng"].alias("at_lng"), raw.alias("country_raw"), canonical_country(raw).alias("country"), F.lit(0.9).alias("base"), F.col("hit.token").alias("token"), entry["country_code"].alias("code"))
        why = F.concat(F.lit('geonames:"'), "token", F.lit('"->('), number_text("at_lat"), F.lit(","), number_text("at_lng"), F.lit(") "), "code", self._fold())
        return self._in_time(hit.withColumn("why", why).drop("token", "code")).unionByName(lost)

    @staticmethod
    def _fold() -> Column:
        changed = F.col("country") != F.col("country_raw")
        return F.when(changed, F.concat(F.lit('; canon:"'), "country_raw", F.lit('"->"'), "country", F.lit('"'))).otherwise("")

    def _by_point(self, keys: DataFrame) -> DataFrame:
        rows = keys.withColumn("country_raw", country_token("place"))
        rows = self.borders.check(rows.withColumn("country", canonical_country("country_raw")), "country")
        rows = rows.withColumn("ancient", F.when(~F.col("string_known"), ancient_contradiction("place", "lat", "lng")))
        head = F.concat(F.lit("gedcom-embedded-coords:("), number_text("lat"), F.lit(","), number_text("lng"), F.lit(")"))
        fold = F.coalesce(self._fold(), F.lit(""))
        point = F.concat(F.format_string("(%.2f,%.2f)", "lat", "lng"))
        note = F.when(F.col("contradicts"), F.concat(F.lit('coord-rejected:string="'), "country", F.lit('",point-in="'), "point_country", F.lit('"'))).otherwise(
            F.concat(F.lit('coord-rejected:ancient="'), "ancient", F.lit('",point='), point)
        )
        bad = F.col("contradicts") | F.col("ancient").isNotNull()
        rejected = rows.filter(bad).select(*KEY, *_result(modern_country=F.col("country"), modern_country_raw=F.col("country_raw"), historical_polity=F.col("country"), confidence=F.lit(0.4), provenance=F.concat(head, F.lit("; "), note, fold)))
        good = rows.filter(~bad).select(*KEY, F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"), "country_raw", "country", F.lit(0.95).alias("base"), F.concat(head, fold).alias("why"))
        return self._in_time(good).unionByName(rejected)


def default_resolver(spark: SparkSession) -> HistoricalResolver:
    """The sample tables, with coarse boxes in place of today's borders."""
    return HistoricalResolver(GazetteerIndex(reference.gazetteer_index(reference.gazetteer(spark))), PolityTable(reference.polities(spark)), BorderTable(reference.borders(spark)))


def resolve_rows(rows: DataFrame, resolver: Resolver) -> DataFrame:
    """``rows`` (with place, year, lat, lng) and the columns of RESULT; every distinct key is resolved once."""
    return look_up(rows, {k: F.col(k) for k in KEY}, resolver.resolve, *RESULT)
