"""Whole analyses against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import layers, present
from kinweave.operators.resolve import BorderTable, GazetteerIndex, HistoricalResolver, PolityTable, StubResolver, default_resolver, geocode
from kinweave.plans import analyze as A
from kinweave.sources import reference
from tests.trees import SAMPLE, family, person, text


@pytest.fixture(scope="module")
def sample(spark):
    return A.analyze_text(spark, SAMPLE)


def shares(found, grain, measure="fractional"):
    rows = found.report.breakdown.filter(F.col("granularity") == grain).filter(F.col(measure).isNotNull()).orderBy(f"{measure}_rank")
    return [(r["region"], r[measure]) for r in rows.collect()]


def budget(found):
    return tuple(found.report.coverage.drop("root_id").first())


def test_sample(sample):
    assert sample.root_id == "@I1@" and sample.tree_size() == (13, 7)
    people = {r["id"].strip("@"): r for r in sample.people.collect()}
    assert len(people) == 13 and sum(r["lat"] is not None for r in people.values()) == 12 and people["I11"]["lat"] is None
    order = sorted(people, key=lambda i: people[i]["path_key"])
    assert order == "I1 I2 I4 I10 I11 I5 I12 I3 I6 I13 I14 I7 I15".split()
    ten = people["I10"]
    assert (ten["times_reached"], ten["contribution_weight"], ten["leaf_weight"], ten["depths"]) == (2, 0.25, 0.25, [3])
    assert [(g["id"], g["depth"], g["contribution_weight"]) for g in sample.gaps.collect()] == [("gap:@I5@:father", 3, 0.125)]
    assert budget(sample) == (0.75, 0.125, 0.125)
    assert (people["I15"]["historical_polity"], people["I15"]["confidence"]) == ("Austria-Hungary", 0.9 * (2 / 3))
    assert people["I6"]["historical_polity"] == "Sweden" and people["I7"]["historical_polity"] == "Ukraine"


def test_sample_shares(sample):
    assert shares(sample, "modernCountry")[0] == ("Germany", 0.25) and dict(shares(sample, "modernCountry")) == {"Germany": 0.25, "Norway": 0.125, "Sweden": 0.125, "Finland": 0.125, "Slovakia": 0.125}
    assert dict(shares(sample, "historicalPolity")) == {"German Empire": 0.25, "Norway": 0.125, "Sweden": 0.125, "Finland": 0.125, "Austria-Hungary": 0.125}
    assert shares(sample, "culturalRegion") == [("Nordic", 0.375), ("Germanic", 0.25), ("Central Europe", 0.125)]
    assert shares(sample, "modernCountry", "headcount") == [("United States", 4), ("Germany", 1), ("Norway", 2)][:1] + [("Norway", 2), ("Finland", 2), ("Germany", 1), ("Sweden", 1), ("Ukraine", 1), ("Slovakia", 1)]
    assert shares(sample, "culturalRegion", "headcount") == [("Nordic", 5), ("Germanic", 1), ("Central Europe", 1)]
    assert sample.report.place_variants.count() == 0


def test_sample_layers(sample):
    points, arcs = layers.build_layers(sample.people, sample.links, 8)
    assert points.count() == 12 and sample.links.count() == 13 and arcs.count() == 12
    assert layers.filter_by_depth(sample.people, 1).count() == 3
    ends = {(r["start_lat"], r["start_lng"]) for r in arcs.collect()} | {(r["end_lat"], r["end_lng"]) for r in arcs.collect()}
    assert ends <= {(r["lat"], r["lng"]) for r in points.collect()}


def test_reports(spark, sample):
    shown = A.file_report(sample, "sample")
    assert "13 individuals, 7 families" in shown and "resolved 75.0%  |  unresolved 12.5%  |  unknown/gaps 12.5%" in shown and "Hinterland  ×1" in shown
    assert "Pressburg    1895  Slovakia       -> Austria-Hungary" in A.demo_report(spark, sample, "sample")


def test_rejected_point(spark):
    tree = text(
        person("I1", "Newark, Renfrewshire, Scotland", coords=("N21.0", "E78.0"), famc="F1"),
        person("I2", "Aberdeen, Aberdeenshire, Scotland", coords=("N56.8", "W4.2")), family("F1", "I2", None, ["I1"]),
    )
    found = A.analyze_text(spark, tree)
    one, two = (found.people.filter(F.col("id") == i).first() for i in ("@I1@", "@I2@"))
    assert one["modern_country"] == "Scotland" and one["lat"] is None and "coord-rejected" in one["provenance"] and one["confidence"] == 0.4
    assert (two["lat"], two["lng"]) == (56.8, -4.2) and budget(found) == (0.5, 0.0, 0.5)


def test_ancient_place(spark):
    found = A.analyze_text(spark, text(person("I1", "Edom (Idumaea)", coords=("S29.0", "E24.0"))))
    one = found.people.first()
    assert one["lat"] is None and one["modern_country"] == "Edom (Idumaea)" and one["confidence"] == 0.4
    assert one["provenance"].endswith('coord-rejected:ancient="Edom / Idumaea",point=(-29.00,24.00)') and budget(found) == (1.0, 0.0, 0.0)


def test_names_fold_and_spread(spark):
    us = ("39.0", "W98.0")
    leaves = [("I6", "USA", us), ("I7", "US", us), ("I8", "United States of America", us), ("I9", "Va", us), ("I10", "England", ("52.5", "W1.5")), ("I11", "Scotland", ("56.8", "W4.2"))]
    tree = text(
        person("I1", famc="F1"), person("I2", famc="F2"), person("I3", famc="F3"), person("I4", famc="F4"), person("I5", famc="F5"),
        *[person(i, p, coords=c) for i, p, c in leaves],
        family("F1", "I2", "I3"), family("F2", "I4", "I5"), family("F3", "I6", "I7"), family("F4", "I8", "I9"), family("F5", "I10", "I11"),
    )
    found = A.analyze_text(spark, tree)
    assert shares(found, "modernCountry") == [("United States", 0.75), ("England", 0.125), ("Scotland", 0.125)] and budget(found) == (1.0, 0.0, 0.0)
    assert found.report.place_variants.filter("region = 'United States'").first()["variants"] == ["US", "USA", "United States of America", "Va"]
    points = {r["id"]: r for r in layers.build_layers(found.people, found.links, 8)[0].collect()}
    spots = {(points[f"@I{k}@"]["lat"], points[f"@I{k}@"]["lng"]) for k in (6, 7, 8, 9)}
    assert len(spots) == 4 and (points["@I6@"]["lat"], points["@I6@"]["lng"]) == (39.0, -98.0)
    assert all(abs(a - 39) <= 0.4 and abs(b + 98) <= 0.6 for a, b in spots) and points["@I10@"]["lat"] == 52.5


def test_point_without_place_is_placed_but_not_resolved(spark):
    keys = spark.createDataFrame([(None, 1900, 60.0, 10.0)], "place string, year int, lat double, lng double")
    found = default_resolver(spark).resolve(keys).first()
    assert found["coord_lat"] == 60.0 and found["modern_country"] is None and found["historical_polity"] == "Norway"


def test_stub_and_ports(spark):
    keys = spark.createDataFrame([("Danzig, Prussia", None, None, None), ("  ", None, None, None), (None, None, None, None), ("Nowhere", None, None, None)], "place string, year int, lat double, lng double")
    rows = {r["place"]: (r["modern_country"], r["provenance"]) for r in StubResolver(spark).resolve(keys).collect()}
    assert rows == {"Danzig, Prussia": ("Germany", 'stub:alias("prussia")'), "  ": (None, "stub:empty"), None: (None, "stub:empty"), "Nowhere": (None, "stub:no-alias-match")}
    empty = HistoricalResolver(GazetteerIndex(reference.gazetteer_index(reference.gazetteer(spark, []))), PolityTable(reference.polities(spark)), BorderTable(reference.borders(spark, [])))
    assert empty.resolve(keys).filter("modern_country is not null").count() == 0


def test_own_ports(spark):
    """Another geocoder, boundaries and borders than the tables."""

    class Anywhere:
        def find(self, keys):
            entry = F.struct(F.lit(1).alias("ord"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"), F.lit("XX").alias("country_code"), F.lit("Utopia").alias("modern_country"))
            return keys.withColumn("hit", F.struct(F.lower("place").alias("token"), entry.alias("entry")))

    class Realm:
        def at(self, rows, lat, lng):
            told = [F.lit(v).alias(k) for k, v in (("snapshot_year", 1516), ("name", "Realm"), ("subjecto", "Realm"), ("part_of", "Myth"), ("border_precision", 3))]
            return rows.withColumn("polity", F.struct(*told))

    class Never:
        def check(self, rows, country):
            return rows.withColumns({"point_country": F.lit(None).cast("string"), "string_known": F.lit(True), "contradicts": F.lit(False)})

    keys = spark.createDataFrame([("Amaurot", 1516, None, None), ("Here, There", 1600, 7.0, 8.0)], "place string, year int, lat double, lng double")
    found = {r["raw"]: r for r in HistoricalResolver(Anywhere(), Realm(), Never()).resolve(keys).collect()}
    assert (found["Amaurot"]["modern_country"], found["Amaurot"]["coord_lat"], found["Amaurot"]["historical_polity"]) == ("Utopia", 1.5, "Realm")
    assert (found["Here, There"]["coord_lng"], found["Here, There"]["cultural_region"]) == (8.0, "Myth")


def test_geonames(spark, tmp_path):
    """The most populous of a name wins; alternate names count; unknown countries don't."""
    place = lambda i, name, other, lat, lng, code, people: "\t".join([str(i), name, name, other, str(lat), str(lng), "P", "PPL", code, "", "", "", "", "", str(people), "", "", "", ""])
    (tmp_path / "places.txt").write_text("\n".join([place(7, "Springfield", "", 39.8, -89.6, "US", 114000), place(5, "Springfield", "", 1.0, 2.0, "GB", 900), place(9, "Wien", "Vienna,Vindobona", 48.2, 16.4, "AT", 1900000), place(3, "Nowhere", "", 0.0, 0.0, "ZZ", 5)]))
    (tmp_path / "countries.txt").write_text("#ISO\tISO3\nUS\tUSA\t840\tUS\tUnited States\nGB\tGBR\t826\tUK\tUnited Kingdom\nAT\tAUT\t040\tAU\tAustria")
    index = reference.gazetteer_index(reference.gazetteer_from_geonames(spark, str(tmp_path / "places.txt"), str(tmp_path / "countries.txt")))
    keys = spark.createDataFrame([(p, None, None, None) for p in ("Springfield", "Stephansplatz, vindobona, X", "Nowhere")], "place string, year int, lat double, lng double")
    found = {r["place"]: r["hit"] and (r["hit"]["entry"]["modern_country"], r["hit"]["entry"]["lat"]) for r in geocode(keys, index).collect()}
    assert found == {"Springfield": ("United States", 39.8), "Stephansplatz, vindobona, X": ("Austria", 48.2), "Nowhere": None}


def test_person_and_arcs(sample):
    assert [r["id"] for r in present.find_person(sample.people, "@I7@").collect()] == ["@I7@"] and present.find_person(sample.people, None).isEmpty()
    _, arcs = layers.build_layers(sample.people, sample.links, 8)
    assert layers.visible_arcs(arcs, 0.45).count() == 12 and layers.visible_arcs(arcs, 0.44).isEmpty()


def test_arguments():
    assert vars(A.arguments(["x.ged", "--root=@I3@", "--gen", "9.7"])) == {"path": "x.ged", "root": "@I3@", "gen": 9}
    for bad in (["x", "--gen", "-1"], ["x", "--gen=a"], ["x", "y"], [], ["x", "--other"]):
        with pytest.raises(SystemExit):
            A.arguments(bad)


def test_geojson_borders(spark, tmp_path):
    ring = "[[0,0],[10,0],[10,10],[0,10],[0,0]]"
    hole = "[[4,4],[6,4],[6,6],[4,6],[4,4]]"
    path = tmp_path / "b.json"
    path.write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"Ring"},"geometry":{"type":"Polygon","coordinates":[%s,%s]}},{"properties":{"name":"Two"},"geometry":{"type":"MultiPolygon","coordinates":[[[[20,0],[21,0],[21,1],[20,0]]],[[[4,4],[6,4],[6,6],[4,6],[4,4]]]]}}]}' % (ring, hole))
    from kinweave.operators.resolve import country_at

    table = reference.borders_from_geojson(spark, str(path))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 0.0, 5.0), (4, 50.0, 50.0), (5, 0.2, 20.9), (6, 0.9, 20.1)], "id int, lat double, lng double")
    assert {r["id"]: r["point_country"] for r in country_at(points, table).collect()} == {1: "Two", 2: "Ring", 3: "Ring", 4: None, 5: "Two", 6: None}
