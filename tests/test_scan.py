"""Rules of the file scan and of the text functions."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.functions.measures import cell, share_label
from kinweave.sources.gedcom import GedcomFile, GedcomText, Rows, read_text

LINES = [
    "1 NAME before any record", "0 @I1@ INDI\r", "1 NAME Jo", "1 NAME Other /Sur/", "1 SEX M", "1 SEX X", "  1 BIRT", "2 DATE BET 1840 AND 1850", "2 PLAC a   b", "2 PLAC c,   d",
    "1 BIRT", "2 PLAC second", "4 LATI 91", "4 LONG 5", "1 DEAT", "4 LATI N1", "1 NOTE x", "2 DATE 1700", "1 FAMC", "1 FAMC @F1@", "1 FAMS @F2@", "1 MARR", "4 LATI W45", "4 LONG 1",
    "x not a level", "", "0 @F1@ FAM", "1 HUSB @A@", "1 HUSB", "1 WIFE @B@", "1 CHIL @I1@", "1 CHIL", "1 MARR", "0 @I2@ INDI", "1 NAME First //", "0 @I3@ INDI", "0 @I2@ INDI", "1 NAME /Second/", "0 TRLR",
]


def test_scan(spark):
    people, families = GedcomText(spark, "\n".join(LINES)).load()
    rows = {r["id"]: r for r in people.collect()}
    one = rows["@I1@"]
    assert (one["given"], one["surname"], one["sex"], one["famc"], one["fams"]) == ("Jo", "Sur", "U", ["@F1@"], ["@F2@"])
    events = [(e["type"], e["place"], e["date"] and e["date"]["year"], e["coords"] and tuple(e["coords"])) for e in one["events"]]
    assert events == [("BIRT", "c, d", 1840, None), ("BIRT", "second", None, None), ("DEAT", None, None, None), ("MARR", None, None, (-45.0, 1.0))]
    assert one["events"][0]["date"]["approximate"]
    assert (rows["@I2@"]["given"], rows["@I2@"]["surname"]) == (None, "Second") and rows["@I2@"]["seq"] < rows["@I3@"]["seq"]
    family = families.first()
    assert (family["husband"], family["wife"], family["children"]) == (None, "@B@", ["@I1@"])


def test_files_are_read_in_stretches(spark, tmp_path):
    """A file over many blocks gives the rows, in order, that its text gives at once; odd lines of level 0 begin records too."""
    lines = ["0 HEAD", "1 CHAR UTF-8"]
    for i in range(4000):
        lines += [f"0 @I{i % 3990}@ INDI", f"1 NAME N{i} /S/", "1 BIRT", f"2 DATE {1700 + i % 300}", "2 PLAC Ort, Land", f"1 FAMC @F{i}@"]
        lines += ["", f"  +00 @F{i}@ FAM", f"1 HUSB @I{i + 1}@"] if i % 5 == 0 else ["0 @N1@ NOTE 0 zero", "1 CONT 0 @X@ INDI"] if i % 7 == 0 else []
    whole = "\r\n".join([*lines, "0 TRLR"])
    path = tmp_path / "tree.ged"
    path.write_bytes(whole.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        source = GedcomFile(spark, str(path))
        assert read_text(spark, str(path)).select(F.spark_partition_id()).distinct().count() > 5
        found = [x.drop("tree", "seq").orderBy("id").collect() for x in source.load()]
        order = [[r["id"] for r in x.orderBy("seq").select("id").collect()] for x in source.load()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    once = GedcomText(spark, whole).load()
    assert found == [x.drop("tree", "seq").orderBy("id").collect() for x in once] and len(found[0]) == 3990 and len(found[1]) == 800
    assert order == [[r["id"] for r in x.orderBy("seq").select("id").collect()] for x in once]


def test_rows_source(spark):
    people, families = Rows(spark, [("a", "A", None), ("b", "B", None)], {"a": ("b", None)}).load()
    assert people.count() == 2 and families.first()["husband"] == "b"


def values(spark, function, *inputs):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in table.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, T.parse_year, "BET 1840 AND 1850", "1 JAN 99", "500 BC", "é1850", "12345", None) == [1840, None, 500, 1850, None, None]
    assert values(spark, T.parse_coord, "N45.5", "s 3", "-2", "W-3", "E", "4,5") == [45.5, -3.0, -2.0, -3.0, None, None]
    assert values(spark, T.norm_country, "Eng>", "Scot.", "U.S.A.", " Österreich  -  Ungarn") == ["eng", "scot", "usa", "osterreich ungarn"]
    assert values(spark, T.norm_place, " Åbo\t", "Lwów", "Øst") == ["abo", "lwow", "øst"]
    assert values(spark, T.trim, "﻿\t a b  ") == ["a b"] and values(spark, T.country_token, "a, b, , ", ",", None) == ["b", None, None]


def test_measures(spark):
    table = spark.createDataFrame([(0, -0.125), (1, 0.125)], "i int, x double")
    assert [r["c"] for r in table.select("i", cell("x").alias("c")).orderBy("i").collect()] == [-2, 3]
    shares = spark.createDataFrame([(i, x) for i, x in enumerate((0.0, 0.00005, 0.0005, 0.1225, 1.0))], "i int, x double")
    assert [r["s"] for r in shares.select("i", share_label("x").alias("s")).orderBy("i").collect()] == ["0%", "<0.01%", "0.05%", "12.3%", "100.0%"]


def test_largest_remainder(spark):
    from kinweave.operators.present import hundred_percent

    rows = spark.createDataFrame([("r", i, w) for i, w in enumerate((1 / 3, 1 / 3, 1 / 3))], "root string, i int, w double")
    assert [r["percent"] for r in hundred_percent(rows, ["root"], "i", "w").orderBy("i").collect()] == [33.4, 33.3, 33.3]
    none = spark.createDataFrame([("r", i, 0.0) for i in range(2)], "root string, i int, w double")
    assert [r["percent"] for r in hundred_percent(none, ["root"], "i", "w").orderBy("i").collect()] == [50.0, 50.0]


def test_stream(spark, tmp_path):
    from kinweave.streaming.resolve import resolve_names

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("Oslo, Norway", 1900, None, None)], "place string, year int, lat double, lng double").write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema("place string, year int, lat double, lng double").parquet(str(tmp_path / "in/*"))
    query = resolve_names(stream).writeStream.format("memory").queryName("named").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert spark.table("named").select(F.col("modern_country")).first()[0] == "Norway"


def test_first_line_of_odd_level(spark, tmp_path):
    """A level goes up to its last digit, in the first line of a file too."""
    (tmp_path / "odd.ged").write_text("0x @I1@ INDI\n1 NAME Ann /Lee/\n0 @I2@ INDI\n1 NAME Bo /Lee/\n")
    people, _ = GedcomFile(spark, str(tmp_path / "odd.ged")).load()
    assert [(r["id"], r["given"]) for r in people.orderBy("seq").collect()] == [("@I1@", "Ann"), ("@I2@", "Bo")]


def test_numbers_of_a_stretch_never_run_into_the_next(spark, tmp_path, monkeypatch):
    """A stretch with more records than have numbers is an error, not another order."""
    from kinweave.sources import gedcom

    (tmp_path / "many.ged").write_text("0 HEAD\n" + "".join(f"00 @I{i}@ INDI\n" for i in range(9)))
    assert GedcomFile(spark, str(tmp_path / "many.ged")).load()[0].count() == 9
    monkeypatch.setattr(gedcom, "CHUNK_RECORDS", 4)
    with pytest.raises(Exception, match="too many records"):
        GedcomFile(spark, str(tmp_path / "many.ged")).load()[0].collect()
