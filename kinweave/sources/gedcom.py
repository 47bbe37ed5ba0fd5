"""Reads family files into individuals and families."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.text import blank_to_null, parse_coord, parse_date, parse_name, trim, valid_coord

EVENT_TAGS = ("BIRT", "DEAT", "CHR", "BURI", "MARR")
#: White space of any kind, and byte order marks; where a record begins: before a line of level 0.
BLANK = "(?U:[\\s\\x{feff}])*"
BEGIN = f"\n(?={BLANK}[+-]?0+(?![0-9]))"
#: Records of one stretch of a file are numbered below this; more are an error.
CHUNK_RECORDS = 1 << 20


class Source(Protocol):
    """Anything that gives a tree: (individuals, families)."""

    def load(self) -> tuple[DataFrame, DataFrame]: ...


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """tree (the path), record, text of stretches of files, each of one record as a rule; files are read in many tasks.

    Spark cuts at the line breaks before `0 `; record grows along a file: where the block begins, and the row's number
    in its partition, which is less than the bytes before it. What is left of a stretch's first line is made whole again,
    but for the head of a file, which is told by its level.
    """
    rows = spark.read.text(path, lineSep="\n0 ")
    rows = rows.select(F.input_file_name().alias("tree"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    head = (F.col("block") == 0) & F.col("value").rlike(f"^{BLANK}[+-]?[0-9]+[^ \n]*(?: |\\s*$|\\s*\n)")
    whole = F.when(head, F.col("value")).otherwise(F.concat(F.lit("0 "), "value"))
    return rows.select("tree", (F.col("block") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("record"), whole.alias("text"))


def tokenize(text: Column) -> Column:
    """The lines of a text as (level, xref, tag, value); blank lines and those without a level are left out."""
    parts = F.transform(F.split(text, "\n"), lambda line: F.split(trim(line), " +"))

    def line(p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
        rest = lambda i: F.array_join(F.slice(p, i + 1, F.greatest(F.size(p) - i, F.lit(0))), " ")
        named = at(1).startswith("@") & at(1).endswith("@")
        return F.struct(
            F.regexp_extract(at(0), "^[+-]?[0-9]+", 0).try_cast("int").alias("level"), F.when(named, at(1)).alias("xref"),
            F.when(named, at(2)).otherwise(at(1)).alias("tag"), F.when(named, rest(3)).otherwise(rest(2)).alias("value"),
        )

    return F.filter(F.transform(parts, line), lambda x: x["level"].isNotNull())


def _values(lines: Column | str, level: int, tag: str) -> Column:
    return F.transform(F.filter(lines, lambda x: (x["level"] == level) & (x["tag"] == tag)), lambda x: x["value"])


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _told(lines: Column | str, tag: str) -> Column:
    """The values of a tag of level 1 that aren't empty, in order."""
    return F.filter(_values(lines, 1, tag), lambda v: v != "")


def _events(lines: str) -> Column:
    """Each line of level 1 with the lines up to the next one, if it begins an event."""
    begins = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i)["level"] == 1)
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(lines) + 1))
    spans = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.element_at(lines, x["b"])["tag"].isin(*EVENT_TAGS))

    def event(span: Column) -> Column:
        own = F.slice(lines, span["b"], span["e"] - span["b"])
        axis = lambda tag: _last(F.filter(F.transform(_values(own, 4, tag), parse_coord), lambda v: v.isNotNull()))
        lat, lng = axis("LATI"), axis("LONG")
        coords = F.when(valid_coord(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))
        return F.struct(
            F.element_at(lines, span["b"])["tag"].alias("type"), parse_date(_last(_values(own, 2, "DATE"))).alias("date"),
            blank_to_null(_last(_values(own, 2, "PLAC"))).alias("place"), coords.alias("coords"),
        )

    return F.when(F.size(begins) > 0, F.transform(spans, event)).otherwise(F.array()).cast(f"array<{schemas.EVENT}>")


def _latest(records: DataFrame) -> DataFrame:
    """A repeated reference: the later record at the earlier place."""
    return records.groupBy("tree", "xref").agg(F.max_by(F.struct(*records.columns), "record").alias("r"), F.min("record").alias("seq"))


def scan(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(individuals, families) of texts (tree, text), or of stretches of them (tree, record, text).

    A text is cut before its lines of level 0, and each record is read within its row, so only finished records are
    shuffled, to look for repeated references; no task holds a whole tree.
    """
    stretches = "record" in texts.columns
    at = F.col("record") * CHUNK_RECORDS if stretches else F.lit(0).cast("long")
    records = texts.select("tree", at.alias("at"), F.posexplode(F.split("text", BEGIN)).alias("pos", "text"))
    pos = F.when(F.col("pos") < CHUNK_RECORDS, F.col("pos")).otherwise(F.raise_error("a stretch of a file has too many records")) if stretches else F.col("pos")
    records = records.select("tree", (F.col("at") + pos).alias("record"), tokenize(F.col("text")).alias("lines"))
    head = F.get("lines", F.lit(0))
    records = records.filter((head["level"] == 0) & head["xref"].isNotNull()).withColumns({"xref": head["xref"], "kind": head["tag"]})

    name = F.transform(_values("lines", 1, "NAME"), parse_name)
    first = lambda part: F.get(F.filter(F.transform(name, lambda x: x[part]), lambda v: v.isNotNull()), F.lit(0))
    sex = _last(_values("lines", 1, "SEX"))
    people = records.filter("kind = 'INDI'").select(
        "tree", "record", "xref", first("given").alias("given"), first("surname").alias("surname"),
        F.when(sex.isin("M", "F"), sex).otherwise("U").alias("sex"), _events("lines").alias("events"),
        _told("lines", "FAMC").alias("famc"), _told("lines", "FAMS").alias("fams"),
    )
    families = records.filter("kind = 'FAM'").select(
        "tree", "record", "xref", blank_to_null(_last(_values("lines", 1, "HUSB"))).alias("husband"),
        blank_to_null(_last(_values("lines", 1, "WIFE"))).alias("wife"), _told("lines", "CHIL").alias("children"),
    )
    people = _latest(people).select("tree", F.col("xref").alias("id"), "seq", "r.given", "r.surname", "r.sex", "r.events", "r.famc", "r.fams")
    families = _latest(families).select("tree", F.col("xref").alias("id"), "seq", "r.husband", "r.wife", "r.children")
    return people, families


class GedcomFile:
    """A file, or many by a pattern, each a tree of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> tuple[DataFrame, DataFrame]:
        return scan(read_text(self.spark, self.path))


class GedcomText:
    """A text at hand."""

    def __init__(self, spark: SparkSession, text: str):
        self.spark, self.text = spark, text

    def load(self) -> tuple[DataFrame, DataFrame]:
        return scan(self.spark.createDataFrame([("", self.text)], "tree string, text string"))


class Rows:
    """A tree from rows: people as (id, given, surname), parents as {child: (father, mother)}; no files."""

    def __init__(self, spark: SparkSession, people: list[tuple], parents: dict):
        self.spark, self.people, self.parents = spark, people, parents

    def load(self) -> tuple[DataFrame, DataFrame]:
        own = {c: f"F:{c}" for c in self.parents}
        people = [(i, n, g, s, "U", [], [own[i]] if i in own else [], []) for n, (i, g, s) in enumerate(self.people)]
        families = [(own[c], n, f, m, [c]) for n, (c, (f, m)) in enumerate(self.parents.items())]
        return self.spark.createDataFrame(people, schemas.INDIVIDUALS), self.spark.createDataFrame(families, schemas.FAMILIES)
