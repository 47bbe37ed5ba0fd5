"""A whole analysis: from a source to report, people, links and gaps; and the two console reports."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import display_name
from kinweave.operators import pedigree as P
from kinweave.operators import present, report
from kinweave.operators.resolve import Resolver, StubResolver, default_resolver
from kinweave.sources.gedcom import GedcomFile, GedcomText, Source

GENERATIONS = 8
#: Places and years of the demonstration.
MARQUEE = (("Pressburg, Hungary", 1895), ("Köln, Germany", 1915), ("Helsinki, Finland", 1930), ("Lemberg, Austria", 1948))


@dataclass(frozen=True)
class Analysis:
    root_id: str
    generations: int
    report: report.Report
    people: DataFrame
    links: DataFrame
    gaps: DataFrame
    individuals: DataFrame
    families: DataFrame

    def tree_size(self) -> tuple[int, int]:
        return self.individuals.count(), self.families.count()


def people(nodes: DataFrame, individuals: DataFrame) -> DataFrame:
    """One row for each person of the walk, with what is shown of them."""
    named = individuals.select("id", display_name("given", "surname", F.col("id").cast("string")).alias("name"))
    return nodes.join(named, "id").select(
        "root_id", "id", "name", F.array_min("depths").alias("min_depth"), "depths", "contribution_weight", "leaf_weight", "is_leaf", "times_reached",
        F.col("year").alias("birth_year"), F.col("place").alias("birth_place"), F.col("coord_lat").alias("lat"), F.col("coord_lng").alias("lng"),
        "modern_country", "historical_polity", "cultural_region", "confidence", "provenance", "path_key",
    )


def analyze(source: Source, spark: SparkSession, root_id: str | None = None, generations: int = GENERATIONS, resolver: Resolver | None = None) -> Analysis:
    """Analyses the tree of a source from one root, by default the person with most ancestors."""
    individuals, families = source.load()
    individuals, families = P.checkpoint(individuals), P.checkpoint(families)
    parents = P.checkpoint(P.parents(individuals, families))
    root = root_id if root_id is not None else P.pick_root(parents).first()["root_id"]
    walked = P.build(parents, spark.createDataFrame([(root,)], "root_id string"), generations)
    nodes = P.checkpoint(report.resolved_nodes(walked, report.births(individuals), resolver or default_resolver(spark)))
    gaps, links = P.checkpoint(walked.gaps), P.checkpoint(walked.links)
    return Analysis(root, generations, report.aggregate(nodes, gaps), people(nodes, individuals), links, gaps, individuals, families)


def analyze_text(spark: SparkSession, text: str, **options) -> Analysis:
    return analyze(GedcomText(spark, text), spark, **options)


def marquee(spark: SparkSession, rows=MARQUEE) -> DataFrame:
    """Today's country by name beside the polity of the time, for a few places."""
    keys = spark.createDataFrame([(p, y, None, None) for p, y in rows], "place string, year int, lat double, lng double")
    now = StubResolver(spark).resolve(keys).select("place", "year", F.coalesce("modern_country", F.lit("-")).alias("modern"))
    then = default_resolver(spark).resolve(keys).select("place", "year", F.coalesce("historical_polity", F.lit("-")).alias("historical"))
    return now.join(then, ["place", "year"])


def _shares(found: Analysis, grain: str) -> list[tuple[str, float]]:
    rows = found.report.breakdown.filter((F.col("granularity") == grain) & F.col("fractional").isNotNull()).orderBy("fractional_rank")
    return [(r["region"], r["fractional"]) for r in rows.select("region", "fractional").collect()]


def _head(found: Analysis, title: str) -> list[str]:
    nodes, lost = found.people, found.gaps
    n = nodes.agg(F.count("*").alias("n"), F.count_if("is_leaf").alias("leaves"), F.coalesce(F.max(F.array_max("depths")), F.lit(0)).alias("d")).first()
    g = lost.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()
    size = found.tree_size()
    pooled = nodes.filter("times_reached > 1").orderBy("path_key").select("name", "times_reached", "contribution_weight").collect()
    c = found.report.coverage.first()
    pct = present.percent_text
    out = ["=" * 64, f"  {title}", "=" * 64, f"parsed:    {size[0]} individuals, {size[1]} families", f"root:      {found.root_id}", f"pedigree:  {n['n']} ancestors, {n['leaves']} leaves, {g['n']} gap slot(s)"]
    out.append(f"depth:     deepest generation reached {max(0, n['d'], g['d'])} (cap {found.generations})")
    if pooled:
        out.append("collapse:  " + ", ".join(f"{r['name']} ×{r['times_reached']} ({pct(r['contribution_weight'])})" for r in pooled))
    return [*out, "", "COVERAGE (resolved + unresolved + gaps = 100%)", f"  resolved {pct(c['resolved_weight'])}  |  unresolved {pct(c['unresolved_weight'])}  |  unknown/gaps {pct(c['gap_weight'])}", ""]


def file_report(found: Analysis, title: str) -> str:
    """Counts, coverage, the eight largest shares and the ten most common unresolved birthplaces."""
    out = _head(found, title)
    out += [*present.shares_text("TOP FRACTIONAL - modern country (share of you):", _shares(found, "modernCountry"), 8), ""]
    out += [*present.shares_text("TOP FRACTIONAL - historical polity (at birth year):", _shares(found, "historicalPolity"), 8), ""]
    named = found.people.select("root_id", F.col("birth_place").alias("place"), F.col("lat").alias("coord_lat"), "path_key")
    lost = [(r["place"], r["people"]) for r in report.unresolved_birthplaces(named).orderBy("rank").collect()]
    title = "MOST COMMON UNRESOLVED BIRTHPLACES (have a string, no coordinates):"
    out += present.shares_text(title, lost, 10, lambda v: f"×{v}") if lost else [title, "  (none: every recorded birthplace resolved)"]
    return "\n".join(out)


def demo_report(spark: SparkSession, found: Analysis, title: str) -> str:
    """Coverage, all shares at three grains, and places at their time."""
    out = _head(found, title)
    for grain, name in (("modernCountry", "MODERN country (share of you)"), ("historicalPolity", "HISTORICAL polity (at each birth year)"), ("culturalRegion", "cultural region")):
        out += [*present.shares_text(f"FRACTIONAL by {name}:", _shares(found, grain)), ""]
    rows = {(r["place"], r["year"]): r for r in marquee(spark).collect()}
    out.append("TEMPORAL RESOLUTION (modern country vs polity at birth year):")
    out += [f"  {p.split(',')[0].ljust(12)} {y}  {rows[p, y]['modern'].ljust(14)} -> {rows[p, y]['historical']}" for p, y in MARQUEE]
    return "\n".join(out)


def arguments(argv: list[str]) -> argparse.Namespace:
    """path, root, gen; --root X and --root=X alike, gen is rounded down and not below 0."""

    def generations(text: str) -> int:
        try:
            value = float(text)
        except ValueError:
            value = -1.0
        if not 0 <= value < float("inf"):
            raise argparse.ArgumentTypeError(f'expects a non-negative number, got "{text}"')
        return int(value)

    parser = argparse.ArgumentParser("kinweave", allow_abbrev=False)
    parser.add_argument("path")
    parser.add_argument("--root")
    parser.add_argument("--gen", type=generations, default=GENERATIONS)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    given = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    try:
        found = analyze(GedcomFile(spark, given.path), spark, given.root, given.gen)
    except AnalysisException:
        print(f'cannot read file "{given.path}"', file=sys.stderr)
        return 1
    print(file_report(found, given.path))
    return 0
