"""The engine's queries over the tree derived from the customer table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.catalog_sql import oracle_sql
from kinweave.functions.measures import distance_km, share_label
from kinweave.functions.text import display_name, is_approximate, parse_coord, parse_name, parse_year
from kinweave.operators import layers, pedigree, present, report
from kinweave.operators import resolve as R
from kinweave.plans import analyze, derived
from kinweave.sources import gedcom, reference

__all__ = ["oracle_sql", "queries"]

GENERATIONS = 8


def _parents(people: DataFrame) -> DataFrame:
    return people.select("id", "seq", "father", "mother")


def _walked(spark: SparkSession, people: DataFrame, cap: int = GENERATIONS) -> pedigree.Pedigree:
    root = spark.createDataFrame([(0,)], "root_id long")
    return pedigree.build(_parents(people), root, cap)


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pedigree.Pedigree]:
    people = derived.people(spark, sf_dir)
    walked = _walked(spark, people)
    births = people.select("id", "place", "year", "lat", "lng")
    return pedigree.checkpoint(report.resolved_nodes(walked, births, R.default_resolver(spark))), walked


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pedigree.Pedigree]:
    nodes, walked = _nodes(spark, sf_dir)
    return analyze.people(nodes, derived.people(spark, sf_dir)), walked


def _text(column: str, order: str | None = None):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def parent_edges(spark, sf_dir):
    return pedigree.edges(_parents(derived.people(spark, sf_dir)))


def pedigree_nodes(spark, sf_dir):
    return _walked(spark, derived.people(spark, sf_dir)).nodes.select("id", "times_reached", "contribution_weight", "leaf_weight", "is_leaf", _text("depths"))


def person_lookup(spark, sf_dir):
    """One person of the walk, by id."""
    nodes = _walked(spark, derived.people(spark, sf_dir)).nodes
    return present.find_person(nodes, 11).select("id", "times_reached", "contribution_weight", "is_leaf")


def pedigree_gaps(spark, sf_dir):
    return _walked(spark, derived.people(spark, sf_dir)).gaps.select("id", "missing_parent_of", "slot", "depth", "contribution_weight")


def pedigree_cycle(spark, sf_dir):
    return _walked(spark, derived.cyclic(derived.people(spark, sf_dir))).gaps.select("missing_parent_of", "slot", "depth", "contribution_weight")


def pedigree_links(spark, sf_dir):
    return _walked(spark, derived.people(spark, sf_dir)).links.select("child_id", "parent_id")


def pedigree_counts(spark, sf_dir):
    nodes, walked = _nodes(spark, sf_dir)
    return report.pedigree_counts(nodes, walked.gaps).drop("root_id")


def coverage_budget(spark, sf_dir):
    nodes, walked = _nodes(spark, sf_dir)
    return report.coverage(nodes, walked.gaps).drop("root_id")


def coverage_all_roots(spark, sf_dir):
    """The walk from every person at once: people reached, leaf weight and gap weight of each."""
    parents = pedigree.checkpoint(_parents(derived.people(spark, sf_dir)))
    walked = pedigree.build(parents, parents.select(F.col("id").alias("root_id")), GENERATIONS)
    own = walked.nodes.groupBy("root_id").agg(F.count("*").alias("persons"), F.sum("leaf_weight").alias("leaf_weight"))
    lost = walked.gaps.groupBy("root_id").agg(F.sum("contribution_weight").alias("gap_weight"))
    return own.join(lost, "root_id", "left").select("root_id", "persons", "leaf_weight", F.coalesce("gap_weight", F.lit(0.0)).alias("gap_weight"))


def coverage_looped_roots(spark, sf_dir):
    """The same over a tree with cycles: what closes one is a gap, and only people on cycles keep what their paths have met."""
    parents = pedigree.checkpoint(_parents(derived.looped(derived.people(spark, sf_dir))))
    walked = pedigree.build(parents, parents.select(F.col("id").alias("root_id")), GENERATIONS, "pooled")
    own = walked.nodes.groupBy("root_id").agg(F.count("*").alias("persons"), F.sum("times_reached").alias("visits"), F.sum("leaf_weight").alias("leaf_weight"))
    lost = walked.gaps.groupBy("root_id").agg(F.sum("contribution_weight").alias("gap_weight"))
    return own.join(lost, "root_id", "left").select("root_id", "persons", "visits", "leaf_weight", F.coalesce("gap_weight", F.lit(0.0)).alias("gap_weight"))


def looped_closure_counts(spark, sf_dir):
    """Ancestors of everybody in a tree with cycles; whoever is on one is an own ancestor."""
    return pedigree.ancestor_counts(_parents(derived.looped(derived.people(spark, sf_dir)))).select("id", "ancestors")


def ancestor_closure_counts(spark, sf_dir):
    return pedigree.ancestor_counts(_parents(derived.people(spark, sf_dir))).select("id", "ancestors")


def pick_root(spark, sf_dir):
    return pedigree.pick_root(_parents(derived.people(spark, sf_dir)))


def fractional_shares(spark, sf_dir):
    rows = report.breakdown(_nodes(spark, sf_dir)[0]).filter("fractional is not null")
    return rows.select("granularity", "region", F.col("fractional").alias("value"), F.col("fractional_rank").alias("rank"))


def headcount_shares(spark, sf_dir):
    return report.breakdown(_nodes(spark, sf_dir)[0]).select("granularity", "region", F.col("headcount").alias("value"), F.col("headcount_rank").alias("rank"))


def place_variants(spark, sf_dir):
    return report.place_variants(_nodes(spark, sf_dir)[0]).select("region", _text("variants"))


def _keys(spark, sf_dir):
    return derived.people(spark, sf_dir).select("id", "place", "year", "lat", "lng")


def stub_resolve(spark, sf_dir):
    return R.resolve_rows(_keys(spark, sf_dir), R.StubResolver(spark)).select("id", "modern_country", "historical_polity", "cultural_region", "confidence", "provenance")


def geocode_first_token(spark, sf_dir):
    places = _keys(spark, sf_dir).select("place", F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")).distinct()
    found = R.geocode(places, reference.gazetteer_index(reference.gazetteer(spark)))
    return found.filter("hit is not null").select("place", F.col("hit.token").alias("token"), "hit.entry.lat", "hit.entry.lng", "hit.entry.country_code", "hit.entry.modern_country")


def canonical_country(spark, sf_dir):
    rows = _keys(spark, sf_dir).select("id", R.country_token("place").alias("raw"))
    return rows.withColumn("canonical", R.canonical_country("raw")).withColumn("changed", F.coalesce(F.col("canonical") != F.col("raw"), F.lit(False)))


def snapshot_asof(spark, sf_dir):
    return R.snapshot_year(_keys(spark, sf_dir).filter("year is not null").select("id", "year"), reference.polities(spark))


def snapshot_asof_many(spark, sf_dir):
    """Every customer's number of days among snapshots at the numbers of every fifth customer."""
    people = derived.people(spark, sf_dir)
    held = people.filter("k % 5 = 2").select((F.col("k") * 104_729 % 1_000_003).cast("int").alias("snapshot"))
    return R.as_of(people.select("id", (F.col("k") * 7919 % 1_000_003 - 5).cast("int").alias("day")), held, "day", "snapshot")


def country_in_coasts(spark, sf_dir):
    """Points in rings of a third of all customers each."""
    people = derived.people(spark, sf_dir)
    return R.country_at(people.filter("lat is not null").select("id", "lat", "lng"), derived.coasts(people)).select("id", "point_country")


def temporal_pip(spark, sf_dir):
    keys = _keys(spark, sf_dir).filter("lat is not null and year is not null").select("id", "year", "lat", "lng")
    return R.polity_at(keys, reference.polities(spark), "lat", "lng").select("id", "polity.subjecto", "polity.part_of", "polity.snapshot_year")


def country_at_point(spark, sf_dir):
    return R.country_at(_keys(spark, sf_dir).filter("lat is not null").select("id", "lat", "lng"), reference.borders(spark)).select("id", "point_country")


def country_in_rings(spark, sf_dir):
    """Points in polygons with holes, of several parts and with slanted edges."""
    shapes = reference.borders_from_rings(spark, derived.SHAPES)
    return R.country_at(_keys(spark, sf_dir).filter("lat is not null").select("id", "lat", "lng"), shapes).select("id", "point_country")


def coord_contradiction(spark, sf_dir):
    rows = _keys(spark, sf_dir).filter("lat is not null").withColumn("country", R.canonical_country(R.country_token("place")))
    return R.contradicts(rows, reference.borders(spark), "country").select("id", "country", "point_country", "string_known", "contradicts")


def ancient_rule(spark, sf_dir):
    rows = _keys(spark, sf_dir).filter("lat is not null")
    return rows.select("id", R.ancient_contradiction("place", "lat", "lng").alias("ancient"))


def historical_resolve(spark, sf_dir):
    columns = ("coord_lat", "coord_lng", "modern_country", "modern_country_raw", "historical_polity", "cultural_region", "confidence", "border_precision", "provenance")
    return R.resolve_rows(_keys(spark, sf_dir), R.default_resolver(spark)).select("id", *columns)


def parse_gdate(spark, sf_dir):
    rows = derived.people(spark, sf_dir).select("id", derived.pick(derived.DATES).alias("raw"))
    return rows.withColumns({"year": parse_year("raw"), "approximate": is_approximate("raw")})


def parse_coords(spark, sf_dir):
    rows = derived.people(spark, sf_dir).select("id", derived.pick(derived.COORDS).alias("raw"))
    return rows.withColumn("value", parse_coord("raw"))


def parse_names(spark, sf_dir):
    rows = derived.people(spark, sf_dir).select("id", derived.pick(derived.NAMES).alias("raw"))
    return rows.withColumn("name", parse_name("raw")).select("id", "raw", "name.given", "name.surname")


def gedcom_individuals(spark, sf_dir):
    people = gedcom.scan(derived.files(derived.people(spark, sf_dir)))[0]
    birth = F.col("events")[0]
    return people.select(
        "id", "given", "surname", "sex", F.size("events").alias("n_events"), birth["date"]["year"].alias("year"), birth["place"].alias("place"),
        birth["coords"]["lat"].alias("lat"), birth["coords"]["lng"].alias("lng"), F.get("famc", F.lit(0)).alias("famc"),
    )


def gedcom_families(spark, sf_dir):
    return gedcom.scan(derived.files(derived.people(spark, sf_dir)))[1].select("id", "husband", "wife", _text("children"))


def gedcom_parents(spark, sf_dir):
    """Parents as the scanned records of one tree tell them, against those that the records were made from."""
    people, families = gedcom.scan(derived.records(derived.people(spark, sf_dir), trees=1))
    return pedigree.parents(people, families).select("id", "father", "mother")


def display_names(spark, sf_dir):
    return derived.people(spark, sf_dir).select("id", display_name("given", "surname", F.col("id").cast("string")).alias("name"))


def first_birth(spark, sf_dir):
    people = gedcom.scan(derived.files(derived.people(spark, sf_dir)))[0]
    return report.births(people)


def depth_filter(spark, sf_dir):
    return layers.filter_by_depth(_shown(spark, sf_dir)[0], 4).select("id", "min_depth")


def placed_filter(spark, sf_dir):
    return layers.placed(_shown(spark, sf_dir)[0]).select("id", "lat", "lng")


def spread_overlaps(spark, sf_dir):
    return layers.spread_overlaps(layers.placed(_shown(spark, sf_dir)[0])).select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def map_points(spark, sf_dir):
    people, walked = _shown(spark, sf_dir)
    points = layers.build_layers(people, walked.links, GENERATIONS)[0]
    return points.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "weight", "depth", "is_leaf", "label", "region")


def _arcs(spark, sf_dir):
    people, walked = _shown(spark, sf_dir)
    return layers.build_layers(people, walked.links, GENERATIONS)[1].withColumn("distance_km", F.round("distance_km", 3))


def migration_arcs(spark, sf_dir):
    return _arcs(spark, sf_dir).select("child_id", "parent_id", "weight", "depth", "distance_km", "long_haul", "region")


def isolate_arcs(spark, sf_dir):
    return layers.isolate_arcs(_arcs(spark, sf_dir), ["Norway", "Finland"]).select("child_id", "parent_id", "region")


def isolate_points(spark, sf_dir):
    people = layers.placed(_shown(spark, sf_dir)[0]).withColumn("region", F.col("modern_country"))
    return layers.isolate_points(people, ["Norway", "Finland"]).select("id", "region", "included")


def great_circle(spark, sf_dir):
    rows = _keys(spark, sf_dir).filter("lat is not null")
    return rows.select("id", F.round(distance_km("lat", "lng", F.lit(51.5), F.lit(-0.12)), 3).alias("km"))


def unresolved_top10(spark, sf_dir):
    return report.unresolved_birthplaces(_nodes(spark, sf_dir)[0]).filter("rank <= 10").select("place", "people", "rank")


def deepest_generation(spark, sf_dir):
    nodes, walked = _nodes(spark, sf_dir)
    return report.deepest_generation(nodes, walked.gaps).select("deepest")


def slider_ceiling(spark, sf_dir):
    nodes, walked = _nodes(spark, sf_dir)
    return report.deepest_generation(nodes, walked.gaps, floor=8).select(F.col("deepest").alias("ceiling"))


def top_shares_with_rest(spark, sf_dir):
    return present.top_shares(report.breakdown(_nodes(spark, sf_dir)[0]), "historicalPolity", 8).drop("root_id")


def coverage_hundred_pct(spark, sf_dir):
    nodes, walked = _nodes(spark, sf_dir)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part_no"), F.lit(n).alias("part"), F.expr(e).alias("weight")) for i, (n, e) in enumerate((("resolved", "resolved_weight"), ("unknown", "unresolved_weight + gap_weight")))]))
    rows = report.coverage(nodes, walked.gaps).select("root_id", parts.alias("p")).select("root_id", "p.*")
    return present.hundred_percent(rows, ["root_id"], "part_no", "weight").select("part", "weight", "percent")


def share_labels(spark, sf_dir):
    rows = _walked(spark, derived.people(spark, sf_dir)).nodes
    return rows.select("id", share_label("contribution_weight").alias("label"))


def range_select(spark, sf_dir):
    return present.range_select(report.breakdown(_nodes(spark, sf_dir)[0]), "modernCountry", "Norway", "Finland").select("rank", "region")


def variants_of_people(spark, sf_dir):
    nodes, _ = _nodes(spark, sf_dir)
    return present.variants_of(nodes, report.place_variants(nodes)).select("id", _text("variants"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        parent_edges, pedigree_nodes, person_lookup, pedigree_gaps, pedigree_cycle, pedigree_links, pedigree_counts, coverage_budget, coverage_all_roots,
        ancestor_closure_counts, pick_root, fractional_shares, headcount_shares, place_variants, stub_resolve, geocode_first_token, canonical_country,
        coverage_looped_roots, looped_closure_counts, snapshot_asof, snapshot_asof_many, temporal_pip, country_at_point, country_in_rings, country_in_coasts, coord_contradiction, ancient_rule, historical_resolve, parse_gdate, parse_coords, parse_names,
        gedcom_individuals, gedcom_families, gedcom_parents, display_names, first_birth, depth_filter, placed_filter, spread_overlaps, map_points,
        migration_arcs, isolate_arcs, isolate_points, great_circle, unresolved_top10, deepest_generation, slider_ceiling, top_shares_with_rest,
        coverage_hundred_pct, share_labels, range_select, variants_of_people,
    )
    return {f.__name__: f for f in every}
