"""Shares, headcounts and the coverage budget of walked pedigrees; every frame is keyed by root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.pedigree import Pedigree
from kinweave.operators.resolve import Resolver, resolve_rows

GRAINS = {"modernCountry": "modern_country", "historicalPolity": "historical_polity", "culturalRegion": "cultural_region"}


@dataclass(frozen=True)
class Report:
    """coverage: root_id, resolved_weight, unresolved_weight, gap_weight (their sum is 1). breakdown: root_id, granularity,
    region, fractional, headcount, fractional_rank, headcount_rank. place_variants: root_id, region, variants."""

    coverage: DataFrame
    breakdown: DataFrame
    place_variants: DataFrame


def births(individuals: DataFrame) -> DataFrame:
    """id, place, year, lat, lng of each person's first birth event, even if that is empty."""
    birth = F.try_element_at(F.filter("events", lambda e: e["type"] == "BIRT"), F.lit(1))
    return individuals.select("id", birth.alias("b")).select("id", F.col("b.place").alias("place"), F.col("b.date.year").alias("year"), F.col("b.coords.lat").alias("lat"), F.col("b.coords.lng").alias("lng"))


def resolved_nodes(pedigree: Pedigree, births_: DataFrame, resolver: Resolver) -> DataFrame:
    return resolve_rows(pedigree.nodes.join(births_, "id"), resolver)


def coverage(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """Leaf weight with and without a country, and the weight of gaps; leaves without a birthplace are unresolved."""
    known = F.col("modern_country").isNotNull()
    part = lambda where: F.sum(F.when(F.col("is_leaf") & where, F.col("leaf_weight")).otherwise(0.0))
    own = nodes.groupBy("root_id").agg(part(known).alias("resolved_weight"), part(~known).alias("unresolved_weight"))
    lost = gaps.groupBy("root_id").agg(F.sum("contribution_weight").alias("gap_weight"))
    return own.join(lost, "root_id", "left").select("root_id", "resolved_weight", "unresolved_weight", F.coalesce("gap_weight", F.lit(0.0)).alias("gap_weight"))


def breakdown(nodes: DataFrame) -> DataFrame:
    """Leaf weight and headcount by region at three grains in one aggregation; ties rank in the order of first visit."""
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(c).alias("region")) for g, c in GRAINS.items()]))
    rows = nodes.filter("modern_country is not null").select("root_id", "is_leaf", "leaf_weight", "path_key", grains.alias("g")).select("*", "g.*").filter("region <> ''")
    leaf = F.col("is_leaf")
    sums = rows.groupBy("root_id", "granularity", "region").agg(
        F.sum(F.when(leaf, F.col("leaf_weight"))).alias("fractional"), F.count("*").alias("headcount"),
        F.min(F.when(leaf, F.col("path_key"))).alias("first_leaf"), F.min("path_key").alias("first"),
    )
    of = Window.partitionBy("root_id", "granularity")
    by_share = F.row_number().over(of.orderBy(F.col("fractional").desc_nulls_last(), "first_leaf", "region")).cast("long")
    return sums.select(
        "root_id", "granularity", "region", "fractional", "headcount", F.when(F.col("fractional").isNotNull(), by_share).alias("fractional_rank"),
        F.row_number().over(of.orderBy(F.col("headcount").desc(), "first", "region")).cast("long").alias("headcount_rank"),
    )


def place_variants(nodes: DataFrame) -> DataFrame:
    """For each country the names that were folded into it, sorted."""
    folded = nodes.filter((F.col("modern_country") != "") & (F.col("modern_country_raw") != "") & (F.col("modern_country_raw") != F.col("modern_country")))
    return folded.groupBy("root_id", F.col("modern_country").alias("region")).agg(F.array_sort(F.collect_set("modern_country_raw")).alias("variants"))


def aggregate(nodes: DataFrame, gaps: DataFrame) -> Report:
    return Report(coverage(nodes, gaps), breakdown(nodes), place_variants(nodes))


def deepest_generation(nodes: DataFrame, gaps: DataFrame, floor: int = 0) -> DataFrame:
    """Greatest depth of nodes and gaps of each root, ``floor`` at least."""
    depths = nodes.select("root_id", F.array_max("depths").alias("depth")).unionByName(gaps.select("root_id", "depth"))
    return depths.groupBy("root_id").agg(F.greatest(F.lit(floor), F.max("depth")).alias("deepest"))


def pedigree_counts(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    own = nodes.groupBy("root_id").agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.count_if(F.col("times_reached") > 1).alias("collapsed"))
    lost = gaps.groupBy("root_id").agg(F.count("*").alias("gaps"))
    return own.join(lost, "root_id", "left").select("root_id", "nodes", "leaves", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "collapsed")


def unresolved_birthplaces(nodes: DataFrame) -> DataFrame:
    """Birthplaces that have a text but no point: root_id, place, people, rank (most first, ties by first visit)."""
    rows = nodes.filter((F.col("place") != "") & F.col("coord_lat").isNull()).groupBy("root_id", "place").agg(F.count("*").alias("people"), F.min("path_key").alias("first"))
    rank = F.row_number().over(Window.partitionBy("root_id").orderBy(F.col("people").desc(), "first")).cast("long")
    return rows.select("root_id", "place", "people", rank.alias("rank"))
