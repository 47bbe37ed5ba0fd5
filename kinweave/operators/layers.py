"""Points and migration arcs for a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.measures import cell, distance_km, spread_lat, spread_lng
from kinweave.operators.keyed import free_names, ranked

#: Least weight of an arc, of a long one, and from how many km on an arc is long.
ARC_WEIGHT, LONG_WEIGHT, LONG_KM = 0.002, 0.0001, 1500
#: Fixed value: below this camera altitude no arc is shown.
LEAST_ALTITUDE = 0.45


def filter_by_depth(people: DataFrame, depth: int) -> DataFrame:
    return people.filter(F.col("min_depth") <= depth)


def placed(people: DataFrame) -> DataFrame:
    return people.filter("lat is not null and lng is not null")


def spread_overlaps(people: DataFrame) -> DataFrame:
    """People at one spot are moved apart on a spiral: the heaviest stays, the others step outwards by weight, then order of visit.

    Ranks within a spot are given over ranges of its people, so a crowded one is no single task.
    """
    rank, = free_names(people, "rank")
    rows = ranked(people, [F.col("root_id"), cell("lat"), cell("lng")], [(F.col("contribution_weight"), True), (F.col("path_key"), False)], rank)
    moved = F.col(rank) > 0
    return rows.withColumns({"lng": F.when(moved, spread_lng("lat", "lng", rank)).otherwise(F.col("lng")), "lat": F.when(moved, spread_lat("lat", rank)).otherwise(F.col("lat"))}).drop(rank)


def to_points(people: DataFrame) -> DataFrame:
    year = F.when(F.col("birth_year") != 0, F.concat(F.lit(" ("), F.col("birth_year").cast("string"), F.lit(")"))).otherwise("")
    label = F.concat("name", F.lit(" — "), F.coalesce("birth_place", F.lit("unknown")), F.coalesce(year, F.lit("")))
    return people.select("root_id", "id", "lat", "lng", F.col("contribution_weight").alias("weight"), F.col("min_depth").alias("depth"), "is_leaf", label.alias("label"), F.col("modern_country").alias("region"))


def to_arcs(people: DataFrame, links: DataFrame) -> DataFrame:
    """Arcs from child to parent, both placed: heavy ones, and long ones down to a lower weight."""
    end = lambda side: people.select("root_id", F.col("id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lng").alias(f"{side}_lng"), *([F.col("contribution_weight").alias("weight"), F.col("min_depth").alias("depth"), F.col("modern_country").alias("region")] if side == "parent" else []))
    arcs = links.select("root_id", "child_id", "parent_id").join(end("child"), ["root_id", "child_id"]).join(end("parent"), ["root_id", "parent_id"])
    arcs = arcs.withColumn("distance_km", distance_km("child_lat", "child_lng", "parent_lat", "parent_lng"))
    arcs = arcs.withColumn("long_haul", F.col("distance_km") >= LONG_KM)
    arcs = arcs.filter((F.col("weight") >= ARC_WEIGHT) | (F.col("long_haul") & (F.col("weight") >= LONG_WEIGHT)))
    return arcs.select("root_id", "child_id", "parent_id", F.col("child_lat").alias("start_lat"), F.col("child_lng").alias("start_lng"), F.col("parent_lat").alias("end_lat"), F.col("parent_lng").alias("end_lng"), "weight", "depth", "distance_km", "long_haul", "region")


def build_layers(people: DataFrame, links: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(points, arcs) of the people within a depth."""
    seen = spread_overlaps(placed(filter_by_depth(people, depth)))
    return to_points(seen), to_arcs(seen, links)


def isolate_arcs(arcs: DataFrame, regions: list[str]) -> DataFrame:
    """Arcs whose region is selected; no selection keeps all."""
    return arcs.filter(F.col("region").isin(*regions)) if regions else arcs


def isolate_points(points: DataFrame, regions: list[str]) -> DataFrame:
    """Points with included: whether their region is selected; others are dimmed, not removed."""
    return points.withColumn("included", F.coalesce(F.col("region").isin(*regions), F.lit(False)) if regions else F.lit(True))


def visible_arcs(arcs: DataFrame, altitude: float) -> DataFrame:
    """All arcs, or none if the camera is too close."""
    return arcs if altitude >= LEAST_ALTITUDE else arcs.limit(0)
