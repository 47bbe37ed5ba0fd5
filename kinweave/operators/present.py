"""What is shown of a report: top lists, labels, percentages, selections, and the text of the console reports."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.measures import share_label


def hundred_percent(weights: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """Adds percent: tenths that sum to exactly 100 within ``by``; the largest remainders are rounded up, ties by ``order``."""
    of = Window.partitionBy(*by)
    total = F.sum(weight).over(of)
    tenths = F.col(weight) / F.when(total == 0, 1.0).otherwise(total) * 1000
    rows = weights.withColumn("tenths", tenths).withColumn("floor", F.floor("tenths"))
    left = 1000 - F.sum("floor").over(of)
    rank = F.row_number().over(of.orderBy((F.col("tenths") - F.col("floor")).desc(), order))
    n = F.count("*").over(of)
    rows = rows.withColumns({"left": left, "rank": rank, "n": n})
    extra = F.floor((F.col("left") - F.col("rank") + F.col("n")) / F.col("n"))
    return rows.withColumn("percent", (F.col("floor") + F.greatest(extra, F.lit(0))) / 10).drop("tenths", "floor", "left", "rank", "n")


def top_shares(breakdown: DataFrame, granularity: str, top: int) -> DataFrame:
    """The largest shares and how many more there are: root_id, rank, region, fractional, hidden."""
    rows = breakdown.filter((F.col("granularity") == granularity) & F.col("fractional").isNotNull())
    hidden = F.greatest(F.count("*").over(Window.partitionBy("root_id")) - top, F.lit(0)).alias("hidden")
    return rows.select("root_id", F.col("fractional_rank").alias("rank"), "region", "fractional", hidden).filter(F.col("rank") <= top)


def labels(breakdown: DataFrame, granularity: str) -> DataFrame:
    rows = breakdown.filter((F.col("granularity") == granularity) & F.col("fractional").isNotNull())
    return rows.select("root_id", "region", share_label("fractional").alias("label"))


def range_select(breakdown: DataFrame, granularity: str, anchor: str, clicked: str) -> DataFrame:
    """Regions from the anchor to the clicked one, in either direction, in the order of shares; none if one isn't listed."""
    rows = breakdown.filter((F.col("granularity") == granularity) & F.col("fractional").isNotNull())
    at = lambda name: F.max(F.when(F.col("region") == name, F.col("fractional_rank"))).over(Window.partitionBy("root_id"))
    rows = rows.withColumns({"a": at(anchor), "b": at(clicked)}).filter("a is not null and b is not null")
    return rows.filter(F.col("fractional_rank").between(F.least("a", "b"), F.greatest("a", "b"))).select("root_id", F.col("fractional_rank").alias("rank"), "region")


def toggle(selected: set[str], region: str) -> set[str]:
    """Adds a region to a selection, or takes it out."""
    return selected ^ {region}


def find_person(people: DataFrame, id_) -> DataFrame:
    """The row of one person for each root, none if the id isn't there or is null."""
    return people.filter(F.col("id") == F.lit(id_))


def variants_of(people: DataFrame, place_variants: DataFrame) -> DataFrame:
    """People with the names folded into their country; an empty list where there are none."""
    known = place_variants.select("root_id", F.col("region").alias("modern_country"), "variants")
    return people.join(known, ["root_id", "modern_country"], "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))


def percent_text(x: float) -> str:
    return f"{Decimal(x * 100).quantize(Decimal('0.1'), ROUND_HALF_UP)}%"


def shares_text(title: str, rows: list[tuple[str, float]], top: int | None = None, value=percent_text) -> list[str]:
    """Lines of a table of shares; what is beyond ``top`` is only counted."""
    if not rows:
        return [title, "  (none)"]
    shown = rows if top is None else rows[:top]
    width = max(len(r) for r, _ in shown)
    out = [title, *(f"  {r.ljust(width)}  {value(v)}" for r, v in shown)]
    return out + [f"  …and {len(rows) - len(shown)} more"] * (len(rows) > len(shown))
