"""Look-ups by key that keep rows as they are, and ranks that no single task has to give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.shared import checkpoint


def look_up(rows: DataFrame, on: dict[str, Column], find: Callable[[DataFrame], DataFrame], *values: str) -> DataFrame:
    """``rows`` with columns ``values`` that ``find`` works out once for each distinct key (``on``: names and expressions).

    Every row stays, repeated ones too, and keys that are null are keys like others. Columns of the rows lie in a struct
    meanwhile, so none can clash with a key; one of the name of a value is replaced. Keys are joined by their hash and
    themselves, by which neither side is dealt yet, so Spark can split the rows of a hot key.
    """
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c not in values]
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[x.alias(k) for k, x in on.items()])
    found = find(held.select(*on).distinct()).select(*on, *values)
    found = found.select(F.xxhash64(*on).alias("found_hash"), *[F.col(k).alias(f"found_{k}") for k in on], *values)
    held = held.withColumn("hash", F.xxhash64(*on))
    same = F.col("hash") == F.col("found_hash")
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"found_{k}"))
    return held.join(found, same, "left").select(*kept, *values)


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column has them."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ranked(rows: DataFrame, by: list[Column], order: list[tuple[Column, bool]], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with column ``name``: their number from 0 within the group of ``by``, by ``order`` (values, and whether from the greatest down).

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks. A row's number is its place
    in its range, plus the rows of its group in the ranges before; there is one count for each range and group in it.
    The order must tell the rows of a group apart, or ties are numbered in any order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"by{i}" for i in range(len(by))]
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[x.alias(k) for k, x in zip(keys, by, strict=True)], *[x.alias(f"order{i}") for i, (x, _) in enumerate(order)])
    sort = [F.col(k) for k in keys] + [F.col(f"order{i}").desc() if down else F.col(f"order{i}") for i, (_, down) in enumerate(order)]
    dealt = held.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    place = F.monotonically_increasing_id()
    dealt = checkpoint(dealt.select("row", *keys, F.shiftrightunsigned(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    counts = dealt.groupBy("part", *keys).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.xxhash64("part", *keys).alias("hash"), F.col("part").alias("found_part"), *[F.col(k).alias(f"found_{k}") for k in keys], (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    same = (F.xxhash64("part", *keys) == F.col("hash")) & (F.col("part") == F.col("found_part"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"found_{k}"))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c != name]
    return dealt.join(shift, same).select(*kept, (F.col("place") + F.col("shift")).alias(name))

