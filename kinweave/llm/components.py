"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import checkpoint, rekeyed


#: Links that are contracted at once at least, and that a partition holds at most.
CHUNK, MOST_HELD = 500_000, 2_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links connect to a smaller one, and the smallest it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces a partition's links by links to the smallest node that they connect to; fewer than it has nodes.

    What is held is contracted whenever it has doubled, so time is linear but for sorting, and given away at ``MOST_HELD``.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, limit = 0, CHUNK
    for rows in batches:
        held.append((rows["a"].to_numpy(), rows["b"].to_numpy()))
        n += len(rows)
        if n > limit:
            held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n = len(held[0][0])
            if n > MOST_HELD:
                yield pd.DataFrame(dict(zip("ab", held[0], strict=True)))
                held, n = [], 0
            limit = max(CHUNK, 2 * n)
    if held:
        a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pd.DataFrame({"a": a, "b": b})


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return links.select(F.col("b").alias("u"), "a").join(rekeyed(low, "u"), "u").select("a", F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    return links.join(rekeyed(low, "a"), "a").select(F.inline(F.filter(ends, lambda x: x["a"] != x["b"]))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node connected to it) for every node of ``links`` (a > b, long) but the smallest ones.

    Alternating large-star and small-star rounds, about the logarithm of the longest chain; each star is written to the
    shared folder, as its rows are read twice. Only whether a round was the last comes to the driver.
    """
    # partitions of a dense group find the same smallest node, so few different links are left of it
    links = checkpoint(links.select("a", "b").mapInPandas(_contract, "a long, b long").distinct())
    while True:
        ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        links = checkpoint(_small_star(checkpoint(_large_star(links))))
