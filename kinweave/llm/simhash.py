"""SimHash near-duplicates through an inverted index of fingerprint bytes by position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import similar
from kinweave.llm.common import BROADCAST_ROWS, checkpoint, numbered, rekeyed, row_number, text_of, without
from kinweave.llm.components import components, stars

#: Members of a posting list that are compared at once; longer ones are walked from link to link, and much longer ones dealt over blocks.
SHORT, BLOCK = 64, 16_384


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. seeds: of the hashes, each giving 64 bits of the fingerprint. bits: that may differ.
    shared: positional bytes that a pair must share. key: positions of a posting list's key, of ``positions`` first ones."""

    words: int = 4
    seeds: tuple[int, ...] = (42,)
    bits: int = 4
    shared: int = 4
    key: int = 3
    positions: int = 7

    def keys(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.positions), self.key))


#: 64 bits of which 4 may differ: a pair shares 4 of 8 positional bytes at least, so 3 of any 7.
EXACT = Settings()
#: 64 bits of which 6 may differ: a pair shares 2 of 8 positional bytes at least. For sets of five-word shingles, before their exact check.
SIMILAR = Settings(words=5, bits=6, shared=2, key=2, positions=8)


def fingerprint(text: str, words: int, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """64 bits for each seed; bit b is 1 if it is set in over half of the shingles' XXH64. 0 without words."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(len(seeds), np.uint64)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(own) - words + 1)
    hash_ = xxhash.xxh64_intdigest
    sums, last = np.zeros((len(seeds), 64), np.int64), end[words - 1 :] if len(own) >= words else end[-1:]
    for at in range(0, n, 65_536):
        shingles = [joined[b:e] for b, e in zip(begin[at : min(n, at + 65_536)].tolist(), last[at : at + 65_536].tolist(), strict=True)]
        for k, seed in enumerate(seeds):
            hashes = np.array([hash_(x, seed) for x in shingles], "<u8")
            sums[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = np.array([fingerprint(x, settings.words, settings.seeds) for x in rows.pop("text")], np.uint64).reshape(len(rows), -1)
            yield rows.assign(**{f"fp{k}": found[:, k].view(np.int64) if len(rows) else [] for k in range(len(settings.seeds))})

    return run


def near(one: np.ndarray, many: np.ndarray, settings: Settings = EXACT) -> np.ndarray:
    """The count filter, then the check: which fingerprints (rows) share enough positional bytes and differ in few bits."""
    differ = np.ascontiguousarray(one ^ many)
    tally = (differ.view(np.uint8) == 0).sum(axis=1)
    return (tally >= settings.shared) & (np.bitwise_count(differ).sum(axis=1) <= settings.bits)


def forest(node: np.ndarray, fp: np.ndarray, settings: Settings = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the linked pairs of one posting list connect, fewer than there are members.

    A member that is linked leaves those still to be reached, so groups of copies take a few passes, not all pairs.
    """
    out, rest = [], np.arange(1, len(node))
    queue = [0]
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        at = queue.pop()
        hit = near(fp[at], fp[rest], settings)
        if hit.any():
            out.append((np.full(int(hit.sum()), node[at]), node[rest[hit]]))
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return out


def within(key: np.ndarray, node: np.ndarray, fp: np.ndarray, settings: Settings = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links in whole posting lists, sorted by key: all pairs of short lists, at growing distances; long ones by ``forest``."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    length = np.diff(edge)
    short = np.repeat(length <= SHORT, length)
    out = []
    for step in range(1, min(SHORT, int(length.max(initial=1)))):
        at = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        hit = at[near(fp[at], fp[at + step], settings)]
        out.append((node[hit], node[hit + step]))
    for b, n in zip(edge[:-1][length > SHORT], length[length > SHORT], strict=True):
        out += forest(node[b : b + n], fp[b : b + n], settings)
    return out


def _linker(settings: Settings):
    """Walks posting lists that come sorted by key and gives the links in each; a list may span batches."""
    names = [f"fp{k}" for k in range(len(settings.seeds))]

    def rows(lists):
        links = within(*(np.concatenate(x) for x in zip(*lists, strict=True)), settings)
        if links:  # of a batch's lists only what connects their nodes
            a, b = stars(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not len(batch):
                continue
            key, node = batch["key"].to_numpy(), batch["node"].to_numpy()
            fp = np.ascontiguousarray(batch[names].to_numpy(np.int64)).view(np.uint64)
            last = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if last:
                yield from rows([*held, (key[:last], node[:last], fp[:last])])
                held = []
            elif held and held[0][0][0] != key[0]:
                yield from rows(held)
                held = []
            held.append((key[last:], node[last:], fp[last:]))
        if held:
            yield from rows(held)

    return link


def links(nodes: DataFrame, settings: Settings = EXACT) -> DataFrame:
    """Links (a > b) that connect all nodes (node, fp0, ..) whose fingerprints differ in few enough bits.

    The inverted index has a posting list for every value of every ``key`` of the first ``positions`` byte positions,
    rather than of single ones: a pair that shares the guaranteed bytes is in such a list together, and lists of one
    position would hold a 256th of all fingerprints. A pair's shared bytes are tallied over all positions. A list of more
    than ``BLOCK`` members is dealt over blocks, and each pair of blocks is a list of its own.
    """
    byte = lambda i: F.shiftright(F.col(f"fp{i // 8}"), 8 * (i % 8)).bitwiseAND(255)

    def key(number: int, at: tuple[int, ...]):
        out = F.lit(number).cast("long")
        for i in at:
            out = out * 256 + byte(i)
        return out

    names = [f"fp{k}" for k in range(len(settings.seeds))]
    keys = F.array(*[key(k, at) for k, at in enumerate(settings.keys())])
    postings = nodes.select("node", *names, F.explode(keys).alias("key"))
    hot = postings.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).filter("blocks > 1")
    hot = checkpoint(hot)
    if n := hot.count():
        dealt = postings.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array("block"))))
        pair = F.least("block", "other") * 65_536 + F.greatest("block", "other")
        postings = dealt.withColumn("key", F.shiftleft("key", 32) + pair).select("node", *names, "key")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = postings.repartition(parts, "key").sortWithinPartitions("key", "node").select("key", "node", *names)
    return listed.mapInPandas(_linker(settings), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, settings: Settings = EXACT, row: str | None = None) -> DataFrame:
    """row_id, doc_id, fingerprint (16 hexadecimal digits for each seed), component_id, kept; a row for each document.

    Fingerprints link if they differ in few enough bits; component_id is the smallest id that is reachable over links,
    null ids apart, and its first row is kept. A null or empty text has fingerprint zero, which links like any other.
    Equal fingerprints are one node, so copies cost no links. An empty table gives no rows. ``row`` names a column that
    numbers the rows; else they are numbered here.
    """
    names = [f"fp{k}" for k in range(len(settings.seeds))]
    rows = docs.select(row_number(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = checkpoint(rows.mapInPandas(_fingerprints(settings), "row_id long, doc_id long, " + ", ".join(f"{x} long" for x in names)))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    nodes = checkpoint(rows.groupBy(*names).agg(F.min(first).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    label = components(links(nodes.select("node", *names), settings))
    nodes = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = nodes.groupBy("component").agg(F.min("first").alias("best"))
    nodes = nodes.join(rekeyed(best, "component"), "component").select(*names, "best")
    digits = F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in names])
    return rows.join(nodes, names).select("row_id", "doc_id", digits.alias("fingerprint"), F.col("best.doc_id").alias("component_id"), (F.col("row_id") == F.col("best.row_id")).alias("kept"))


def groups(rows: DataFrame, settings: Settings = SIMILAR) -> DataFrame:
    """node, component: of ``rows`` (node, fp0, ..) those whose fingerprints are linked or equal to another's, and their group."""
    names = [f"fp{k}" for k in range(len(settings.seeds))]
    first = checkpoint(rows.groupBy(*names).agg(F.min("node").alias("node"), F.count("*").alias("rows")))
    label = similar.all_nodes(components(links(first.select("node", *names), settings)))
    found = first.join(label, "node", "left").filter("rows > 1 or component is not null")
    found = found.select(*names, F.coalesce("component", "node").alias("component"))
    return checkpoint(rows.join(rekeyed(found, names[0]), names).select("node", "component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they are.

    Near are texts whose sets of five-word shingles have similarity 0.8 or more. The index of fingerprint bytes finds the
    sets whose fingerprints differ in 6 bits or fewer, and these are compared exactly. At similarity 0.8 fingerprints differ in
    some 15 % of the bits, so for pairs beyond that the exact check goes on along posting lists of shingles; no link is lost.
    Of a group the smallest id stays, null ids last; of rows that are alike in all, one. Null and empty texts are alike; an
    empty table stays empty.
    """
    held = numbered(docs)
    keys = similar.keyed(held, "row")
    return without(held, similar.dropped(held, "row", keys, groups(keys.select("node", "fp0"))))
