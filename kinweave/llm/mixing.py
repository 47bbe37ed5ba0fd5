"""Mixes sources to target weights out of fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, checkpoint, feistel, numbered, places, row_number, text_of, unfeistel

#: Words of a block, slots of a shard at least, shards at most.
BLOCK, SHARD_SLOTS, MOST_SHARDS = 64, 4096, 65_536
WEIGHTS, SHARE, MOST_REPEATS, SEED = (5, 2, 1), 1.5, 2, 42


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> dict[str | None, float]:
    """Words that each source should give.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target above
    ``most`` times its source's size stops there and the excess is shared anew by weight until none is above.
    """
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def draw(slots: np.ndarray, seed: int = SEED) -> pd.DataFrame:
    """Multinomial counts of each source for every shard: shard, source_no, n, first (slots of the source before it).

    Each shard draws with the slots that its sources still have open as probabilities, and never more than those, so
    the counts are multinomial and end exactly at ``slots``.
    """
    left = np.asarray(slots, np.int64).copy()
    total = int(left.sum())
    size = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    out = []
    for shard in range(-(-total // size)):
        rng, counts, want = np.random.default_rng([seed, shard]), np.zeros(len(left), np.int64), min(size, int(left.sum()))
        while (lacks := want - int(counts.sum())) > 0:
            rest = left - counts
            counts += np.minimum(rng.multinomial(lacks, rest / rest.sum()), rest)
        used = np.asarray(slots, np.int64) - left
        out += [(shard, s, int(counts[s]), int(used[s])) for s in np.flatnonzero(counts)]
        left -= counts
    return pd.DataFrame(out, columns=["shard", "source_no", "n", "first"]).astype("int64")


def starts(base: DataFrame) -> DataFrame:
    """Adds ``start``: words of the same source before the row, in an order that follows from ids and sizes."""
    return places(base, ["source_no"], ["doc_id", "size"], F.col("size"), "row_id", "start")


def _key_of(source_no, pass_) -> np.ndarray:
    return SEED + 1_000_003 * np.asarray(source_no) + 7 * np.asarray(pass_)


def _block_of(k: np.ndarray, blocks: np.ndarray, source_no: np.ndarray) -> np.ndarray:
    """The block of a source's k-th slot, by the source's pseudorandom permutation of its blocks, a new one for each pass."""
    return feistel(k % blocks, blocks, _key_of(source_no, k // blocks)).astype(np.int64)


def slots_of(source_no: int, size: int, target: float, block: int) -> tuple[int, int]:
    """Slots that a source of ``size`` words gets, and how many words of its last slot's block are taken.

    All blocks are full but the last one, which may be short. Where that one comes in each pass follows from the inverse
    of the pass's permutation, so slots end on the target to the word, whatever the size.
    """
    blocks, want = -(-size // block), round(target)
    if not blocks or not want:
        return 0, 0
    passes = np.arange(MOST_REPEATS)
    at = unfeistel(np.full(MOST_REPEATS, blocks - 1), np.full(MOST_REPEATS, blocks), _key_of(source_no, passes)).astype(np.int64)
    lacking = blocks * block - size
    short = sorted(int(p * blocks + i) for p, i in enumerate(at))
    words = lambda slots: slots * block - lacking * sum(i < slots for i in short)
    slots = max(1, want // block)
    while words(slots) < want:
        slots += 1
    return slots, want - words(slots - 1)


def _map_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sends the k-th slot of a source to a block."""
    for x in batches:
        k, blocks = x["k"].to_numpy(), x["blocks"].to_numpy()
        x["pass"] = k // blocks
        x["block"] = _block_of(k, blocks, x["source_no"].to_numpy())
        yield x[["shard", "slot", "source_no", "pass", "block", "most"]]


def plan(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, taken): base has a row for each document: row_id, doc_id, source, size, source_no, source_size, target,
    start; taken has a row for each stretch of a document in each block that the mix takes: shard, slot, source_no,
    pass (0 or 1), block, row_id, first (word in the document, from 0), n_words.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none. Reruns agree, as everything follows from ids, sizes and the
    seed. The table of sources goes to the driver; its size is the number of sources, not of documents.
    ``row`` names a column that numbers the rows; else they are numbered here.
    """
    spark = docs.sparkSession
    base = checkpoint(docs.select(
        row_number(row).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
    ))
    sizes = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes)
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    blocks = np.array([-(-sizes[s] // block) for s in names], np.int64)
    slots, cut = np.array([slots_of(i, sizes[s], target[s], block) for i, s in enumerate(names)], np.int64).reshape(-1, 2).T
    rows = [(i, s, sizes[s], float(target[s]), int(blocks[i])) for i, s in enumerate(names)]
    table = spark.createDataFrame(rows, "source_no long, source string, source_size long, target double, blocks long")
    sources = F.broadcast(table) if len(rows) <= 10_000 else table
    base = base.join(sources, base["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    base = checkpoint(starts(base).drop("blocks"))
    drawn = draw(slots)
    for name, values in (("blocks", blocks), ("slots", slots), ("cut", cut)):
        drawn[name] = values[drawn["source_no"]] if len(drawn) else drawn["n"]
    shards = spark.createDataFrame(drawn, "shard long, source_no long, n long, first long, blocks long, slots long, cut long")
    one = shards.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    k = F.col("first") + F.col("i")
    most = F.when(k == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block)).cast("long")
    one = one.select("shard", "source_no", "blocks", k.alias("k"), most.alias("most"), F.xxhash64("shard", "source_no", "i").alias("slot"))
    slot = one.mapInPandas(_map_slots, "shard long, slot long, source_no long, pass long, block long, most long")
    size = F.lit(block)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    piece = base.filter("size > 0").select("row_id", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * size - F.col("start"))
    within = F.greatest(F.lit(0), F.col("start") - F.col("block") * size)
    piece = piece.select("row_id", "source_no", "block", begin.alias("first"), within.alias("within"), (end - begin).alias("n_words"))
    taken = slot.join(piece, ["source_no", "block"]).withColumn("n_words", F.least("n_words", F.col("most") - F.col("within")))
    return base, taken.filter("n_words > 0").drop("most", "within")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the mix takes from each document: row_id, doc_id, source, size, source_size, target, taken (words, repeats counted).

    One row for each document, empty ones too (size 0 takes 0); an empty table gives none. Repeated rows count each.
    """
    base, taken = plan(docs, block)
    sums = taken.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    out = base.join(sums, "row_id", "left")
    return out.select("row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each document and pass, its text the words taken in that pass.

    A pass that takes all of a document keeps its text unchanged; else the taken stretches are joined, each word with
    the white space after it. Documents of no words, null or blank, are never taken; repeated rows are documents of
    their own. n_chars, if there, is set anew. An empty table gives no rows.
    """
    held = numbered(docs)
    base, taken = plan(held, block, "row")
    spans = taken.groupBy("row_id", "pass").agg(F.sum("n_words").alias("taken_words"), F.sort_array(F.collect_list(F.struct("first", "n_words"))).alias("spans"))
    spans = spans.join(base.select("row_id", (F.col("size") * 1).alias("all_words")), "row_id").withColumnRenamed("row_id", "row")
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+[{SPACE}]*)"), F.lit(1))
    whole = F.col("taken_words") == F.col("all_words")
    stretch = lambda all_, s: F.slice(all_, s["first"].cast("int") + 1, s["n_words"].cast("int"))
    # An array of one holds the words, so that a text is split once and not anew for each of its stretches.
    part = F.transform(F.array(words), lambda all_: F.array_join(F.flatten(F.transform("spans", lambda s: stretch(all_, s))), ""))[0]
    out = held.select("row", "doc").join(spans, "row").withColumn("taken_text", F.when(whole, text).otherwise(part))
    new = {"text": F.col("taken_text"), "n_chars": F.char_length("taken_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns])
