"""Exact duplicates through a minimal perfect hash over distinct digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, checkpoint, numbered, rekeyed, row_number, text_of, without

#: Rows of one index shard, and of one lookup task's group, on average and at most.
SHARD_DIGESTS, LOOKUP_ROWS = 1024, 2048
INDEX = "shard long, n long, pilots binary, digests binary, keep_ids binary, keep_null binary, keep_rows binary, sizes binary"
FOUND = "row_id long, doc_id long, n_chars_all long, digest binary, member boolean, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row_id, doc_id, n_chars_all (code points of the original text) and the digest of the text without white space."""
    text = text_of()
    bare = F.regexp_replace(text, f"[{SPACE}]+", "")
    return docs.select(
        row_number(row).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_chars_all"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """For each distinct digest its size and the locator of the row that stays: longest original, smallest id (null last)."""
    order = F.struct((-F.col("n_chars_all")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row_id")
    best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket word and slot word of n x 32 bytes; other bytes than those that choose the shard."""
    pairs = np.ascontiguousarray(digest[:, 8:24]).view("<u8")
    return pairs[:, 0], pairs[:, 1]


def _slot(word: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (word ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_hash(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and slots of a minimal perfect hash over n distinct digests (n x 32 bytes).

    Keys fall into buckets of four on average. Large buckets first, each takes the first pilot that sends its
    keys to free, different slots; a lone key takes a free slot outright, noted as a negative pilot.
    """
    n = len(digest)
    bucket_word, slot_word = _words(digest)
    buckets = (bucket_word % np.uint64(n // 4 + 1)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    ends = np.cumsum(np.bincount(buckets, minlength=n // 4 + 1))
    groups = [order[b:e] for b, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    pilots, slots, free = np.zeros(n // 4 + 1, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for b in sorted(range(len(groups)), key=lambda b: -len(groups[b])):
        own = groups[b]
        if len(own) == 1:
            break
        first = 0
        while len(own):
            tries = np.arange(first, first + 64)
            at = np.sort(_slot(slot_word[own][None, :], tries[:, None], n), axis=1)
            good = free[at].all(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
            if good.any():
                pilots[b] = tries[good.argmax()]
                slots[own] = _slot(slot_word[own], np.full(len(own), pilots[b]), n)
                free[slots[own]] = False
                break
            first += 64
    left = iter(np.flatnonzero(free))
    for b, own in enumerate(groups):
        if len(own) == 1:
            slots[own[0]] = next(left)
            pilots[b] = -1 - slots[own[0]]
    return pilots, slots


def find_slots(digest: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The only slot at which each digest can be."""
    bucket_word, slot_word = _words(digest)
    pilot = pilots[(bucket_word % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot, _slot(slot_word, np.maximum(pilot, 0), n))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("digest", ignore_index=True)
    digest = _matrix(rows["digest"])
    pilots, slots = build_hash(digest)
    at = np.argsort(slots)
    null = rows["keep_id"].isna().to_numpy()
    column = lambda x: np.asarray(x, np.int64)[at].tobytes()
    return pd.DataFrame({
        "shard": [rows["shard"].iloc[0]], "n": [len(rows)], "pilots": [pilots.tobytes()], "digests": [digest[at].tobytes()],
        "keep_ids": [column(rows["keep_id"].fillna(0))], "keep_null": [null[at].tobytes()],
        "keep_rows": [column(rows["keep_row"])], "sizes": [column(rows["group_size"])],
    })


def _shard(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of the digests: pilots, and slots that hold full digest, winner locator and group size."""
    return winners(history).withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX)


def _look_up(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    n = len(rows)
    member, slot = np.zeros(n, bool), np.zeros(n, np.int64)
    long = lambda name: np.frombuffer(index[name].iloc[0], np.int64)
    if len(index) and n:
        digest, held = _matrix(rows["digest"]), _matrix(index["digests"].iloc[:1])
        slot = find_slots(digest, long("pilots"), len(held))
        member = (held[slot] == digest).all(axis=1)
    out = rows[["row_id", "doc_id", "n_chars_all", "digest"]].assign(member=member)
    for name, source in (("keep_id", "keep_ids"), ("keep_row", "keep_rows"), ("group_size", "sizes")):
        out[name] = pd.array(long(source)[slot] if len(index) else slot, dtype="Int64")
        out.loc[~member, name] = pd.NA
    if len(index):
        out.loc[np.frombuffer(index["keep_null"].iloc[0], bool)[slot], "keep_id"] = pd.NA
    return out


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Looks every row's digest up in its shard and compares all 32 bytes.

    A shard with many rows (a hot digest) is looked up in several groups of rows, each with its own copy of the shard.
    """
    rows = rows.withColumn("shard", _shard(shards))
    parts = rekeyed(rows.groupBy("shard").agg(F.ceil(F.count("*") / LOOKUP_ROWS).cast("long").alias("parts")), "shard")
    dealt = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts"))).drop("parts")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(_look_up, FOUND)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, row: str | None = None) -> DataFrame:
    """Rows: row_id, doc_id, keep_id, group_size, kept, known, text_sha256; one for each row of ``docs``.

    Texts are equal if they are identical without white space (space, tab to carriage return); null is empty.
    ``history`` None: the documents are their own history, and of each group the longest original stays, then the
    smallest id (null ids last, then the first of identical rows). With a ``history``, members repeat something
    historical: none is kept, and keep_id is the historical winner; nonmembers group among themselves.
    An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash. ``row`` names a column
    that numbers the rows; else they are numbered here.
    """
    rows = checkpoint(digests(docs, row))
    past = rows if history is None else checkpoint(digests(history))
    shards = max(1, -(-past.count() // SHARD_DIGESTS))
    found = look_up(rows, build_index(past, shards), shards)
    if history is not None:
        found = checkpoint(found)
        new = found.filter(~F.col("member"))
        own = new.drop("keep_id", "keep_row", "group_size").join(winners(new), "digest").select(found.columns)
        found = found.filter("member").withColumn("keep_row", F.lit(-1).cast("long")).unionByName(own)
    return found.select(
        "row_id", "doc_id", "keep_id", "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.col("member").alias("known"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` doesn't keep, all columns as they are. Null, empty and blank texts are
    one group; of rows alike in all one stays, whatever their number; an empty table stays empty."""
    held = numbered(docs)
    return without(held, exact_dedup(held, history, "row").filter(~F.col("kept")).withColumnRenamed("row_id", "row"))
