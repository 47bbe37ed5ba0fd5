"""Packs documents into sequences of fixed capacity by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import checkpoint, places, runs, text_of, written
from kinweave.llm.tokens import default_path, word_encoder

CAPACITY, END_ID = 4096, 2
#: Code points of texts that are encoded at once.
BATCH = 524_288
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        for rows in batches:
            texts, ids = rows["text"].tolist(), rows["doc_id"].tolist()
            for b, e in runs([len(x) for x in texts], BATCH):
                out = []
                for doc_id, text in zip(ids[b:e], texts[b:e], strict=True):
                    found = encoder.ids(text) + end
                    for at in range(0, len(found), 4 * capacity):
                        piece = found[at : at + 4 * capacity]
                        out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(found) // 4, piece)[: 6 if with_ids else 5])
                made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5])
                yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's ids, ended by ``end_id``, cut into full windows and one remainder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(_cutter(path or default_path(), capacity, end_id, with_ids), PIECE + ", ids binary" * with_ids)


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of which lengths make up the next window: the longest that is left, and with it the multiset that
    leaves the least slack.

    Subset sums are the bits of an integer: adding a group of k equal lengths shifts it by their sum, groups of 1, 2,
    4 and so on stand for a length's count. From the highest bit reached the groups are walked back.
    """
    longest = max(left)
    mask, target = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, steps = 1 << longest, []
    for length in sorted(left, reverse=True):
        most = min(left[length] - (length == longest), (capacity - longest) // length)
        group = 1
        while most > 0 and not reach & target:
            group = min(group, most)
            steps.append((length, group, reach))
            reach |= (reach << (length * group)) & mask
            most -= group
            group *= 2
        if reach & target:
            break
    total, used = reach.bit_length() - 1, {longest: 1}
    for length, group, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + group
            total -= length * group
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length, how often) that use up all counts.

    A pattern repeats while its lengths last, so each uses up one length at least: there are as many patterns as
    lengths, at most, whatever the counts.
    """
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        used = fill(left, capacity)
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        left = {k: v for k, v in ((k, v - times * used.get(k, 0)) for k, v in left.items()) if v}
    return out


def _stretches(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern the ranks it serves: key (length and first rank), pieces in a window, first sequence, offset."""
    out, rank, sequence = [], {}, 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            first = rank.get(length, 0)
            out.append(((length << 48) + first, first, used[length], sequence, offset))
            rank[length] = first + used[length] * times
            offset += length * used[length]
        sequence += times
    rows = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "each", "sequence", "offset"), rows.T, strict=True))


def _placer(shared, columns: list[str]):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows.pop("rank").to_numpy()
            i = np.searchsorted(at["key"], (length.astype(np.int64) << 48) + rank, "right") - 1
            turn, place_ = np.divmod(rank - at["first"][i], at["each"][i])
            rows["sequence_id"], rows["offset"] = at["sequence"][i] + turn, at["offset"][i] + place_ * length
            yield rows[columns]

    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for): a row for each piece.

    Documents longer than a window fill whole windows; what remains of each is packed. Only the histogram of lengths,
    of ``capacity`` entries at most, goes to the driver, and the plan, of as many patterns at most, to the executors.
    Pieces of a length are numbered in buckets (``places``), so that a length, or a piece, that a third of the documents
    have is numbered in many tasks. A null or empty text is the end id alone; null ids and repeated rows are packed like others; an empty
    table gives no rows.
    """
    made = pieces(docs, path, capacity, end_id, with_ids).withColumn("row_id", F.monotonically_increasing_id())
    made = written(made) if with_ids else checkpoint(made)
    counted = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    ranked = places(made, ["length"], ["doc_id", "start", "ids_crc32"], F.lit(1), "row_id", "rank").drop("row_id")
    shared = docs.sparkSession.sparkContext.broadcast(_stretches(plan(counted, capacity)))
    schema = PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInPandas(_placer(shared, [x.split()[0] for x in schema.split(", ")]), schema)
