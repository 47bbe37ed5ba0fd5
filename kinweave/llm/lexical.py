"""Ranked lexical search: MaxScore over shards of an inverted index that holds the terms of a block of queries.

Scores are whole numbers, so they are the same in any order of summing and on any number of machines.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import text_of, whole_id, written

#: Documents and postings at which a shard is closed; bytes of a text that are cut into terms at once; bytes of queries
#: in a block on average (their terms are what is broadcast).
SHARD_DOCS, SHARD_POSTINGS, CHUNK, BLOCK_BYTES = 8192, 1_000_000, 1 << 20, 8_000_000
TOP = 50
INDEX = "n_docs long, total long, doc_id binary, no_id binary, length binary, terms array<int>, df array<int>, docs binary, tf binary"


def _table() -> bytes:
    """Bytes of a text to bytes of its terms: capitals to small letters; ASCII that is neither letter nor digit to blanks."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)))


TABLE = _table()


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, all of them in order, in lists of a stretch of the text each."""
    data = text.encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass(frozen=True)
class Queries:
    """The queries of a block: which terms, by number, each one has. Words are all different terms."""

    ids: list[int | None]
    own: list[np.ndarray]
    words: dict[bytes, int]


def compile_queries(rows: list[tuple[int | None, str]]) -> Queries:
    words: dict[bytes, int] = {}
    own = []
    for _, text in rows:
        found = dict.fromkeys(t for part in terms(text) for t in part)
        own.append(np.array([words.setdefault(t, len(words)) for t in found], np.int64))
    return Queries([i for i, _ in rows], own, words)


def _count(text: str, words: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, which of ``words`` are among them, and how often each; held for a stretch at a time."""
    n, own, tf = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in terms(text):
        n += len(part)
        found = np.array(array("q", map(words.get, part, repeat(-1))), np.int64)
        found, times = np.unique(found[found >= 0], return_counts=True)
        if len(own):
            found, at = np.unique(np.r_[own, found], return_inverse=True)
            times = np.bincount(at, np.r_[tf, times]).astype(np.int64)
        own, tf = found, times
    return n, own, tf


def _shard(ids: list, lengths: list[int], own: list[np.ndarray], times: list[np.ndarray]) -> dict:
    """One row of the index, from the terms of each document and how often it has them."""
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    term, tf = np.concatenate(own), np.concatenate(times)
    order = np.argsort(term, kind="stable")
    present, df = np.unique(term, return_counts=True)
    length, null = np.array(lengths, np.int64), np.array([i is None for i in ids], bool)
    return {
        "n_docs": int((length > 0).sum()), "total": int(length.sum()), "doc_id": np.array([i or 0 for i in ids], np.int64).tobytes(),
        "no_id": null.tobytes(), "length": length.tobytes(), "terms": present.astype(np.int32), "df": df.astype(np.int32),
        "docs": doc[order].astype(np.int32).tobytes(), "tf": tf[order].astype(np.int32).tobytes(),
    }


def _indexer(shared):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value.words
        ids, lengths, own, times, held = [], [], [], [], 0
        for rows in batches:
            for doc_id, no_id, text in zip(rows["doc_id"].tolist(), rows["no_id"].tolist(), rows["text"].tolist(), strict=True):
                n, found, tf = _count(text, words)
                for column, x in ((ids, None if no_id else doc_id), (lengths, n), (own, found), (times, tf)):
                    column.append(x)
                held += len(found)
                if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    yield pd.DataFrame([_shard(ids, lengths, own, times)])
                    ids, lengths, own, times, held = [], [], [], [], 0
        if ids:
            yield pd.DataFrame([_shard(ids, lengths, own, times)])

    return index


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * length * n) div total of each document, right beyond 64 bits too."""
    if not total:
        return np.full(len(length), 50, np.int64)
    if 50 * n * int(length.max(initial=0)) < 1 << 63:
        return 50 + 50 * length * n // total
    return np.array([50 + 50 * x * n // total for x in length.tolist()], np.int64)


class Shard:
    """A shard's postings with what each adds to a score, and each term's greatest addition in this shard."""

    def __init__(self, row, weights: np.ndarray, n: int, total: int):
        self.ids, self.null = np.frombuffer(row.doc_id, np.int64), np.frombuffer(row.no_id, bool)
        m = norms(np.frombuffer(row.length, np.int64), n, total)
        self.docs, tf = np.frombuffer(row.docs, np.int32).astype(np.int64), np.frombuffer(row.tf, np.int32).astype(np.int64)
        self.terms, df = np.asarray(row.terms, np.int64), np.asarray(row.df, np.int64)
        self.ends = np.cumsum(df)
        self.begins = self.ends - df
        self.adds = np.repeat(weights[self.terms], df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs]))
        self.bounds = np.maximum.reduceat(self.adds, self.begins) if len(df) else np.zeros(0, np.int64)

    def search(self, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score ``least`` or more, and above 0, for the query of terms ``own``.

        Lists are ranked by bound. Those whose bounds sum to less than ``least`` are non-essential: what is in no other
        list can't qualify. So candidates come from the essential lists; the others are probed for them from the greatest
        bound down, as long as a candidate's score and all bounds still to come reach ``least``.
        """
        at = np.searchsorted(self.terms, own)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == own)] if len(self.terms) else at[:0]
        at = at[np.argsort(self.bounds[at], kind="stable")]
        reach = np.cumsum(self.bounds[at])
        first = int(np.searchsorted(reach, max(least, 1)))
        if first == len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.ids), np.int64)
        for i in at[first:]:
            score[self.docs[self.begins[i] : self.ends[i]]] += self.adds[self.begins[i] : self.ends[i]]
        found = np.flatnonzero(score)
        score = score[found]
        for k in range(first - 1, -1, -1):
            may = score + reach[k] >= least
            found, score = found[may], score[may]
            if not len(found):
                break
            docs, adds = self.docs[self.begins[at[k]] : self.ends[at[k]]], self.adds[self.begins[at[k]] : self.ends[at[k]]]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score = score + np.where(docs[place] == found, adds[place], 0)
        may = score >= max(least, 1)
        return found[may], score[may]


def _best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, null, -score))[:top]


def _searcher(shared, weights, n: int, total: int, top: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best documents of all shards of a task; what they score is the least that the next shard's must reach."""
        queries, w = shared.value, weights.value
        none = np.zeros(0, np.int64)
        held = [(none, none, np.zeros(0, bool))] * len(queries.own)
        for rows in batches:
            for row in rows.itertuples(index=False):
                shard = Shard(row, w, n, total)
                for q, own in enumerate(queries.own):
                    score, ids, null = held[q]
                    found, new = shard.search(own, int(score[-1]) if len(score) == top else 0)
                    if len(found):
                        score, ids, null = np.r_[score, new], np.r_[ids, shard.ids[found]], np.r_[null, shard.null[found]]
                        best = _best(score, ids, null, top)
                        held[q] = score[best], ids[best], null[best]
        for q, (score, ids, null) in enumerate(held):
            if len(score):
                doc_id = pd.array(ids, dtype="Int64")
                doc_id[null] = pd.NA
                item = pd.array([queries.ids[q]] * len(ids), dtype="Int64")
                yield pd.DataFrame({"query": np.full(len(ids), q), "item_id": item, "doc_id": doc_id, "score": score})

    return search


def _search_block(docs: DataFrame, rows: list[tuple[int | None, str]], top: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    queries = compile_queries(rows)
    shared = context.broadcast(queries)
    texts = docs.select(*whole_id(), text_of().alias("text"))
    index = written(texts.mapInPandas(_indexer(shared), INDEX))
    size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect()
    weights = np.zeros(max(1, len(queries.words)), np.int64)
    for r in counted:
        weights[r["terms"]] = weight(size["n"], r["df"])
    found = index.mapInPandas(_searcher(shared, context.broadcast(weights), size["n"], size["total"], top), "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of highest score above 0 for each row of ``items`` (item_id, text).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. Equal scores rank by
    doc_id, null ids last. Null texts, and those without a term, count nowhere and find nothing; a repeated row is a
    document, or a query, of its own; empty tables give no rows. Only doc_id, text and item_id are read.

    Queries are worked on in blocks of some ``BLOCK_BYTES``, whose terms are broadcast; a block costs a pass over the
    documents. Of each block an index in shards is written: only postings of the block's terms, held in the order of terms,
    and each document's length. How many documents hold a term is summed over the shards (a number for each term of the
    block comes to the driver). Then each shard is searched for all queries by MaxScore. A task goes on from shard to shard
    with its best scores and gives ``top`` rows for each query, of which Spark keeps the best again.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = [_search_block(docs, [(r["item_id"], r["text"]) for r in rows.filter(F.col("block") == b).collect()], top) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)
