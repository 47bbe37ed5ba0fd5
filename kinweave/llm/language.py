"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import bound63, hash63, held_out, runs, text_of

#: Bytes of the longest context; documents that a language is learned from and code points of each at most.
ORDER, SAMPLE, MOST_CHARS = 4, 400, 16_384
#: Bytes scored at once, and what stands before a text.
CHUNK, BEFORE = 1 << 19, b"\n"


def _keys(data: bytes, order: int) -> np.ndarray:
    """For each byte after the first ``order`` ones, it and those before it as one integer, the byte itself lowest."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x) - order
    out = np.zeros(max(n, 0), np.int64)
    for k in range(order + 1):
        out |= x[order - k : order - k + n] << (8 * k)
    return out


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


class ContextTree:
    """Frozen counts of one language: for each order the contexts and what followed them.

    ``cost`` gives exact code lengths in bits of method C: a symbol that followed the longest known context n of N times
    costs log2((N + D) / n), D being the number of different symbols there; else an escape, log2((N + D) / D), leads to
    the context without its first byte, where symbols of the longer context no longer count; the last resort is an even
    choice of the bytes never seen.
    """

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        keys = np.concatenate([np.zeros(0, np.int64), *(_keys(BEFORE * order + _bytes(x), order) for x in texts)])
        self.grams, self.counts, self.contexts, self.total, self.distinct, self.shadow = [], [], [], [], [], []
        for k in range(order + 1):
            grams, counts = np.unique(keys & ((1 << (8 * (k + 1))) - 1), return_counts=True)
            contexts, first = np.unique(grams >> 8, return_index=True)
            self.grams.append(grams)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.total.append(np.add.reduceat(counts, first) if len(first) else counts)
            self.distinct.append(np.diff(np.r_[first, len(grams)]))
            # of each context: how often its symbols followed the next shorter context
            seen = counts if not k else self.counts[k - 1][np.searchsorted(self.grams[k - 1], grams & ((1 << (8 * k)) - 1))]
            self.shadow.append(np.add.reduceat(seen, first) if len(first) else seen)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        bits, todo = np.zeros(len(keys)), np.arange(len(keys))
        hidden, hidden_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(self.order, -1, -1):
            if not len(self.grams[k]):
                continue
            gram = keys[todo] & ((1 << (8 * (k + 1))) - 1)
            c = np.minimum(np.searchsorted(self.contexts[k], gram >> 8), len(self.contexts[k]) - 1)
            here = self.contexts[k][c] == gram >> 8
            g = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            found = here & (self.grams[k][g] == gram)
            kinds = self.distinct[k][c] - hidden_kinds[todo]
            all_ = self.total[k][c] - hidden[todo] + kinds
            used = here & (kinds > 0)
            of = np.where(found, self.counts[k][g], np.maximum(kinds, 1))
            bits[todo] += np.where(used, np.log2(np.maximum(all_, 1) / of), 0)
            hidden[todo] = np.where(here, self.shadow[k][c], hidden[todo])
            hidden_kinds[todo] = np.where(here, self.distinct[k][c], hidden_kinds[todo])
            todo = todo[~found]
        bits[todo] += np.log2(np.maximum(256 - hidden_kinds[todo], 1))
        return bits


class Model:
    """Context trees by language, and the costs of every string of full length that any of them has seen."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.order, self.languages = order, sorted(samples)
        self.trees = [ContextTree(samples[x], order) for x in self.languages]
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.grams[order] for t in self.trees)]))
        self.costs = np.stack([t.cost(self.known) for t in self.trees], axis=1).astype(np.float32) if self.trees else np.zeros((0, 0), np.float32)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each key's last byte in each language."""
        if not len(self.known):
            return np.stack([t.cost(keys) for t in self.trees], axis=1)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        out = self.costs[at].astype(np.float64)
        new = np.flatnonzero(self.known[at] != keys)
        if len(new):
            rare, back = np.unique(keys[new], return_inverse=True)
            out[new] = np.stack([t.cost(rare) for t in self.trees], axis=1)[back]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text in each language, in bits; long texts go through in chunks."""
        out = np.zeros((len(texts), len(self.languages)))
        data = [_bytes(x) for x in texts]
        for b, e in runs([len(x) for x in data], CHUNK):
            if e - b == 1:
                whole = BEFORE * self.order + data[b]
                for at in range(0, len(data[b]), CHUNK):
                    out[b] += self.bits(_keys(whole[at : at + CHUNK + self.order], self.order)).sum(axis=0)
                continue
            keys = [_keys(BEFORE * self.order + x, self.order) for x in data[b:e]]
            sums = np.cumsum(self.bits(np.concatenate(keys)), axis=0)
            ends = np.cumsum([len(k) for k in keys])
            total = np.where((ends > 0)[:, None], sums[np.maximum(ends - 1, 0)] if len(sums) else 0, 0)
            out[b:e] = np.diff(total, axis=0, prepend=np.zeros((1, total.shape[1])))
        return out


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Learns from a sample of each language outside the held-out fold: the ``sample`` documents of smallest hashes of id and text.

    Of these at most ``MOST_CHARS`` code points each come to the driver, and a count for each language, of which there
    must be no more than a driver can hold models of. Rows alike in id and text count once.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, order)
    bounds = docs.sparkSession.createDataFrame([(k, bound63(sample, n)) for k, n in counts.items()], "lang string, bound long")
    drawn = rows.join(F.broadcast(bounds) if len(counts) <= 10_000 else bounds, "lang").withColumn("hash", hash63("doc_id", "text")).filter("hash < bound")
    drawn = drawn.groupBy("lang", "hash").agg(F.min(F.substring("text", 1, MOST_CHARS)).alias("text"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("nth") <= sample)
    found: dict[str, list[str]] = {}
    for r in drawn.select("lang", "nth", "text").sort("lang", "nth").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    return Model(found, order)


def _predictor(shared):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for rows in batches:
            texts, lettered = rows.pop("text").tolist(), rows.pop("lettered").to_numpy()
            rows["lang_pred"], rows["score"] = "und", 0.0
            if model.languages and lettered.any():
                at = np.flatnonzero(lettered)
                bits = model.lengths([texts[i] for i in at])
                best = bits.argmin(axis=1)
                weight = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                rows.iloc[at, rows.columns.get_loc("lang_pred")] = np.array(model.languages, object)[best]
                rows.iloc[at, rows.columns.get_loc("score")] = 1 / weight.sum(axis=1)
            yield rows

    return predict


def identify(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row for each document.

    lang_pred is the language whose context tree codes the whole text in fewest bits (ties: the first by code point),
    score its probability if all languages were equally likely. Null texts and texts without a letter are `und` with
    score 0, as are all if nothing can be learned from. A null id counts as held out; repeated rows are judged alike; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, order, sample))
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInPandas(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")
