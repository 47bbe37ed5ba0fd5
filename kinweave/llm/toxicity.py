"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bound63, checkpoint, hash63, held_out, text_of

#: Bounds of what is fitted on: confirmed and unlabelled documents, code points of each, words of the model.
POSITIVES, UNLABELLED, MOST_CHARS, VOCABULARY = 2000, 4000, 32_768, 512
#: Rounds of the optimiser, its step, the weight of the squared coefficients, and how far below 0 the corrected risk may fall.
ROUNDS, STEP, RIDGE, BETA = 1000, 0.03, 2e-5, 0.0
#: A word of the model stands in so many sampled documents at least, and its frequencies differ by so many standard errors.
LEAST_DOCS, LEAST_SCORE = 5, 6.0
#: ASCII but letters and digits separates words; A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(TABLE).split())


def choose_words(positive: list[Collection[bytes]], unlabelled: list[Collection[bytes]], most: int = VOCABULARY) -> list[bytes]:
    """The words whose document frequencies differ clearly, most first, by a two-sample score; ties by the word."""
    both: dict[bytes, list[int]] = {}
    for k, docs in enumerate((positive, unlabelled)):
        for own in docs:
            for w in own:
                both.setdefault(w, [0, 0])[k] += 1
    names = [w for w, c in both.items() if sum(c) >= LEAST_DOCS]
    counts = np.array([both[w] for w in names], float).reshape(-1, 2)
    size = np.array([len(positive), len(unlabelled)], float)
    rate, pooled = counts / size, counts.sum(1) / size.sum()
    score = np.abs(rate[:, 0] - rate[:, 1]) / np.sqrt(pooled * (1 - pooled) * (1 / size).sum() + 1e-9)
    return [names[i] for i in sorted(np.flatnonzero(score >= LEAST_SCORE), key=lambda i: (-score[i], names[i]))[:most]]


def _matrix(docs: list[Collection[bytes]], at: dict[bytes, int]) -> np.ndarray:
    out = np.zeros((len(docs), len(at)), np.float32)
    for i, own in enumerate(docs):
        out[i, [at[w] for w in own if w in at]] = 1
    return out


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R+(positive), and R-(unlabelled) - prior * R-(positive), of the logistic loss; and the gradient of each."""
    w = theta[:-1].astype(np.float32)
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w + theta[-1], -30, 30))) for x in (xp, xu))
    # losses of label 1 and 0 are -log(s) and -log(1-s); their slopes in the score are s-1 and s
    positive = -prior * np.log(sp + 1e-12).mean()
    negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
    up, gp, gu = prior * (sp - 1) / len(sp), -prior * sp / len(sp), su / len(su)
    back = lambda g, x: np.append(x.T @ g.astype(np.float32), g.sum())
    return positive, negative, back(up, xp), back(gp, xp) + back(gu, xu)


def fit(positive: list[Collection[bytes]], unlabelled: list[Collection[bytes]], prior: float) -> tuple[dict[bytes, float], float]:
    """Weights of words and a bias, from confirmed toxic and unlabelled documents.

    Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with Adam; while the second part is
    below -BETA, its gradient is followed upwards instead, which is what keeps it non-negative.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return {}, float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    names = choose_words(positive, unlabelled)
    at = {w: i for i, w in enumerate(names)}
    xp, xu = _matrix(positive, at), _matrix(unlabelled, at)
    theta = np.zeros(len(at) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        _, negative, up, down = risk(theta, xp, xu, prior)
        grad = -down if negative < -BETA else up + down
        grad[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {w: float(theta[i]) for w, i in at.items()}, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], float]:
    """Fits on a bounded sample of documents outside the held-out fold, those of smallest hashes.

    The class prior is the share of toxic among all labelled ids outside that fold; an id with contradicting labels is
    toxic, null labels and null ids don't count. The unlabelled sample is of documents whatever their label. Documents
    of the same words count once, else a group of copies would make its own words look telling.
    """
    known = labels.filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("id is not null and toxic is not null")
    seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    chosen = known.filter("toxic = 1").orderBy(hash63(F.lit(1), "id"), "id").limit(POSITIVES).select("id", F.lit(True).alias("positive"))
    rows = docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(F.broadcast(chosen), "id", "left")
    drawn = F.col("hash") < bound63(UNLABELLED, docs.count() * 4 // 5)
    kinds = F.array_compact(F.array(F.when(F.col("positive"), "positive"), F.when(drawn, "unlabelled")))
    rows = rows.withColumn("hash", hash63(F.lit(2), "id", "text")).filter(F.col("positive") | drawn)
    rows = rows.select("hash", F.explode(kinds).alias("kind"), F.substring("text", 1, MOST_CHARS).alias("text"))
    rows = checkpoint(rows.groupBy("kind", "hash").agg(F.min("text").alias("text")))
    least = lambda kind, n: [r["text"] for r in rows.filter(F.col("kind") == kind).orderBy("hash").limit(n).select("text").collect()]
    sample = {"positive": least("positive", POSITIVES), "unlabelled": least("unlabelled", UNLABELLED)}
    one: dict[bytes, bytes] = {}  # each word is held once, else the sample's words would fill a tenth of the driver
    own = {kind: list(dict.fromkeys(tuple(sorted(one.setdefault(w, w) for w in words(x))) for x in texts)) for kind, texts in sample.items()}
    return fit(own["positive"], own["unlabelled"], (seen["toxic"] or 0) / max(seen["n"], 1))


def _scorer(shared):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        known = weights.keys()
        for rows in batches:
            z = np.array([bias + sum(weights[w] for w in sorted(words(x) & known)) for x in rows.pop("text")], float)
            yield rows.assign(score=1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5); a row for each document, from its whole text.

    A null or empty text gets the score that the bias alone gives; a null id counts as held out; equal texts score
    equal; without any label, or any toxic one, all score near 0; an empty table gives no rows. Scoring shuffles nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    scored = rows.mapInPandas(_scorer(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic, all columns kept; null and empty texts are judged by the bias alone,
    repeated rows alike, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield next(_scorer(shared)(iter([pd.DataFrame({"text": texts})])))["score"]

    return docs.filter(toxic(text_of()) < 0.5)
