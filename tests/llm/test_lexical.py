"""Ranked search against scoring every document for every query."""

import math
import random
import re

import numpy as np
import pytest

from kinweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(0x41, 0x5B)}
SCHEMA = "doc_id long, text string, item_id long, score long, rank int, query string, terms array<int>"


def own_terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def brute(docs, items, top):
    """(item_id, rank, doc_id, score) by the formula, with Python's whole numbers."""
    held = [(i, own_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        wanted = dict.fromkeys(own_terms(text))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t in wanted if (df := sum(t in own for _, own in held))}
        for doc_id, own in held:
            m = 50 + 50 * len(own) * n // total
            score = sum(w * (1_000_000_000 * tf // (1000 * tf + 20 * m)) for t, w in weights.items() if (tf := own.count(t)))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    """Both tables with columns of clashing names."""
    held = spark.createDataFrame([(i, t, 1, 1, 1, "q", [1]) for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(1, t, i, 1, 1, "q", [1]) for i, t in items], SCHEMA)
    return held, asked


def found(spark, docs, items, top=lexical.TOP):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(*frames(spark, docs, items), top).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["Ünïcode", "ünïcode", "日本語", "A1"]
    text = lambda most: " ".join(rng.choice(words) + rng.choice(["", ",", "-x", "\x7f"]) for _ in range(rng.randint(1, most)))
    docs = [(i, text(80)) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " ,.\t"), (None, docs[0][1]), (None, "w1 w2"), (403, "the " * 40_000 + text(50)), (2**60 + 1, "w1 rare"), *docs[:6]]
    docs += [(500 + i, "tie tie w3") for i in range(70)]
    items = [(i, text(25)) for i in range(20)] + [(90, None), (91, ""), (92, "nowhere"), (93, "tie W3"), (94, "the THE rare"), (93, "tie"), (None, "日本語 a1")]
    return docs, items


def test_search_as_by_brute_force(spark, corpus):
    docs, items = corpus
    want = brute(docs, items, 50)
    assert found(spark, docs, items) == want
    assert [r[2] for r in want if r[0] == 93 and r[3] == max(x[3] for x in want if x[0] == 93)]


def test_many_shards_and_blocks_of_queries(spark, corpus, monkeypatch):
    docs, items = corpus
    for name, value in (("SHARD_DOCS", 16), ("CHUNK", 64), ("BLOCK_BYTES", 700)):
        monkeypatch.setattr(lexical, name, value)
    assert found(spark, docs, items, 7) == brute(docs, items, 7)


def test_a_shard_gives_all_that_can_qualify():
    """For any least score: exactly the documents that reach it, whatever lists are non-essential."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        lists = [np.flatnonzero(rng.random(40) < p) for p in rng.random(6)]
        tf = [rng.integers(1, 9, len(x)) for x in lists]
        docs = [np.array([k for k, x in enumerate(lists) if d in x], np.int64) for d in range(40)]
        times = [np.array([tf[k][list(lists[k]).index(d)] for k in own], np.int64) for d, own in enumerate(docs)]
        length = [int(x.sum()) + 3 for x in times]
        row = type("Row", (), lexical._shard(list(range(40)), length, docs, times))
        weights, n, total = rng.integers(0, 5000, 6), 40, sum(length)
        shard = lexical.Shard(row, weights, n, total)
        m = [50 + 50 * x * n // total for x in length]
        scores = {d: sum(int(weights[k]) * (1_000_000_000 * int(t) // (1000 * int(t) + 20 * m[d])) for k, t in zip(docs[d], times[d], strict=True)) for d in range(40)}
        for least in (0, 1, *np.quantile(list(scores.values()), [0.3, 0.7, 0.95]).astype(int).tolist(), max(scores.values()), max(scores.values()) + 1):
            got = dict(zip(*(x.tolist() for x in shard.search(np.arange(7), least)), strict=True))
            assert got == {d: s for d, s in scores.items() if s >= max(least, 1)}


def test_norms_beyond_64_bits():
    length = np.array([0, 7, 10**9], np.int64)
    n, total = 10**12, 10**15
    assert lexical.norms(length, n, total).tolist() == [50 + 50 * x * n // total for x in length.tolist()]


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items[:3]) == [] and found(spark, docs[:5], []) == []
