"""The near_dedup stage gets its groups from the index of fingerprint bytes; the exact check follows, and goes on beyond its reach."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import common, similar, simhash

COLUMNS = "doc_id long, text string, lang string, source string"


def labels(links, nodes):
    out = {x: x for x in nodes}
    for a, b in links:
        old, new = max(out[a], out[b]), min(out[a], out[b])
        out = {x: new if c == old else c for x, c in out.items()}
    return out


def test_majority_is_the_fingerprint_of_the_set():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 70_000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        bits = [int(((own >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(own) for b in range(64)]
        assert int(similar.majority(own)) == sum(1 << b for b, x in enumerate(bits) if x)
    assert similar.majority(similar.shingles("")) == 0


def test_groups_are_those_of_all_pairs_within_6_bits(spark):
    """The index loses no pair of fingerprints that differ in 6 bits or fewer, wherever these are; equal ones are a group."""
    rng = random.Random(8)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 3, 6, 7]))))
        spoilt = rng.sample(range(8), 6)  # six bits in six different bytes: two bytes are shared, no more
        prints += [base ^ sum(1 << (8 * b + rng.randrange(8)) for b in spoilt)]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "node long, fp0 long")
    found = {r["node"]: r["component"] for r in simhash.groups(rows).collect()}
    assert set(found) == {x for pair in near for x in pair}
    want = labels(near, range(len(prints)))
    assert all((found[a] == found[b]) == (want[a] == want[b]) for a in found for b in found)


def test_stage_goes_by_fingerprints_then_by_the_exact_check(spark, monkeypatch):
    """Without the posting lists of shingles, copies within 6 bits still go, and only those alike from 0.8 on; with them all go."""
    rng = random.Random(12)
    texts = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(200)]
        for changed in (0, 0, 2, 5, 7, 9, 12):  # from 0.95 to 0.5
            own = base[:]
            for at in rng.sample(range(39), changed):
                own[at * 5 + 2] = f"n{rng.randint(0, 10**9)}"
            texts.append(" ".join(own).upper() if changed == 0 and rng.random() < 0.5 else " ".join(own))
    sets = [similar.shingles(x) for x in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if (n := len(np.intersect1d(sets[a], sets[b]))) * 5 >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    prints = [int(similar.majority(x)) for x in sets]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6]
    assert set(close) - set(alike) and set(alike) - set(close)  # the check takes some away, the rest adds some
    reached = labels(close, range(len(texts)))
    by_prints = sorted(set(labels([(a, b) for a, b in alike if reached[a] == reached[b]], range(len(texts))).values()))
    whole = sorted(set(labels(alike, range(len(texts))).values()))
    assert len(whole) < len(by_prints) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], COLUMNS)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == whole
    none = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(similar, "meeting", lambda keys: none)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == by_prints


def moved(spark):
    return sum(x.totalShuffleWrite() for x in (lambda held: [held.apply(i) for i in range(held.size())])(spark._jsc.sc().statusStore().executorList(False)))


def test_texts_stay_where_they_are_and_sets_move_once_a_comparison(spark, monkeypatch):
    """What joins look up is small, so neither texts nor sets are dealt for it; when it is too large to broadcast, the rows are the same."""
    rng = random.Random(15)
    texts = []
    for g in range(60):
        base = [f"{rng.getrandbits(40):x}" for _ in range(3000)]
        for changed in (0, 40, 100, 140):
            own = base[:]
            for at in rng.sample(range(599), changed):
                own[at * 5 + 2] = f"{rng.getrandbits(40):x}"
            texts.append(" ".join(own))
    alone = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(30)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + alone)], COLUMNS).repartition(4)
    docs = docs.localCheckpoint()
    sets = sum(similar.shingles(x).nbytes for x in texts)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        kept = sorted(r["doc_id"] for r in simhash.keep_first(docs).select("doc_id").collect())
        assert moved(spark) - before < 3 * sets
        assert len(alone) < len(kept) < len(texts + alone) and kept[-len(alone) :] == list(range(len(texts), len(texts + alone)))
        monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
        assert sorted(r["doc_id"] for r in simhash.keep_first(docs).select("doc_id").collect()) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_look_up_by_bits_finds_each_row(spark, monkeypatch):
    """Too many keys to broadcast: no row that has one is lost, and few others are dealt."""
    rows = spark.range(-5000, 5000).select(F.col("id").alias("node"), F.col("id").cast("string").alias("text"))
    few = spark.range(-5000, 5000, 7).select(F.col("id").alias("node"), (F.col("id") * 2).alias("twice"))
    want = sorted((r, str(r), 2 * r) for r in range(-5000, 5000, 7))
    for most in (10**6, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(tuple(r) for r in common.looked_up(rows, few, "node").select("node", "text", "twice").collect()) == want
