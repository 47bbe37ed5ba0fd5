"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and columns of clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import components, exact_dedup, jpeg, language, media, mixing, packing, queries, similar, simhash, token_shards, tokens, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, row_id long, size long, key string, member boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, 1, 1, "k", True) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [(i, " ".join(word() for _ in range(rng.randint(1, 120))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(60)]
    odd = [(100, None, "en", "s1"), (101, "", None, None), (102, " \t\n", "en", "s2"), (None, "no id here", "fr", "s1"), (None, "no id here", "fr", "s1"), (103, "A", "en", "s1")]
    long = [(104, " ".join(word() for _ in range(30_000)), "en", "s1"), (105, "ab1" * 30_000, "en", "s2")]
    copies = [(200 + i, base[0][1] + " " * (i % 3), "en", "s1") for i in range(25)] + [base[1], base[1]]
    return base + odd + long + copies


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def first(i):
    return (i is None, i or 0)


def test_exact_dedup(docs, empty, rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), *first(i), i))
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(groups)
    by = {hashlib.sha256(t.encode()).hexdigest(): sorted(g) for t, g in groups.items()}
    assert all((r["keep_id"], r["group_size"], r["known"]) == (by[r["text_sha256"]][0][3], len(by[r["text_sha256"]]), True) for r in found)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(bare(r["text"]) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_with_history(spark, docs, empty):
    history = frame(spark, [(1000, "no id\there", None, None), (1001, "unheard of", None, None)])
    found = {r["row_id"]: r for r in exact_dedup.exact_dedup(docs, history).collect()}
    known = [r for r in found.values() if r["known"]]
    assert {(r["keep_id"], r["kept"]) for r in known} == {(1000, False)} and len(known) == 2 and len(found) == docs.count()
    fresh = [r for r in found.values() if not r["known"]]
    assert sum(r["kept"] for r in fresh) == len({r["text_sha256"] for r in fresh})
    assert exact_dedup.exact_dedup(docs, empty).filter("known").count() == 0


def test_near_duplicates(docs, empty, rows):
    found = simhash.near_duplicates(docs).collect()
    fps = [int(simhash.fingerprint(t or "", 4)[0]) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    best = {c: min((first(rows[i][0]), rows[i][0]) for i in range(len(rows)) if label[i] == c)[1] for c in set(label)}
    want = sorted(((i[0], f"{fp:016x}", best[c]) for i, fp, c in zip(rows, fps, label, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == want
    assert sum(r["kept"] for r in found) == len(best) and simhash.near_duplicates(empty).count() == 0


def test_long_posting_lists_are_dealt(spark, monkeypatch):
    """Lists of several blocks lose no link, and give none that isn't there."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(3, 5))) for _ in range(150)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect())
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect()) == want


def test_similar_texts_go(spark):
    rng = random.Random(8)
    rows = []
    for i in range(20):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        rows += [(3 * i, " ".join(own), "en", "s"), (3 * i + 1, " ".join([*own[:150], "new", *own[151:]]), "en", "s"), (3 * i + 2, " ".join([*own[:298], "end"]), "en", "s")]
    kept = simhash.keep_first(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3 * i for i in range(20)]


def test_similar_texts_as_by_brute_force(spark):
    """Pairs of similarity 0.6 to 0.95, chains, repeated lines, and texts without five words: rows kept as by exact Jaccard groups."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = []
    for i in range(150):
        own = [word() for _ in range(200)]
        texts.append(" ".join(own))
        for _ in range(2):  # each changed word takes five shingles
            own = own[:]
            for at in rng.sample(range(40), 1 + i % 9):
                own[at * 5] = word()
            texts.append(" ".join(own))
    line = " ".join(word() for _ in range(12))
    texts += [f"{line} {line} {line} {line} {line} " + " ".join(word() for _ in range(40)) for _ in range(10)]
    texts += ["one two", "One  two", "one", "", None]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        own = (t or "").lower().split()
        sets.append({tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))})
    label = list(range(len(texts)))
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in near:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    kept = simhash.keep_first(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert 150 < len(set(label)) < len(texts) and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_repeated_lines_are_no_copies(spark):
    """Texts that share one line five times over and nothing else all stay."""
    rng = random.Random(22)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [" ".join([line] * 5 + [f"w{rng.randint(0, 5000)}" for _ in range(20)]) for _ in range(12)]
    assert simhash.keep_first(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).count() == 12


def test_large_groups_are_dealt(spark, monkeypatch):
    """A group of several blocks links across them."""
    monkeypatch.setattr(similar, "BLOCK", 200)
    own = [f"w{i}" for i in range(100)]
    texts = [" ".join([*own[:i], "new", *own[i + 1 :]]) for i in range(0, 100, 5)]
    kept = simhash.keep_first(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_components(spark):
    rng = random.Random(3)
    chain = [(i + 1, i) for i in range(60)]
    pairs = chain + [(max(a, b), min(a, b)) for a, b in ((rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)) if a != b]
    label = {x: x for p in pairs for x in p}
    for a, b in pairs * 2:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {x: new if c == old else c for x, c in label.items()}
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: c for x, c in label.items() if x != c}


def test_mix(docs, empty, rows):
    found = mixing.mix(docs, block=8).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    target = mixing.targets(sizes)
    taken = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and np.isclose(r["target"], target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 8 for s in sizes)
    again = mixing.mix(docs.repartition(5), block=8).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again) == sorted((r["doc_id"] or -1, r["taken"]) for r in found)
    assert mixing.mix(empty).count() == 0


def test_mix_by_brute_force(docs, rows):
    """Every word taken, from the draws, the permutations and the words' order alone: blocks of a source are its words cut up."""
    block = 8
    base, _ = mixing.plan(docs, block)
    order = {r["row_id"]: r for r in base.collect()}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    words = {s: [] for s in names}
    for r in sorted(order.values(), key=lambda r: r["start"]):
        words[r["source"]] += [r["row_id"]] * r["size"]
    assert all(words[r["source"]][r["start"] : r["start"] + r["size"]] == [r["row_id"]] * r["size"] for r in order.values())
    target = mixing.targets({s: len(words[s]) for s in names})
    slots = np.array([mixing.slots_of(i, len(words[s]), target[s], block) for i, s in enumerate(names)])
    drawn = mixing.draw(slots[:, 0])
    want = dict.fromkeys(order, 0)
    for i, s in enumerate(names):
        own = drawn[drawn["source_no"] == i]
        turns = [k for first, n in zip(own["first"], own["n"], strict=True) for k in range(first, first + n)]
        assert sorted(turns) == list(range(slots[i, 0]))
        blocks = -(-len(words[s]) // block)
        for k in turns:
            at = int(mixing.feistel(np.array([k % blocks]), np.array([blocks]), np.array([mixing.SEED + 1_000_003 * i + 7 * (k // blocks)]))[0])
            for w in words[s][at * block : at * block + (slots[i, 1] if k == slots[i, 0] - 1 else block)]:
                want[w] += 1
    found = {r["row_id"]: r["taken"] for r in mixing.mix(docs, block).collect()}
    key = lambda taken: sorted((order[i]["doc_id"] or -1, order[i]["size"], n) for i, n in taken.items())
    assert key(found) == key(want) and sum(want.values()) > 0


@pytest.mark.parametrize("wanted, sizes", [((15, 40), [7, 30, 3]), ((60, 40), [40]), ((100, 130), [1] * 130), ((0, 40), [40]), ((259, 130), [130])])
def test_small_sources_end_on_target(spark, monkeypatch, wanted, sizes):
    """A source of few words gives its target to the word."""
    want, size = wanted
    monkeypatch.setattr(mixing, "targets", lambda _: {"s": float(want), "t": 900.0})
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n)), "en", "s") for i, n in enumerate(sizes)] + [(500, "t " * 1000, "en", "t")]
    docs = frame(spark, rows)
    taken = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    texts = {"s": 0, "t": 0}
    for r in mixing.mix_documents(docs).collect():
        texts[r["source"]] += len(r["text"].split())
    assert taken == texts == {"s": min(want, 2 * size), "t": 900}


def test_mixed_documents(docs, rows):
    whole = mixing.mix(docs, block=8).agg(F.sum("taken")).first()[0]
    out = mixing.mix_documents(docs, block=8)
    found = out.collect()
    assert out.columns == docs.columns and sum(len(r["text"].encode().split()) for r in found) == whole
    words = {}
    for i, text, *_ in rows:
        words.setdefault(i, set()).update((text or "").split())
    assert all(set(r["text"].split()) <= words[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in found)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_count_tokens(docs, empty, rows):
    tokenizer = tokens.load(tokens.default_path())
    want = sorted(((i or -1, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs).collect()) == want
    assert tokens.count_tokens(empty).count() == 0


def test_pack(docs, empty, rows):
    tokenizer = tokens.load(tokens.default_path())
    found = packing.pack(docs, with_ids=True).collect()
    pieces = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    for i, own in texts.items():
        ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in own]
        assert all(x == ids[0] for x in ids)
        got = sorted(pieces[i])
        assert sum((p for _, p, _ in got[:: len(own)]), []) == ids[0] and {n for *_, n in got} == {len(ids[0])}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 4096
    total = sum(r["length"] for r in found)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) == -(-total // 4096)
    assert packing.pack(empty).count() == 0


def test_language(spark, docs, empty):
    table = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * 3, "en" if i % 2 else "fr", None) for i in range(40)]
    table += [(50, "12 34 !", "en", None), (51, None, "en", None), (52, "", None, None), (None, "the dog", None, None), (53, "the dog " * 9000, None, None)]
    found = {r["doc_id"]: r for r in language.identify(frame(spark, table)).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "fr") and 0.5 < found[i]["score"] <= 1 for i in range(40))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (50, 51, 52))
    assert found[53]["lang_pred"] == found[None]["lang_pred"] == "en" and found[None]["held_out"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    twice = language.identify(frame(spark, table + table)).collect()
    assert len(twice) == 2 * len(table) and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in twice}) == len(table)
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:40]
    tied = language.identify(frame(spark, [(i, "same text", lang, None) for i, lang in zip(learned, ("fr", "en") * 20, strict=True)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in tied} == {("en", 0.5)}
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None))).collect()} == {"und"} and language.identify(empty).count() == 0


def test_languages_of_long_documents_only(spark):
    table = [(i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * (3 if i % 2 else 1000), "en" if i % 2 else "fr", None) for i in range(20)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, table)).collect()}
    assert found == {i: "en" if i % 2 else "fr" for i in range(20)}


def test_samples_are_bounded(spark, monkeypatch):
    """A repeated id draws its rows no more than others do, and no sample is larger than stated."""
    monkeypatch.setattr(toxicity, "POSITIVES", 30)
    monkeypatch.setattr(toxicity, "UNLABELLED", 50)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: seen.update(p=len(positive), u=len(unlabelled), prior=prior) or ({}, 0.0))
    rows = [(1, f"w{i} x y", "en", "s") for i in range(400)] + [(i, f"w{i} y z", "en", "s") for i in range(400)]
    toxicity.train(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 0)], "doc_id long, toxic int"))
    assert seen["p"] == 30 and seen["u"] == 50 and 0.4 < seen["prior"] < 0.6
    sizes = []
    monkeypatch.setattr(language, "Model", lambda found, order: sizes.append({k: len(v) for k, v in found.items()}))
    language.train(frame(spark, [(1, f"w{i}", "en", "s") for i in range(900)] + [(i, f"w{i}", "fr", "s") for i in range(900)] + [(1, "t", "de", "s")] * 50), sample=20)
    assert sizes == [{"en": 20, "fr": 20, "de": 1}]


def test_toxicity_of_contradicting_labels_and_repeats(spark):
    """An id with labels 0 and 1 is toxic; rows that are alike score alike."""
    rng = random.Random(14)
    table = [(i, " ".join([f"w{rng.randint(0, 50)}" for _ in range(20)] + (["vile"] if i % 6 == 0 else [])), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)] + [(i, 0) for i in range(300)], "doc_id long, toxic int")
    found = toxicity.score(frame(spark, table + table), labels).collect()
    assert len(found) == 600 and all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in found) and len({(r["doc_id"], r["score"]) for r in found}) == 300


def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    table, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        own = [f"w{rng.randint(0, 50)}" for _ in range(20)] + (["vile"] if bad else [])
        table.append((i, " ".join(own), "en", "s"))
        labels.append((i, int(bad)))
    frame_, known = frame(spark, [*table, (700, None, None, None), (None, "vile", None, None)]), spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(frame_, known).collect()}
    assert all(found[i]["predicted"] == int(i % 6 == 0) for i in range(600)) and found[700]["predicted"] == 0 and found[None]["predicted"] == 1
    kept = toxicity.reject_toxic(frame_, known)
    assert kept.columns == frame_.columns and kept.count() == 501
    none = toxicity.score(docs, known.limit(0))
    assert none.count() == docs.count() and none.filter("predicted = 1").count() == 0 and toxicity.score(empty, known).count() == 0


def test_toxic_documents_all_long(spark):
    rng = random.Random(10)
    table = [(i, " ".join([f"w{rng.randint(0, 50)}" for _ in range(20)] + (["vile"] * 8000 if i % 6 == 0 else [])), "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in toxicity.score(frame(spark, table), labels).collect())


def test_media_round_trip(docs, empty, rows):
    found = sorted(media.round_trip(docs).collect(), key=lambda r: (r["doc_id"] or -1, r["n_bytes"]))
    for r, (_, text) in zip(found, sorted(((i or -1, (t or "").encode()) for i, t, *_ in rows), key=lambda x: (x[0], len(x[1]))), strict=True):
        data = text + bytes(-len(text) % 64 if text else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        file = jpeg.payload_images([data])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and r["feature"]
    assert media.round_trip(empty).count() == 0


def test_decode_media(spark):
    file = jpeg.payload_images([bytes(range(64)) * 3])[0]
    no_tables = file.replace(b"\xff\xc4", b"\xff\xe4")
    table = [(1, file, "x"), (2, None, "y"), (3, b"no image", "z"), (4, file, "w"), (5, no_tables, ""), (6, file[:-30], ""), (7, b"", ""), (1, file, "x")]
    found = {r["id"]: r for r in media.decode_media(spark.createDataFrame(table, "id int, media binary, rgb string").coalesce(1)).collect()}
    images, coefficients = jpeg.decode([file])
    assert (found[1]["height"], found[1]["width"]) == (16, 16) and found[1]["rgb"] == found[4]["rgb"] == jpeg.rgb(images[0], coefficients).tobytes()
    assert all(found[i]["rgb"] is None and found[i]["height"] is None for i in (2, 3, 5, 6, 7))


def test_token_shards(spark, docs, empty, rows, tmp_path):
    encode = token_shards.load(token_shards.default_path()).encode_ordinary
    shards = token_shards.write_shards(docs, f"file://{tmp_path}/shards", length=16, records=100)
    found = token_shards.read_shards(spark, shards).collect()
    assert sorted(r["slot"] for r in found) == list(range(shards.sequences)) and len({r["shard"] for r in found}) > 20
    got, lists = {}, {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and 2 * r["length"] == len(r["ids"])
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u2").tolist()))
        lists.setdefault(r["shard"], []).append((r["slot"], r["offset"]))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    for i, own in texts.items():
        assert sum((x for _, x in sorted(got[i])[:: len(own)]), []) == [*encode(own[0]), 50256]
    ends = 0
    for shard, own in sorted(lists.items()):  # slots of a file are gapless, and go on where the last file ended
        assert sorted(own) == [(ends + k, k * shards.stride) for k in range(len(own))]
        assert len((tmp_path / f"shards/shard-{shard:09d}.bin").read_bytes()) == len(own) * shards.stride
        ends += len(own)
    none = token_shards.write_shards(empty, f"file://{tmp_path}/none")
    assert none.sequences == 0 and token_shards.read_shards(spark, none).count() == 0


def test_token_shards_in_order(spark, docs, tmp_path):
    """The order is the permutation's: neighbours of a document part, and the same key gives the same files; reading goes on from a slot."""
    folders = [f"file://{tmp_path}/{k}" for k in range(3)]
    table = f"file://{tmp_path}/table"
    docs.select("doc_id", "text").write.parquet(table)
    shards = [token_shards.write_shards(spark.read.parquet(table), f, length=16, records=500, key=k) for f, k in zip(folders, (42, 42, 43), strict=True)]
    files = [sorted((x.name, x.read_bytes()) for x in (tmp_path / str(k)).glob("shard-*.bin")) for k in range(3)]
    assert files[0] == files[1] != files[2]
    whole = {r["slot"]: r for r in token_shards.read_shards(spark, shards[0]).collect()}
    places = [s for s, r in sorted(whole.items()) if r["doc_id"] == 105]
    assert len(places) > 1000 and np.mean(np.diff(places) == 1) < 0.9 and places[0] < 100 and places[-1] > shards[0].sequences - 100
    again = token_shards.Shards.open(spark, folders[0])
    assert again == shards[0]
    for start in (0, 1, 700, shards[0].sequences - 1, shards[0].sequences):
        rest = token_shards.read_shards(spark, again, start).collect()
        assert {r["slot"]: r for r in rest} == {s: r for s, r in whole.items() if s >= start}
    (tmp_path / "0" / files[0][0][0]).write_bytes(files[0][0][1][:-1])
    with pytest.raises(Exception, match="records"):
        token_shards.read_shards(spark, again).count()


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for verdict, rule in url_filter.RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x#y", "https://org/", "https://example.org/es/1", "http://x.example.org/en/2", "http://myorg/x", "ftp://a.com/de/1#z", "http://a.com/fr", "http://a.com/fr/9", "http://b.net?q=://org/", "http://É.com/en/x\ny", "http://a.com:80/fr/1", "http://b.net/" + "a/" * 500]
    table = spark.createDataFrame([(i, u, "t", "v") for i, u in enumerate([*urls, urls[4]])] + [(None, "http://b.net/x", "t", "v")], "page_id long, url string, template string, verdict string")
    found = {r["page_id"]: r for r in url_filter.judge(table).collect()}
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule) and found[i]["verdict"] == (verdict or found[i]["verdict"])
    assert len(found) == len(urls) + 2 and url_filter.judge(table.limit(0)).count() == 0


def brute_tree(urls, blocked, settings=url_filter.Settings()):
    """Verdicts by the definition, one node after the other, in dictionaries. urls: (host, path); blocked: True, False or None."""
    rate = lambda bad, every: (bad + 0.5) / (every + 1)
    shape = lambda path: tuple("*" if re.search(r"[0-9]|^[0-9A-Fa-f-]{16,}$", s) else s for s in re.sub("^/", "", path).split("/"))
    counts = {}
    for (host, path), b in zip(urls, blocked, strict=True):
        own = counts.setdefault((host, shape(path)), [0, 0])
        own[0] += b is not None
        own[1] += b is True
    template = {}

    def split(host, name, level, members):
        every, bad = (sum(counts[host, m][k] for m in members) for k in (0, 1))
        if not 0 < bad < every:
            template.update({(host, m): name + "/**" for m in members})
            return
        template.update({(host, m): name for m in members if len(m) <= level})
        children, groups = {}, {}
        for m in members:
            if len(m) > level:
                children.setdefault(m[level], []).append(m)
        pooled = rate(bad, every)
        for segment, own in children.items():
            n, b = (sum(counts[host, m][k] for m in own) for k in (0, 1))
            apart = segment != "*" and n > 0 and abs(rate(b, n) - pooled) > settings.z * (pooled * (1 - pooled) / n) ** 0.5
            groups.setdefault(segment if apart else "*", []).extend(own)
        for segment, own in groups.items():
            split(host, f"{name}/{segment}", level + 1, own)

    hosts = {}
    for host, parts in counts:
        hosts.setdefault(host, []).append(parts)
    for host, members in hosts.items():
        split(host, "", 0, members)
    sums = lambda pick: [sum(c[k] for key, c in counts.items() if pick(key)) for k in (0, 1)]
    n, b = sums(lambda _: True)
    share, out, known = (b + 1) / (n + 2), [], {}
    for host, path in urls:
        name = template[host, shape(path)]
        if (host, name) not in known:
            n, b = sums(lambda key: key[0] == host)  # noqa: B023
            prior = min(share, (b + settings.strength * share) / (n + settings.strength))
            n, b = sums(lambda key: key[0] == host and template[key] == name)  # noqa: B023
            known[host, name] = (b + settings.strength * prior) / (n + settings.strength)
        out.append((name, known[host, name]))
    return out


@pytest.mark.parametrize("sections", [1, 20, 40, 1000])
def test_tree_as_by_brute_force(spark, sections):
    """One section of a host, and a page two levels down in another, are bad; verdicts don't depend on how many siblings they have."""
    rng, rows, labels = random.Random(sections), [], []
    for i in range(4 * sections + 200):
        section, page = rng.randrange(sections) if i >= 120 else sections, rng.choice(("list", "item", "spam"))
        path = f"/s{chr(97 + section % 26)}{'x' * (section // 26)}/{page}/" + "deep/" * (i % 7) + f"{i}.html"
        rows.append((i, f"http://h.net{path}"))
        if i % 3:
            labels.append((i, section == sections or (page == "spam" and section == 0)))
    rows += [(100_000 + i, f"http://other.net/{i}") for i in range(30)] + [(200_000, None), (200_001, "http://h.net"), (200_002, "http://new.net/x/y")]
    labels += [(100_000 + i, False) for i in range(30)] + [(None, True), (200_002, None), (100_000, True)]
    known = spark.createDataFrame(labels, "page_id long, blocked boolean")
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), (), known).collect()}
    told = {}
    for i, b in labels:
        told[i] = b if told.get(i) is None else told[i] or b
    want = brute_tree([(found[i]["host"], found[i]["path"]) for i, _ in rows], [told.get(i) for i, _ in rows])
    assert [found[i]["template"] for i, _ in rows] == [name for name, _ in want]
    assert np.allclose([found[i]["purity"] for i, _ in rows], [p for _, p in want])
    assert all((found[i]["verdict"] == "block") == (p >= 0.5) for (i, _), (_, p) in zip(rows, want, strict=True))
    assert sections == 1 or all(found[i]["verdict"] == "block" for i in range(120)) and found[100_005]["verdict"] == "allow"


def test_url_sql_where_the_tree_blocks(spark, tmp_path):
    """The SQL's rows where most urls of a host are blocked by rules, so that its other urls are by the tree."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"https://www.bad.com/de/{i}/x") for i in range(80)] + [(100 + i, f"https://www.bad.com/{('en', 'it')[i % 2]}/{i}") for i in range(20)]
    rows += [(200 + i, f"http://mixed.com/{('de', 'fr', 'en')[i % 3]}/a/b/c/d/e/{i}") for i in range(90)] + [(300 + i, f"http://e.example.org/{('es', 'en/1', 'en', 'fr')[i % 4]}{i}") for i in range(80)]
    spark.createDataFrame([*rows, (None, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = duckdb.sql(f"SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(queries.url_sql()).df()
    found = queries.op10_url_filter(spark, str(tmp_path)).toPandas()
    key = lambda x: sorted(map(tuple, x[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(x.notna(), None).to_numpy().tolist()), key=str)
    assert key(found) == key(want) and ((found["verdict"] == "block") & found["rule"].isna()).sum() > 10


def test_templates_by_purity(spark):
    """Of one host's labelled branches, one is all bad, the others are good; only the bad one's new urls are rejected."""
    pages = [(i, f"http://h.net/{('spam', 'news', 'blog')[i % 3]}/{i}/{'page' if i % 2 else 'item'}.html") for i in range(300)]
    labels = [(i, i % 3 == 0) for i in range(0, 300, 2)]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, blocked boolean")).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 3 == 0 else "allow") for r in found)
    assert {r["template"] for r in found} == {"/spam/**", "/news/**", "/blog/**"}
