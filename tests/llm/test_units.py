"""Parts of the operators that need no cluster, against brute force."""

import random
import zlib

import numpy as np
import pytest

from kinweave.llm import common, exact_dedup, jpeg, language, mixing, packing, simhash, tokens, toxicity


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        one = common.feistel(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(one) == list(range(n))
    both = common.feistel(np.r_[0:5, 0:9], np.repeat([5, 9], [5, 9]), np.ones(14))
    assert sorted(both[:5]) == list(range(5)) and sorted(both[5:]) == list(range(9))
    assert list(common.feistel(np.arange(100), np.full(100, 100), np.full(100, 1))) != list(range(100))


@pytest.mark.parametrize("n", [1, 2, 5, 100, 3000])
def test_minimal_perfect_hash(n):
    digest = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    pilots, slots = exact_dedup.build_hash(digest)
    assert sorted(slots) == list(range(n)) and (exact_dedup.find_slots(digest, pilots, n) == slots).all()


def brute_cost(texts, order, keys):
    """Code lengths by the definition, with dictionaries and sets."""
    counts = {}
    for x in texts:
        data = b"\n" * order + x.encode().lower()
        for i in range(order, len(data)):
            for k in range(order + 1):
                own = counts.setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1
    out = []
    for key in keys:
        bits, hidden = 0.0, set()
        for k in range(order, -1, -1):
            own = {s: n for s, n in counts.get(key[order - k : order], {}).items() if s not in hidden}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if key[order] in own:
                bits += np.log2(total / own[key[order]])
                break
            bits += np.log2(total / len(own))
            hidden |= set(own)
        else:
            bits += np.log2(max(256 - len(hidden), 1))
        out.append(bits)
    return np.array(out)


def test_context_tree_costs_are_exact():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abracad ") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    keys = [bytes(rng.choice(b"abracadz \n") for _ in range(4)) for _ in range(300)]
    tree = language.ContextTree(texts, 3)
    asked = np.array([int.from_bytes(k, "big") for k in keys])
    assert np.allclose(tree.cost(asked), brute_cost(texts, 3, keys))


def test_costs_of_a_context_sum_to_one():
    tree = language.ContextTree(["abracadabra", "banana"], 2)
    for context in (b"ab", b"zz", b"an", b"za"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert np.isclose(np.exp2(-tree.cost(keys)).sum(), 1)


def test_language_in_chunks(monkeypatch):
    model = language.Model({"a": ["the cat sat on the mat " * 5], "b": ["le chat est sur le tapis " * 5]})
    texts = ["the mat", "", "le tapis " * 40, "chat"]
    whole = model.lengths(texts)
    monkeypatch.setattr(language, "CHUNK", 16)
    assert np.allclose(model.lengths(texts), whole) and whole[1].sum() == 0
    assert [model.languages[i] for i in whole.argmin(axis=1)] == ["a", "a", "b", "b"]


def payload(kind, n, rng):
    choices = {"any": range(256), "near": (126, 127, 128, 129, 130), "flat": (128,), "rare": (128,) * 40 + (129, 127, 0)}
    return bytes(rng.choice(choices[kind]) for _ in range(64 * n))


def test_jpeg_holds_payloads():
    rng = random.Random(5)
    data = [payload(k, n, rng) for k in ("any", "near", "flat", "rare") for n in (1, 3, 9, 70)]
    files = jpeg.payload_images(data)
    images, found = jpeg.decode(files)
    assert [jpeg.payload_of(i, found) for i in images] == data
    assert all(f[:2] == b"\xff\xd8" and b"\xff\xc2" in f for f in files)
    alone, own = jpeg.decode(files[:1])
    assert jpeg.payload_of(alone[0], own) == data[0]


@pytest.mark.parametrize("interval", [1, 3, 1000])
def test_jpeg_of_three_components(interval):
    """Chroma of half resolution, odd sizes: coefficients come back, and pixels are those of the transform."""
    rng = np.random.default_rng(1)
    height, width = 37, 50
    parts = [jpeg.Component(h, v, np.full(64, q)) for h, v, q in ((2, 2, 1), (1, 1, 2), (1, 1, 2))]
    n = jpeg.lay_out(height, width, parts)
    coefficients = np.where(rng.random((n, 64)) < 0.2, rng.integers(-60, 60, (n, 64)), 0)
    for c in parts:  # only blocks of the image proper are told by scans of one component
        grid = c.first + np.arange(c.rows)[:, None] * c.columns + np.arange(c.columns)
        outside = np.ones(grid.shape, bool)
        outside[: c.own_rows, : c.own_columns] = False
        coefficients[grid[outside], 1:] = 0
    file = jpeg.encode([(height, width, parts, b"")], coefficients, interval)[0]
    images, found = jpeg.decode([file])
    assert (found == coefficients).all() and (images[0].height, images[0].width) == (height, width)
    tensor = jpeg.rgb(images[0], found)
    assert tensor.shape == (height, width, 3) and tensor.dtype == np.uint8
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = coefficients[0]
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    assert np.abs(jpeg.planes(images[0], found)[0][:8, :8] - np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)).max() <= 0.51


def test_colours_by_pixel():
    """Each pixel's colour from the samples that lie under it, by the conversion's definition."""
    rng = np.random.default_rng(2)
    parts = [jpeg.Component(h, v, np.full(64, 3)) for h, v in ((2, 2), (1, 2), (2, 1))]
    n = jpeg.lay_out(21, 35, parts)
    coefficients = np.where(rng.random((n, 64)) < 0.1, rng.integers(-90, 90, (n, 64)), 0).astype(np.int16)
    image = jpeg.Image(21, 35, parts)
    planes = jpeg.planes(image, coefficients)
    tensor = jpeg.rgb(image, coefficients)
    for y in range(21):
        for x in range(35):
            luma, cb, cr = (float(p[y * c.v // 2, x * c.h // 2]) for p, c in zip(planes, parts, strict=True))
            want = (luma + 1.402 * (cr - 128), luma - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), luma + 1.772 * (cb - 128))
            assert all(abs(int(a) - min(255, max(0, b))) <= 0.51 for a, b in zip(tensor[y, x], want, strict=True))


class Scan:
    """Codes one value after the other, with runs of ended blocks, each symbol as its own eight bits."""

    def __init__(self):
        self.bits, self.ended, self.waiting = "", 0, ""

    def symbol(self, symbol, extra="", width=8):
        self.bits += f"{symbol:0{width}b}" + extra

    def flush(self):
        if self.ended:
            n = self.ended.bit_length() - 1
            self.symbol(n << 4, f"{self.ended - (1 << n):0{n}b}" if n else "")
            self.bits, self.ended, self.waiting = self.bits + self.waiting, 0, ""

    def first(self, block, low):
        run = 0
        for c in block:
            v = abs(c) >> low
            if not v:
                run += 1
                continue
            self.flush()
            while run > 15:
                self.symbol(0xF0)
                run -= 16
            s = v.bit_length()
            self.symbol(run << 4 | s, f"{v if c > 0 else v ^ ((1 << s) - 1):0{s}b}")
            run = 0
        self.ended += run > 0

    def refine(self, block, low):
        sizes = [abs(c) >> low for c in block]
        last = max((k for k, v in enumerate(sizes) if v == 1), default=-1)
        run, passed = 0, ""
        for k, v in enumerate(sizes):
            if not v:
                run += 1
                continue
            while run > 15 and k <= last:
                self.flush()
                self.symbol(0xF0)
                self.bits, passed, run = self.bits + passed, "", run - 16
            if v > 1:
                passed += str(v & 1)
                continue
            self.flush()
            self.symbol(run << 4 | 1, "1" if block[k] > 0 else "0")
            self.bits, passed, run = self.bits + passed, "", 0
        if run or passed:
            self.ended, self.waiting = self.ended + 1, self.waiting + passed

    def done(self):
        self.flush()
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def foreign_file(blocks, interval):
    """A grey file of one row of blocks by a plain coder whose codes are flat: every symbol but 255 is its own code."""
    segment = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([2]) * 64) + segment(0xC2, bytes([8, 0, 8]) + (8 * len(blocks)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    flat = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out += segment(0xC4, bytes([0x00]) + flat) + segment(0xC4, bytes([0x10]) + flat) + segment(0xDD, interval.to_bytes(2, "big"))
    step = interval or len(blocks)
    for first, last, high, low in ((0, 0, 0, 0), (1, 40, 0, 2), (41, 63, 0, 1), (1, 40, 2, 1), (1, 63, 1, 0)):
        lanes = []
        for b in range(0, len(blocks), step):
            scan, before = Scan(), 0
            for block in blocks[b : b + step]:
                if first == 0:
                    d, before = block[0] - before, block[0]
                    s = abs(d).bit_length()
                    scan.symbol(s, f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
                else:
                    (scan.refine if high else scan.first)(block[first : last + 1], low)
            lanes.append(scan.done())
        body = b"".join(x + (bytes([255, 0xD0 + k % 8]) if k < len(lanes) - 1 else b"") for k, x in enumerate(lanes))
        out += segment(0xDA, bytes([1, 1, 0, first, last, 16 * high + low])) + body
    return out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 7])
def test_runs_of_ended_blocks(interval):
    rng = np.random.default_rng(interval)
    for share in (0.0, 0.01, 0.1, 0.7):
        blocks = np.where(rng.random((40, 64)) < share, rng.integers(-9, 10, (40, 64)), 0)
        blocks[:, 0] = rng.integers(-100, 100, 40)
        images, found = jpeg.decode([foreign_file(blocks.tolist(), interval)])
        assert images[0].whole and (found == blocks).all()


def test_damaged_files_are_marked():
    """Cut off, without tables, or with bytes changed: an error or a mark, never another file's loss."""
    good = jpeg.payload_images([bytes(range(64)) * 30])[0]
    other = jpeg.payload_images([bytes(range(7, 71)) * 20])[0]
    bad = [good[:-2], good[: len(good) // 2], good[:30], good.replace(b"\xff\xc4", b"\xff\xe4"), good[:-40] + good[-2:]]
    rng = random.Random(1)
    for _ in range(40):
        at = rng.randrange(2, len(good))
        bad.append(good[:at] + bytes([rng.randrange(256)]) + good[at + 1 :])
    marked = 0
    for x in bad:
        try:
            images = [jpeg.parse(x), jpeg.parse(other)]
        except ValueError:
            marked += 1
            continue
        images, found = jpeg.decode([x, other], images)
        assert images[1].whole and jpeg.payload_of(images[1], found) == bytes(range(7, 71)) * 20
        marked += not images[0].whole
    assert marked >= 15 and all(not jpeg.decode([x])[0][0].whole for x in (good[:-2], good[: len(good) // 2], good[:-40] + good[-2:]))


def test_long_payloads_in_stretches(monkeypatch):
    rng = random.Random(6)
    data = [payload("any", 300, rng), payload("rare", 200, rng), payload("near", 1, rng)]
    files = jpeg.payload_images(data)
    monkeypatch.setattr(jpeg, "STRETCH", 32)
    monkeypatch.setattr(jpeg, "STRETCH_BYTES", 500)
    assert jpeg.payload_images(data) == files
    images, found = jpeg.decode(files)
    assert [jpeg.payload_of(i, found) for i in images] == data and all(i.whole for i in images)
    tensor = jpeg.rgb(images[0], found)
    monkeypatch.undo()
    assert (jpeg.rgb(images[0], found) == tensor).all()


def test_not_a_jpeg():
    for bad in (b"", b"text", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00"):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


TEXTS = [
    "", " ", "plain words, and more. " * 60, "x" * 900, "a<|endoftext|> b<|StartOfText|>. <|endoftext|>" * 30, "é́ ÀÉ. ñÑ! 　 \x1c \x85 don't I'LL " * 40,
    "漢字かな交じり文" * 60, "word\n\n\t" * 100 + "y" * 300 + " end",
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(tokens.default_path())


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_in_chunks(tokenizer, text):
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((64, 8), (100, 1), (7, 3)):
        assert [int(i) for x in tokens.encode_pieces(tokenizer, text, chunk, overlap) for i in x] == whole
    assert np.frombuffer(tokens.WordEncoder(tokenizer).ids(text), "<u4").tolist() == whole


def test_word_encoder_forgets_the_oldest(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 20)
    encoder = tokens.WordEncoder(tokenizer)
    for i in range(200):
        text = f"the word{i} and, then{i}."
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder) <= 30 and b"the" in encoder and b"word3" not in encoder and b"word3" not in encoder.older


def test_word_encoder_on_random_texts(tokenizer):
    rng, encoder = random.Random(7), tokens.WordEncoder(tokenizer)
    for letters in ("aAéÉ.!,'<|>endoftext \t\n1½Ⅻ̸́ßſK", "abÀÖßØÿþÞñÑ÷×µ. ,", "aB.!?,;: "):
        texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(200)]
        found = [np.frombuffer(encoder.ids(x), "<u4").tolist() for x in texts]
        assert found == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_targets():
    found = mixing.targets({"c": 100, "a": 10, "b": 100})
    assert found["a"] == 20 and np.isclose(found["b"], 295 * 2 / 3) and np.isclose(found["c"], 295 / 3)
    sizes = {"b": 100, "a": 100, None: 100, "c": 1}
    found = mixing.targets(sizes)
    assert found["c"] == 2 and np.isclose(found["a"], found[None]) and np.isclose(sum(found.values()), 1.5 * 301)
    assert all(found[s] <= 2 * n + 1e-9 for s, n in sizes.items())
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_draws_end_at_the_slots():
    slots = np.array([9000, 0, 17, 40_000])
    drawn = mixing.draw(slots)
    assert (drawn.groupby("source_no")["n"].sum().reindex(range(4), fill_value=0) == slots).all()
    assert (drawn.groupby("shard")["n"].sum().iloc[:-1] == mixing.SHARD_SLOTS).all() and drawn.equals(mixing.draw(slots))
    first = drawn.groupby("source_no")["n"].cumsum() - drawn["n"]
    assert (drawn["first"] == first).all() and len(mixing.draw(np.array([0, 0]))) == 0


def best_fill(left, capacity):
    longest, reach = max(left), {max(left)}
    for length, n in left.items():
        for _ in range(n - (length == longest)):
            reach |= {r + length for r in reach if r + length <= capacity}
    return max(reach)


def test_fill_is_as_close_as_can_be():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        used = packing.fill(left, 40)
        assert sum(k * n for k, n in used.items()) == best_fill(left, 40) and all(n <= left[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    counts = {5: 1000, 7: 3, 4096: 2, 4000: 10, 96: 4}
    patterns = packing.plan(counts)
    total = {}
    for used, times in patterns:
        assert sum(k * n for k, n in used.items()) <= 4096
        for k, n in used.items():
            total[k] = total.get(k, 0) + n * times
    assert total == counts and packing.plan({}) == []


def brute_fingerprint(text, words):
    import xxhash

    own = text.encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", " \t", "One", "a b c", "a b c d", "The cat sat on THE mat É and the cat sat"):
        assert int(simhash.fingerprint(text, 4)[0]) == brute_fingerprint(text, 4)


def joined(pairs, n):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("size", [2, 40, 200])
def test_posting_lists_lose_no_link(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, size // 4 + 1, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (size, 3), dtype=np.uint64), axis=1)
    fp = (base[rng.integers(0, len(base), size)] ^ flips)[:, None]
    node = np.arange(size)
    want = [(i, j) for i in range(size) for j in range(i) if simhash.near(fp[i], fp[j : j + 1])[0]]
    for found in (simhash.within(np.zeros(size, int), node, fp), simhash.forest(node, fp)):
        assert joined([(a, b) for x, y in found for a, b in zip(x, y, strict=True)], size) == joined(want, size)


def test_pairs_in_reach_share_a_key():
    rng = random.Random(1)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        same = [i for i in range(8) if (a >> 8 * i) & 255 == (b >> 8 * i) & 255]
        assert len(same) >= 4 and any(set(k) <= set(same) for k in simhash.EXACT.keys())


def test_risk_stays_corrected():
    rng = random.Random(4)
    neutral = [f"w{i}" for i in range(60)]
    document = lambda bad: {w.encode() for w in [*rng.sample(neutral, 15), *(["bad"] if bad else [])]}
    positive = [document(True) for _ in range(200)]
    unlabelled = [document(rng.random() < 0.1) for _ in range(600)]
    weights, bias = toxicity.fit(positive, unlabelled, 0.1)
    assert weights[b"bad"] + bias > 0 > bias and max(weights, key=weights.get) == b"bad"
    assert toxicity.fit([], unlabelled, 0.1)[0] == {} and toxicity.fit(positive, unlabelled, 0.0)[0] == {}


def test_risk_by_its_definition():
    """Both parts of the risk from single losses, and their gradients from finite differences."""
    rng = np.random.default_rng(3)
    xp, xu = (rng.integers(0, 2, (n, 5)).astype(np.float64) for n in (13, 29))
    theta, prior = rng.normal(size=6).astype(np.float32).astype(np.float64), 0.17
    loss = lambda x, sign: np.mean([np.log1p(np.exp(-sign * (row @ theta[:-1] + theta[-1]))) for row in x])
    positive, negative, up, down = toxicity.risk(theta, xp, xu, prior)
    assert np.isclose(positive, prior * loss(xp, 1)) and np.isclose(negative, loss(xu, -1) - prior * loss(xp, -1))
    for k in range(6):
        step = np.zeros(6)
        step[k] = 2.0**-10
        high, low = (toxicity.risk(theta + s * step, xp, xu, prior)[:2] for s in (1, -1))
        assert np.allclose([(h - x) / 2.0**-9 for h, x in zip(high, low, strict=True)], [up[k], down[k]], atol=1e-4)


def test_bounds_of_samples():
    """About half as many again as wanted are below the bound, at any number of rows."""
    for want, of in ((400, 10**9), (400, 10**13), (4000, 10**18), (2000, 3001)):
        assert np.isclose(common.bound63(want, of) / 2**63, min(1, 1.5 * want / of), rtol=1e-9) and common.bound63(want, of) > 0
    assert common.bound63(400, 5) == common.bound63(400, 0) == 2**63 - 1


def test_contraction_is_linear_and_bounded(monkeypatch):
    """Links that don't contract: as many come out, in pieces, and each is looked at a few times only."""
    import pandas as pd

    from kinweave.llm import components

    monkeypatch.setattr(components, "CHUNK", 1000)
    monkeypatch.setattr(components, "MOST_HELD", 30_000)
    worked, plain = [], components.stars
    monkeypatch.setattr(components, "stars", lambda a, b: worked.append(len(a)) or plain(a, b))
    n = 100_000
    node = np.arange(n) * 2
    batches = [pd.DataFrame({"a": node[i : i + 500] + 1, "b": node[i : i + 500]}) for i in range(0, n, 500)]
    out = list(components._contract(iter(batches)))
    assert sum(map(len, out)) == n and max(map(len, out)) < 80_000 and len(out) > 1 and sum(worked) < 5 * n


def test_held_out_fold_is_crc32(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 0, 7, 123456789012)], "doc_id long").select("doc_id", common.held_out().alias("h")).collect()
    assert [r["h"] for r in rows] == [zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0 for r in rows]
