"""Progressive JPEG: an encoder of coefficients and a decoder, both in numpy over many restart intervals at once."""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

#: Blocks (MCUs, where a scan has several components) of a restart interval; most MCUs of 16 pixels down an image.
INTERVAL, SIDE = 4, 4095
#: Blocks that a scan is coded for at once, and bytes of a scan that are decoded at once; longer scans go through in stretches of whole intervals.
STRETCH, STRETCH_BYTES = 1 << 15, 1 << 22


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = zigzag()


def codes(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A Huffman table's segment body (counts, symbols) and the code and length of each symbol, from code lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in symbols:
        at <<= lengths[s] - last
        code[s], size[s], last = at, lengths[s], lengths[s]
        at += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(symbols), code, size


#: The encoder's tables: differences of DC; runs and sizes of AC; refinement of AC.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {0x00: 4} | {s: 4 for s in range(1, 9)} | {16 * r + s: 9 for r in range(16) for s in range(0, 12) if (r, s) != (0, 0) and not (r == 0 and s < 9)}
FINE_LENGTHS = {0x00: 1, 0xF0: 6} | {16 * r + 1: 6 for r in range(16)}
#: Scans: first and last coefficient, bits known before, lowest bit told.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0))


TABLES = [codes(x) for x in (DC_LENGTHS, AC_LENGTHS, FINE_LENGTHS)]
SIZES = np.array([x.bit_length() for x in range(1 << 12)])


def _values(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The extra bits of a signed value: itself, or for negatives one less in `size` bits."""
    return np.where(x < 0, x + (1 << size) - 1, x)


def _coded_values() -> tuple[np.ndarray, np.ndarray]:
    """Code with extra bits, and their length, of each run up to 15 and value from -2047 to 2047: at run * 4096 + value + 2048."""
    v = np.arange(-2048, 2048)
    s = SIZES[np.minimum(np.abs(v), 2047)]
    symbol = (np.arange(16)[:, None] << 4) | s
    _, code, size = TABLES[1]
    return ((code[symbol] << s) | _values(v, s)).ravel(), (size[symbol] + s).ravel()


CODED, CODED_LENGTH = _coded_values()


def ragged(n: np.ndarray) -> np.ndarray:
    """0 .. n[i]-1 for each i, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)


def _write_bits(value: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Packs values of up to 24 bits, in order of their lanes, each lane padded to a byte with ones; the bytes and each lane's number of bytes."""
    ends = np.cumsum(length)
    last = np.searchsorted(lane, np.arange(lanes), "right")
    bits = np.diff(np.r_[0, ends][last], prepend=0)
    pad = -bits % 8
    size = (bits + pad) >> 3
    base = (np.cumsum(size) - size) << 3
    words = (int(size.sum()) >> 2) + 2
    out = np.zeros(words)
    at = ends - length + (np.cumsum(pad) - pad)[lane]
    for at_, value_, length_ in ((at, value, length), (base + bits, (1 << pad) - 1, pad)):
        word, shift = at_ >> 5, 32 - length_ - (at_ & 31)
        # the bits never overlap, so sums of up to 32 of them are what they make together, exactly
        over = np.flatnonzero(shift < 0)
        out += np.bincount(word, np.where(shift < 0, value_ >> np.maximum(-shift, 0), value_ << np.maximum(shift, 0)), words)[:words]
        if len(over):
            out += np.bincount(word[over] + 1, (value_[over] << (32 + shift[over])) & 0xFFFFFFFF, words)[:words]
    return out.astype(">u4").view(np.uint8)[: int(size.sum())], size


def _dc_items(dc: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, code, size = TABLES[0]
    diff = np.diff(dc, prepend=0)
    diff[new] = dc[new]
    s = SIZES[np.abs(diff)]
    return (code[s] << s) | _values(diff, s), size[s] + s


def _insert(at: np.ndarray, block: np.ndarray, value: np.ndarray, length: np.ndarray, new: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.insert(x, at, y) for x, y in zip((block, value, length), new, strict=True)) if len(at) else (block, value, length)


def _ac_items(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, value and length of each code of a first scan; x: blocks by coefficients of the band."""
    _, code, size = TABLES[1]
    where = np.flatnonzero(x)
    block = where // x.shape[1]
    run = np.diff(where, prepend=-1) - 1
    first = np.flatnonzero(np.diff(block, prepend=-1))
    run[first] = where[first] - block[first] * x.shape[1]
    index = ((run & 15) << 12) + x.ravel()[where] + 2048
    value, length, long = CODED[index], CODED_LENGTH[index], run >> 4
    if long.any():
        n = long + 1
        main = np.cumsum(n) - 1
        block = np.repeat(block, n)
        all_value, all_length = np.full(len(block), code[0xF0]), np.full(len(block), size[0xF0])
        all_value[main], all_length[main] = value, length
        value, length = all_value, all_length
    open_ = np.flatnonzero(x[:, -1] == 0)
    return _insert(np.searchsorted(block, open_, "right"), block, value, length, (open_, code[0], size[0]))


#: Correction bits that are told as one value.
TOGETHER = 20


def _known_items(low: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of blocks where nothing is new: the end, and the correction bits of all known coefficients."""
    _, code, size = TABLES[2]
    own = low[rows]
    b, k = np.nonzero(own)
    n = np.bincount(b, minlength=len(rows))
    nth = ragged(n)
    start = np.flatnonzero(nth % TOGETHER == 0)
    length = np.diff(np.r_[start, len(b)])
    value = np.add.reduceat((own[b, k] & 1).astype(np.int64) << (np.repeat(length, length) - 1 - nth % TOGETHER), start) if len(start) else np.zeros(0, np.int64)
    every = np.arange(len(rows))
    block, value, length = _insert(np.searchsorted(b[start], every), b[start], value, length, (every, code[0], size[0]))
    return rows[block], value, length


def _fine_items(x: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, value and length of each code and correction bit of a refining scan of a band.

    An event (a coefficient that becomes non-zero, sixteen zeros passed before one, or the end of what is new in a
    block) is followed by the correction bits of the known coefficients that it passes.
    """
    _, code, size = TABLES[2]
    all_low = np.abs(x) >> bit
    new = (all_low == 1).any(axis=1)
    plain = _known_items(all_low, np.flatnonzero(~new))
    rows = np.flatnonzero(new)
    if not len(rows):
        return plain
    low, width = all_low[rows], x.shape[1]
    known, fresh, zero = low > 1, low == 1, low == 0
    zeros = np.cumsum(zero, axis=1)
    at = np.arange(width)
    last = np.maximum.accumulate(np.where(fresh, at, -1), axis=1)
    previous = np.concatenate([np.full((len(rows), 1), -1), last[:, :-1]], axis=1)
    passed = zeros - np.where(previous >= 0, np.take_along_axis(zeros, np.maximum(previous, 0), axis=1), 0)
    sixteen = zero & (passed % 16 == 0) & (passed > 0) & (at < last[:, -1:])
    event = fresh | sixteen
    own, k = np.nonzero(event)
    isnew = fresh[own, k]
    symbol = np.where(isnew, ((passed[own, k] & 15) << 4) | 1, 0xF0)
    value = np.where(isnew, (code[symbol] << 1) | (x[rows[own], k] > 0), code[symbol])
    length = size[symbol] + isnew
    open_ = np.flatnonzero(last[:, -1] < width - 1)
    until = np.minimum.accumulate(np.where(event, at, width)[:, ::-1], axis=1)[:, ::-1]
    b2, k2 = np.nonzero(known)
    key = np.r_[(own << 14) | (k << 7), (open_ << 14) | (width << 7), (b2 << 14) | (until[b2, k2] << 7) | (k2 + 1)]
    order = np.argsort(key, kind="stable")
    value = np.r_[value, np.full(len(open_), code[0]), low[b2, k2] & 1][order]
    length = np.r_[length, np.full(len(open_), size[0]), np.ones(len(b2), np.int64)][order]
    every = [np.r_[a, b] for a, b in zip(plain, (rows[key[order] >> 14], value, length), strict=True)]
    order = np.argsort(every[0], kind="stable")
    return every[0][order], every[1][order], every[2][order]


@dataclass
class Component:
    """A component's sampling factors, its quantisation table (zigzag order) and its blocks' grid, padded to whole MCUs."""

    h: int
    v: int
    quant: np.ndarray
    rows: int = 0
    columns: int = 0
    own_rows: int = 0
    own_columns: int = 0
    first: int = 0
    tables: dict = field(default_factory=dict)


def lay_out(height: int, width: int, parts: list[Component], first: int = 0) -> int:
    """Sets the grids of an image's components, and where each one's blocks begin; the number of blocks so far."""
    hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for c in parts:
        c.rows, c.columns = down * c.v, across * c.h
        c.own_rows, c.own_columns = -(-(-(-height * c.v // vmax)) // 8), -(-(-(-width * c.h // hmax)) // 8)
        c.first = first
        first += c.rows * c.columns
    return first


def scan_blocks(images: list[list[Component]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A scan of images whose components have the same sampling factors: the blocks in order, image after image, the place
    in the scan of each one's component, the number of blocks of each image, and of an MCU."""
    if len(images[0]) == 1:
        first, rows, columns, stride = np.array([(c.first, c.own_rows, c.own_columns, c.columns) for (c,) in images], np.int64).T
        n = rows * columns
        i, wide = ragged(n), np.repeat(columns, n)
        y = i // wide
        blocks = np.repeat(first, n) + y * np.repeat(stride, n) + i - y * wide
        return blocks, np.zeros(len(blocks), np.int64), n, 1
    k, y, x = np.array([(k, y, x) for k, c in enumerate(images[0]) for y in range(c.v) for x in range(c.h)]).T
    v, h = np.array([(c.v, c.h) for c in images[0]]).T
    down, across = np.array([(own[0].rows // own[0].v, own[0].columns // own[0].h) for own in images], np.int64).T
    first, stride = np.array([[(c.first, c.columns) for c in own] for own in images], np.int64).transpose(2, 0, 1)
    n = down * across
    who, i = np.repeat(np.arange(len(images)), n), ragged(n)
    my, mx = np.divmod(i, across[who])
    blocks = first[who][:, k] + (my[:, None] * v[k] + y) * stride[who][:, k] + mx[:, None] * h[k] + x
    return blocks.ravel(), np.tile(k, len(i)), n * len(k), len(k)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _encode_scan(scan: tuple, images: list[list[Component]], coefficients: np.ndarray, interval: int) -> list[bytes]:
    """The entropy-coded bytes of one scan of each image, with restart markers."""
    first, last, high, low = scan
    order, owner, n, mcu = scan_blocks(images)
    counts = -(-n // (mcu * interval))
    base = np.cumsum(counts) - counts
    lane = np.repeat(base, n) + ragged(n) // (mcu * interval)
    final = np.zeros(int(counts.sum()), bool)
    final[base + counts - 1] = True
    number = ragged(counts) % 8
    done, sizes = [], []
    edges = np.unique(np.searchsorted(lane, lane[np.arange(0, len(lane), STRETCH)]))
    for b, e in zip(edges, [*edges[1:], len(lane)], strict=True):
        own, at = lane[b:e] - lane[b], lane[b]
        lanes = int(own[-1]) + 1
        x = coefficients[order[b:e], first : last + 1]
        if first == 0 and high:
            block, value, length = np.arange(e - b), (x[:, 0].astype(np.int64) >> low) & 1, np.ones(e - b, np.int64)
        elif first == 0:
            block, value, length = np.arange(e - b), np.zeros(e - b, np.int64), np.zeros(e - b, np.int64)
            for k in range(len(images[0])):
                i = np.flatnonzero(owner[b:e] == k)
                value[i], length[i] = _dc_items(x[i, 0].astype(np.int64) >> low, np.diff(own[i], prepend=-1) > 0)
        elif high:
            block, value, length = _fine_items(x, low)
        else:
            block, value, length = _ac_items(np.sign(x) * (np.abs(x) >> low) if low else x)
        data, size = _write_bits(value, length, own[block], lanes)
        # a zero after each 255, and a marker after each interval but an image's last
        stuffed = data == 255
        grow, ends, marked = stuffed + np.int64(1), np.cumsum(size), ~final[at : at + lanes]
        grow[ends[marked] - 1] += 2
        to = np.cumsum(grow) - grow
        out = np.zeros(int(to[-1] + grow[-1]) if len(to) else 0, np.uint8)
        out[to] = data
        mark = to[ends[marked] - 1] + 1 + stuffed[ends[marked] - 1]
        out[mark], out[mark + 1] = 255, 0xD0 + number[at : at + lanes][marked]
        done.append(out.tobytes())
        sizes.append(np.diff((to + grow)[ends - 1], prepend=0))
    whole, ends = b"".join(done), np.cumsum(np.concatenate(sizes))[final].tolist() if sizes else []
    return [whole[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]


def encode(images: list[tuple[int, int, list[Component], bytes]], coefficients: np.ndarray, interval: int = INTERVAL) -> list[bytes]:
    """Progressive JPEG files of images (height, width, components, comment) from their quantised coefficients.

    The components of all images are laid out one after the other; ``coefficients`` has a row of 64 in zigzag order for
    each block. A scan of DC takes all components of an image, one of AC a single one.
    """
    files: list[bytes] = [b""] * len(images)
    huffman = b"".join(_segment(0xC4, bytes([kind]) + TABLES[k][0]) for k, kind in enumerate((0x00, 0x10, 0x11)))
    alike: dict[tuple, list[int]] = {}
    for i, (_, _, parts, _) in enumerate(images):
        alike.setdefault(tuple((c.h, c.v) for c in parts), []).append(i)
    for shape, members in alike.items():
        parts = [images[i][2] for i in members]
        bodies: list[list[bytes]] = [[] for _ in members]
        for first, last, high, low in SCANS:
            for own in [range(len(shape))] if first == 0 else [[c] for c in range(len(shape))]:
                tables = b"".join(bytes([c + 1, 0x00 if first == 0 else 0x01 if high else 0x00]) for c in own)
                head = _segment(0xDA, bytes([len(own)]) + tables + bytes([first, last, 16 * high + low]))
                for body, data in zip(bodies, _encode_scan((first, last, high, low), [[p[c] for c in own] for p in parts], coefficients, interval), strict=True):
                    body += [head, data]
        for i, body in zip(members, bodies, strict=True):
            height, width, parts_, comment = images[i]
            quants = [c.quant.tobytes() for c in parts_]
            index = {q: k for k, q in enumerate(dict.fromkeys(quants))}
            frame = struct.pack(">BHHB", 8, height, width, len(parts_)) + b"".join(bytes([k + 1, 16 * c.h + c.v, index[q]]) for k, (c, q) in enumerate(zip(parts_, quants, strict=True)))
            tables = b"".join(_segment(0xDB, bytes([k]) + bytes(np.frombuffer(q, np.int64).tolist())) for q, k in index.items())
            files[i] = b"".join([b"\xff\xd8", _segment(0xFE, comment), tables, _segment(0xC2, frame), huffman, _segment(0xDD, struct.pack(">H", interval)), *body, b"\xff\xd9"])
    return files


@dataclass
class Image:
    """What the decoder knows of a file: size, components, comment, and its scans' parameters and bytes; whether it is whole."""

    height: int = 0
    width: int = 0
    parts: list[Component] = field(default_factory=list)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)
    whole: bool = True


def parse(data: bytes) -> Image:
    """Reads a file's segments; ValueError if it isn't a progressive JPEG of 8 bits and one or three components."""
    try:
        return _parse(data)
    except (KeyError, IndexError, TypeError, struct.error) as error:
        raise ValueError("a segment is damaged") from error


def _parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    x = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(x[:-1] == 255)
    kinds = x[marks + 1]
    stops = marks[(kinds != 0) & (kinds != 255) & (kinds & 0xF8 != 0xD0)].tolist()
    out, quants, tables, names, interval, at = Image(), {}, {}, {}, 0, 2
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 255 or size < 2 or at + 2 + size > len(data):
            raise ValueError("no whole segment where one must be")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDA:
            n = body[0]
            own = [(names[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            high, low = bits >> 4, bits & 15
            huffman = () if first == 0 and high else tuple(tables[t >> 4 if first == 0 else 16 + (t & 15)] for _, t in own)
            if not own or not first <= last <= 63 or (first == 0 < last) or (first and n > 1) or low > 13:
                raise ValueError("no scan of a progressive JPEG")
            k = bisect_left(stops, at)
            stop = stops[k] if k < len(stops) else len(data)
            out.scans.append((first, last, high, low, tuple(c for c, _ in own), huffman, interval, at, stop))
            at = stop
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if len(body) < n:
                    raise ValueError("a Huffman table is cut off")
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xFE:
            out.comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xC2:
            bits, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            for k in range(n):
                name, factors, q = body[6 + 3 * k : 9 + 3 * k]
                names[name] = len(out.parts)
                out.parts.append(Component(factors >> 4, factors & 15, quants.get(q)))
                out.parts[-1].tables["quant"] = q
            if bits != 8 or n not in (1, 3) or not out.height or not out.width or any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in out.parts):
                raise ValueError("not 8 bits a sample of one or three components")
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
    out.whole = data[at : at + 2] == b"\xff\xd9" and len(out.scans) > 0
    if not out.parts:
        raise ValueError("no frame")
    for c in out.parts:
        c.quant = quants[c.tables["quant"]]
        if len(c.quant) != 64 or max(d.h for d in out.parts) % c.h or max(d.v for d in out.parts) % c.v:
            raise ValueError("sampling factors that don't divide the largest, or a short quantisation table")
    if lay_out(out.height, out.width, out.parts) > 8 * len(data):
        raise ValueError("more blocks than the file has bits, and each takes one at least")
    return out


class _Bits:
    """Bits of many lanes in one array of bytes; past the end there are zeros."""

    def __init__(self, data: np.ndarray):
        self.data = np.r_[data, np.zeros(8, np.uint8)]
        x = self.data.astype(np.int64)
        self.words = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
        self.top = len(self.words) - 1

    def get(self, at: np.ndarray, n) -> np.ndarray:
        return (self.words[np.minimum(at >> 3, self.top)] >> (32 - n - (at & 7))) & ((1 << n) - 1)

    def single(self, at: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.data)[np.minimum(at, 8 * len(self.data) - 1)]


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)


@lru_cache(64)
def lookup(body: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol * 32 + length of its code, 0 if there is no such code."""
    counts, symbols = body[:16], body[16:]
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def whole_codes(body: bytes) -> np.ndarray:
    """The same for codes of AC with their extra bits: (value << 13) | (size << 9) | (run << 5) | bits in all, which are 0
    if 16 don't hold them. The value of a size 0 is how many blocks end."""
    code, ahead = lookup(body), np.arange(1 << 16)
    length, run, s = code & 31, code >> 9, (code >> 5) & 15
    extra = np.where(s > 0, s, np.where(run < 15, run, 0))
    told = (ahead >> np.maximum(16 - length - extra, 0)) & ((1 << extra) - 1)
    value = np.where(s > 0, _extend(told, s), np.where(run < 15, (1 << run) + told, 0))
    fits = (length > 0) & (length + extra <= 16)
    return (value << 13) | (s << 9) | (run << 5) | np.where(fits, length + extra, 0)


def _long_codes(bits: _Bits, p: np.ndarray, codes_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Length in all, run, size, value and whether there is such a code, where 16 bits don't hold a code and its extra bits."""
    code = codes_[bits.get(p, 16)]
    length, run, s = code & 31, code >> 9, (code >> 5) & 15
    extra = np.where(s > 0, s, np.where(run < 15, run, 0))
    told = bits.get(p + length, extra)
    return np.maximum(length + extra, 1), run, s, np.where(s > 0, _extend(told, s), np.where(run < 15, (1 << run) + told, 0)), length == 0


def _decode_scan(bits: _Bits, at: np.ndarray, blocks: np.ndarray, owner: np.ndarray, count: np.ndarray, params: tuple, coefficients: np.ndarray) -> np.ndarray:
    """Decodes a scan of many lanes at once: each lane's bits start at ``at``, and it has the next ``count`` of the blocks.
    Returns where each lane's bits end, -1 for what no file can have."""
    first, last, high, low, huffman = params
    flat = coefficients.reshape(-1)
    begin, end = np.cumsum(count) - count, at.copy()
    if first == 0 and high:
        flat[blocks << 6] |= bits.single(np.repeat(at, count) + ragged(count)).astype(flat.dtype) << low
        return at + count
    if first == 0:
        table = np.concatenate([lookup(h) for h in huffman])
        known = np.zeros((len(at), len(huffman)), np.int64)
        for j in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > j)
            b, p = begin[on] + j, end[on]
            own = owner[b]
            code = table[(own << 16) | bits.get(p, 16)]
            s = np.minimum(code >> 5, 15)
            known[on, own] += np.where(s > 0, _extend(bits.get(p + (code & 31), s), s), 0)
            end[on] = np.where((p < 0) | (code == 0), np.int64(-1 << 40), p + (code & 31) + s)
            flat[blocks[b] << 6] = known[on, own] << low
            end[on] = np.where(end[on] < 0, -1, end[on])
        return end
    on = np.flatnonzero(count > 0)
    p, j, stop, k = at[on], begin[on].copy(), (begin + count)[on], np.full(len(on), first)
    if not high:
        table, words, top, wrong = whole_codes(huffman[0]), bits.words, bits.top, []
        row = blocks[j] << 6
        while len(on):
            e = table[(words[np.minimum(p >> 3, top)] >> (16 - (p & 7))) & 0xFFFF]
            total, run, s, value = e & 31, (e >> 5) & 15, (e >> 9) & 15, e >> 13
            if not total.all():
                i = np.flatnonzero(total == 0)
                total[i], run[i], s[i], value[i], bad = _long_codes(bits, p[i], lookup(huffman[0]))
                wrong.append(on[i[bad]])
            p = p + total
            k = k + run
            if s.all():
                done = np.int64(0)
                flat[row + np.minimum(k, 63)] = value << low
                if k.max() > last:
                    wrong.append(on[k > last])
            else:
                hit = np.flatnonzero(s)
                flat[row[hit] + np.minimum(k[hit], 63)] = value[hit] << low
                wrong.append(on[hit[k[hit] > last]])
                done = np.where((s == 0) & (run < 15), value, 0)
            k = k + 1
            over = (done > 0) | (k > last)
            if over.any():
                j = j + np.maximum(done, k > last)
                k = np.where(over, first, k)
                gone = j >= stop
                if gone.any():
                    end[on[gone]] = np.where(j[gone] > stop[gone], -1, p[gone])
                    stay = np.flatnonzero(~gone)
                    on, p, j, stop, k = on[stay], p[stay], j[stay], stop[stay], k[stay]
                row = blocks[j] << 6
        if wrong:
            end[np.concatenate(wrong)] = -1
        return end
    # Refinement. First the codes are walked, with what each one passes noted; then all correction bits are applied.
    table = lookup(huffman[0])
    band = coefficients[blocks, first : last + 1] != 0
    width = last - first + 1
    zeros = np.concatenate([np.zeros((len(blocks), 1), np.int8), np.cumsum(~band, axis=1, dtype=np.int8)], axis=1)
    place = np.full((len(blocks), width + 17), width, np.int8)
    row, col = np.nonzero(~band)
    place[row, zeros[row, col]] = col
    k, rest, notes, fresh, wrong = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), [], [], []
    while len(on):
        running = rest > 0
        code = table[bits.get(p, 16)]
        run, s = code >> 9, (code >> 5) & 15
        start = ~running & (s == 0) & (run < 15)
        wrong.append(on[~running & ((code == 0) | (s > 1))])
        p = p + np.where(running, 0, code & 31)
        value = bits.get(p, np.where(running, 0, np.where(start, run, s)))
        p = p + np.where(running, 0, np.where(start, run, s))
        rest = np.where(start, (1 << run) + value, rest)
        ends = running | start
        seen = zeros[j, k].astype(np.int64)
        to = np.where(ends, width, place[j, np.minimum(seen + run, width + 16)]).astype(np.int64)
        passed = (to - k) - (zeros[j, to] - seen)
        some = np.flatnonzero(passed > 0)
        notes.append(np.stack([j[some], k[some], p[some], passed[some]]))
        new = np.flatnonzero(~ends & (s > 0) & (to < width))
        wrong.append(on[~ends & (to >= width)])
        fresh.append(np.stack([j[new], to[new], np.where(value[new] > 0, 1, -1)]))
        p = p + passed
        k = to + 1
        rest = np.where(ends, rest - 1, rest)
        over = k >= width
        j, k = j + over, np.where(over, 0, k)
        if over.any():
            gone = j >= stop
            end[on[gone]] = np.where(rest[gone] > 0, -1, p[gone])
            stay = np.flatnonzero(~gone)
            on, p, j, stop, k, rest = on[stay], p[stay], j[stay], stop[stay], k[stay], rest[stay]
    # the known coefficients of a band in order, numbered through, so that a note's are a stretch of them
    note = np.concatenate(notes, axis=1) if notes else np.zeros((4, 0), np.int64)
    known = np.flatnonzero(band)
    row = known // width
    known = (blocks[row] << 6) + known - row * width + first
    per = band.sum(axis=1)
    nth = (np.cumsum(per) - per)[note[0]] + note[1] - zeros[note[0], note[1]]
    n = note[3]
    step = ragged(n)
    told = np.flatnonzero(bits.single(np.repeat(note[2], n) + step))
    which = known[(np.repeat(nth, n) + step)[told]]
    flat[which] += np.sign(flat[which]) << low
    if fresh:
        r, c, sign = np.concatenate(fresh, axis=1)
        flat[(blocks[r] << 6) + c + first] = sign << low
    if wrong:
        end[np.concatenate(wrong)] = -1
    return end


def decode(files: list[bytes], images: list[Image] | None = None) -> tuple[list[Image], np.ndarray]:
    """The images and the coefficients of all their blocks (zigzag order), accumulated over their scans.

    Files with the same scans and tables are decoded together, each restart interval being a lane of its own. An image
    isn't whole any more if a lane has a code that there isn't, or its codes end elsewhere than its bytes.
    """
    images, total = images or [parse(x) for x in files], 0
    for x in images:
        total = lay_out(x.height, x.width, x.parts, total)
    coefficients = np.zeros((total, 64), np.int16)
    for step in range(max((len(x.scans) for x in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if step < len(x.scans):
                first, last, high, low, own, huffman, interval, _, _ = x.scans[step]
                groups.setdefault((first, last, high, low, huffman, interval, tuple((x.parts[c].h, x.parts[c].v) for c in own)), []).append(i)
        for (*params, interval, _), members in groups.items():
            scans = [images[i].scans[step] for i in members]
            _decode_group(files, images, members, scans, interval, tuple(params), coefficients)
    return images, coefficients


def _decode_group(files: list[bytes], images: list[Image], members: list[int], scans: list[tuple], interval: int, params: tuple, coefficients: np.ndarray) -> None:
    order, owner, n, mcu = scan_blocks([[images[i].parts[c] for c in scan[4]] for i, scan in zip(members, scans, strict=True)])
    # a zero after each file's bytes, so that none of them makes up a marker with the next file's
    x = np.frombuffer(b"\0".join([*(files[i][scan[7] : scan[8]] for i, scan in zip(members, scans, strict=True)), b""]), np.uint8)
    size = np.array([scan[8] - scan[7] for scan in scans], np.int64)
    close = np.cumsum(size + 1) - 1
    lane = np.full(len(n), mcu * interval) if interval else np.maximum(n, 1)
    lanes = -(-n // lane)
    mark = np.flatnonzero((x[:-1] == 255) & (x[1:] & 0xF8 == 0xD0))
    before = np.searchsorted(mark, close - size)
    marks = np.searchsorted(mark, close) - before
    who, j = np.repeat(np.arange(len(n)), lanes), ragged(lanes)
    padded = np.r_[mark, 0]
    at = np.where(j == 0, (close - size)[who], np.where(j <= marks[who], padded[np.minimum(before[who] + j - 1, len(mark))] + 2, close[who]))
    at = np.minimum(at, close[who])
    until = np.where(j < marks[who], padded[np.minimum(before[who] + j, len(mark))], close[who])
    count = np.minimum(lane[who], n[who] - j * lane[who])
    bad = set(np.flatnonzero(marks != lanes - 1).tolist())
    done, edges = np.cumsum(count), [0]
    while edges[-1] < len(at):  # stretches of lanes, of bounded bytes unless one lane alone has more
        edges.append(max(int(np.searchsorted(at, at[edges[-1]] + STRETCH_BYTES)), edges[-1] + 1))
    for b, e in zip(edges[:-1], edges[1:], strict=True):
        lo = at[b]
        own = x[lo : max(until[b:e].max(), lo)]
        stuffed = np.r_[False, (own[1:] == 0) & (own[:-1] == 255)][: len(own)]
        less = np.r_[0, np.cumsum(stuffed)]
        to_bits = lambda y: (np.minimum(y - lo, len(own)) - less[np.minimum(y - lo, len(own))]) * 8  # noqa: B023, E731
        span = slice(done[b] - count[b], done[e - 1])
        end = _decode_scan(_Bits(own[~stuffed]), to_bits(at[b:e]), order[span], owner[span], count[b:e], params, coefficients)
        lost = to_bits(until[b:e]) - end
        bad.update(who[b:e][(end < 0) | (lost < 0) | (lost > 7)].tolist())
    for k in bad:
        images[members[k]].whole = False


def _basis(bits: int = 22) -> np.ndarray:
    """The inverse transform as a matrix of whole numbers: coefficients in zigzag order to samples, times 2 to the power of ``bits``.

    Products of whole numbers are exact, so equal blocks give equal samples however many are transformed at once.
    """
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.rint(np.kron(one, one)[ZIGZAG] * 2.0**bits)


BASIS_BITS = 22
BASIS = _basis(BASIS_BITS)


def planes(image: Image, coefficients: np.ndarray) -> list[np.ndarray]:
    """Each component's samples, inverse-transformed."""
    out = []
    for c in image.parts:
        x = np.empty((c.rows * c.columns, 64), np.uint8)
        for b in range(0, len(x), STRETCH):
            own = coefficients[c.first + b : c.first + min(b + STRETCH, len(x))] * c.quant.astype(np.float64)
            x[b : b + STRETCH] = np.clip(np.floor(own @ BASIS * 2.0**-BASIS_BITS + 128.5), 0, 255)
        out.append(x.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8))
    return out


def rgb(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Height x width x 3 tensor of 8 bits; chroma is brought to full resolution by repeating samples."""
    hmax, vmax = max(c.h for c in image.parts), max(c.v for c in image.parts)
    out, found = np.empty((image.height, image.width, 3), np.uint8), planes(image, coefficients)
    step = 8 * vmax * max(1, STRETCH // image.width)
    for top in range(0, image.height, step):  # stretches of whole sample rows, so that only they are held as fractions
        full = []
        for p, c in zip(found, image.parts, strict=True):
            tall, wide = vmax // c.v, hmax // c.h
            own = p[top // tall : (top + step) // tall]
            own = own.repeat(tall, axis=0) if tall > 1 else own
            full.append((own.repeat(wide, axis=1) if wide > 1 else own)[: image.height - top, : image.width])
        if len(full) < 3:
            out[top : top + step] = full[0][:, :, None]
            continue
        y, cb, cr = (x.astype(np.float32) for x in full)
        cb, cr = cb - 128, cr - 128
        # fixed values: the conversion of JFIF
        for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[top : top + step, :, k] = np.clip(np.rint(x), 0, 255)
    return out


#: Sampling factors of the images that hold payloads: chroma of half resolution.
SAMPLING = ((2, 2), (1, 1), (1, 1))


def payload_images(payloads: list[bytes]) -> list[bytes]:
    """Files that hold payloads of whole 64 bytes: a byte less 128 is a coefficient, 64 of them a block.

    Blocks fill the luma first, then both chroma components of half resolution; an image is eight MCUs wide, or more if
    it would be too tall. What is left of the last component is zero; the comment tells the payload's length.
    """
    images, total = [], 0
    flat = [Component(h, v, np.ones(64, np.int64)) for h, v in SAMPLING]
    for x in payloads:
        mcus = -(-len(x) // (64 * 6))
        across = max(min(mcus, 8), -(-mcus // SIDE))
        down = -(-mcus // across)
        parts = [replace(c) for c in flat]
        total = lay_out(16 * down, 16 * across, parts, total)
        images.append((16 * down, 16 * across, parts, b"payload %d" % len(x)))
    block = np.zeros((total, 64), np.int16)
    for x, (_, _, parts, _) in zip(payloads, images, strict=True):
        n = len(x) // 64
        block[parts[0].first : parts[0].first + n] = np.frombuffer(x, np.uint8).reshape(n, 64)
        block[parts[0].first : parts[0].first + n] -= 128
    return encode(images, block) if images else []


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload that an image of ``payload_images`` holds."""
    first, size = image.parts[0].first, int(image.comment.split()[1])
    return (coefficients[first : first + size // 64].ravel() + 128).astype(np.uint8).tobytes()
