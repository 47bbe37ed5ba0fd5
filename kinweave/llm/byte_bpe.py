"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, others by a heap over linked bytes; and back to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import named_id, text_of, whole_id
from kinweave.llm.exact_dedup import build_hash, find_slots

#: Words that are held as ids at once; words of each of the two generations a worker remembers, and their bytes at most.
CHUNK, HELD, HELD_BYTES = 65_536, 500_000, 48
#: Unicode's white space. Before a blank that something else follows, and around white space, no match of the public pattern
#: goes on, as its matches are letters, numbers or other signs with a blank before them at most, or white space alone.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_codecs: dict[str, Codec] = {}


def _digests(words: list[bytes]) -> np.ndarray:
    """n x 32 bytes, of which the hash takes bytes 8 to 23."""
    out = np.zeros((len(words), 32), np.uint8)
    out[:, 8:24] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint8).reshape(-1, 16)
    return out


@dataclass(frozen=True)
class Vocabulary:
    """A minimal perfect hash of all entries: its slots hold entry and rank."""

    pilots: np.ndarray
    entries: list[bytes]
    ranks: np.ndarray


def vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    pilots, slots = build_hash(_digests(list(ranks)))
    at = np.argsort(slots)
    entries = list(ranks)
    return Vocabulary(pilots, [entries[i] for i in at], np.array(list(ranks.values()), np.int64)[at])


class Codec:
    """A vocabulary of ranks as two tiers.

    The first is a minimal perfect hash: what lies in a word's slot counts only if the entry's bytes are those asked for.
    Pre-tokens that aren't entries go through the second: their bytes are a linked list, and a heap gives the pair of
    neighbours of lowest rank (the leftmost of equals) to be joined next, in n log n steps. The ids of what has been met
    lately are remembered, so that most of a corpus asks neither.
    """

    def __init__(self, held: Vocabulary, pattern: str):
        self.pattern, self.held = regex.compile(pattern), held
        self.words = WORDS if pattern == default_pattern() else self.pattern
        self.ranks = dict(zip(held.entries, held.ranks.tolist(), strict=True))
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        by_rank = [b""] * (int(held.ranks.max()) + 1)
        for entry, rank in self.ranks.items():
            by_rank[rank] = entry
        self.size = np.array([len(x) for x in by_rank], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_rank), np.uint8)

    def look_up(self, words: list[bytes]) -> list[int]:
        """The rank of each word that is an entry, else -1."""
        if not words:
            return []
        entries = self.held.entries
        slots = find_slots(_digests(words), self.held.pilots, len(entries))
        return [r if entries[s] == w else -1 for s, r, w in zip(slots.tolist(), self.held.ranks[slots].tolist(), words, strict=True)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word that is no entry.

        A node is the place of its first byte; after[a] is the next node's, before[a] the one's before. What is in the heap is
        rank, first place and end of the pair as one number; it is out of date if the pair's first node is gone, or if
        what follows it ends elsewhere now.
        """
        get, n = self.ranks.get, len(word)
        bits = n.bit_length()
        low, high = (1 << bits) - 1, 2 * bits
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r << high) | (a << bits) | (a + 2) for a in range(n - 1) if (r := get(word[a : a + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            a, stop = (top >> bits) & low, top & low
            b = after[a]
            if b >= n or after[b] != stop:
                continue
            after[a] = stop
            after[b] = -1
            before[stop] = a
            if stop < n and (r := get(word[a : after[stop]])) is not None:
                heappush(heap, (r << high) | (a << bits) | after[stop])
            if (p := before[a]) >= 0 and (r := get(word[p:stop])) is not None:
                heappush(heap, (r << high) | (p << bits) | stop)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : after[at]]])
            at = after[at]
        return out

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids, as bytes, of words that aren't remembered; those too long to be remembered are in what is returned."""
        seen, parts = self.seen, {w: self.pattern.findall(w) for w in new}
        tokens = set().union(*parts.values()).difference(seen)
        words = [t.encode("utf-8", "surrogatepass") for t in tokens]
        own = {t: array("I", [r] if r >= 0 else self.merge(w)).tobytes() for t, w, r in zip(tokens, words, self.look_up(words), strict=True)}
        whole = {w: b"".join([seen.get(t) or own[t] for t in p]) for w, p in parts.items()}
        for kept in (own, whole):
            seen.update((t, ids) for t, ids in kept.items() if len(t) <= HELD_BYTES)
        return {w: ids for w, ids in whole.items() if w not in seen}

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text, little-endian unsigned 32-bit integers, in stretches of ``CHUNK`` words."""
        found = (m.group() for m in self.words.finditer(text)) if len(text) > 16 * CHUNK else iter(self.words.findall(text))
        while words := list(islice(found, CHUNK)):
            if len(self.seen) > HELD:
                self.older, self.seen = self.seen, {}
            seen, long = self.seen, {}
            if new := set(words).difference(seen):
                seen.update((w, ids) for w in new if (ids := self.older.get(w)))
                long = self.learn(new.difference(seen))
            yield b"".join(map(seen.__getitem__, words) if not long else [seen.get(w) or long[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id that is none raises IndexError."""
        numbers = np.frombuffer(ids, "<u4")
        size = self.size[numbers]
        begin = self.begin[numbers] - (np.cumsum(size) - size)
        return self.flat[np.arange(int(size.sum())) + np.repeat(begin, size)].tobytes()


@cache
def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file that the driver can read, a line for each entry: base64, a space, the rank."""
    with open(path, "rb") as file:
        return vocabulary({base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, file)})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _codec(key: str, shared: Broadcast) -> Codec:
    """The codec of a vocabulary, once for each worker, so that later tasks know the words of earlier ones."""
    if key not in _codecs:
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


def _runner(key: str, shared: Broadcast, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, shared)
        for rows in batches:
            out = []
            for text in rows.pop("text"):
                n, own, back, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in codec.pieces(text):
                    n += len(ids) // 4
                    own.update(ids)
                    back.update(codec.decode(ids))
                    kept += [ids] if with_ids else []
                out.append((n, own.hexdigest(), back.hexdigest(), b"".join(kept))[: 4 if with_ids else 3])
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 if with_ids else 3]
            yield rows.assign(**{name: [x[i] for x in out] for i, name in enumerate(names)})

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit); a row for each document.

    Each match of the pattern is encoded for itself, without special tokens; then the ids are decoded. A null or empty text
    has no ids; repeated rows are encoded each; a null id stays null; an empty table gives no rows. Only doc_id and text are
    read. The vocabulary, some 50,000 entries whatever the corpus, is read by the driver and sent to the workers once. Long
    texts go through in stretches of ``CHUNK`` words; a single pre-token of any length is one heap. Nothing is shuffled.
    """
    spark, path, pattern = docs.sparkSession, path or default_path(), pattern or default_pattern()
    shared = spark.sparkContext.broadcast((read_vocabulary(path), pattern))
    rows = docs.select(*whole_id(), text_of().alias("text"))
    schema = "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return named_id(rows.mapInPandas(_runner(f"{path}\n{pattern}", shared, with_ids), schema))


def _decoder(key: str, shared: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, shared)
        for rows in batches:
            yield rows.assign(text=[codec.decode(x).decode("utf-8", "replace") for x in rows.pop("ids")])

    return run


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); bytes that aren't UTF-8, as where a text was cut, become replacement characters."""
    spark, path, pattern = rows.sparkSession, path or default_path(), pattern or default_pattern()
    shared = spark.sparkContext.broadcast((read_vocabulary(path), pattern))
    held = rows.select(*whole_id(), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return named_id(held.mapInPandas(_decoder(f"{path}\n{pattern}", shared), "doc_id long, no_id boolean, text string"))
