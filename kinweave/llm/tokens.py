"""Token counts; huge documents are encoded in overlapping chunks that are spliced where both sides agree."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import text_of

#: Characters of a chunk and of the first overlap; texts of up to two chunks are encoded word by word.
CHUNK, OVERLAP = 8192, 256
#: Words of each of the two generations that a worker holds, and bytes of a word that is held.
HELD, HELD_BYTES = 150_000, 48
#: A word that ends in stops after an ASCII or Latin-1 letter.
STOPPED = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,;:!?]+)", re.DOTALL)
#: Words of small ASCII letters and Latin-1 letters in UTF-8, which are one pre-token and normalised but for capitals.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space of ASCII, at which a cut is proven.
BLANKS = frozenset(" \t\n\x0b\x0c\r")
_loaded: dict = {}
_encoders: dict[str, WordEncoder] = {}


def load(path: str):
    """The tokenizer of a file, once for each worker; a file's path must be the same on all machines."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(tokenizer, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of text[begin:end] and where each token starts in the text."""
    out = tokenizer.encode(text[begin:end], add_special_tokens=False)
    return np.array(out.ids, np.int64), np.array([a for a, _ in out.offsets], np.int64) + begin


def encode_pieces(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of a whole text in pieces, equal to encoding it at once, with memory for a chunk and its overlap.

    A chunk is encoded with an overlap beyond its end, and the next chunk's head from that end on. They are spliced at
    the first place of the overlap where a token starts in both and the character before is ASCII white space. There
    the cut is proven: white space ends every match of the pre-tokenizer, no merge crosses it, no special string has
    it, and normalising neither composes across it nor looks past it. If the overlap holds no such place it is widened
    to double, up to the end of the text.
    """
    begin = 0
    while begin + chunk + overlap < len(text):
        start, wide, cut = begin + chunk, overlap, None
        while cut is None:
            stop = min(len(text), start + wide)
            ids, at = _encode(tokenizer, text, begin, stop)
            common = np.intersect1d(at, _encode(tokenizer, text, start, stop)[1])
            cut = next((int(p) for p in common if p > start and text[p - 1] in BLANKS), len(text) if stop == len(text) else None)
            wide *= 2
        yield ids[at < cut]
        begin = cut
    if begin < len(text):
        yield _encode(tokenizer, text, begin, len(text))[0]


def count_one(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(len(x) for x in encode_pieces(tokenizer, text, chunk, overlap))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
#: Small letters of the second bytes of capital Latin-1 letters.
LOWER = bytes(b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))


class WordEncoder(dict):
    """Encodes texts word by word with the tokenizer's library, and keeps the ids of the words it has met lately.

    Words are cut at ASCII white space, where a cut changes no token (see ``encode_pieces``), and between a letter and
    the stops that end a word, as the pre-tokenizer's letters end there too. ASCII letters are lower-cased, as the
    normaliser does, unless special strings may be about. A word of Latin-1 letters alone is one pre-token, so the model
    is asked directly, with bytes spelled as its vocabulary spells them.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize, self.older = tokenizer, tokenizer.model.tokenize, {}

    def __missing__(self, word: bytes) -> bytes:
        if ids := self.older.get(word):
            pass
        elif word.isalpha() and word.islower():
            ids = array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
        elif stopped := STOPPED.fullmatch(word):
            ids = self[stopped[1]] + self[stopped[2]]
        elif LETTERS.fullmatch(word):
            ids = array("I", [t.id for t in self.tokenize(word.translate(LOWER).decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()
        if len(word) <= HELD_BYTES:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if len(self) > HELD:
            self.older = dict(self)
            self.clear()
        data = text.encode("utf-8", "surrogatepass")
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a file, once for each worker, so that later tasks know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(load(path))
    return _encoders[path]


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, encoder = load(path), word_encoder(path)
        for rows in batches:
            yield rows.assign(n_tokens=[count_one(tokenizer, x) if len(x) > 2 * CHUNK else len(encoder.ids(x)) // 4 for x in rows.pop("text")])

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; a row for each document, as many tokens as encoding the whole text gives.

    Texts of more than two chunks go through in chunks with overlaps (``encode_pieces``), others word by word. A null or
    empty text has 0 bytes and tokens; repeated rows are counted each; a null id stays null; an empty table gives no
    rows. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    counted = rows.mapInPandas(_counter(path or default_path()), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
