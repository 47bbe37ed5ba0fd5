"""Media columns of progressive JPEG: texts stored as coefficients, and files decoded to RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import jpeg
from kinweave.llm.common import runs, text_of

#: Bytes of payload, or of files, that are coded at once; more only where one alone is larger.
BATCH = 1 << 21
TENSOR = "height int, width int, rgb binary"
DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        data = [x.encode("utf-8", "surrogatepass") for x in rows.pop("text")]
        data = [x + bytes(-len(x) % 64 if x else 64) for x in data]
        for b, e in runs([len(x) for x in data], BATCH):
            yield rows.iloc[b:e].assign(media=jpeg.payload_images(data[b:e]))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled up with zeros to whole 64, as coefficients of a progressive JPEG with chroma of half resolution."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return rows.mapInPandas(_store, "doc_id long, n_bytes long, media binary")


def _decoded(files: list[bytes | None]) -> Iterator[tuple[int, jpeg.Image | None, np.ndarray | None]]:
    """Each file's image and the coefficients; None for null and for what can't be decoded or is damaged."""
    for b, e in runs([len(x or b"") for x in files], BATCH):
        good, images = [], []
        for i in range(b, e):
            try:
                images.append(jpeg.parse(files[i] or b""))
                good.append(i)
            except ValueError:
                yield i, None, None
        images, coefficients = jpeg.decode([files[i] for i in good], images)
        for i, image in zip(good, images, strict=True):
            yield (i, image, coefficients) if image.whole else (i, None, None)


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with height, width and rgb (height x width x 3 bytes) of its progressive JPEG files.

    All scans are accumulated, of one or three components and any sampling factors that divide the largest. Null files,
    those that are no progressive JPEG of 8 bits, and damaged ones (cut off, or with codes that can't be) get nulls, and
    don't touch the others. Columns called height, width or rgb are replaced; repeated rows are decoded each.
    """
    kept = media.drop("height", "width", "rgb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, image, coefficients in _decoded(rows[column].tolist()):
                tensor = None if image is None else jpeg.rgb(image, coefficients)
                size = (None, None, None) if tensor is None else (*tensor.shape[:2], tensor.tobytes())
                one = rows.iloc[i : i + 1].copy()
                for name, value in zip(("height", "width", "rgb"), size, strict=True):
                    one[name] = [value]
                yield one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{fields}, {TENSOR}")


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel and deviation of the first, of an RGB tensor."""
    n, red = tensor.shape[0] * tensor.shape[1], tensor[:, :, 0]
    mean = tensor.sum(axis=(0, 1), dtype=np.int64) / n
    squares = int(np.bincount(red.ravel(), minlength=256) @ np.arange(256) ** 2)
    spread = np.sqrt(max(0.0, squares / n - mean[0] ** 2))
    return f"{tensor.shape[0]}x{tensor.shape[1]}x3:" + ",".join(f"{m:.3f}" for m in mean) + f":{spread:.3f}"


def _read_back(features: Callable[[np.ndarray], str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            files, out = rows.pop("media").tolist(), [None] * len(rows)
            for i, image, coefficients in _decoded(files):
                payload = jpeg.payload_of(image, coefficients)
                out[i] = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(files[i]), hashlib.sha256(files[i]).hexdigest(), features(jpeg.rgb(image, coefficients)),
                )
            columns = [x.split()[0] for x in DIGEST.split(", ")]
            made = pd.DataFrame(out, columns=columns) if out else pd.DataFrame(columns=columns)
            yield pd.concat([rows.reset_index(drop=True), made], axis=1)

    return run


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from each stored file; a row for each document.

    A null text counts as empty; an empty one is stored as 64 zeros. Equal texts give equal values, repeated rows a row
    each. A long text is one image, coded in stretches of restart intervals: a task holds about 20 bytes for each byte
    of its longest text. The feature is of the RGB tensor, chroma brought to full resolution. An empty table gives no
    rows. Nothing is shuffled.
    """
    return store(docs).mapInPandas(_read_back(feature), f"doc_id long, n_bytes long, {DIGEST}")
