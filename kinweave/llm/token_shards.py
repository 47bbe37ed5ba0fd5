"""Writes token ids in training order: fixed-stride records in shard files, ordered by a keyed permutation."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import checkpoint, feistel, runs, shared_dir, text_of

#: Ids of a sequence, records of a shard file on average, key of the order, bytes of an id.
LENGTH, SHARD_RECORDS, KEY, ID_BYTES = 256, 16_384, 42, 2
#: Partitions of the documents, and sequences of one, at most: numbers below their product are permuted.
MOST_PARTITIONS, MOST_SEQUENCES = 1_000_000, 1 << 33
#: Bytes of text that are encoded at once, bytes of text that make up a token for choosing the number of files, records read at once.
BATCH, TOKEN_BYTES, READ = 1 << 22, 2.5, 4096
#: doc_id (the smallest integer for null), place of the first id in the document, ids that count.
HEAD = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("length", "<i4")])
_loaded: dict = {}


def load(path: str):
    """Byte-level BPE from a file of ranks, once for each worker; 50256, which no rank has, ends and fills up."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class Shards:
    """Where the files are, and what a reader must know. The folder's manifest says which slots each file holds."""

    folder: str
    sequences: int
    length: int

    @property
    def stride(self) -> int:
        return _record(self.length).itemsize

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Shards:
        """What an earlier session wrote."""
        known = spark.read.parquet(f"{folder}/manifest")
        whole = known.agg(F.max("length").alias("length"), F.max(F.col("first_slot") + F.col("records")).alias("n")).first()
        return cls(folder, whole["n"] or 0, whole["length"] or LENGTH)


def _record(length: int) -> np.dtype:
    return np.dtype([("head", HEAD), ("ids", "<u2", length)])


def _cutter(path: str, length: int, end_id: int, key: int, shards: int):
    record, size = _record(length), _record(length).itemsize
    domain = MOST_PARTITIONS * MOST_SEQUENCES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, partition = load(path).encode_ordinary, 0, TaskContext.get().partitionId()
        if partition >= MOST_PARTITIONS:
            raise ValueError(f"more than {MOST_PARTITIONS} partitions")
        for rows in batches:
            texts = rows.column("text").to_pylist()
            doc_ids = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            for b, e in runs([len(x) for x in texts], BATCH):
                ids = [array("H", encode(x)) for x in texts[b:e]]
                n = np.array([len(x) + 1 for x in ids], np.int64)
                each = -(-n // length)
                first = np.cumsum(each) - each
                made = np.zeros(int(each.sum()), record)
                nth = np.arange(len(made)) - np.repeat(first, each)
                made["head"]["doc_id"], made["head"]["start"] = np.repeat(doc_ids[b:e], each), nth * length
                made["head"]["length"] = np.minimum(length, np.repeat(n, each) - nth * length)
                flat = np.full(len(made) * length, end_id, "<u2")
                for at, own in zip((first * length).tolist(), ids, strict=True):
                    flat[at : at + len(own)] = own
                made["ids"] = flat.reshape(-1, length)
                index = partition * MOST_SEQUENCES + seen + np.arange(len(made))
                seen += len(made)
                order = feistel(index, np.full(len(made), domain), np.full(len(made), key))
                shard = (order // np.uint64(-(-domain // shards))).astype(np.int32)
                ends = np.arange(len(made) + 1, dtype=np.int32) * np.int32(size)
                blob = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(ends), pa.py_buffer(made)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(order.astype(np.int64)), blob], ["shard", "order", "record"])

    return cut


def _writer(folder: str, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(folder)
        store.create_dir(own, recursive=True)
        current, seen, out, name = None, 0, None, None

        def close():
            out.close()
            store.move(name, f"{own}/shard-{current:09d}.bin")
            return pa.RecordBatch.from_pydict({"shard": [current], "records": [seen]})

        for rows in batches:
            shard = rows.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            for b, e in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[b] != current:
                    if out is not None:
                        yield close()
                    # a name of its own for each attempt; the finished file takes its place in one step
                    current, seen, name = int(shard[b]), 0, f"{own}/.writing-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                column = rows.column("record").slice(b, e - b)
                begin = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
                out.write(column.buffers()[2].slice(begin, (e - b) * size))
                seen += e - b
        if out is not None:
            yield close()

    return write


def write_shards(docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, records: int = SHARD_RECORDS, key: int = KEY, end_id: int = 50256) -> Shards:
    """Writes every sequence of the documents to its slot, with a manifest, and returns how to read them.

    Each document's ids, with the end id, are cut into stretches of ``length``. A sequence's number is its partition and
    place in it; a keyed Feistel permutation with cycle-walking over all numbers that there can be sends each to a place
    of its own, and slots are the places' ranks, without gaps. So texts are encoded once, nothing has to be counted or
    written before the one shuffle, which brings each range of places together in a file of about ``records``, sorted. A
    file is written under another name and moved when whole, so a repeated task leaves the same files. For that ``docs``
    must be a table as it is read, whose rows come alike each time; write other frames down first.

    A null or empty text is one sequence of the end id; a null id is kept as such; repeated rows have sequences of their
    own; an empty table gives no file. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    guess = F.sum(F.floor(F.octet_length("text") / F.lit(TOKEN_BYTES * length)) + 1)
    shards = max(1, -(-(rows.agg(guess.alias("n")).first()["n"] or 0) // records))
    size = _record(length).itemsize
    made = rows.mapInArrow(_cutter(path or default_path(), length, end_id, key, shards), "shard int, order long, record binary")
    dealt = made.repartitionById(shards, "shard").sortWithinPartitions("shard", "order")
    done = checkpoint(dealt.mapInArrow(_writer(folder, size), "shard long, records long"))
    counts = sorted((r["shard"], r["records"]) for r in done.collect())  # a row for each file, of some 9 MB
    firsts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    table = docs.sparkSession.createDataFrame([(s, f, n, length) for (s, n), f in zip(counts, firsts, strict=False)], "shard long, first_slot long, records long, length int")
    table.coalesce(1).write.parquet(f"{folder}/manifest")
    return Shards(folder, firsts[-1], length)


def _reader(shards: Shards, start: int):
    record = _record(shards.length)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(shards.folder)
        for files in batches:
            for shard, first, n in zip(files["shard"].tolist(), files["first_slot"].tolist(), files["records"].tolist(), strict=True):
                with store.open_input_file(f"{folder}/shard-{shard:09d}.bin") as file:
                    if file.size() != n * record.itemsize:
                        raise ValueError(f"shard {shard} has {file.size()} bytes, not {n} records")
                    skip = max(0, start - first)
                    file.seek(skip * record.itemsize)
                    for b in range(skip, n, READ):
                        x = np.frombuffer(file.read(min(READ, n - b) * record.itemsize), record)
                        at, length = np.arange(b, b + len(x)), x["head"]["length"]
                        doc_id = pd.Series(x["head"]["doc_id"].astype(np.int64), dtype="Int64")
                        ids = [own[:k].tobytes() for own, k in zip(x["ids"], length.tolist(), strict=True)]
                        yield pd.DataFrame({
                            "doc_id": doc_id.mask(doc_id == np.iinfo(np.int64).min), "start": x["head"]["start"].astype(np.int64),
                            "length": length.astype(np.int64), "slot": first + at, "shard": np.full(len(x), shard),
                            "offset": at * record.itemsize, "ids": ids, "ids_crc32": [zlib.crc32(i) for i in ids],
                        })

    return read


def read_shards(spark: SparkSession, shards: Shards, start: int = 0) -> DataFrame:
    """doc_id, start, length, slot, shard, offset (bytes in the file), ids (16-bit, little-endian), ids_crc32 of all records
    from slot ``start`` on; files before it aren't opened, and in its own the reader starts at its place."""
    known = spark.read.parquet(f"{shards.folder}/manifest").filter(F.col("first_slot") + F.col("records") > start)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, length long, slot long, shard long, offset long, ids binary, ids_crc32 long"
    return known.select("shard", "first_slot", "records").repartition(parts, "shard").mapInPandas(_reader(shards, start), schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
