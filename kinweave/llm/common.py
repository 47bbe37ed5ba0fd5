"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java's regular expression for one character that separates words.
SPACE = r"\x20\x09-\x0D"
#: How the folders of tables that are written on the way begin.
WRITTEN = "kinweave-"
#: Those folders that this process has written and not deleted.
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir.

    Where that is unset, a temporary folder is set in local mode, where driver and executors are one machine; on a cluster
    it's an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage, so that no lost executor changes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``checkpoint``, in Parquet: smaller for long texts, and columns that are not read cost nothing. And the folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{WRITTEN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    _own.add(path)
    return df.sparkSession.read.parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def forget(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder that ``written_at`` gave in this session, and nothing else; what was worked out from it must be written by then."""
    if path in _own:
        _own.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of a table of row numbers that may be broadcast (8 MB of numbers).
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a column ``row`` that tells them apart and all their own columns in ``doc``.

    ``row`` is the doc_id where that is unique. Rows whose id is null or repeated get a hash of all they hold and, if
    they are alike in all, of a running number; so numbers hold however often this frame is computed, and no text needs
    to be written down for them.
    """
    named = [F.col(f"`{c}`") for c in docs.columns]
    light = [F.col(f"`{c}`") for c in ("text", "source") if c in docs.columns]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *light, F.struct(*named).alias("doc"))
    odd = checkpoint(held.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"))
    n = odd.count()
    if not n:
        return held.withColumn("row", F.col("doc_id"))
    odd = odd.filter("doc_id is not null")
    odd = F.broadcast(odd) if n <= BROADCAST_ROWS else odd
    alike = F.xxhash64("doc_id", F.to_json("doc")), F.xxhash64(F.to_json("doc"), F.lit(1))
    rest = held.join(odd, "doc_id", "left_semi").unionByName(held.filter("doc_id is null")).withColumns({"h1": alike[0], "h2": alike[1]})
    rest = rest.withColumn("twin", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc_id")))
    rest = rest.withColumn("row", F.xxhash64("h1", "h2", "twin")).drop("h1", "h2", "twin")
    return held.filter("doc_id is not null").join(odd, "doc_id", "left_anti").withColumn("row", F.col("doc_id")).unionByName(rest)


def without(held: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``numbered`` but those whose ``row`` is in ``dropped``, with their own columns alone."""
    dropped = checkpoint(dropped.select("row"))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return held.select("row", "doc").join(dropped, "row", "left_anti").select("doc.*")


def looked_up(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` joined by an integer key with ``few``, a table that is written down.

    Up to ``BROADCAST_ROWS`` it is broadcast, so long rows stay where they are. Beyond that both are dealt by the key, but only
    after most rows that find nothing have gone: those whose hashed key has no bit among 2^24, in 2^18 words that are broadcast.
    """
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key)
    word, bit = F.expr(f"shiftrightunsigned(xxhash64(`{key}`), 46)"), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    bits = few.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits").join(few, key)


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """``df``, an aggregate by an integer key, so that a join deals it by the key anew. Only then does Spark see two dealt
    tables, of which it splits a hot key's rows over several tasks."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def hash63(*columns: Column | str) -> Column:
    """A hash from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def bound63(want: int, of: int) -> int:
    """What half as many again as ``want`` of ``of`` rows have a ``hash63`` below, on average; above 0 whatever ``of`` is."""
    return min((1 << 63) - 1, max(1, (3 * want << 62) // max(of, 1)))


def row_number(row: str | None) -> Column:
    return F.col(row) if row else F.monotonically_increasing_id()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_id() -> list[Column]:
    """doc_id without nulls, and no_id where it was null: pandas keeps a column of numbers with nulls as floats, which
    don't hold all of 64 bits."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), doc_id.isNull().alias("no_id")]


def named_id(rows: DataFrame) -> DataFrame:
    """Undoes ``whole_id``."""
    return rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that nothing is learned from; a null id counts as an empty string, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words; a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, domain: np.ndarray, key: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Keyed pseudorandom permutation of 0 .. domain-1, element by element.

    A balanced Feistel network permutes the next power of four at or above the domain; results outside the
    domain are sent through it again (cycle-walking), which ends, as a cycle that starts inside returns there.
    Arrays of equal length: ``domain`` and ``key`` may differ from element to element.
    """
    index, domain, key = (np.asarray(x).astype(np.uint64) for x in (index, domain, key))
    half = np.ones(len(domain), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < domain).any():
        half[small] += np.uint64(1)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], low[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(rounds):
                left, right = right, left ^ (mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1342543DE82EF95)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= domain[todo]]
    return out


def unfeistel(value: np.ndarray, domain: np.ndarray, key: np.ndarray, rounds: int = 5) -> np.ndarray:
    """What ``feistel`` sends to each value."""
    out, domain, key = (np.asarray(x).astype(np.uint64).copy() for x in (value, domain, key))
    half = np.ones(len(domain), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < domain).any():
        half[small] += np.uint64(1)
    low, todo = (np.uint64(1) << half) - np.uint64(1), np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], low[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in reversed(range(rounds)):
                left, right = right ^ (mix64(left + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1342543DE82EF95)) & m), left
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= domain[todo]]
    return out


#: Rows, on average and at most, whose places one task works out.
BUCKET_ROWS = 2048


def places(rows: DataFrame, by: list[str], alike: list[str], size: Column, row: str, name: str) -> DataFrame:
    """``rows`` with column ``name``: the sizes of the rows of the same ``by`` before it, summed.

    The order is that of hashed buckets of the columns ``alike``, then of these columns; rows that are the same in them (and
    so in ``size``) stand in any order, told apart by ``row``. Sums go over different rows within a bucket, then over the
    buckets, so no value of ``by`` is a task of its own; many rows alike are numbered in parts, which have their counts.
    """
    key = [*by, *alike]
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    groups = rows.groupBy(*key).agg(F.count("*").alias("n_alike"))
    groups = groups.withColumns({"bucket": F.pmod(F.xxhash64(*alike), F.lit(buckets)), "width": F.col("n_alike") * size})
    sums = groups.groupBy(*by, "bucket").agg(F.sum("width").alias("bucket_width"))
    ahead = lambda x, of: F.coalesce(F.sum(x).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("bucket_start", ahead("bucket_width", Window.partitionBy(*by).orderBy("bucket")))
    sums = sums.select("bucket_start", F.col("bucket").alias("of_bucket"), *[F.col(k).alias(f"of_{k}") for k in by])
    inside = F.col("bucket") == F.col("of_bucket")
    for k in by:
        inside = inside & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    groups = groups.withColumn("within", ahead("width", Window.partitionBy(*by, "bucket").orderBy(*alike))).join(sums, inside).drop(*[f"of_{k}" for k in by])
    groups = checkpoint(groups.select(*[F.col(k).alias(f"of_{k}") for k in key], "n_alike", (F.col("within") + F.col("bucket_start")).alias("group_start"), F.xxhash64(*key, F.lit(1)).alias("group_hash")))
    same = F.xxhash64(*key, F.lit(1)) == F.col("group_hash")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    parts = F.ceil(F.col("n_alike") / BUCKET_ROWS)
    held = rows.join(groups, same).drop(*[f"of_{k}" for k in key])
    held = held.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64(row), parts)).otherwise(0))
    held = held.withColumn("turn", F.row_number().over(Window.partitionBy("group_hash", *key, "part").orderBy(row)) - 1)
    if not groups.filter(parts > 1).isEmpty():
        held = checkpoint(held)
        counts = held.filter(parts > 1).groupBy("group_hash", *key, "part").agg(F.count("*").alias("n_part"))
        counts = counts.withColumn("before", ahead("n_part", Window.partitionBy("group_hash", *key).orderBy("part")))
        counts = checkpoint(counts.select(F.xxhash64("group_hash", "part").alias("part_hash"), F.col("group_hash").alias("of_group"), F.col("part").alias("of_part"), *[F.col(k).alias(f"of_{k}") for k in key], "before"))
        same = (F.xxhash64("group_hash", "part") == F.col("part_hash")) & (F.col("group_hash") == F.col("of_group")) & (F.col("part") == F.col("of_part"))
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        held = held.join(counts, same, "left").withColumn("turn", F.col("turn") + F.coalesce("before", F.lit(0)))
    return held.select(*rows.columns, (F.col("group_start") + F.col("turn") * size).alias(name))


def runs(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list into stretches (begin, end) of total weight at most ``most``, one element at least."""
    begin = total = 0
    for i, w in enumerate(weights):
        if i > begin and total + w > most:
            yield begin, i
            begin, total = i, 0
        total += w
    if begin < len(weights):
        yield begin, len(weights)
