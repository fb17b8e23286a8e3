"""Shared parts: scratch tables, word hashes, id bitmaps and connected components.

Scratch tables are Spark tables in a database whose folder is ``spark.checkpoint.dir``
(or, where that is unset, as in tests, the warehouse), so every executor can read what
another one wrote, and a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATABASE = "tallyframe_llm"
BITMAP_BITS = 1 << 25  # 4 MB at any input size; a full map only filters less
BATCH_ROWS = "2000"
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that bound Arrow batches by bytes and let hot join keys be split."""
    for key, value in (
        ("spark.sql.execution.arrow.pyspark.enabled", "true"),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
    ):
        spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


class Scratch:
    """Tables of one run of an operator, by label; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names, self.made = spark, {}, False

    def keep(self, df: DataFrame, label: str, bucket_by: str | None = None) -> DataFrame:
        """Writes ``df`` as a table and reads it back; with ``bucket_by``, joins on that column need no shuffle of it."""
        if not self.made:
            shared = self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.spark.conf.get(
                "spark.checkpoint.dir", None
            )
            place = f" LOCATION '{shared.rstrip('/')}/{DATABASE}'" if shared else ""
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}{place}")
            self.made = True
        self.drop(label)
        self.names[label] = f"{DATABASE}.{label}_{uuid.uuid4().hex}"
        if bucket_by:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer = df.repartition(n, bucket_by).write.bucketBy(n, bucket_by)
        else:
            writer = df.write
        writer.format("parquet").option("compression", "zstd").saveAsTable(self.names[label])
        return self.spark.table(self.names[label])

    def drop(self, *labels: str) -> None:
        for label in labels:
            if label in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(label)}")


# --- memory ----------------------------------------------------------------------------


def release() -> None:
    """Gives memory that this worker has freed back to the system.

    Spark uses a Python worker again for other functions; without this, one that held a large
    cache would keep its memory, and those of several stages would add up.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """Wraps a function over batches so that its worker is small again when the task ends."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


# --- words -----------------------------------------------------------------------------

MIX = np.uint64(0x9E3779B97F4A7C15)
POLY = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(h, words), np.uint64, len(words))


POLY_INVERSE = np.uint64(pow(int(POLY), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the polynomial's base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((POLY, POLY_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values, from prefix sums of h[i] * base^i."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:], dtype=np.uint64)
    return mixed((sums[size:] - sums[:-size]) * down[:n])


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows of a generator as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fold_of_value(value: int, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds


# --- bitmaps ---------------------------------------------------------------------------


def hash_bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of ``BITMAP_BITS`` slots of a column of 64-bit hashes, of fixed size whatever the input.

    It only spares rows a shuffle: a set bit may be a chance hit, so what passes is
    joined or compared exactly afterwards; a clear bit proves the hash absent.
    """
    slot = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    parts = df.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("bit"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for k, bits in parts.groupBy("k").agg(F.bitmap_construct_agg("bit")).collect():
        out[(k - 1) * len(bits) : k * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slots = hashes.view(np.uint64) % np.uint64(BITMAP_BITS)
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- components ------------------------------------------------------------------------


def _all_stars(edges: DataFrame) -> bool:
    """Whether every a of the distinct edges (a, b) has one b only, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below")))
    degree = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("least"))
    return degree.where("n > 1 OR (n = 1 AND least = 0)").count() == 0


def components(scratch: Scratch, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the smallest id reachable, for every node of edges (a, b).

    Alternating large-star and small-star rounds: every round is two grouped minima and
    two joins, each with a row per edge; no component is ever gathered. Edges that are
    stars around their smallest node are done, from the start or after any round. Null ends
    and loops are ignored.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}_0",
    )
    turn = 0
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        turn += 1
        now = scratch.keep(small.distinct(), f"{label}_{turn % 2 + 1}")
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    if turn:
        scratch.drop(f"{label}_0", f"{label}_{(turn + 1) % 2 + 1}")
    return now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
