"""Helpers that the corpus operators share: the shared folder, byte columns, word hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.sources.tables import shared_folder

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes that separate words: space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd 64-bit value for each byte, and powers of an odd base.
BYTE_VALUES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.full(max(n, 1), base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only on one machine, as in tests, may the setting be missing; there a temporary folder is used.
    """
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def texts_of(df: DataFrame) -> DataFrame:
    """The frame, for a function over Arrow batches of whole texts.

    Spark's default of ten thousand rows a batch is made for numbers; of texts, a tenth is enough, and bounds what the JVM and a
    Python worker hold at once. A session that sets its own size keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage ends in files of the shared folder."""
    shared_path(df.sparkSession, "touch")  # sets the folder where it is unset
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder as Parquet and read again: compressed, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add `at`, the number of a row in its group in this order, and `n`, the rows of the group; equal rows take any order.

    Rows are range-partitioned, so a large group lies in many parts; only the sizes of a group's parts are summed.
    """
    parted = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parted = stored(parted.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "numbered")
    sizes = parted.groupBy(group, "part").agg(F.count("*").alias("k"), F.min("row").alias("row0"))
    w = Window.partitionBy(group)
    first = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "part", "row0", first.alias("first"), F.sum("k").over(w).alias("n"))
    return parted.join(sizes.hint("merge"), [group, "part"]).withColumn("at", F.col("first") + F.col("row") - F.col("row0")).drop("part", "row", "row0", "first")


def text_bytes(df: DataFrame, column: str = "text") -> DataFrame:
    """Total UTF-8 bytes and rows, in one row."""
    return df.agg(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit("")))).alias("bytes"), F.count("*").alias("rows"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and where each row starts; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, at


def slices(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole rows that hold about `most` bytes each, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in `data`, and for each row the number of its first word; rows start at `at`.

    `apart` says for each byte whether it separates words.
    """
    solid = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each row the number of its first word."""
    starts, ends, first = word_spans(data, at, apart)
    if not len(starts):
        return np.zeros(0, U64), first
    length = ends - starts
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        terms = BYTE_VALUES[data[np.repeat(starts, length) + inside]] * powers(int(length.max()))[inside]
        total = np.add.reduceat(terms, np.cumsum(length) - length)
        return mix(total + length.astype(U64) * _GOLD), first


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside, and as it was afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def interpreted(spark: SparkSession) -> Iterator[None]:
    """Many small plans in a row: compiling each of them costs more time and driver memory than it saves."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): columns node, component (the smallest node reached).

    Large-star and small-star steps alternate until nothing changes; every step is an aggregate and a join, and only a
    count and a checksum reach the driver. The steps end by themselves: each lowers a sum of node numbers or is the last.
    """
    with interpreted(edges.sparkSession):
        pairs = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        seen = None
        while True:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
            least = large.groupBy("b").agg(F.min("a").alias("m"))
            small = large.join(least.hint("merge"), "b").select("m", "a", "b")
            small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")).select("e.*")
            pairs = stored(small.where("a < b").distinct(), "edges")
            now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == seen:
                break
            seen = now
    roots = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


#: Keys that are sent to every task at most: 16 MB of numbers.
BROADCAST_KEYS = 2_000_000


def picked(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is among `keys` (one column), or with how="left_anti" those whose is not.

    So the rows, which carry texts, are not shuffled as long as the keys are counted to be few; else both sides are.
    """
    keys = stored(keys, "keys")
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), keys.columns[0], how)
