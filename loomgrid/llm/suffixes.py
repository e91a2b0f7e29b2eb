"""Exact removal of long repeated byte strings, after difference-cover blockwise suffix sorting.

A string of `length` bytes repeats if another suffix, of the same or of another document, begins with the same bytes. To
sort every suffix by that many bytes would move the corpus many times over. A difference cover keeps it small:

1. Positions whose rest modulo v is in a perfect difference set D of about sqrt(v) elements form the cover sample. For any
   two positions there is a shift below v that brings both into the sample, so two equal strings contain two equal sample
   strings of `length - v + 1` bytes at the same place. The sample strings are named by hash, dealt into buckets, and
   every bucket is sorted alone: its result is which names occur more than once.
2. Only suffixes with such a name within reach are tied for long, and only they are sorted by their full `length`
   bytes: again dealt into buckets, one bucket sorted at a time, in memory that the bucket size bounds. The order inside
   a bucket is that of the fingerprints, as only equality counts; a fingerprint has 64 bits beside the bucket's number.
   Texts that occur whole more than once are found first, by digest: one copy speaks for all.
3. The marks go back to the chunk of documents they came from, and covered bytes are removed.

Documents are dealt into chunks of about `chunk_bytes` once, and all three steps read that one exchange. Keys travel in
binary blocks, one for each chunk and bucket, each distinct key of a chunk once, so a string with many copies reaches a
bucket at most once a chunk.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import BASE, BYTE_VALUES, U64, flat, mix, powers, text_bytes

BLOCK = 1 << 20
SECOND = U64(0xA0761D6478BD642F)
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


@lru_cache
def difference_cover(most: int) -> tuple[int, tuple[int, ...]]:
    """v <= most, and a perfect difference set modulo v = q*q + q + 1 for the largest prime q that fits (Singer's construction)."""
    for q in (q for q in range(int(most**0.5), 1, -1) if q * q + q + 1 <= most and all(q % d for d in range(2, q))):
        v = q * q + q + 1
        for a, b, c in ((a, b, c) for c in range(1, q) for b in range(q) for a in range(q)):
            x, zeros = (1, 0, 0), []
            for i in range(v):  # powers of a root of x^3 = a x^2 + b x + c; those in a plane
                if x[2] == 0:
                    zeros.append(i)
                x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
            if len(zeros) == q + 1 and len({(s - t) % v for s in zeros for t in zeros}) == v:
                return v, tuple(zeros)
    return 1, (0,)


@lru_cache
def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(size, U64(base)), powers(size, U64(pow(base, -1, 1 << 64)))


def window_hashes(data: np.ndarray, at: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of data[p : p + n] for each p of the sorted positions `at`, block by block."""
    out = np.empty(len(at), U64)
    up, down = _tables(int(base), BLOCK + n + 1)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(at):
            lo = at[k]
            m = int(np.searchsorted(at, lo + BLOCK))
            part = data[lo : at[m - 1] + n]
            total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUES[part] * up[: len(part)])))
            p = at[k:m] - lo
            out[k:m] = (total[p + n] - total[p]) * down[p]
            k = m
    return mix(out)


class _Chunk:
    """The documents of a chunk in a fixed order, with their sample and candidate suffixes."""

    def __init__(self, table, length: int, n_buckets: int, n_large: int):
        data, at = flat(table.column("text"))
        ids = [(-1 if x is None else x) for x in table.column("doc_id").to_pylist()]
        digests = [hashlib.md5(data[at[i] : at[i + 1]]).digest() for i in range(len(ids))]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], digests[i]))
        self.doc_ids = table.column("doc_id").to_pylist()
        pieces = [data[at[i] : at[i + 1]] for i in self.order]
        self.data = np.concatenate(pieces) if pieces else data[:0]
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
        self.length, self.n_buckets, self.n_large = length, n_buckets, n_large
        self.v, cover = difference_cover(max(1, length - min(64, length // 2)))
        short = length - self.v + 1
        size = np.diff(self.at)
        phase = np.arange(len(self.data)) - np.repeat(self.at[:-1], size)
        left = np.repeat(size, size) - phase
        chosen = np.zeros(self.v, bool)
        chosen[list(cover)] = True
        # a document shorter than `length` holds no such string
        self.sample = np.flatnonzero(chosen[phase % self.v] & (left >= short) & np.repeat(size >= length, size))
        self.fits = left >= length
        self.begin = np.arange(len(self.data)) - phase
        self.digests, self.size = [digests[i] for i in self.order], size
        self.names, self.name_of, self.name_counts = np.unique(window_hashes(self.data, self.sample, short), return_inverse=True, return_counts=True)

    def sample_blocks(self):
        bucket = (self.names % U64(self.n_buckets)).astype(np.int64)
        return bucket, (self.names >> U64(32)).astype("<u4"), self.name_counts > 1

    def candidates(self, repeated: np.ndarray, copies: dict[bytes, bool]) -> None:
        """Suffixes that reach a repeated sample name, and their distinct fingerprints.

        `copies` has the digests of texts that occur twice or more, and whether this chunk speaks for the copies. They are
        removed whole; the suffixes of one copy are enough for all other texts.
        """
        copied = [bool(n >= self.length and d in copies) for d, n in zip(self.digests, self.size, strict=True)]
        silent, spoken = [], set()
        for c, d in zip(copied, self.digests, strict=True):
            silent.append(c and (not copies[d] or d in spoken))
            spoken.add(d)
        self.copied, self.whole = np.repeat(np.asarray(copied, bool), self.size), np.repeat(np.asarray(silent, bool), self.size)
        hit = self.sample[repeated[self.name_of]]
        hit = hit[~self.whole[hit]]
        step = np.bincount(np.maximum(self.begin[hit], hit - self.v + 1), minlength=len(self.data) + 1).astype(np.int32)
        step[hit + 1] -= 1
        self.starts = np.flatnonzero((np.cumsum(step[:-1]) > 0) & self.fits)
        prints = window_hashes(self.data, self.starts, self.length)
        self.prints, first, self.print_of, self.print_counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        self.print_bucket = (window_hashes(self.data, np.sort(self.starts[first]), self.length, SECOND) % U64(self.n_large)).astype(np.int64)
        self.print_bucket = self.print_bucket[np.argsort(np.argsort(self.starts[first]))] if len(first) else self.print_bucket

    def results(self, repeated: np.ndarray) -> list[list]:
        hit = self.starts[repeated[self.print_of]]
        step = np.zeros(len(self.data) + self.length + 1, np.int32)
        step[hit] += 1
        step[hit + self.length] -= 1
        gone = (np.cumsum(step[: len(self.data)]) > 0) | self.copied
        out: list[list] = [[] for _ in range(6)]
        for k, i in enumerate(self.order):
            lo, hi = self.at[k], self.at[k + 1]
            mine = gone[lo:hi]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = hashlib.sha256(self.data[lo:hi][~mine].tobytes()).hexdigest()
            for column, value in zip(out, (self.doc_ids[i], int(hi - lo), int(mine.sum()), len(spans), kept, spans), strict=True):
                column.append(value)
        return out


def _by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _blocks(chunk_id: int, bucket: np.ndarray, keys: np.ndarray, twice: np.ndarray) -> pa.Table:
    groups = _by_bucket(bucket)
    return pa.table({
        "bucket": pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), "chunk": pa.array([chunk_id] * len(groups), pa.int64()),
        "keys": pa.array([keys[g].tobytes() for g in groups], pa.binary()), "twice": pa.array([np.packbits(twice[g]).tobytes() for g in groups], pa.binary()),
    })


def _marks(marks, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The marks of one kind, put where their keys are."""
    out = np.zeros(len(bucket), bool)
    groups = {int(bucket[g[0]]): g for g in _by_bucket(bucket)}
    for k, b, bits in zip(marks.column("kind").to_pylist(), marks.column("bucket").to_pylist(), marks.column("marks").to_pylist(), strict=True):
        if k == kind:
            g = groups[b]
            out[g] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(g)).astype(bool)
    return out


def _copies(marks) -> dict[bytes, bool]:
    return {m[:16]: m[16:] == b"1" for k, m in zip(marks.column("kind").to_pylist(), marks.column("marks").to_pylist(), strict=True) if k == 0}


def _sorted_bucket(kind: int, width: str):
    """Sort one bucket: which of its keys does more than one suffix have?"""

    def run(table):
        blocks, twice = table.column("keys").to_pylist(), table.column("twice").to_pylist()
        keys = [np.frombuffer(b, width) for b in blocks]
        size = [len(k) for k in keys]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        marks = np.zeros(len(every), bool)
        marks[order[1:][same]] = True
        marks[order[:-1][same]] = True
        marks |= np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(twice, size, strict=True)]).astype(bool)
        at = np.cumsum([0, *size])
        rows = [(c, b, np.packbits(marks[at[i] : at[i + 1]]).tobytes()) for i, (c, b) in enumerate(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True)) if marks[at[i] : at[i + 1]].any()]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "marks": pa.array([r[2] for r in rows], pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = 400, chunk_bytes: int = 1 << 21, bucket_keys: int = 1 << 22) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which also starts anywhere else, judged on the input.

    One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans in bytes. A null text is
    empty and keeps the digest of nothing. Repeated rows repeat each other's strings. Texts are whole at any length. Other
    columns are ignored. An empty table gives an empty result.
    """
    total = text_bytes(docs).first().bytes or 0
    n_chunks, n_large = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_keys))
    n_buckets = max(1, -(-total // (12 * bucket_keys)))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))

    def sample(key, table):
        return _blocks(key[0].as_py(), *_Chunk(table, length, n_buckets, n_large).sample_blocks())

    def suffixes(key, table, marks):
        chunk = _Chunk(table, length, n_buckets, n_large)
        chunk.candidates(_marks(marks, 1, chunk.sample_blocks()[0]), _copies(marks))
        return _blocks(key[0].as_py(), chunk.print_bucket, chunk.prints.astype("<u8"), chunk.print_counts > 1)

    def remove(key, table, marks):
        chunk = _Chunk(table, length, n_buckets, n_large)
        chunk.candidates(_marks(marks, 1, chunk.sample_blocks()[0]), _copies(marks))
        out = chunk.results(_marks(marks, 2, chunk.print_bucket))
        names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        return pa.table({n: pa.array(x, t) for x, (n, t) in zip(out, names, strict=True)})

    blocks, marked = "bucket long, chunk long, keys binary, twice binary", "chunk long, kind int, bucket long, marks binary"
    by_chunk = parts.groupBy("chunk")
    names = by_chunk.applyInArrow(sample, blocks).groupBy("bucket").applyInArrow(_sorted_bucket(1, "<u4"), marked)
    # texts that occur twice or more, once for each chunk they are in, and whether that chunk is the first
    texts = parts.where(F.length("text") >= length).select("chunk", F.md5("text").alias("digest")).distinct()
    twice = parts.where(F.length("text") >= length).groupBy(F.md5("text").alias("digest")).agg(F.min("chunk").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = texts.join(twice, "digest").select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.concat(F.unhex("digest"), F.when(F.col("lead") == F.col("chunk"), F.lit("1")).otherwise(F.lit("0")).cast("binary")).alias("marks"))
    names = names.unionByName(copies)
    large = by_chunk.cogroup(names.groupBy("chunk")).applyInArrow(suffixes, blocks).groupBy("bucket").applyInArrow(_sorted_bucket(2, "<u8"), marked)
    return by_chunk.cogroup(names.unionByName(large).groupBy("chunk")).applyInArrow(remove, _RESULT)


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
