"""Periodic runs of words: a suffix automaton whose suffix links are walked by link-cut access.

The words of a stretch build a suffix automaton. Its suffix links are a tree in which the path from a prefix's state to the root
holds all suffixes of that prefix. The words are then taken in order: access colours the path of each prefix with its end. The
path is made of segments of one earlier colour each, which are the last occurrences of the suffixes on them: where the distance
p from the former end to the new one is no more than a segment's longest suffix, the suffix and its former occurrence touch, and
so the last 2p words are a square of smallest period p. A square is extended to both sides to its run, once a run. Each access
changes few colours, log n at a mean, and finds the segments in splay trees.

Only stretches that can hold a run go through the automaton: in a run of four periods (or six equal words) each three words in a
row are there three times at least, so only stretches all of whose words are in triples that a table counts three times or more
are taken. The table counts hashes, which can only add stretches. Nothing is shuffled; a document is never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import mix

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_SPLIT = r"[\x20\x09-\x0D]+"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a list of numbers: the suffix link and longest length of each state, and the state of each prefix.

    State 0 is the root, whose link is -1.
    """
    link, longest, after, ends = [-1], [0], [{}], []
    last = 0
    for w in words:
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        after.append({})
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = new
            p = link[p]
        if p >= 0:
            q = after[p][w]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:  # q also holds longer strings, so those that end here move to a state of their own
                part = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                after.append(dict(after[q]))
                while p >= 0 and after[p].get(w) == q:
                    after[p][w] = part
                    p = link[p]
                link[q] = link[new] = part
        ends.append(new)
        last = new
    return link, longest, ends


class Paths:
    """The paths to the root of a fixed tree, each kept in a splay tree ordered by depth, and coloured as a whole."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)  # parent in the splay tree, or for its root the tree parent of the path's top
        self.left, self.right = [-1] * n, [-1] * n
        self.colour = [-1] * n  # of the path, held by the splay tree's root

    def _splay(self, v: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        own = None
        while True:
            p = up[v]
            if p < 0 or (left[p] != v and right[p] != v):
                break
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            own = colour[g if inner else p]  # in the last turn that is the splay tree's root
            # the child next to the root turns first where both lean the same way
            turns = ((p, v) if (left[g] == p) == (left[p] == v) else (v, v)) if inner else (v,)
            for x in turns:
                y = up[x]
                z = up[y]
                if left[y] == x:
                    b = right[x]
                    left[y], right[x] = b, y
                else:
                    b = left[x]
                    right[y], left[x] = b, y
                if b >= 0:
                    up[b] = y
                if z >= 0:
                    if left[z] == y:
                        left[z] = x
                    elif right[z] == y:
                        right[z] = x
                up[x], up[y] = z, x
        if own is not None:
            colour[v] = own

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from v to the root a colour; return its former segments as (deepest node, former colour), from v up."""
        found, below, v0 = [], -1, v
        while v >= 0:
            self._splay(v)
            found.append((v, self.colour[v]))
            cut = self.right[v]
            if cut >= 0:  # what hangs deeper stays a path of its own, of the former colour
                self.colour[cut] = self.colour[v]
            self.right[v] = below
            below, v = v, self.up[v]
        self._splay(v0)
        self.colour[v0] = colour
        return found


def runs(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs of a list of numbers as (start, length, smallest period), by start, then period."""
    n = len(words)
    link, longest, ends = automaton(words)
    paths = Paths(link)
    reached: dict[int, int] = {}  # period: end of its last run
    out = []
    for i, state in enumerate(ends):
        for node, former in paths.access(state, i):
            p = i - former
            if former < 0 or p > longest[node] or reached.get(p, -1) >= i:
                continue
            start, stop = i - 2 * p + 1, i + 1
            while start > 0 and words[start - 1] == words[start - 1 + p]:
                start -= 1
            while stop < n and words[stop] == words[stop - p]:
                stop += 1
            reached[p] = stop - 1
            if stop - start >= max(least_words, least_periods * p):
                out.append((start, stop - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The place each of the n words is taken from where the document's number says so, else None. A null number says nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def stretches(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: maximal stretches (start, stop) of six words or more in triples counted three times or more.

    codes: word numbers of documents one after the other; doc: the document of each, ascending.
    """
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        triple = mix(mix(mix(c[:-2] + (doc[:-2].astype(np.uint64) << np.uint64(40))) + c[1:-1]) + c[2:])
    size = 1 << max(12, int(2 * n).bit_length())
    slot = (triple & np.uint64(size - 1)).astype(np.int64)
    often = (np.bincount(slot, minlength=size) >= 3)[slot] & (doc[:-2] == doc[2:])
    on = np.zeros(n + 1, bool)
    for k in range(3):
        on[k : k + n - 2] |= often
    first = np.concatenate(([True], doc[1:] != doc[:-1], [True]))
    before = np.concatenate(([False], on[:-1]))
    begins = np.flatnonzero(on & (~before | first))
    stops = np.flatnonzero(before & (~on | first))
    long = stops - begins >= LEAST_WORDS
    return list(zip(begins[long].tolist(), stops[long].tolist(), strict=True))


def _of_slice(ids: list, texts: pa.Array) -> Iterator[tuple]:
    """A result row for each document of a slice."""
    split = pc.split_pattern_regex(texts.fill_null("").cast(pa.string()), pattern=_SPLIT)
    flat, at = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.not_equal(flat, "")
    keep = real.to_numpy(zero_copy_only=False)
    flat = flat.filter(real)
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    sizes = np.diff(at)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), " ")
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    source = np.arange(len(codes))  # where each word is taken from
    changed = set()
    for k, i in enumerate(ids):
        moved = planted(i, int(sizes[k]))
        if moved is not None:
            source[at[k] : at[k + 1]] = at[k] + moved
            changed.add(k)
    codes = codes[source] if changed else codes
    doc = np.repeat(np.arange(len(ids)), sizes)
    found: dict[int, list] = {}
    for lo, hi in stretches(codes, doc):
        k = int(doc[lo])
        found.setdefault(k, []).extend((lo - int(at[k]) + s, length, p) for s, length, p in runs(codes[lo:hi].tolist()))
    for k, i in enumerate(ids):
        of_doc = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
        dropped = np.zeros(int(sizes[k]), bool)
        for s, length, p in of_doc:
            dropped[s + p : s + length] = True
        if k in changed or of_doc:
            collapsed = " ".join(flat.take(pa.array(source[at[k] : at[k + 1]][~dropped])).to_pylist())
        else:
            collapsed = joined[k].as_py()
        best = min(of_doc, key=lambda r: (-r[1], r[0], r[2])) if of_doc else (None, None, None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in of_doc)
        sha = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()
        yield i, len(of_doc), *best, 1000 * best[1] // best[2] if of_doc else None, *sha, [{"start": s, "length": n, "period": p} for s, n, p in of_doc], collapsed


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])
_TYPES = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FULL = ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Bytes of text that are worked on at once, one document at least.
SLICE_BYTES = 4 << 20


def periodic_runs(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of the runs and of the text without
    repeats, and with `texts` the runs and that text themselves.

    One row for each row of docs; equal rows give equal rows, other columns are ignored, an empty table has none. A null, empty or
    blank text has no words: no runs, four nulls, digests of nothing. A null doc_id is a number of no planted run. Ties of the
    longest run go to the smallest start, then period. Texts of any length are one document; memory is some 0.5 kB a word of
    its longest stretch of repeats, and some 50 bytes a word otherwise.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(ids):
                before = int(size[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
                rows = list(zip(*_of_slice(ids[lo:hi], column.slice(lo, hi - lo)), strict=True))
                fields = list(_ROW)[: len(_ROW) if texts else -2]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, fields, strict=False)], schema=pa.schema(fields))
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _TYPES + (_FULL if texts else ""))


def op13_periods(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
