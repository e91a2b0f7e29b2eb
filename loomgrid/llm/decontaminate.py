"""Benchmark decontamination by latent semantic retrieval.

1. The terms are the words of the benchmark items. Their document frequencies are counted over all passages of the corpus
   (windows of `width` words); words in more than `max_df` of the passages say little and go.
2. A randomised SVD of the TF-IDF passages gives the latent space: the product of the passages' Gram matrix with a random
   block is summed over the corpus term by term, its orthonormal basis goes through the same product again (a power iteration),
   and Nystroem's formula turns the result into singular directions. The items are passages of the same matrix; all
   directions they span are kept before those of the corpus, as they are what is sought.
3. All overlapping passages with two of the terms, or with a term that makes a whole item, are projected and compared with all items by cosine; those above
   `cosine` are candidates.
4. A candidate is confirmed on the words themselves: the longest common subsequence of the item and some stretch of the
   document half as long again must have `lcs` of the item, and that of its answer, the last quarter, `answer` of it. So
   insertions, omissions and changed words are found, not only copies.

Items of one or two words are no passages: such an item is a leak where a document's words are just the item's.

The corpus is read four times a block and never shuffled. The items are a stated query set, taken in blocks of about
`block_words` words; what is broadcast is one block's terms by as many directions as it has items, bounded by the block's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import LOWER, SPACES, U64, flat, slices, texts_of, word_hashes

#: Bytes that separate terms: blanks and ASCII punctuation.
APART = SPACES.copy()
APART[[b for b in range(33, 128) if not chr(b).isalnum()]] = True
_APART = r"\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: A text of two words at most.
BRIEF = rf"\A[{_APART}]*+(?:[^{_APART}]++[{_APART}]*+){{0,2}}+\z"
LEAKS = "array<struct<item_id:long,cosine:double,lcs:double>>"


@dataclass
class Items:
    """A block of benchmark items: numbers, words, and their terms as indices of `terms` (sorted hashes)."""

    ids: list[int]
    words: list[np.ndarray]
    terms: np.ndarray


def small_letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with capitals of ASCII and of Latin-1 made small."""
    out = LOWER[data]
    if len(out) > 1:
        after = out[1:]
        after[(out[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 32
    return out


def _read(texts: list[str]) -> list[np.ndarray]:
    data, at = flat(pa.array([(t or "").encode() for t in texts], pa.binary()))
    hashes, first = word_hashes(small_letters(data), at, APART)
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _passages(data: np.ndarray, at: np.ndarray, items: Items, width: int, stride: int):
    """Words of some rows, each row's first word, and the (passage, term) pairs with counts of its windows, with each passage's row and place."""
    hashes, first = word_hashes(small_letters(data), at, APART)
    n_words = np.diff(first)
    per_row = np.where(n_words > 0, np.maximum(1, -(-np.maximum(n_words - width, 0) // stride) + 1), 0)
    row = np.repeat(np.arange(len(n_words)), per_row)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * stride
    # most words are no terms: a table of the hashes' low bits leaves few for the search
    likely = np.zeros(1 << 16, bool)
    likely[(items.terms & U64(0xFFFF)).astype(np.int64)] = True
    known = np.flatnonzero(likely[(hashes & U64(0xFFFF)).astype(np.uint16)])
    term = np.searchsorted(items.terms, hashes[known])
    term[term == len(items.terms)] = 0
    right = items.terms[term] == hashes[known] if len(items.terms) else np.zeros(0, bool)
    known, term = known[right], term[right]
    begin = first[row] + place
    lo, hi = np.searchsorted(known, begin), np.searchsorted(known, np.minimum(begin + width, first[row + 1] if len(row) else begin))
    held = hi - lo
    inside = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held) + np.repeat(lo, held)
    pair, count = np.unique(np.repeat(np.arange(len(row)), held) * np.int64(max(1, len(items.terms))) + term[inside], return_counts=True)
    return hashes, first, row, place, pair // max(1, len(items.terms)), pair % max(1, len(items.terms)), count


def _rows(batches: Iterator[pa.RecordBatch], column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        data, at = flat(batch.column(column))
        for lo, hi in slices(at):
            yield data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def frequencies(docs: DataFrame, items: Items, width: int) -> tuple[np.ndarray, int]:
    """In how many passages of `width` words, side by side, each term is, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.terms) + 1, np.int64)
        for data, at in _rows(batches, 0):
            _, _, row, _, _, term, _ = _passages(data, at, items, width, width)
            total[:-1] += np.bincount(term, minlength=len(items.terms))
            total[-1] += len(row)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["term", "n"])

    out = np.zeros(len(items.terms) + 1, np.int64)
    for r in texts_of(docs.select(F.col("text").cast("binary"))).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n  # one row for each term of the block
    return out[:-1], int(out[-1])


def _weights(passage: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF of the pairs, each passage of length one."""
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(passage, w * w, minlength=n))
    return (w / np.maximum(norm, 1e-12)[passage]).astype(np.float32)


def _spread(passage: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of `values` by passage (sorted), for all n passages."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(passage):
        lead = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        out[passage[lead]] = np.add.reduceat(values, lead, axis=0)
    return out


def latent_space(docs: DataFrame, items: Items, idf: np.ndarray, matrix: np.ndarray, width: int, rank: int, power: int = 1) -> np.ndarray:
    """Orthonormal directions in term space (terms x rank): all those of the items first, then the corpus' leading ones."""
    n_terms = len(items.terms)
    block = min(rank + 8, n_terms)
    omega = np.random.default_rng(5).standard_normal((n_terms, block)).astype(np.float32)

    def product(batches: Iterator[pa.RecordBatch], omega: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_terms, omega.shape[1]), np.float32)
        for data, at in _rows(batches, 0):
            _, _, row, _, passage, term, count = _passages(data, at, items, width, width)
            w = _weights(passage, term, count, idf, len(row))
            y = _spread(passage, omega[term] * w[:, None], len(row))
            order = np.argsort(term, kind="stable")
            total += _spread(term[order], y[passage[order]] * w[order][:, None], n_terms)
        k = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([total[i].tobytes() for i in k], pa.binary())], ["term", "y"])

    def add(key, table):
        total = np.sum([np.frombuffer(y, np.float32) for y in table.column("y").to_pylist()], axis=0, dtype=np.float64)
        return pa.table({"term": [key[0].as_py()], "y": [total.astype(np.float32).tobytes()]})

    def gram(omega: np.ndarray) -> np.ndarray:
        """The passages' Gram matrix times a block, one row for each term."""
        z = np.zeros((n_terms, omega.shape[1]))
        rows = texts_of(docs.select(F.col("text").cast("binary"))).mapInArrow(lambda batches: product(batches, omega), "term long, y binary").groupBy("term").applyInArrow(add, "term long, y binary")
        for r in rows.toLocalIterator():
            z[r.term] = np.frombuffer(r.y, np.float32)
        return z

    z = gram(omega)
    for _ in range(power):
        omega = np.ascontiguousarray(np.linalg.qr(z)[0].astype(np.float32))
        z = gram(omega)
    _, size, own = np.linalg.svd(matrix, full_matrices=False)
    own = own[size > size.max(initial=0) * 1e-6].T
    core = omega.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(1e-9, values.max(initial=0) * 1e-7)
    corpus = z @ vectors[:, good] / np.sqrt(values[good])
    corpus = np.linalg.svd(corpus, full_matrices=False)[0][:, :rank] if good.any() else corpus[:, :0]
    basis, r = np.linalg.qr(np.hstack([own, corpus]))
    return np.ascontiguousarray(basis[:, np.abs(np.diag(r)) > 1e-6].astype(np.float32))


def lcs_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: masks has the places of each word of the item."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = masks.get(w, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def flag_block(docs: DataFrame, corpus: DataFrame, items: Items, width: int, rank: int, max_df: float, cosine: float, lcs: float, answer: float) -> DataFrame:
    """Add `leaks` for one block of items to docs, which has the texts of corpus; the latent space is learned from corpus."""
    df, n = frequencies(corpus, items, width)
    place = [np.searchsorted(items.terms, np.unique(w)) for w in items.words]
    telling = df <= max(2, max_df * n)
    for p in place:  # an item whose words are nearly all frequent keeps them
        if telling[p].sum() < 5:
            telling[p] = True
    idf = np.where(telling, np.log((1 + n) / (1 + df)) + 1, 0.0)
    keep = np.flatnonzero(telling)
    items = Items(items.ids, items.words, items.terms[keep])
    idf = idf[keep]
    matrix = np.zeros((len(items.ids), len(keep)), np.float32)
    for i, w in enumerate(items.words):
        k, c = np.unique(w[np.isin(w, items.terms)], return_counts=True)
        matrix[i, np.searchsorted(items.terms, k)] = (1 + np.log(c)) * idf[np.searchsorted(items.terms, k)]
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    basis = latent_space(corpus, items, idf, matrix, width, rank)
    wanted = matrix @ basis
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-12)
    sent = docs.sparkSession.sparkContext.broadcast((items, idf, basis, wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis, wanted = sent.value
        listed = [w.tolist() for w in items.words]
        tails = [w[-max(1, len(w) // 4) :].tolist() for w in items.words]
        whole = [(_masks(w.tolist()), len(w)) for w in items.words]
        alone = np.zeros(max(1, len(items.terms)), bool)  # terms that make a whole item
        for w in items.words:
            own = np.unique(np.searchsorted(items.terms, w[np.isin(w, items.terms)]))
            alone[own] |= len(own) == 1
        ends = [(_masks(t), len(t)) for t in tails]
        for batch in batches:
            data, at = flat(batch.column("_text"))
            leaks: list[list] = [[] for _ in range(len(at) - 1)]
            for lo, hi in slices(at):
                hashes, first, row, place, passage, term, count = _passages(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], items, width, width // 2)
                few = (np.bincount(passage, minlength=len(row))[passage] >= 2) | (np.bincount(passage, alone[term], minlength=len(row))[passage] > 0) if len(passage) else np.zeros(0, bool)
                passage, term, count = passage[few], term[few], count[few]
                if not len(passage):
                    continue
                some, passage = np.unique(passage, return_inverse=True)
                weights = _weights(passage, term, count, idf, len(some))
                found: dict[tuple[int, int], float] = {}
                seen: dict[tuple[int, int], list[int]] = {}
                for a in range(0, len(some), 512):  # so few passages at once that their terms' directions fit
                    at0, at1 = np.searchsorted(passage, (a, a + 512))
                    z = _spread(passage[at0:at1] - a, basis[term[at0:at1]] * weights[at0:at1, None], min(512, len(some) - a))
                    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                    close = z @ wanted.T
                    for p, i in zip(*np.nonzero(close >= cosine), strict=True):
                        k = (int(row[some[a + p]]), int(i))
                        found[k] = max(found.get(k, 0.0), float(close[p, i]))
                        seen.setdefault(k, []).append(int(place[some[a + p]]))
                for (r, i), c in sorted(found.items()):
                    masks, size = whole[i]
                    best, stretch, step = 0.0, size + size // 2, max(1, size // 4)
                    tried = set()
                    for p in seen[r, i]:
                        b0, b1 = max(first[r], first[r] + p - size), min(first[r + 1], first[r] + p + width + size)
                        there = set(hashes[b0 : min(b1 + stretch - size, first[r + 1])].tolist())  # all that the stretches below hold
                        if sum(w in there for w in listed[i]) < lcs * size:
                            continue  # no common subsequence can be long enough
                        for b in range(int(b0), int(max(b0 + 1, b1 - size + 1)), step):
                            if b in tried:
                                continue
                            tried.add(b)
                            part = hashes[b : min(b + stretch, first[r + 1])].tolist()
                            share = lcs_length(masks, size, part) / max(1, size)
                            if share > best and share >= lcs and lcs_length(*ends[i], part) >= answer * ends[i][1]:
                                best = share
                    if best:
                        leaks[lo + r].append({"item_id": items.ids[i], "cosine": c, "lcs": best})
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(leaks, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())])))], [*names, "leaks"])

    sizes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "leaks")
    kept = [f"`{f.name}`" for f in docs.schema.fields if f.name != "leaks"]
    frame = docs.select(*kept, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    return texts_of(frame).mapInArrow(search, f"{sizes + ', ' if kept else ''}leaks {LEAKS}")


def flag(docs: DataFrame, benchmark: DataFrame, width: int = 48, rank: int = 48, max_df: float = 0.02, cosine: float = 0.5, lcs: float = 0.7, answer: float = 0.5, block_words: int = 16_000) -> DataFrame:
    """docs with `leaks`: an array of (item_id, cosine, lcs), empty where the text holds no item.

    Null and empty texts hold none, and items with null or empty text are in none; an item of one or two words is a leak only of
    a text of just these words. Equal items are each reported. Repeated rows are each searched, at any length. Other columns
    pass through, except one named `leaks`, which is replaced. An empty corpus or benchmark gives empty arrays.
    """
    held = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("words"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(held.words or 0) // block_words))
    out = docs.withColumn("leaks", F.array().cast(LEAKS))
    short: dict[tuple, list[int]] = {}
    for b in range(blocks):  # a stated query set against all rows, in blocks
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").orderBy("item_id", "text").collect()
        words = _read([r.text for r in rows])
        for r, w in zip(rows, words, strict=True):
            if 0 < len(w) < 3:
                short.setdefault(tuple(w.tolist()), []).append(r.item_id)
        use = [i for i, w in enumerate(words) if len(w) >= 3]
        if use:
            items = Items([rows[i].item_id for i in use], [words[i] for i in use], np.unique(np.concatenate([words[i] for i in use])))
            out = flag_block(out.withColumnRenamed("leaks", "_before"), docs, items, width, rank, max_df, cosine, lcs, answer)
            out = out.withColumn("leaks", F.concat("_before", "leaks")).drop("_before")
    return _flag_short(out, short) if short else out


def _flag_short(docs: DataFrame, short: dict[tuple, list[int]]) -> DataFrame:
    """Add the items of one or two words to the leaks of texts that have no other words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("_text"))
            hashes, first = word_hashes(small_letters(data[at[0] : at[-1]]), at - at[0], APART)
            leaks = [[{"item_id": i, "cosine": 1.0, "lcs": 1.0} for i in short.get(tuple(hashes[a:b].tolist()), [])] if 0 < b - a < 3 else [] for a, b in zip(first[:-1], first[1:], strict=True)]
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(leaks, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())])))], [*names, "_more"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    # few texts have so few words, at whatever length, and only they go through Python
    brief = F.coalesce("text", F.lit("")).rlike(BRIEF)
    found = texts_of(docs.where(brief).withColumn("_text", F.coalesce("text", F.lit("")).cast("binary"))).mapInArrow(search, f"{kinds}, _more {LEAKS}")
    found = found.withColumn("leaks", F.concat("leaks", "_more")).drop("_more")
    return found.unionByName(docs.where(~brief))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.round("l.cosine", 4).alias("cosine"), F.round("l.lcs", 4).alias("lcs"))
