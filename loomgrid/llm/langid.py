"""Language identification by multilingual mixtures.

Training: byte trigrams of labelled texts give one smoothed distribution per language. The labelled rows are a bounded
sample: at most `rows_per_lang` expected rows of each language, chosen by a hash of the text. Prediction covers every
whole text: each word gets its log-likelihood under each language, expectation-maximisation over the words estimates the
proportions of the languages in the document, and the set of languages is chosen by penalised likelihood (a language
stays only if it raises the log-likelihood by more than the penalty). The largest proportion names the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import LOWER, flat, slices, texts_of, word_spans

BITS = 15
UNKNOWN = "und"
ROWS_PER_LANG = 2000


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of all words with a blank on either side, where each word's start, and each row's first word."""
    starts, ends, first = word_spans(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    length = ends - starts
    begin = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(begin, length)
    here = np.repeat(starts, length) + inside
    x = LOWER[data].astype(np.uint32)
    left = np.where(inside == 0, 32, x[np.maximum(here - 1, 0)])
    right = np.where(inside == np.repeat(length, length) - 1, 32, x[np.minimum(here + 1, len(x) - 1)])
    return ((((left << 16) | (x[here] << 8) | right) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), begin, first


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the doc_id as text leaves no rest; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams, from (text, lang) rows; null texts and langs are left out.

    What reaches the driver is one count per language and trigram cell: bounded by the languages, not by the rows.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = labelled.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(rows_per_lang) / F.col("count")))
    share = {r.lang: r.share for r in sizes.collect()}
    langs = sorted(share)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    picked = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < wanted * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            data, at = flat(batch.column(1))
            which = np.asarray([langs.index(x) for x in batch.column(0).to_pylist()])
            for lo, hi in slices(at):
                grams, begin, first = _grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                row = np.searchsorted(np.append(begin, len(grams))[first[1:]], np.arange(len(grams)), side="right")
                np.add.at(total, (which[lo + row], grams), 1)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(total[k, g])], ["k", "g", "n"])

    counts = texts_of(picked.select("lang", F.col("text").cast("binary").alias("text"))).mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    table = np.full((len(langs), 1 << BITS), 0.05)
    for r in counts.toLocalIterator():
        table[r.k, r.g] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True))


def mixture(words: np.ndarray, weight: np.ndarray, rounds: int = 8, penalty: float = 12.0) -> np.ndarray:
    """Proportions of the languages for words (log-likelihoods, one row each).

    EM, then backward elimination: languages go, the smallest proportion first, while that costs at most `penalty` of
    log-likelihood. Those below a fiftieth go at once if that costs no more than one may.
    """
    like = np.exp(words - words.max(1, keepdims=True))

    def em(use: np.ndarray) -> tuple[np.ndarray, float]:
        p = use / use.sum()
        for _ in range(rounds if use.sum() > 1 else 0):
            p = p * ((weight / np.maximum(like @ p, 1e-300)) @ like)
            p /= p.sum()
        return p, float((np.log(np.maximum(like @ p, 1e-300)) * weight).sum())

    use = np.ones(words.shape[1])
    p, best = em(use)
    fewer = (p >= 0.02).astype(float)
    if 0 < fewer.sum() < use.sum():
        q, fit = em(fewer)
        if best - fit <= penalty:
            use, p, best = fewer, q, fit
    while use.sum() > 1:
        low = int(np.argmin(np.where(use > 0, p, 2)))
        fewer = use.copy()
        fewer[low] = 0
        q, fit = em(fewer)
        if best - fit > penalty:
            break
        use, p, best = fewer, q, fit
    return p


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 12.0) -> DataFrame:
    """Add lang_pred, score and languages (the chosen set) to every row.

    A text that is null or has no letter is `und` with score 0. The score is the proportion of the named language.
    """
    names = langs
    broadcast = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32)))  # 2**15 cells a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = broadcast.value
        for batch in batches:
            data, at = flat(batch.column("_text"))
            lettered = batch.column("_letters").to_pylist()
            pred, score, sets = [UNKNOWN] * len(lettered), [0.0] * len(lettered), [[] for _ in lettered]
            for lo, hi in slices(at):
                grams, begin, first = _grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if not len(grams) or not names:
                    continue
                words = np.add.reduceat(logs[grams], begin, axis=0).astype(np.float64)
                lengths = np.diff(np.append(begin, len(grams)))
                for i in range(lo, hi):
                    a, b = first[i - lo], first[i - lo + 1]
                    if lettered[i] and b > a:
                        p = mixture(words[a:b], lengths[a:b] / lengths[a:b].mean(), penalty=penalty)
                        top = int(np.argmax(p))
                        pred[i], score[i], sets[i] = names[top], float(min(1.0, p[top])), [names[k] for k in np.flatnonzero(p > 0)]
            keep = [k for k, n in enumerate(batch.schema.names) if n not in ("_text", "_letters")]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [batch.schema.names[k] for k in keep] + ["lang_pred", "score", "languages"])

    frame = docs.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")).cast("binary"), "_letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "languages")]
    names_sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return texts_of(frame.select(*[f"`{f.name}`" for f in kept], "_text", "_letters")).mapInArrow(run, f"{names_sql}, lang_pred string, score double, languages array<string>")


def identify(docs: DataFrame, folds: int = 5, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict every row: doc_id, held_out, lang_pred, score, languages."""
    langs, table = train(docs.where(~held_out(folds=folds)), rows_per_lang)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, table)
    return out.select("doc_id", held_out(folds=folds).alias("held_out"), "lang_pred", "score", "languages")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
