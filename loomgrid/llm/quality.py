"""Quality rules under weak supervision, in DataFrame functions only.

Every rule votes good or bad or abstains. Votes are counted by pattern (a few hundred rows for any corpus), and
expectation-maximisation over the patterns estimates how each rule votes on good and on bad documents: its accuracies. The
posterior probability of good, from all votes together, replaces a filter in which every rule must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import cut
from loomgrid.llm.native import SPACE, indices, let, words

GOOD, BAD, ABSTAIN = 1, 0, 2
#: What is believed of a rule before any document: twenty votes on good and twenty on bad documents, better than chance.
PRIOR = {"g": {GOOD: 18.0, BAD: 0.4, ABSTAIN: 1.6}, "b": {GOOD: 12.0, BAD: 6.0, ABSTAIN: 2.0}}
#: Frequent short words of English, German, French and Spanish.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "die", "der", "und", "das", "ist", "zu", "den", "ein", "le", "la", "les", "de", "et", "un", "une", "des", "en", "el", "los", "que", "y", "se"]


def _repeated(hashes: Column, width: int = 5) -> Column:
    """How many words are in a window of `width` words that the text has twice or more."""
    grams = F.transform(indices(F.size(hashes) - (width - 1)), lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]).alias("h"), i.alias("i")))

    def covered(ranked: Column) -> Column:
        again = F.filter(ranked, lambda g, k: F.coalesce((F.get(ranked, k - 1)["h"] == g["h"]), F.lit(False)) | F.coalesce((F.get(ranked, k + 1)["h"] == g["h"]), F.lit(False)))
        places = F.sort_array(F.transform(again, lambda g: g["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    return let(F.sort_array(grams), covered).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules use; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    two = one.select("doc_id", "text", words(F.col("text")).alias("w"))

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(F.array_distinct(h)).cast("long").alias("distinct"), _repeated(h).alias("repeated"))).alias("h"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        )

    def by_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    t = F.col("text")
    three = two.select(
        "doc_id",
        let(F.col("w"), by_words).alias("w"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0), by_lines).alias("l"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_shouts"),
        (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long").alias("n_digits"),
    )
    return three.select(
        "doc_id", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"), F.col("w.h.repeated").alias("n_repeat_words"),
        F.col("l.n_lines").alias("n_lines"), F.col("w.h.distinct").alias("n_distinct"), F.col("w.n_function").alias("n_function"), "n_upper", "n_shouts", "n_digits",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes by rule; each reads the columns of features()."""
    n, c = F.col("n_words"), F.col
    some = F.greatest(n, F.lit(1))
    return {
        "length": _vote(n >= 30, n < 12),
        "word_length": _vote((c("word_chars") >= 2.5 * n) & (c("word_chars") <= 12 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        "symbols": _vote(c("n_symbols") * 50 <= some, c("n_symbols") * 10 > some),
        "dup_lines": _vote(c("n_dup_lines") * 10 <= c("n_lines"), c("n_dup_lines") * 3 > c("n_lines")),
        "repeats": _vote(c("n_repeat_words") * 20 <= some, c("n_repeat_words") * 4 > some),
        "capitals": _vote(c("n_upper") * 10 <= c("word_chars"), c("n_upper") * 3 > c("word_chars")),
        "shouts": _vote(c("n_shouts") * 20 <= some, c("n_shouts") * 5 > some),
        "digits": _vote(c("n_digits") * 10 <= c("word_chars"), c("n_digits") * 3 > c("word_chars")),
        # different words grow about as the root of all words, at any length
        "variety": _vote(c("n_distinct") * c("n_distinct") >= 9 * n, c("n_distinct") * c("n_distinct") < 2 * n),
        "function_words": _vote(c("n_function") * 50 >= some, (c("n_function") == 0) & (n >= 40)),
    }


def fit(patterns: DataFrame, names: list[str], rounds: int = 12, prior: float = 0.85) -> tuple[float, dict[str, tuple[list[float], list[float]]]]:
    """EM over vote patterns (one column for each rule, and n): the share of good documents, and for each rule the
    probabilities of a good vote, a bad vote and no vote, on good and on bad documents.

    A round is one aggregate of the pattern table whose result is one row. It starts from the belief that a document with a bad
    vote is bad nine times in ten, and a document without is good nine times in ten; a rule that calls a third of all
    documents bad says nothing at the start (a list of function words in a corpus of other languages). Counts start from
    PRIOR.
    """
    order = [GOOD, BAD, ABSTAIN]
    shares = patterns.agg(*[(F.sum(F.when(F.col(r) == BAD, F.col("n")).otherwise(0.0)) / F.sum("n")).alias(r) for r in names]).first()
    first = [r for r in names if (shares[r] or 0.0) < 1 / 3]
    share, table = prior, None
    for _ in range(rounds):
        if table is None:
            hit = F.lit(False)
            for r in first:
                hit = hit | (F.col(r) == BAD)
            good = F.when(hit, 0.1).otherwise(0.9)
        else:
            good = posterior(share, table)
        weighed = patterns.withColumn("g", good * F.col("n")).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("g").alias("g"), F.sum("b").alias("b")]
        sums += [F.sum(F.when(F.col(r) == v, F.col(k)).otherwise(0.0)).alias(f"{k}_{r}_{v}") for r in names for v in order for k in "gb"]
        row = weighed.agg(*sums).first()
        g, b = row["g"] or 0.0, row["b"] or 0.0
        share = (g + 1) / (g + b + 2)
        table = {r: tuple([(row[f"{k}_{r}_{v}"] or 0.0) + PRIOR[k][v] for v in order] for k in "gb") for r in names}
        table = {r: tuple([x / sum(p) for x in p] for p in t) for r, t in table.items()}
    return share, table


def posterior(share: float, table: dict[str, tuple[list[float], list[float]]]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(share) - math.log(1 - share))
    for r, (good, bad) in table.items():
        logs = [math.log(x) - math.log(y) for x, y in zip(good, bad, strict=True)]
        odds = odds + F.when(F.col(r) == GOOD, logs[0]).when(F.col(r) == BAD, logs[1]).otherwise(logs[2])
    return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: the counts, base_failed, p_good and kept.

    A null or empty text has no words and fails the base rules. Repeated rows and equal texts get equal results. An empty
    table gives no rows. Columns other than doc_id and text are ignored.
    """
    votes = rules()
    counted = cut(features(docs).withColumns(votes))
    patterns = cut(counted.groupBy(*votes).agg(F.count("*").cast("double").alias("n")))
    p_good = posterior(*fit(patterns, list(votes)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round(p_good, 6).alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
