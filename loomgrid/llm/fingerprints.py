"""Fingerprints of texts that add up: a homomorphic hash of the multiset of a text's paragraphs, in DataFrame functions only.

Each paragraph (a line) is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors modulo 2**32.
So the order of paragraphs doesn't matter, and a paragraph is added to or taken from a fingerprint by adding or subtracting its
vector: the edited text's fingerprint here is that of the paragraphs before the edit, computed once, and those after it.

Of the 144 numbers of a vector the first 16 are the paragraph's SHA-512: they tell texts apart. The other 128 compare texts: each
is the sum of +1 or -1 for every pair of neighbouring words, by a bit of the pair's hash, so the product of two fingerprints
estimates how many pairs two texts share (with an error of one part in eight of the length, at a mean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import numbered, stored
from loomgrid.llm.native import SPACE, let

SEALS, SIGNS = 16, 128
_BLANKS = " \t\n\x0b\f\r"
#: Pairs that a count of eight bits can hold, the highest of which has the sign.
BLOCK = 127
#: The lowest bit of each byte of a number, and the lowest byte of each of its halves.
_EIGHT, _BYTES = 0x0101010101010101, 0x000000FF000000FF


def pairs(paragraph: Column) -> Column:
    """Hashes of a paragraph's pairs of neighbouring words; of one word or none it is the hash of that."""
    words = F.split(F.trim(paragraph, F.lit(_BLANKS)), SPACE)
    of_pairs = lambda ws: F.transform(F.slice(ws, 1, F.size(ws) - 1), lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))
    return let(words, lambda ws: F.when(F.size(ws) > 1, of_pairs(ws)).otherwise(F.array(F.xxhash64(ws[0]))))


def _wrapped(x: Column) -> Column:
    """A number modulo 2**32, from -2**31."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, paragraphs array) -> keys, vector (array of 144 numbers): the sum over all paragraphs of all rows of a key.

    Number 16 + b is for bit b of a pair's hash (b < 64), number 80 + b for bit b of that hash hashed again. Keys may be null; a
    key without paragraphs has no row. A pair's bits are counted eight to a number, in blocks of 127 pairs that no count can
    outgrow, and the blocks' counts in 32 bits.
    """
    each = rows.select(*keys, F.posexplode("paragraphs").alias("at", "p")).withColumn("seal", F.unhex(F.sha2("p", 512)))
    blocks = let(pairs(F.col("p")), lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs), F.lit(BLOCK)), lambda s: F.slice(hs, s, BLOCK)))
    each = each.select(*keys, "at", "seal", F.posexplode(blocks).alias("block", "hs")).select(*keys, "at", "seal", "block", F.explode("hs").alias("h0")).withColumn("h1", F.xxhash64("h0"))
    bits = lambda h, s: F.shiftrightunsigned(F.col(h), s).bitwiseAND(F.lit(_EIGHT))
    counts = each.groupBy(*keys, "at", "block", "seal").agg(F.count("*").alias("n"), *[F.sum(bits(f"h{k}", s)).alias(f"c{k}_{s}") for k in (0, 1) for s in range(8)])
    number = lambda k: F.conv(F.hex(F.substring("seal", 4 * k + 1, 4)), 16, 10).cast("long")
    seals = [F.sum(F.when(F.col("block") == 0, number(k)).otherwise(F.lit(0))).alias(f"s{k}") for k in range(SEALS)]
    wide = [F.sum(F.shiftrightunsigned(F.col(f"c{k}_{s}"), 8 * j).bitwiseAND(F.lit(_BYTES))).alias(f"w{k}_{s + 8 * j}") for k in (0, 1) for s in range(8) for j in range(4)]
    told = counts.groupBy(*keys).agg(F.sum("n").alias("n"), *seals, *wide)
    half = lambda k, b: F.shiftrightunsigned(F.col(f"w{k}_{b % 32}"), 32 if b >= 32 else 0).bitwiseAND(F.lit((1 << 32) - 1))
    signs = [half(k, b) * 2 - F.col("n") for k in (0, 1) for b in range(64)]
    return told.select(*keys, F.transform(F.array(*[F.col(f"s{k}") for k in range(SEALS)], *signs), _wrapped).alias("vector"))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together; a null one adds nothing."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: _wrapped(x + y)), a, b)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of a text's paragraphs without those of another."""
    return F.zip_with(a, b, lambda x, y: _wrapped(x - y))


def encoded(vector: Column) -> Column:
    """A fingerprint as text: base64 of its numbers in 32 bits, the highest byte first."""
    numbers = F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), "")
    return F.replace(F.base64(F.unhex(numbers)), F.lit("\r\n"), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts of two fingerprints are, 0 to 1: twice the shared pairs by the pairs of both, 1 if they are equal."""
    tail = lambda v: F.slice(v, SEALS + 1, SIGNS)
    none = F.struct(F.lit(0.0).alias("shared"), F.lit(0.0).alias("all"))
    terms = F.zip_with(tail(a), tail(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    sums = F.aggregate(terms, none, lambda t, e: F.struct((t["shared"] + e["x"] * e["y"]).alias("shared"), (t["all"] + e["x"] * e["x"] + e["y"] * e["y"]).alias("all")))
    part = let(sums, lambda t: F.when(t["all"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * t["shared"] / t["all"]))).otherwise(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(part)


def paragraphs(text: Column) -> Column:
    """The lines of a text, blank ones too; a null text is one of nothing."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), vector, fingerprint: a row for each text of each doc_id, equal rows once.

    A null text is an empty one. Other columns are ignored; an empty table has no rows. Rows with a null doc_id are kept apart by
    their texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).dropDuplicates(["doc_id", "h"])
    found = vectors(rows.select("doc_id", "h", paragraphs(F.col("text")).alias("paragraphs")), "doc_id", "h")
    return found.select("doc_id", "h", "vector", encoded(F.col("vector")).alias("fingerprint"))


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text ends, in place of its last quarter (in code points, rounded down), with as much of the beginning of the next
    text, or all of it if that is shorter; after the last text comes the first. Rows ascend by doc_id (null first), and those of one
    doc_id by a hash of the text; a repeated row is followed by its like. A null text is an empty one, a single row is its own
    next. Other columns are ignored.

    Only keys and lengths are sorted. Texts are shuffled once, by their key, and the beginnings that are asked for once; both then
    lie where the fingerprints are summed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k0"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k1"), "text")
    keys = rows.groupBy(F.col("doc_id").isNotNull().alias("known"), "k0", "k1").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = numbered(stored(keys.withColumn("all", F.lit(0)), "keys").withColumnRenamed("n", "chars"), "all", "known", "k0", "k1")
    order = stored(order.select("k0", "k1", "copies", "chars", "at", "n"), "order")
    after = order.select(F.col("k0").alias("next0"), F.col("k1").alias("next1"), F.col("copies").alias("last"), F.col("at").alias("next_at"))
    asked = order.join(after, F.pmod(F.col("at") + 1, "n") == F.col("next_at"))
    asked = asked.select(F.col("next0").alias("k0"), F.col("next1").alias("k1"), "last", F.struct("k0", "k1", "copies", (F.col("chars") / 4).cast("long").alias("quarter")).alias("of"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k0", "k1").orderBy("doc_id")))
    heads = rows.join(asked.hint("merge"), ["k0", "k1"]).where("copy >= last")  # one row of each key
    heads = heads.select("of.*", F.col("k0").alias("next0"), F.col("k1").alias("next1"), F.substring("text", F.lit(1), F.col("of.quarter").cast("int")).alias("head"))
    both = rows.join(heads.hint("merge"), ["k0", "k1"])
    both = both.withColumns({"again": F.col("copy") < F.col("copies"), "n_chars": F.length("text").cast("long"), "cut": F.length("text") - F.col("quarter").cast("int")})
    both = both.withColumns({"kept": F.substring("text", F.lit(1), F.col("cut")), "head": F.when(F.col("again"), F.substring("text", F.lit(1), F.col("quarter").cast("int"))).otherwise(F.col("head"))})
    both = both.withColumns({"lines": paragraphs(F.col("kept")), "edited_sha256": F.sha2(F.concat("kept", "head"), 256)})
    ended = lambda tail: paragraphs(F.concat(F.element_at("lines", -1), tail))
    parts = [F.slice("lines", 1, F.size("lines") - 1), ended(F.substring("text", F.col("cut") + 1, F.length("text"))), ended(F.col("head"))]
    group = ["k0", "k1", "copy", "doc_id", "again", "next0", "next1", "n_chars", "edited_sha256"]
    split = both.select(*group, F.posexplode(F.array(*parts)).alias("part", "paragraphs"))
    summed = vectors(split, *group, "part").groupBy(*group).agg(F.collect_list(F.struct("part", "vector")).alias("v"))
    of_part = lambda k: F.get(F.filter("v", lambda x: x["part"] == k), F.lit(0))["vector"]
    summed = summed.select(*group, added(of_part(0), of_part(1)).alias("own"), added(of_part(0), of_part(2)).alias("edited"))
    summed = stored(summed.withColumns({c: F.transform(c, lambda x: x.cast("int")) for c in ("own", "edited")}), "vectors")
    following = summed.where("NOT again").select(F.col("k0").alias("next0"), F.col("k1").alias("next1"), F.col("own").alias("following"))
    told = summed.join(following, ["next0", "next1"])
    near_next = F.when(F.col("again"), F.lit(1.0)).otherwise(likeness(F.col("own"), F.col("following")))
    return told.select("doc_id", "n_chars", "edited_sha256", encoded(F.col("own")).alias("fingerprint"), encoded(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), near_next.alias("near_next"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
