"""Fingerprints of texts against plain sums."""

import base64
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgrid.llm import fingerprints as P


def pair_hashes(paragraph):
    words = re.findall(r"[^\x20\x09-\x0D]+", paragraph)
    one = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
    return [one(b, one(a)) for a, b in zip(words, words[1:])] or [one(words[0] if words else "")]


def brute_vector(text):
    total = [0] * 144
    for p in (text or "").split("\n"):
        for k, v in enumerate(struct.unpack(">16I", hashlib.sha512(p.encode()).digest())):
            total[k] += v
        for h in pair_hashes(p):
            bits = h | xxhash.xxh64_intdigest(struct.pack("<Q", h), 42) << 64
            for b in range(128):
                total[16 + b] += 1 if bits >> b & 1 else -1
    return [(v + 2**31) % 2**32 - 2**31 for v in total]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    shared, both = sum(x * y for x, y in zip(a[16:], b[16:])), sum(x * x + y * y for x, y in zip(a[16:], b[16:]))
    return max(0.0, min(1.0, 2 * shared / both)) if both else 0.0


def name(v):
    return base64.b64encode(struct.pack(">144i", *v)).decode()


def brute(rows):
    """Rows in the order of the documents: by doc_id, null first; these have no ties but repeated rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        t, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        a, b, c = brute_vector(t), brute_vector(edited), brute_vector(following)
        out.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), name(a), name(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, k1 string, part int, copies int")
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in P.edits(df).collect()), key=str)


def test_edits(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "été", "\U0001f600", "Gamma,", "d", " "]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(n))
    rows = [(i * 3, text(rnd.randint(0, 60))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "ab"), (503, "abcd"), (504, "\n\n\n\n"), (505, "same text\nhere"), (506, "same text\nhere"), (None, "no number"), (700, "twice \n" * 5), (700, "twice \n" * 5), (700, "twice \n" * 5), (-5, "first " * 4)]
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone and\nonly")], [(1, None)], [(1, "x y z w"), (1, "x y z w")]])
def test_edits_of_small_tables(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_long_paragraphs_and_counts(spark, monkeypatch):
    text = "one two " * 2_000 + "\n" + "three " * 700  # many blocks; one pair more often than a byte can count
    assert P.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().vector == brute_vector(text)


def test_paragraphs_are_added_and_removed(spark):
    a, b = "first paragraph here\nsecond one", "third of these\nfourth\nfourth"
    rows = spark.createDataFrame([(1, a), (2, b), (3, b + "\n" + a), (4, "fourth\nsecond one\nfourth\nthird of these\nfirst paragraph here")], "doc_id long, text string")
    v = {r.doc_id: r for r in P.fingerprints(rows).collect()}
    assert v[3].fingerprint == v[4].fingerprint != v[1].fingerprint
    one = spark.createDataFrame([(v[1].vector, v[2].vector, v[3].vector)], "a array<long>, b array<long>, c array<long>")
    told = one.select(P.added(F.col("a"), F.col("b")).alias("sum"), P.removed(F.col("c"), F.col("b")).alias("rest"), P.added(F.col("a"), F.lit(None).cast("array<long>")).alias("same")).first()
    assert told.sum == v[3].vector and told.rest == v[1].vector == told.same


def test_likeness_follows_shared_pairs(spark):
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(words) for _ in range(400)]
    texts = [(k, " ".join(base[: 400 - 40 * k] + [rnd.choice(words) for _ in range(40 * k)])) for k in range(11)]
    v = [r.vector for r in sorted(P.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    for k in range(11):
        assert abs(brute_likeness(v[0], v[k]) - (1 - k / 10)) < 0.25


def test_no_python_workers(spark):
    plan = P.fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
