"""The Merkle manifest against plain trees and its SQL."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import merkle

TABLE = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, n int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i, digest, proof):
    for nodes in tree[:-1]:
        run, k = nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        proof += run[:k] + run[k + 1 :]
        digest, i = sha("".join(run[:k] + [digest] + run[k + 1 :])), i // 16
    return digest


def brute(rows):
    seal = lambda *vs: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs))
    by = {}
    for doc_id, source, lang, n, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") if text is not None else None
        leaf = seal(doc_id, source, lang, n, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, seal(doc_id, source, lang, n, low) if hit else leaf))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: levels([r[2] for r in sorted(by[s])]) for s in sources}
    above = levels([below[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (known, doc_id, leaf, changed) in enumerate(sorted(by[s])):
            proof = []
            folded = climb(above, j, climb(below[s], i, changed, proof), proof)
            out.append((doc_id if known else None, leaf, below[s][-1][0], above[-1][0], sha("".join(proof)), folded, folded == above[-1][0]))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TABLE)
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("share", [2, 64])
def test_manifest(spark, monkeypatch, share):
    monkeypatch.setattr(merkle, "SHARE", share)
    rnd = random.Random(share)
    rows = [(i, "hot", "en", i % 7, f"Text {i} É") for i in range(600)]
    rows += [(rnd.randrange(10**6), f"s{k}", None, None, "aB\n" * k) for k in range(20) for _ in range(k)]
    rows += [(i, None, "de", 3, None) for i in range(17)] + [(None, "nulls", None, None, None)] * 3 + [(7, "twice", "fr", 1, "A"), (7, "twice", "fr", 1, "A"), (7, "twice", "fr", 1, "B")]
    rows += [(1, "", "", 0, ""), (2, "é", "x", -4, "Ünder\U0001f600"), (3, "z:1", "x", 1, "s"), (4, "lone", "x", 1, "LONG " * 20_000)]
    rnd.shuffle(rows)
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, "a", None, None, "X")], [(k, "a", None, None, "X") for k in range(16)], [(k, "a", None, None, "X") for k in range(17)], [(1, "a", None, None, None), (1, None, None, None, None)]])
def test_small_tables(spark, rows):
    assert built(spark, rows) == brute(rows) if rows else built(spark, rows) == []


def test_tampering_is_found(spark):
    rows = [(k, f"s{k % 3}", "en", 1, f"Text {k}") for k in range(100)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TABLE)
    told = merkle.manifest(df, F.when(F.col("doc_id") == 41, F.lit("other")).otherwise(F.col("text"))).collect()
    assert {r.doc_id for r in told if not r.verified} == {41} and len({r.root for r in told}) == 1


def test_settings_are_as_before(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    built(spark, [(k, "a", None, None, "X") for k in range(40)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_nodes_have_copies_for_what_is_below(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHARE", 4)
    nodes = spark.range(100).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), F.lit(100).cast("long").alias("n"), F.lit(1).cast("long").alias("weight"))
    links, roots = merkle._built(nodes, "s", 100, True)
    assert [df.groupBy("id").count().agg(F.max("count")).first()[0] for df in links] == [1, 4]  # 16 below: four copies
    assert [df.count() for df in roots] == [0, 0, 1]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = merkle.op12_merkle(spark, sf)
    told = con.execute(merkle.OP12_SQL)
    assert [c[0] for c in told.description] == got.columns
    assert sorted(told.fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)
