"""The pipeline on the smallest tables: every stage keeps what it should."""

import collections
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_operators import brute_components, brute_spans, prose, vocabulary

import corpus_pipeline
from loomgrid.llm import decontaminate, packing, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.8 * seen[0]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in spark.read.parquet(f"{tmp_path}/personal_data").select("doc_id").collect()}
    left = decontaminate.flag(spark.read.parquet(f"{tmp_path}/decontamination"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.where("size(leaks) > 0").count() == 0


def common_words(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def plain_redaction(text):
    out, at = "", 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in brute_spans(text)):
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, stop)
    return out + text[at:]


def test_run_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(20)
    own = {lang: vocabulary(seed, 300) for lang, seed in (("aa", 31), ("bb", 32), ("cc", 33))}
    rows = [(i, prose(rnd, own[lang], rnd.choice([60, 90, 700])), lang) for i, lang in enumerate(list(own) * 30)]
    rows += [(200, "123 !! 4", "aa"), (201, "", "bb"), (202, None, "cc")]  # no letter
    for k in range(12):  # near copies, some with a number below the first one's
        words = rows[k][1].split()
        words[7] = own[rows[k][2]][k]
        rows.append((300 + k if k % 2 else -1 - k, " ".join(words), rows[k][2]))
    rows += [rows[40], (None, rows[41][1], rows[41][2])]
    items = [(k, prose(rnd, own["aa"], 24 + k)) for k in range(6)]
    for k, item in items:
        said = item.split()
        if k % 2:
            said[3] = said[9] = "other"
        rows.append((400 + k, f"{prose(rnd, own['aa'], 70)} {' '.join(said)} {prose(rnd, own['aa'], 70)}", "aa"))
    for k, secret in enumerate(["10.0.0.1", "1.2.3.4", "a.b@example.com", "+1 (988) 555-2485", "4387 5130 3523 7269", "x@y.org 192.168.0.1"]):
        rows.append((500 + k, f"{prose(rnd, own['bb'], 60)} {secret} {prose(rnd, own['bb'], 20)}", "bb"))
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    root = brute_components([(i, t) for i, t in kept if i is not None], 5, 80)
    kept = sorted({(i, t) for i, t in kept if i is not None and root[i][1] == i}) + [(i, t) for i, t in kept if i is None]
    kept = [(i, t) for i, t in kept if not any(common_words(x.split(), t.split()) >= 0.7 * len(x.split()) for _, x in items)]
    ids = {i for i, _ in kept}
    assert len(kept) == 90 + 1 + 6 and not ids & {200, 201, 202, *range(400, 406)} and -1 in ids and 0 not in ids
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    want = collections.Counter()
    for i, t in kept:
        said = np.asarray([*tok.encode(plain_redaction(t), add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k in range(-(-len(said) // 1024)):
            n = 1024 if k else len(said) % 1024 or 1024
            want[(i, k, at, n, zlib.crc32(said[at : at + n].tobytes()))] += 1
            at += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0, *(offset + n for offset, n in sorted(held))]
        assert [offset for offset, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024


def test_stages_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaks string, base string, key string, kept string"
    plain = "words that say nothing much at all but are words of a text"
    rows = [(1, plain, "aa"), (1, plain, "aa"), (1, "another text of the same number, with words of its own", None), (None, plain, "aa"), (None, None, None), (2, None, None), (3, "", "aa"), (4, "4 5 6", "aa"), (5, plain + " a@b.co", None)]
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "x", "x", "x") for i, t, lang in table], schema)
        for stage, run in corpus_pipeline.STAGES:
            run(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage}")
            out = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage == "packing":
                assert out.where("piece = 0").count() == docs.count()
            else:
                assert out.columns == docs.columns and out.where("leaks <> 'x' OR base <> 'x' OR key <> 'x' OR kept <> 'x'").count() == 0
                docs = out
            if name == "none":
                assert out.count() == 0
            elif stage == "language_id":  # those with letters, and each has a language
                assert sorted((r.doc_id or 0, r.lang) for r in out.collect()) == [(0, "aa"), (1, "aa"), (1, "aa"), (1, "aa"), (5, "aa")]
            elif stage == "near_duplicates":  # a row without a number stays, a repeated row goes
                assert sorted((r.doc_id or 0, len(r.text)) for r in out.collect()) == [(0, len(plain)), (1, len(rows[2][1])), (1, len(plain))]
