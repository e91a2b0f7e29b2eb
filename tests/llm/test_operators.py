"""The corpus operators against brute force, round trips and held-out rows, on small tables."""

import collections
import gzip
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import archives, chat, common, decontaminate, langid, minhash, packing, pii, quality, sitetree, suffixes

DOC = "doc_id long, text string, source string, row string, node string"


def docs(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", "r", "n") for i, t in texts], DOC)


def vocabulary(seed=1, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


# 1: repeats


def brute_repeats(rows, length):
    at = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if at[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [24, 60])
def test_repeats(spark, length):
    rnd, words = random.Random(length), vocabulary()
    shared = prose(rnd, words, 20)
    texts = [(i, prose(rnd, words, 30) + (shared if i % 3 == 0 else "") + "é" * (i % 5) + prose(rnd, words, 9)) for i in range(25)]
    texts += [(100, texts[0][1]), (101, texts[0][1]), (0, texts[0][1]), (102, "ab" * 100), (103, None), (104, ""), (None, "x" * length), (105, "short")]
    got = suffixes.remove_repeats(docs(spark, texts), length, chunk_bytes=900, bucket_keys=64)
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str)
    assert have == brute_repeats([(i, (t or "").encode()) for i, t in texts], length)


@pytest.mark.parametrize("most", [7, 57, 307, 336])
def test_difference_cover(most):
    v, cover = suffixes.difference_cover(most)
    assert v <= most and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeats_of_nothing(spark):
    assert suffixes.remove_repeats(docs(spark, []).limit(0)).count() == 0


# 2: decontamination


def test_leaks_and_clean_documents(spark):
    rnd, words = random.Random(3), vocabulary(3, 3000)
    items = [(k, prose(rnd, words, 20 + 3 * k)) for k in range(8)]
    texts = [(i, prose(rnd, words, rnd.randint(1, 300))) for i in range(60)]
    changed = items[5][1].split()
    changed[4], changed[15] = "other", "word"
    texts += [(100, prose(rnd, words, 90) + " " + items[2][1] + " " + prose(rnd, words, 90)), (101, items[3][1].upper()), (102, prose(rnd, words, 33) + " " + " ".join(changed)), (103, None), (104, ""), (105, items[2][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    for block in (16_000, 90):
        out = decontaminate.flag(docs(spark, texts), bench, block_words=block)
        assert {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks} == {(100, 2), (101, 3), (102, 5), (105, 2)}
        assert out.count() == len(texts) and "source" in out.columns


def test_leaks_of_thousands_of_items(spark):
    rnd, words = random.Random(12), vocabulary(12, 4000)
    items = [(k, prose(rnd, words, rnd.randint(15, 40))) for k in range(2500)]
    texts, want = [], set()
    for i in range(240):  # short items in windows full of other items' words, a third of them with changed, lost and added words
        k = i * 10
        said = items[k][1].split()
        if i % 3 == 0:
            said[2], said[len(said) // 2] = "other", "word"
            del said[5]
            said.insert(8, "more")
        texts.append((i, prose(rnd, words, rnd.randint(30, 120)) + " " + " ".join(said) + " " + prose(rnd, words, rnd.randint(30, 120))))
        want.add((i, k))
    texts += [(1000 + i, prose(rnd, words, 150)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.flag(docs(spark, texts), bench)
    assert {(r.doc_id, x.item_id) for r in out.collect() for x in r.leaks} == want


def test_short_items_in_texts_of_any_length(spark):
    texts = [(1, "yes" + " " * 600), (2, ("-" * 900) + "Yes!"), (3, "yes " * 300), (4, "ye" + "s" * 900), (5, "\n\t yes \n" + "." * 2000), (6, "say" + " " * 700 + "yes"), (7, " " * 900)]
    out = decontaminate.flag(docs(spark, texts), spark.createDataFrame([(1, "Yes"), (2, "say yes")], "item_id long, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in out for x in r.leaks} == {(1, 1), (2, 1), (5, 1), (6, 2)} and len(out) == len(texts)


def test_short_and_repeating_items(spark):
    items = [(1, "Yes"), (2, "no no no no no"), (3, "alpha beta"), (4, "alpha beta"), (5, ""), (6, None)]
    texts = [(1, "yes."), (2, "well no no no no no indeed it is"), (3, "Alpha, beta!"), (4, "alpha beta gamma"), (5, "say yes to it"), (6, ""), (7, None), (8, "no")]
    out = decontaminate.flag(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in out for x in r.leaks} == {(1, 1), (2, 2), (3, 3), (3, 4)} and len(out) == len(texts)
    none = decontaminate.flag(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(texts) and not any(r.leaks for r in none)


def brute_leaks(texts, items, lcs=0.7, answer=0.5):
    """Every stretch of every text against every item."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for k, item in items:
        w = words(item)
        masks, tail = decontaminate._masks(w), w[-max(1, len(w) // 4) :]
        ends = decontaminate._masks(tail)
        for i, t in texts:
            said = words(t)
            if sum(x in set(said) for x in w) < lcs * len(w):
                continue
            for b in range(max(1, len(said) - len(w) + 1)):
                part = said[b : b + len(w) + len(w) // 2]
                if decontaminate.lcs_length(masks, len(w), part) >= lcs * len(w) and decontaminate.lcs_length(ends, len(tail), part) >= answer * len(tail):
                    out.add((i, k))
                    break
    return out


def test_leaks_against_all_pairs(spark):
    rnd, words = random.Random(40), vocabulary(40, 2500)
    items = [(k, prose(rnd, words, rnd.randint(12, 45))) for k in range(60)]
    texts = [(i, prose(rnd, words, rnd.randint(1, 250))) for i in range(40)]
    for k, item in items:  # copies, changed words, omissions, additions, a moved answer
        said = item.split()
        kind = k % 5
        for _ in range(len(said) // 6):
            at = rnd.randrange(len(said))
            if kind == 1:
                said[at] = rnd.choice(words)
            elif kind == 2:
                del said[at]
            elif kind == 3:
                said.insert(at, rnd.choice(words))
        if kind == 4:
            said = said[-len(said) // 6 :] + said[: -len(said) // 6]
        texts.append((1000 + k, f"{prose(rnd, words, rnd.randint(0, 150))} {' '.join(said)} {prose(rnd, words, rnd.randint(0, 150))}"))
    want = brute_leaks(texts, items)
    got = {(r.doc_id, x.item_id) for r in decontaminate.flag(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect() for x in r.leaks}
    assert got <= want and len(got) >= 0.95 * len(want) > 40
    for kind in range(4):
        assert sum(i >= 1000 and i % 5 == kind for i, _ in got) >= 11


def test_common_subsequences():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 30))], [rnd.randint(0, 5) for _ in range(rnd.randint(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert decontaminate.lcs_length(decontaminate._masks(a), len(a), b) == row[-1]


# 3: quality


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark):
    rnd, words = random.Random(4), vocabulary(4)
    texts = [(i, ". ".join(prose(rnd, words, 12) for _ in range(5)) + ".") for i in range(80)]
    texts += [(200 + i, prose(rnd, words, 60).upper().replace(" ", "!! ")) for i in range(8)] + [(300 + i, prose(rnd, words, 60).replace(" ", "### ")) for i in range(8)]
    texts += [(400, "a b c d e f a b c d e f g\na b c d e\n\n \na b c d e"), (401, None), (402, ""), (403, "é ü x"), (404, "w " * 3000), (0, texts[0][1])]
    out = quality.score(docs(spark, texts)).collect()
    for r in out:
        t = dict(texts)[r.doc_id] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), r.doc_id
    kept = {r.doc_id for r in out if r.kept}
    assert set(range(80)) - kept == set()
    assert not kept & {*range(200, 208), 401, 402, 404}
    assert quality.score(docs(spark, []).limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    rated = quality.score(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in rated.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.95 and share[0] < 0.2


# 4: archives


def test_archives_round_trip(spark, tmp_path):
    same = "<p>WARC/1.1\r\nhttp://x 1.2.3.4 20000101000000 text/html 5\n\r\n\r\né</p>"
    rows = [(1, "http://a/b c?x=1", same), (2, None, None), (3, "http://c/", ""), (9, "http://d/", same), (5, "http://e/", "other"), (9, "http://d/", same), (None, "http://f/", "unnumbered")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = archives.convert(pages).collect()
    assert len(out) == len(rows) and all(r.intact for r in out)
    b32 = {r[0]: archives.sha1_base32((r[2] or "").encode()) for r in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in out} == {(r[0], len((r[2] or "").encode()), b32[r[0]]) for r in rows}
    assert {(r.page_id, r.record_type, r.refers_to) for r in out} == {(1, "revisit", 9), (9, "response", None), (2, "revisit", 3), (3, "response", None), (5, "response", None), (None, "response", None)}
    none = archives.convert(pages, least=1).where("payload_bytes = 0").collect()
    assert {(r.page_id, r.record_type) for r in none} == {(2, "response"), (3, "response")}
    for version in (1, 2):
        archives.write_arc(pages, f"{tmp_path}/arc{version}", version)
        read = archives.read_arc(spark, f"{tmp_path}/arc{version}").collect()
        assert collections.Counter((r.page_id, bytes(r.payload)) for r in read) == collections.Counter((r[0], (r[2] or "").encode()) for r in rows)
        assert all(re.fullmatch(r"\d{14}", r.stamp) for r in read)


def test_archives_are_members(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "same" if k % 3 else f"own {k}") for k in range(30)], "page_id long, url string, html string")
    archives.write_arc(pages.coalesce(1), f"{tmp_path}/arc", 2)
    content = next(Path(f"{tmp_path}/arc").glob("part-*")).read_bytes()
    held = list(archives.members(content))
    assert len(held) == 31 and b"".join(held) == gzip.decompress(content)
    for fields, block in archives.arc_records(held):  # a reader that seeks finds each record at its offset
        at = int(fields["Offset"])
        assert next(archives.members(content[at:])).endswith(block + b"\n")
    assert len(list(archives.arc_records([gzip.decompress(content)]))) == 30  # gzipped whole
    monkeypatch.setattr(archives, "BROADCAST_ROWS", -1)
    out = archives.convert(pages).collect()
    assert {(r.page_id, r.refers_to) for r in out} == {(k, 29 if k % 3 and k != 29 else None) for k in range(30)}


def test_damaged_archives(spark, tmp_path):
    """Whole files and files of members, of both versions, with a damaged header, a lost date, a block cut short and no version block."""
    trap = "http://x/ 1.2.3.4 20000101000000 text/html 1\nZ\n"
    pages = spark.createDataFrame([(k, f"http://a/{k}", trap if k == 3 else f"page {k}") for k in range(8)], "page_id long, url string, html string")
    for version in (1, 2):
        archives.write_arc(pages.coalesce(1), f"{tmp_path}/arc{version}", version)
        held = list(archives.members(next(Path(f"{tmp_path}/arc{version}").glob("part-*")).read_bytes()))
        places = {int(f["URL"].rsplit("/", 1)[1]): n for n, p in enumerate(held) for f, _ in archives.arc_records([p])}
        harm = {
            3: lambda p: p.replace(b" text/html", b"", 1), 5: lambda p: re.sub(rb" [0-9]+\n", b" many\n", p, count=1),
            6: lambda p: re.sub(rb" ([0-9]+)\n", rb" 99999\1\n", p, count=1), 7: lambda p: re.sub(rb" [0-9]{14} ", b" - ", p, count=1),
        }
        broken = [*held]
        for k, make in harm.items():
            broken[places[k]] = make(held[places[k]])
            assert broken[places[k]] != held[places[k]]
        read = lambda pieces, lost: [int(f["URL"].rsplit("/", 1)[1]) for f, _ in archives.arc_records(pieces, lost)]
        lost = [0]
        assert sorted(read(broken, lost)) == [0, 1, 2, 4] and lost == [4]
        lost = [0]  # by lines: a payload that looks like a record is one to a reader that has lost its way, so it is not in this file
        assert sorted(read([b"".join(p for n, p in enumerate(broken) if n != places[3])], lost)) == [0, 1, 2, 4] and lost[0] in (1, 2, 3)
        assert sorted(read([held[0].replace(b"Archive-length", b"?"), *held[1:]], None)) == list(range(8))  # either version is tried
        assert sorted(read(held[1:], None)) == list(range(8))
        folder = tmp_path / f"broken{version}"
        folder.mkdir()
        (folder / "a.arc.gz").write_bytes(b"".join(map(archives.member, broken)))
        assert sorted(r.page_id for r in archives.read_arc(spark, str(folder)).collect()) == [0, 1, 2, 4]
        assert [r.n_lost for r in archives.arc_damage(spark, str(folder)).collect()] == [4]


def test_archives_of_nothing(spark):
    assert archives.convert(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 5: packing


def test_packing(spark):
    from tokenizers import Tokenizer

    rnd, words = random.Random(5), vocabulary(5)
    texts = [(i, prose(rnd, words, rnd.randint(0, 900))) for i in range(60)] + [(70, None), (71, ""), (3, "again"), (None, "no id"), (72, "<|endoftext|> é ß " * 700)]
    out = packing.pack_documents(docs(spark, texts)).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())  # called as the contract calls it
    want = collections.Counter()
    for i, t in texts:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k in range(-(-len(ids) // 1024)):
            n = 1024 if k else len(ids) % 1024 or 1024
            want[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(bins) <= -(-sum(r.length for r in out) // 1024) * 1.05 + 1
    assert packing.pack_documents(docs(spark, []).limit(0)).count() == 0


def test_packing_in_many_groups(spark):
    """Rounds go on until one group is left, whatever the size of a group: forty here."""
    rnd = random.Random(25)
    rows = [(k, 0, 0, rnd.randint(200, 700), 0, k) for k in range(1200)]
    cut = common.stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, row long"), "pieces")
    made = [packing.pack(cut, 1024, group_rows=n).select("sequence_id").distinct().count() for n in (40_000, 30)]
    bound = packing.fewest(np.asarray([r[3] for r in rows]), 1024)
    assert bound <= made[0] <= bound * 1.01 and made[1] <= bound * 1.04


def test_special_tokens_of_the_two_encoders(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>é", "<|endoftext", "plain"):
        assert list(packing.encoder(packing.default_tokenizer())(text)) == tok.encode(text, add_special_tokens=False).ids
    assert 50256 in packing.encoder(packing.default_tokenizer())("x <|endoftext|> y")


def test_packing_when_the_last_read_is_parted_anew(spark):
    rnd, words = random.Random(15), vocabulary(15)
    texts = [(i, prose(rnd, words, rnd.randint(0, 400))) for i in range(300)]
    out = packing.pack_documents(docs(spark, texts).repartition(4))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")  # as when the number of cores has changed since the first round
    try:
        rows = out.collect()
    finally:
        spark.conf.set(key, before)
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(range(300))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0, *(offset + n for offset, n in sorted(held))]
        assert [offset for offset, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024


def test_local_search_empties_bins():
    lengths = np.asarray([6, 6, 4, 4, 5, 5])
    bins = packing.local_search([[0, 2], [1, 3], [4], [5]], lengths, 10)
    assert len(bins) == 3 and sorted(sum(bins, [])) == list(range(6))
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(1, 1025, 2000)
    bins = packing.local_search(packing.best_fit(lengths, 1024), lengths, 1024)
    assert sorted(sum(bins, [])) == list(range(2000)) and max(lengths[b].sum() for b in bins) <= 1024
    assert len(bins) <= -(-lengths.sum() // 1024) * 1.01 + 1


def test_local_search_beats_best_fit():
    rnd = np.random.default_rng(2)
    for low, high, n in ((330, 350, 600), (200, 360, 900)):
        lengths = rnd.integers(low, high, n)
        before = packing.best_fit(lengths, 1024)
        after = packing.local_search(before, lengths, 1024)
        assert packing.fewest(lengths, 1024) <= len(after) < len(before)
        assert sorted(sum(after, [])) == list(range(n)) and max(lengths[b].sum() for b in after) <= 1024


def test_fewest_is_a_bound():
    rnd = random.Random(3)
    for _ in range(200):
        size = rnd.randint(6, 20)
        bins = [[size]] if rnd.random() < 0.2 else []
        for _ in range(rnd.randint(1, 6)):  # a packing that is known
            cuts = sorted(rnd.sample(range(1, size), rnd.randint(0, 3)))
            bins.append([b - a for a, b in zip([0, *cuts], [*cuts, size])][: rnd.randint(1, 4)])
        assert packing.fewest(np.asarray(sum(bins, [])), size) <= len(bins)
    assert packing.fewest(np.full(50, 600), 1024) == 50


# 6: languages


def test_languages(spark):
    rnd = random.Random(6)
    own = {lang: vocabulary(seed, 200) for lang, seed in (("aa", 11), ("bb", 12), ("cc", 13))}
    rows = [(i, prose(rnd, own[lang], 60), lang) for i, lang in enumerate(list(own) * 40)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, prose(rnd, own["aa"], 50) + " " + prose(rnd, own["bb"], 20), None), (1004, "Ж", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows[:120]:
        assert out[i].lang_pred == lang and out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [out[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert out[1003].lang_pred == "aa" and set(out[1003].languages) == {"aa", "bb"} and 0.5 < out[1003].score < 0.9
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing.count() == 0


def plain_mixture(logs, weights, rounds=8, penalty=12.0):
    """The same EM and elimination, word by word."""
    k = len(logs[0])

    def em(use):
        p = [u / sum(use) for u in use]
        like = [[2.718281828459045 ** (x - max(row)) for x in row] for row in logs]
        for _ in range(rounds if sum(use) > 1 else 0):
            new = [0.0] * k
            for row, w in zip(like, weights):
                total = sum(a * b for a, b in zip(row, p))
                for j in range(k):
                    new[j] += w * p[j] * row[j] / total
            p = [x / sum(new) for x in new]
        return p, sum(w * np.log(sum(a * b for a, b in zip(row, p))) for row, w in zip(like, weights))

    use = [1.0] * k
    p, best = em(use)
    fewer = [float(x >= 0.02) for x in p]
    if 0 < sum(fewer) < k:
        q, fit = em(fewer)
        if best - fit <= penalty:
            use, p, best = fewer, q, fit
    while sum(use) > 1:
        low = min((j for j in range(k) if use[j]), key=lambda j: p[j])
        fewer = [0.0 if j == low else u for j, u in enumerate(use)]
        q, fit = em(fewer)
        if best - fit > penalty:
            break
        use, p, best = fewer, q, fit
    return p


def test_mixtures_by_hand():
    rnd = np.random.default_rng(6)
    for n in (1, 3, 20, 60):
        logs = -rnd.random((n, 4)) * 20
        logs[: n // 2, 1] += 8
        weights = rnd.random(n) + 0.5
        assert np.allclose(langid.mixture(logs, weights), plain_mixture(logs.tolist(), weights.tolist()), atol=1e-6)
    tied = np.tile(np.asarray([[-1.0, -1.0, -5.0]]), (9, 1))  # the first of equals goes first
    assert np.allclose(langid.mixture(tied, np.ones(9)), [0, 1, 0])


def test_very_long_texts(spark):
    rnd, words = random.Random(50), vocabulary(50, 900)
    long = prose(rnd, words, 150_000)
    rows = [(1, long), (2, long + " end"), (3, prose(rnd, words, 20)), (4, "x" * 400_000)]
    removed = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(docs(spark, rows)).collect()}
    assert removed == {1: len(long), 2: len(long), 3: 0, 4: 400_000}
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    item = " ".join(long.split()[100_000:100_030])
    found = decontaminate.flag(docs(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found if r.leaks} == {1, 2}
    table = spark.createDataFrame([(i, t, "aa" if i < 4 else "bb") for i, t in rows * 3], "doc_id long, text string, lang string")
    assert langid.identify(table).where("lang_pred <> 'und'").count() == 12
    pages = spark.createDataFrame([(i, "http://a/", f"<nav>n</nav><article><p>{t}</p></article>") for i, t in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in sitetree.extract(pages).collect()} == dict(rows)
    chats = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(chats)).first().loss_chars == len(long)


def test_columns_of_clashing_names(spark):
    extra = ["lang_pred", "score", "languages", "_text", "key", "bin", "host", "cut", "window", "at", "part", "payload", "original", "salt", "node", "centre", "w"]
    widen = lambda df: df.withColumns({c: F.lit("clash") for c in extra if c not in df.columns})
    rows = [(i, f"some words of text {i} here", "aa") for i in range(8)]
    table = widen(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.identify(table).count() == minhash.near_duplicates(table).count() == quality.score(table).count() == suffixes.remove_repeats(table).count() == 8
    pages = widen(spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://a/2", None)], "page_id long, url string, html string"))
    assert sitetree.extract(pages).columns == ["page_id", "url", "text", "n_chars"] and archives.convert(pages).count() == 2
    chats = widen(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string"))
    assert chat.digests(chat.windows(chats)).first().n_turns == 2


# 7: near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rnd, vocab = random.Random(7 + words), vocabulary(7)
    texts = []
    for g in range(6):
        base = prose(rnd, vocab, 80).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, 7)):
                copy[rnd.randrange(80)] = rnd.choice(vocab)
            texts.append((len(texts) + 10, " ".join(copy)))
    texts += [(500 + k, prose(rnd, vocab, rnd.randint(1, 9))) for k in range(25)]
    texts += [(1, texts[0][1].upper()), (2, "one"), (3, "ONE"), (4, ""), (5, None), (6, " \n"), (7, "a a a a a a"), (8, "a a a a a a a a a")]
    out = minhash.near_duplicates(docs(spark, texts), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(texts, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_in_blocks(spark):
    rnd, vocab = random.Random(17), vocabulary(17, 2000)
    base = prose(rnd, vocab, 60).split()
    texts = []
    for k in range(150):  # one star, most of it too far from its centre
        copy = list(base)
        for _ in range(rnd.randint(2, 7)):
            copy[rnd.randrange(60)] = rnd.choice(vocab)
        texts.append((k, " ".join(copy)))
    texts += [(1000, prose(rnd, vocab, 9000)), (1001, None)]
    texts.append((1002, texts[150][1] + " tail"))
    out = minhash.near_duplicates(docs(spark, texts), words=2, block=12_000).collect()
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len({c for _, c in want.values()}) > 5


def test_rows_of_one_document_are_one_node(spark):
    rnd, vocab = random.Random(18), vocabulary(18)
    a, b, c = (prose(rnd, vocab, 30) for _ in range(3))
    out = minhash.near_duplicates(docs(spark, [(5, a), (5, b), (3, a), (9, b), (7, c), (7, ""), (8, c + " more")]), words=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(3, 29, 3), (5, 29, 3), (5, 29, 3), (7, 0, 7), (7, 29, 7), (8, 30, 7), (9, 29, 3)]


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0
    out = minhash.near_duplicates(docs(spark, [(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, None)]), words=2).collect()
    assert sorted(((r.doc_id or 0, r.component_id, r.kept) for r in out), key=str) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 130)] + [(5, 200), (200, 7), (300, 301)]
    out = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {out[k] for k in range(100, 131)} == {100} and out[7] == out[200] == 5 and out[301] == 300


# 8: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            right = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if right:
                out.append((list(PATTERNS).index(kind), m.start(), m.end()))
    return out


def test_personal_data(spark):
    rnd = random.Random(8)
    pieces = ["a.b+c@x-y.example.com", "a@b.c_d@e.f", "@x.y", "a@b", "a@b..c", "1.2.3.4", "01.002.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4387513035237269", "4387 5130 3523 7269", "4387-5130-3523-7260", "+1 (988) 555-2485", "+12", "++44 20 7946 0958.", "1  2", "- 3", "é", "😀", "word", "\n", "+4 (", "99999999999999999999"]
    texts = [(i, rnd.choice(["", " ", "x"]).join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))) for i in range(200)] + [(900, None), (901, ""), (0, "1.2.3.4"), (902, "1" * 5000 + " " + "a" * 5000 + " 1.2.3.4" + " 1-" * 2000)]
    out = pii.find(docs(spark, texts))
    assert {"source", "row"} <= set(out.columns)
    have = collections.Counter((r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.base)) for r in out.collect())
    assert have == collections.Counter((i, tuple(brute_spans(t or ""))) for i, t in texts)
    assert pii.find(docs(spark, []).limit(0)).count() == 0


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "000.1.1.1", "192.168.0.1", "1.2.3.0", "0.1.2.3", "0255.000.00.1", "0256.0.0.1", "0.0.0.300", "1000.0.0.0", "0.0.0"]
    out = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.base] for r in pii.find(docs(spark, [(i, f"at {t} now") for i, t in enumerate(texts)])).collect()}
    assert out == {i: brute_spans(f"at {t} now") for i, t in enumerate(texts)}
    assert [len(out[i]) for i in range(len(texts))] == [1] * 7 + [0] * 4
    assert pii.redact(docs(spark, [(1, "host 10.0.0.1 up")])).first().text == "host [IP] up"


def test_added_spans(spark):
    rnd, words = random.Random(21), vocabulary(21)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    texts, want = [], {}
    for i in range(240):
        said, found = prose(rnd, words, 30), None
        if i % 3 == 0:
            found = [("token", key(40)), ("spelled", f"{words[i % 300]}x at site{i} dot org"), ("account", "DE89 3704 0044 0532 0130 00"), ("ipv6", f"2001:db8:0:0:{i + 1:x}:ff00:42:8329"), ("number", f"{rnd.randint(100, 799)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}")][i // 3 % 5]
            name = {"token": 'token = "', "spelled": "contact: ", "account": "iban: ", "ipv6": "ip: ", "number": "ssn: "}[found[0]]
            said += f" {name}{found[1]}" + ('"' if found[0] == "token" else "") + " " + prose(rnd, words, 5)
        elif i % 3 == 1:  # what only looks like it
            said += " " + rnd.choice(["bigverylongwordwithoutanydigit", "version 1234567", "look at that dot here", "DE00 1234 5678 9012 3456 78", "12:30:45", "1-2-3-4-5-6-7", "step12ofaverylongname"])
        texts.append((i, said))
        want[i] = [] if found is None else [(found[0], said.index(found[1]), said.index(found[1]) + len(found[1]))]
    out = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.added] for r in pii.find(docs(spark, texts)).collect()}
    stored = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.added] for r in pii.find_spans(docs(spark, texts)).collect()}
    assert out == want == stored
    secret = texts[0][1][want[0][0][1] : want[0][0][2]]
    assert secret not in pii.redact(docs(spark, texts)).where("doc_id = 0").first().text


def test_account_checksum(spark):
    table = spark.createDataFrame([("DE89370400440532013000",), ("GB82WEST12345698765432",), ("DE88370400440532013000",)], "a string")
    assert [r.ok for r in table.select(pii.mod97(F.col("a")).alias("ok")).collect()] == [True, True, False]


def test_redaction(spark):
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, [(1, "mail a@b.co or +1 (988) 555-2485 now"), (2, "nothing"), (3, None)])).collect()}
    assert out == {1: "mail [EMAIL] or [PHONE] now", 2: "nothing", 3: ""}


# 9: chats


def test_chats(spark):
    rnd, words = random.Random(9), [*vocabulary(9), "\\", "\\\\", "###", "</turn>", "\\h", "\\t", "### user: ", "</turn>\n", "####", ":"]
    rows = []
    for c in range(12):
        for k in range(rnd.randint(1, 40)):
            role = "system" if k == 0 and c % 2 else ["user", "assistant"][k % 2]
            rows.append((c, k, role, prose(rnd, words, rnd.randint(0, 60))))
    rows += [(50, None, None, None), (50, 1, "assistant", None), (51, 0, "a: b", "x"), (None, 0, "user", "no id"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(table, budget=120, history=40)
    out = {r.conv_id: r for r in chat.digests(formatted).collect()}
    groups = collections.defaultdict(list)
    for c, k, role, text in rows:
        groups[c].append((-1 if k is None else k, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # segments of a few turns give the same turns and the same targets
    short = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in chat.digests(chat.windows(table, budget=120, history=40, segment=7)).collect()}
    assert short == {c: (r.n_turns, r.turns_sha256, r.loss_sha256) for c, r in out.items()}
    split = formatted.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    assert split > 3
    # the system turn leads every window of its conversation
    assert formatted.where("conv_id = 1 AND NOT startswith(formatted, '### system: ')").count() == 0
    assert chat.digests(chat.windows(table.limit(0))).count() == 0


def test_a_very_long_conversation(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"w{k} two") for k in range(6000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.digests(chat.windows(table, budget=200, history=40)).first()
    assert out.n_turns == 6000 and out.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert out.loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()


# 10: pages


def test_pages(spark):
    def page(k, body):
        return (k, f"https://site.example/{k}", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>")

    rows = [page(k, f"<nav><a href=/>Home</a></nav><div class='q{k % 2}x'><div>All rights kept here</div></div><div class=ad>Buy</div><article><h1>Title {k}</h1><p>One &amp; <b>two</b>\n three {k}<br>four<p>quoted by all</p><aside>side</aside><div class='comments'><p>reader</p></div></article><footer>&copy; x</footer>") for k in range(20)]
    rows += [(50, None, "<p>a<!-- x --><p>b &lt;c&gt; &eacute;<div>d</div> tail < 5 <b"), (51, "nohost", None), (52, "https://site.example/52", ""), (53, "https://other/", "<div class='body'>plain <i>text</i></div><ul><li>x<li>y</ul><form>f</form>")]
    out = {r.page_id: r for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(20):
        assert out[k].text == f"Title {k}\n\nOne & two three {k} four\n\nquoted by all"
    assert out[50].text == "a\n\nb <c> é\n\nd\n\ntail < 5" and out[51].text == "" and out[52].text == ""
    assert out[53].text == "plain text\n\nx\n\ny" and all(r.n_chars == len(r.text) for r in out.values())


def test_style_trees_cut_what_a_host_repeats(spark):
    rows = [(k, f"http://h/{k}", f"<div class=box><div>The same words on every page</div></div><div class=story><p>Story number {k} {hashlib.md5(str(k).encode()).hexdigest()}</p></div>") for k in range(30)]
    out = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("same words" not in r.text and r.text.startswith("Story number") for r in out)


def site(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, cut string")


def test_pages_that_names_alone_would_get_wrong(spark):
    rnd, words = random.Random(30), vocabulary(30)
    rows, want = [], {}
    for k in range(12):
        story = [prose(rnd, words, 25) for _ in range(rnd.randint(2, 6))]
        body = "".join(f"<p>{x}</p>" for x in story)
        work = [prose(rnd, words, 30) for _ in range(rnd.randint(2, 5))]
        # a layout that is named after its sidebar; no article; boxes without telling names that all pages share
        rows.append((k, f"http://a/{k}", f"<div class='content with-sidebar'><h1>T {k}</h1>{body}</div><div class=x1><p>Call us today</p></div>", "h", "c"))
        want[k] = [f"T {k}", *story]
        # the text stands beside a teaser that is an article of its own, and every teaser is the same
        rows.append((100 + k, f"http://b/{k}", f"<article class=t><p>Read our book</p></article><div class=main-text>{body}</div><div class=menu><a href=/>{words[k]}</a></div>", "h", "c"))
        want[100 + k] = story
        # inside the article: a part that is only named like noise, and a part that is noise
        rows.append((200 + k, f"http://c/{k}", f"<article><h1>U {k}</h1>{body}<div class=related-work>{''.join(f'<p>{x}</p>' for x in work)}</div><div class=share><a>Send</a> <a>Print</a></div></article>", "h", "c"))
        want[200 + k] = [f"U {k}", *story, *work]
    rows.append((300, "http://alone/", "<nav><a>Home</a></nav><article><p>only page here</p></article><footer>f</footer>", "h", "c"))
    want[300] = ["only page here"]
    out = {r.page_id: r.text for r in sitetree.extract(site(spark, rows)).collect()}
    assert out == {k: "\n\n".join(x) for k, x in want.items()}
    assert sitetree.extract(site(spark, []).limit(0)).count() == 0


def test_importances_by_hand(spark):
    rnd = random.Random(31)
    rows = [(k, f"http://h{k % 3}/", "".join(f"<div class={c}>{''.join(rnd.choice(['<p>', '<ul><li>']) + rnd.choice('ab') for _ in range(rnd.randint(1, 3)))}</div>" for c in ("one", "ad", "nav-x")) + "<article>z</article>" * (k % 2)) for k in range(17)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    have = {(r.host, r.node): r for r in sitetree.importances(pages).collect()}
    seen, m = collections.defaultdict(list), collections.Counter()
    for _, url, html in rows:
        host, nodes = url[7:-1], []
        m[host] += 1
        sitetree.walk(html, nodes=nodes)
        whole = len(nodes.pop()[2])
        has = any(x[4] for x in nodes)
        per = collections.defaultdict(float)
        for path, kids, text, weight, main in nodes:
            per[path, kids, text, weight, has and not main] += len(text) / whole
        for (path, kids, text, weight, beside), mass in per.items():
            seen[host, sitetree._digest(path)].append((text, kids, mass, beside, weight))
    assert set(have) == set(seen)
    w = sitetree.WEIGHTS
    for (host, node), cells in seen.items():
        n, t = collections.Counter(c[0] for c in cells), len(cells)
        content = sum(max(0, 1 - np.log(n[c[0]]) / np.log(m[host] + sitetree.FEW)) for c in cells) / t
        entropy = -sum(x / t * np.log(x / t) for x in collections.Counter(c[1] for c in cells).values())
        shape = (entropy + 0.5) / (np.log(t) + 1)
        z = w["content"] * (content - 0.5) + w["presentation"] * (shape - 0.5) + w["mass"] * (min(1, sum(c[2] for c in cells) / t) - 0.25) + w["beside"] * sum(c[3] for c in cells) / t + cells[0][4]
        assert abs(have[host, node].importance - 1 / (1 + np.exp(-z))) < 1e-9
