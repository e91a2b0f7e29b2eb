"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomgrid.llm import periods


def brute_runs(words, least_words=6, least_periods=4):
    n, out = len(words), set()
    for q in range(1, n // least_periods + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(least_words, least_periods * q) and not any(all(words[s + k] == words[s + k + r] for k in range(length - r)) for r in range(1, q)):
                out.add((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    listed = "".join("%d,%d,%d\n" % r for r in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), sha(kept)


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 60))]
        if len(words) > 8 and rnd.random() < 0.6:
            a = rnd.randrange(len(words))
            p = 1 + (len(words) - a) // rnd.randint(3, 10)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        for least in ((6, 4), (2, 2), (4, 3)):  # with two periods at least, every square counts
            assert periods.runs(words, *least) == brute_runs(words, *least)


def test_automaton_holds_all_substrings():
    rnd = random.Random(3)
    words = [rnd.randrange(3) for _ in range(40)]
    link, longest, ends = periods.automaton(words)
    # the states' strings are distinct, and there are as many as substrings
    assert sum(longest[s] - longest[link[s]] for s in range(1, len(link))) == len({tuple(words[a:b]) for a in range(40) for b in range(a + 1, 41)})
    assert [longest[s] for s in ends] == list(range(1, 41))


def test_access_finds_last_colours():
    rnd = random.Random(4)
    parent = [-1] + [rnd.randrange(max(0, v - 4), v) for v in range(1, 80)]
    paths, last = periods.Paths(parent), [-1] * 80
    for i in range(300):
        v = rnd.randrange(80)
        found, up, want = paths.access(v, i), v, []
        while up >= 0:
            if not want or last[up] != want[-1][1] or last[up] == -1:
                want.append((up, last[up]))
            last[up], up = i, parent[up]
        # untouched nodes are paths of their own
        assert found == want


def test_stretches_lose_no_run():
    rnd = random.Random(5)
    for _ in range(200):
        words = [rnd.randrange(4) for _ in range(rnd.randint(1, 200))]
        a = rnd.randrange(len(words))
        words = words[:a] + words[a : a + 3] * rnd.randint(1, 6) + words[a:]
        doc = np.asarray([0] * (len(words) // 2) + [1] * (len(words) - len(words) // 2))
        kept = periods.stretches(np.asarray(words), doc)
        for k in (0, 1):
            at = np.flatnonzero(doc == k)
            for s, length, _ in brute_runs([words[i] for i in at]):
                lo = int(at[0]) + s
                assert any(b <= lo and lo + length <= e for b, e in kept)


def test_documents(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "\U0001f600"]
    texts = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 70)))) for i in range(120)]
    texts += [(i, "\x0b ".join(["a"] * i) + "\n") for i in (3, 5, 6, 7)]
    texts += [(500, "x y  " * 9), (500, "x y  " * 9), (501, " a " * 8), (None, "a b c " * 9), (None, None), (502, None), (503, ""), (504, " \t\r\n"), (505, "a")]
    # planted in any document whose number says so
    hit = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts.append((hit, " ".join(rnd.choice(vocabulary) for _ in range(400))))
    monkeypatch.setattr(periods, "SLICE_BYTES", 300)
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in texts], "doc_id long, text string, runs string, start int").repartition(3)
    rows = periods.periodic_runs(df).collect()
    assert sorted((tuple(r)[:8] for r in rows), key=str) == sorted((brute(i, t) for i, t in texts), key=str)
    for r in rows:
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert periods.periodic_runs(df.limit(0), texts=False).collect() == []


def test_a_very_long_text(spark):
    text = "one two three " * 100_000
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.collapsed) == (1, 0, 300_000, 3, "one two three")
