"""Periodic runs against comparing every word with every earlier one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dwellspark.llm import runs as R
from dwellspark.llm.queries import op13_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def both(texts):
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = R.find_runs(np.array([c for t in texts for c in t], np.int64), first)
    return got.tolist(), [[s + f, e + f, q] for t, f in zip(texts, first.tolist()) for s, e, q in brute(t)]


def made(rng):
    k, n, t = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([5, 30, 100, 300, 700]), []
    while len(t) < n:
        kind = rng.random()
        if kind < 0.3:
            t += [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        elif kind < 0.7:
            unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 7, 15, 31, 32, 33, 40, 70, 100, 130]))]
            t += unit * rng.choice([1, 2, 2, 2, 3, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
        elif t:
            t += t[rng.randrange(len(t)) :] * rng.choice([1, 1, 2])
    return t[:900]


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(15):
        got, want = both([made(rng) for _ in range(rng.randrange(5))])
        assert got == want


def test_periods_across_touching_runs():
    for k in range(5, 200, 13):
        unit = [0, 1] * k + [0]
        got, want = both([unit * 2, unit * 2 + [7] + unit, ([0] * k + [1]) * 5, ([0] * k + [1] + [0] * (k // 2)) * 3])
        assert got == want


def test_words_that_defeat_polynomial_hashes():
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    got, want = both([t[:2500], t[700:2300] * 2])
    assert got == want


def test_long_and_repetitive_text_ends():
    for unit in ([0], [0, 1, 2], list(range(50_000))):
        t = np.array((unit * (400_000 // len(unit) + 1))[:400_000])
        assert R.find_runs(t, np.array([0, len(t)])).tolist() == [[0, 400_000, len(unit)]]


def expected(doc_id, text):
    ws = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(ws)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in brute(ws)), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(text))


def test_query_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[:8] for r in op13_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert sum(g[1] > 0 for g in got.values()) > 10
    for r in docs:
        if len(r.text or "") < 9000:
            assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_odd_rows(spark):
    many = " ".join(["a b c"] * 20)
    rows = [(1, None, 7), (2, "", 7), (None, many, 7), (None, many, 7), (3, "\x00    \t", 7), (4, "x " * 11, 7), (5, "x\n" * 12, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = {(r.doc_id, r.n_words): r for r in R.periodic_runs(docs).collect()}
    assert (got[1, 0].n_runs, got[1, 0].start, got[1, 0].collapsed) == (0, None, "") and got[2, 0].n_runs == 0
    assert (got[None, 60].length, got[None, 60].period, got[None, 60].exponent_milli, got[None, 60].collapsed) == (60, 3, 20000, "a b c")
    assert got[3, 3].collapsed == "\x00    " and got[4, 11].n_runs == 0 and got[5, 12].collapsed == "x"
    assert R.periodic_runs(docs).where("doc_id IS NULL").count() == 2
    assert R.periodic_runs(docs.limit(0)).count() == 0 and R.with_planted_runs(docs).count() == 7
