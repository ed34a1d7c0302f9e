"""SimHash and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from dwellspark.llm import queries as Q
from dwellspark.llm.components import connected_components
from dwellspark.llm.simhash import near, near_copies, near_links, simhash_components
from dwellspark.llm.substring import FMIndex, drop_repeats


def classes(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def test_near_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]))
    want = classes(range(len(x)), lambda a, b: int(x[a] ^ x[b]).bit_count() <= 3)
    got = near(x, 3, 16).tolist()
    first = {}
    assert all(first.setdefault(g, want[i]) == want[i] for i, g in enumerate(got)) and len(set(got)) == len(set(want.values()))


def test_hot_bucket_is_dealt_by_tile_pairs(spark):
    rng = np.random.default_rng(2)
    fps = sorted({int(v) << 20 | 5 for v in rng.integers(0, 64, 300)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    for most in (8, 1000):
        got = {r.node: r.component for r in connected_components(near_links(df, 3, 4, most)).collect()}
        want = classes(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
        assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(7, 7), (None, 3)], "a long, b long")
    assert {r.component for r in connected_components(df).collect()} == {0}


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {}
    for d in docs:
        w = d.text.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fp[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_simhash_edges(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "a b", 3), (5, "A B", 4), (4, "x " * 5000, 5), (4, "x " * 5000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in simhash_components(df).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (4, 4), (4, 4), (5, 2)]
    assert simhash_components(df.limit(0)).count() == 0


def brute_repeats(docs, window=20):
    seen, out = set(), {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_substring_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op3_substring_dedup(spark, sf).collect()}
    assert got == brute_repeats(docs)


def test_substring_edges(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))) for i in range(60)}
    docs |= {60: None, 61: "", 62: "a " * 300, 63: "a b " * 100, 64: docs[3], 65: docs[3], 66: docs[4] + "\n" + docs[5], 67: "é x " * 30}
    df = spark.createDataFrame([(i, t, "z") for i, t in docs.items()], "doc_id long, text string, words string")
    want = {i: x[:2] for i, x in brute_repeats(docs).items()}
    for hot in (20_000, 3):
        monkeypatch.setattr("dwellspark.llm.substring.HOT_PLACES", hot)
        assert {r.doc_id: (r.n_words, r.n_removed) for r in drop_repeats(df).collect()} == want
    assert drop_repeats(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 5, 400)
    index = FMIndex(np.r_[text, 0], 6)
    query = rng.integers(1, 5, 200)
    ends = np.arange(1, 201)
    for least in (1, 2):
        length, lo, hi = index.matching(query, ends, 6, least)
        for e, n, size in zip(ends.tolist(), length.tolist(), (hi - lo).tolist()):
            counts = [sum(text[i : i + k].tolist() == query[e - k : e].tolist() for i in range(401 - k)) for k in range(min(e, 6) + 1)]
            want = max(k for k, c in enumerate(counts) if c >= least)
            assert n == want and (not n or size == counts[n])


def test_substring_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(1000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a, 5), (1, a, 6), (1, b, 7), (2, b + " end", 8), (None, a, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in drop_repeats(df).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 61, 60)]


def test_substring_long_text(spark):
    rng = random.Random(7)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long[: len(long) // 2])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in drop_repeats(df).collect()}
    assert got[1] == 0 and abs(got[2] - len(long[: len(long) // 2].split())) <= 1


def test_near_copies_by_similarity(spark):
    """Copies with replaced words, by similarity of their five-word shingles."""
    rng = random.Random(8)
    grams = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    rows, want = [], []
    for k in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 500))]
        edits = max(1, round(len(words) * (0.005, 0.01, 0.015, 0.02, 0.035)[k % 5]))
        other = list(words)
        for j in rng.sample(range(len(words)), edits):
            other[j] = "new"
        a, b = grams(words), grams(other)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other).upper())]
        want.append(len(a & b) / len(a | b))
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "one two"), (10**6 + 3, "one two"), (10**6 + 4, "x " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert len(got) == len(rows) and all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(300))
    for low, high, share in ((0.95, 1.1, 1.0), (0.9, 0.95, 0.98), (0.85, 0.9, 0.95), (0.8, 0.85, 0.9)):
        found = [got[2 * k + 1] == 2 * k for k in range(300) if low <= want[k] < high]
        assert sum(found) >= share * len(found) and len(found) > 15
    apart = [got[2 * k + 1] == 2 * k for k in range(300) if want[k] < 0.72]
    assert sum(apart) <= 0.1 * len(apart) and len(apart) > 15
    assert [got[10**6 + j] - 10**6 for j in range(5)] == [0, 0, 2, 2, 4] and near_copies(df.limit(0)).count() == 0
