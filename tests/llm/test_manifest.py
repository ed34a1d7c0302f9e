"""Merkle manifests against building each tree level by level."""

import hashlib
import random

from pyspark.sql import functions as F

from dwellspark.llm import manifest as M
from dwellspark.llm.queries import op12_manifest


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    paths, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for x, i in enumerate(own):
            r = i - i % 3
            paths[x].append(("".join(level[r:i]), "".join(level[i + 1 : r + 3])))
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        own = [i // 3 for i in own]
    return level[0], paths


def plain(rows):
    groups, subs, out = {}, {}, []
    for g, i, leaf in rows:
        groups.setdefault(g, []).append((i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[g] = tree([leaf for _, leaf in groups[g]])
    root, over = tree([subs[g][0] for g in names])
    for g, above in zip(names, over):
        for (i, leaf), p in zip(groups[g], subs[g][1]):
            out.append((str(g), str(i), leaf, subs[g][0], root, tuple(p + above)))
    return sorted(out)


def built(spark, rows):
    d = M.merkle_manifest(spark.createDataFrame(rows, "grp string, id long, leaf string"))
    return sorted((str(r.grp), str(r.id), r.leaf, r.subroot, r.root, tuple((p.l, p.r) for p in r.path)) for r in d.collect())


def test_ids_that_stand_once(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, "é", "z", ""]), i * 5 - 4000, H(str(i))) for i in range(3000)]
    assert built(spark, rows) == plain(rows)


def test_null_repeated_and_far_ids(spark):
    rng = random.Random(2)
    ids = [None, 5, -7, 1 << 62, -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*ids, rng.randrange(-1 << 63, 1 << 63)]), H(str(rng.randrange(40)))) for _ in range(2500)]
    assert built(spark, rows) == plain(rows)


def test_one_leaf_and_none(spark):
    assert built(spark, [("a", 3, H("x"))]) == [("a", "3", H("x"), H("x"), H("x"), ())]
    assert built(spark, []) == []


def test_wide_groups_and_small_arrays(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "SPAN", 9)
    monkeypatch.setattr(M, "PIECE", 3)
    rows = [(f"g{k}", i, H(f"{k} {i}")) for k in range(30) for i in range(k * 3 + 1)] + [("g1", 0, H("same"))] * 20
    assert built(spark, rows) == plain(rows)


def test_tampered_rows_only_fail(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_manifest(spark, sf).collect()
    import zlib

    changed = {i for i, r in docs.items() if zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (r.text or "")}
    assert len(rows) == len(docs) and {r.doc_id for r in rows if not r.verified} == changed and changed
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r.source, r.doc_id, H("".join(map(part, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))) for r in docs.values()]
    want = {int(w[1]): w for w in plain(leaves)}
    for r in rows:
        w = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (w[2], w[3], w[4], H("".join(a + b for a, b in w[5])))
        assert r.verified == (r.folded_root == r.root)


def test_null_fields_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None), ("", 1)], "text string, n int").select(M.leaf_digest(F.col("n"), F.col("text")).alias("h"))
    assert [r.h for r in df.collect()] == [H("--"), H("1:10:")]
