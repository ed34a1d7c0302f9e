"""Decontamination, licences, WARC audit, pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellspark.llm import decontaminate as D
from dwellspark.llm import queries as Q
from dwellspark.llm import warc
from dwellspark.llm.decontaminate import build_index, contaminated
from dwellspark.llm.licenses import BASE, scan_licenses
from dwellspark.llm.warc import audit, damaged, warc_records


def test_search_equals_every_score():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(400, 0, -1) / 80200))
    items = [(i, text(int(rng.integers(5, 150)))) for i in range(30)]
    docs = [text(200) + " " + items[i % 30][1] + " " + text(100) for i in range(40)] + [text(300) for _ in range(40)]
    index = build_index(items, 0.5)
    h, first = D._tokens(pa.array(docs))
    term = index.look_up(h)
    got = {(r, i): round(s, 6) for r, i, s in sorted(D.search(index, term, first), key=lambda x: x[2])}
    want = {}
    for r in range(len(docs)):
        for at in range(first[r], first[r + 1], D.STRIDE):
            own = np.unique(term[at : min(at + D.PASSAGE, first[r + 1])])
            score = np.zeros(len(index.need))
            for t in own[own >= 0]:
                score[index.item[index.post[t] : index.post[t + 1]]] += index.weight[index.post[t] : index.post[t + 1]]
            for j in np.flatnonzero(score >= index.need * 0.9999):
                k = (r, int(index.owner[j]))
                want[k] = max(want.get(k, 0), round(float(score[j]), 6))
    assert got == want and len(want) >= 40


def test_planted_items_are_found(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in Q.op8_decontaminate(spark, sf).collect()}
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)}
    assert want <= got
    half = {(d, i) for d, i in got if len(set(flat(items[i]).split()) & set(flat(docs[d]).split())) < 0.5 * len(set(flat(items[i]).split()))}
    assert not half


def test_decontamination_edges(spark, monkeypatch):
    long = " ".join(f"long{i}" for i in range(500))
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu xi omicron pi"), (2, None), (3, ""), (4, long)], "item_id long, text string")
    rows = [(1, None, 1), (2, "", 1), (3, "x " * 900 + "Alpha BETA gamma delta epsilon, zeta eta theta. Iota kappa lambda mu nu xi omicron pi" + " y" * 900, 1), (4, "alpha beta", 1), (4, "pre " + long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    for most in (1_000_000, 1):
        monkeypatch.setattr(D, "MOST_WORDS", most)
        assert sorted((r.doc_id, r.item_id) for r in contaminated(df, items).collect()) == [(3, 1), (4, 4)]
    assert contaminated(df.limit(0), items).count() == 0 and contaminated(df, items.limit(0)).count() == 0


def test_short_items_are_found(spark):
    word = lambda n, m: " ".join(f"{m}{j}" for j in range(n))
    items = {n: word(n, f"i{n}x") for n in (1, 2, 4, 9, 10)} | {16: "Who is it. " + word(13, "s"), 19: "Name all four now. " + word(15, "t")}
    docs = {n: word(70, "a") + " " + x.upper() + ", " + word(70, "b") for n, x in items.items()} | {90: word(300, "c"), 91: "i4x0 other i4x1 other i4x2", 92: "who is it " + word(60, "d"), 93: items[1]}
    got = contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(n, n) for n in sorted(items)] + [(93, 1)]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spots, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        spots += at
        labels |= {label} if at else set()
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))


def test_licences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Under the MIT license. CC BY-NC cc by nc Apache License, Version 2.0 " * 400),
            (10**6 + 3, "This work is licensed under the GNU General Public License, version 3."), (10**6 + 4, "gnu general public"), (10**6 + 4, "gnu general public")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("labels", F.lit(1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r.labels for r in got}
    assert found[10**6 + 3] == "gpl-3" and found[10**6 + 4] == ""
    assert scan_licenses(docs.limit(0)).count() == 0


def test_fixity(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(10**5, None, None), (10**5, None, None), (None, "u", "x" * 300_000)], "page_id long, url string, html string")
    left = warc_records(pages.unionByName(extra))
    right = damaged(left)
    a, b = ({} for _ in range(2))
    for out, df in ((a, left), (b, right)):
        for r in df.collect():
            out.setdefault(r.id, []).append(bytes(r.record))
    want = {i for i in {*a, *b} if sorted(a.get(i, [])) != sorted(b.get(i, []))}
    got = audit(left, right).collect()
    assert {r.id for r in got} == want and {r.kind for r in got if r.id in a and r.id in b} <= {"changed"}
    assert audit(left, left).count() == 0
    assert {r.kind for r in audit(left, left.limit(0)).collect()} == {"missing"} and audit(left.limit(0), left.limit(0)).count() == 0


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            before, now = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
            assert now <= before if k > 1 else now < before, name  # the last two may find nothing to drop here
            docs = corpus_pipeline.cut(out)
    texts = {r.doc_id for r in docs.collect()}
    got = out.collect()
    assert {r.doc_id for r in got} == texts and all(r.lossless for r in got)
    assert corpus_pipeline.run(spark, sf).count() == len(texts)
    assert all(stage(spark, docs.limit(0), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_rows(spark, sf):
    """Rows with null and shared ids, equal rows and extra columns, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(3)
    text = lambda n=200: " ".join(f"w{x}" for x in rng.integers(0, 5000, n)) + "."
    one, two, three, four = (text() for _ in range(4))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, one, "en", "a"), (1, one, "en", "a"), (1, two, "en", "a"), (None, three, None, None), (None, three, None, None), (5, None, "en", "a"), (6, "", "en", "a"),
            (7, one + " more", "en", "a"), (8, four + " " + " ".join(two.split()[:60]), "en", "b"), (None, text() + " " + item, "en", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r.doc_id or 0, len((r.text or "").split())) for r in d.collect())
    out = stage["quality rules"](spark, df, sf)
    n_item = len(item.split())
    assert ids(out) == sorted([(0, 200), (0, 200), (0, 200 + n_item), (1, 200), (1, 200), (1, 200), (7, 201), (8, 260)]) and out.columns == corpus_pipeline.COLUMNS
    out = stage["SimHash near-dedup"](spark, df, sf)
    assert ids(out) == sorted([(0, 200), (0, 200 + n_item), (1, 200), (1, 200), (5, 0), (8, 260)])
    out = stage["substring dedup"](spark, df, sf)
    assert ids(out) == sorted([(0, 200), (0, 200), (0, 200 + n_item), (1, 200), (1, 200), (1, 200), (5, 0), (6, 0), (7, 1), (8, 200)])
    assert {r.text for r in out.collect() if r.doc_id == 5} == {None}
    out = stage["benchmark decontamination"](spark, df, sf)
    assert len(out.collect()) == 9 and ids(out) == sorted((r[0] or 0, len((r[1] or "").split())) for r in rows[:-1])
    assert sorted(r.doc_id or 0 for r in stage["SentencePiece encoding"](spark, df, sf).collect()) == sorted(r[0] or 0 for r in rows)


def test_leaves_of_hot_ids(spark, monkeypatch):
    """One id and no id with a third of all records each, many of them alike."""
    monkeypatch.setattr(warc, "TOGETHER", 8)
    rng = random.Random(5)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else rng.randrange(3000), bytes([rng.randrange(3)]) * rng.choice([1, 5, 40])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, record binary").withColumn("copy", F.lit("x"))
    got = sorted((r.archive, r.id is not None, r.id or 0, r.copy, r.offset, r.length, r.hash) for r in warc.leaves(df).collect())
    want = []
    for a in {-1 if i is None else i // 1024 for i, _ in rows}:
        at, last, copy = 0, None, 0
        for known, i, h, n in sorted((i is not None, i or 0, hashlib.sha256(x).hexdigest(), len(x)) for i, x in rows if (-1 if i is None else i // 1024) == a):
            copy = copy + 1 if last == (known, i) else 0
            last = known, i
            want.append((a, known, i, copy, at, n, h))
            at += n
    assert got == sorted(want)
    assert audit(df, df).count() == 0
    less = [r for r in rows if r != (7, b"\x01" * 40)]
    assert {(r.id, r.kind) for r in audit(df, spark.createDataFrame(less, "id long, record binary")).collect()} >= {(7, "missing")}
