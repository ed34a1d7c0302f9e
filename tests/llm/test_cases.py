"""Nulls, ties, repeated rows and long texts of the operators that other files leave out."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dwellspark.llm import pieces as P
from dwellspark.llm.decontaminate import contaminated
from dwellspark.llm.language import fit_language_model, identify_language
from dwellspark.llm.quality_rank import fit_quality_ranker, rank_quality
from dwellspark.llm.simhash import near_copies, simhash_components


def test_null_ids_in_classes(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, 1), (None, text, 1), (7, text, 1), (None, "quite another text of its own", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    for of in (simhash_components, near_copies):
        got = sorted((r.doc_id or -1, r.component_id or -1) for r in of(df).collect())
        assert got == sorted([(-1, 7), (-1, 7), (7, 7), (-1, -1), (3, 3)])


def test_long_document_and_tied_items(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"v{rng.randrange(50_000)}" for _ in range(n))
    item = words(40) + ". " + words(20)
    docs = [(1, words(150_000) + " " + item + " " + words(150_000)), (2, words(500))]
    items = spark.createDataFrame([(1, item), (2, item), (3, words(60))], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2)] and len({r.score for r in got}) == 1


def test_language_of_repeated_rows_and_ties(spark):
    rows = [(i, f"{'the cat sat' if i % 2 else 'le chat noir'} {i}", "en" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(df)
    got = identify_language(df.unionByName(df).withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 120 and all(len({(r.lang_pred, r.score) for r in got if r.doc_id == i}) == 1 for i in range(60))
    # two languages with the same texts: one of them, the same each time
    same = df.withColumn("lang", F.when(F.col("doc_id") < 30, "aa").otherwise("bb")).withColumn("text", F.lit("one text"))
    assert len({(r.lang_pred, r.score) for r in identify_language(same, fit_language_model(same)).collect()}) == 1


def test_ranker_without_labels_and_with_ties(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rank_quality(docs, fit_quality_ranker(docs, none)).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1
    both = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    got = rank_quality(docs, fit_quality_ranker(docs, both)).collect()
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id != 1}) == 1


def test_long_units_as_short_ones(monkeypatch):
    model, rng = P.load(P.default_model()), random.Random(2)
    texts = ["".join(rng.choice(c) for _ in range(700)) for c in ("aehilnorst", "abcdefghijklmnopqrstuvwxyz", ["ing", "tion", "é", "中"])]
    one = [P.encode(model, pa.array([t]), np.array([9], np.uint64))[0] for t in texts]
    monkeypatch.setattr(P, "LONG", 10**9)
    assert all(np.array_equal(a, P.encode(model, pa.array([t]), np.array([9], np.uint64))[0]) for a, t in zip(one, texts))


def test_ranker_learns_from_texts_of_any_length(spark):
    """Label 1 has only texts that a bounded sample would leave out."""
    rows = [(k, "Plain words stand here. " * 2500 if k % 2 else f"## {k} $$ CLICK now !!", k % 2) for k in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in rank_quality(docs, fit_quality_ranker(docs, labels)).collect()}
    assert min(s for i, s in score.items() if i % 2) > max(s for i, s in score.items() if not i % 2)
