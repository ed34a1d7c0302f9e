"""Whole results of queries against plain loops over the same tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.llm import decontaminate as D
from dwellspark.llm import licenses as L
from dwellspark.llm import queries as Q
from dwellspark.llm.language import fit_language_model
from dwellspark.llm.pieces import decode_pieces
from dwellspark.llm.quality_rank import fit_quality_ranker
from dwellspark.llm.samples import labelled_texts, remainder

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_language_scores(spark, sf):
    model = fit_language_model(spark.read.parquet(f"{sf}/documents.parquet").where(remainder("doc_id", 5) != 0))
    docs = texts(spark, sf)
    for r in Q.op5_language(spark, sf).collect():
        x = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in docs[r.doc_id].encode()]
        seen = Counter()
        for i in range(len(x) - 1):
            two = x[i] * 0x9E3779B1 + x[i + 1] * 0x85EBCA6B
            for k, h in ((2, two), (3, two + x[i + 2] * 0xC2B2AE35 + 0x27D4EB2F if i + 2 < len(x) else None)):
                if h is not None and any(c != 32 for c in x[i : i + k]):
                    h %= 1 << 32
                    seen[((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)) >> 17] += 1
        if not re.search(r"[^\W\d_]", docs[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        z = sum((n * model.table[b] for b, n in seen.items()), np.zeros(len(model.langs))) / max(1, seen.total())
        z = (z + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.langs[p.argmax()] and abs(r.score - p.max()) < 1e-9 and r.accepted == (p.max() >= model.least)


def test_quality_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality_ranker(docs, labels.where(remainder("doc_id", 5) != 0))
    whole = texts(spark, sf)
    stop, sign = set(b".,;:?"), {c for c in range(128) if not chr(c).isalnum() and chr(c) not in ".,;:? \t\n\v\f\r"}
    for r in Q.op6_quality_rank(spark, sf).collect():
        data = whole[r.doc_id].encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        f = np.zeros(14)
        if words:
            n, size = len(words), np.array([len(w) for w in words])
            count = lambda of: sum(c in of for c in data)
            upper = range(65, 91)
            f = np.array([
                math.log1p(n), min(n / 50, 1), size.mean(), size.std(), math.sqrt(count(sign) / n),
                math.sqrt(sum(len(w) == 1 and w[0] in sign for w in words) / n), math.sqrt(sum(len(w) > 1 and w[-1] in sign for w in words) / n),
                math.sqrt(count(upper) / n), sum(len(w) > 1 and w[0] in upper and w[1] in upper for w in words) / n, count(range(48, 58)) / n,
                count(stop) / n, sum(a == b for a, b in zip(words, words[1:])) / n, (n - len(set(words))) / n, 1.0,
            ])
        assert abs(r.score - model.score(f[None])[0]) < 1e-6 and r.predicted == int(r.score >= 0.3)


def contaminated_pairs(spark, sf, docs):
    parts, runs = [], {}
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        low = item.text.lower()
        words, last = WORD.findall(low), low.rstrip().rstrip(".?!").rfind(". ")
        at = D.split_item(len(words), len(WORD.findall(low[:last])) if last > 0 else None)
        runs[item.item_id] = words[:at], words[at:]
        parts += [(item.item_id, Counter(p.tolist())) for p in np.array_split(np.array(words, object), -(-len(words) // D.STRIDE))]
    df = Counter(w for _, p in parts for w in p)
    mean = sum(p.total() for _, p in parts) / len(parts)
    weight = [
        {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * p.total() / mean)) for w, n in p.items()}
        for _, p in parts
    ]
    having = {}
    for k, p in enumerate(weight):
        for w in p:
            having.setdefault(w, []).append(k)

    def share(part, words):
        k = min(D.RUN, max(len(part), 1))
        grams = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        return len(grams(part) & grams(words)) / len(grams(part)) if part else 1.0

    want = {}
    for i, text in docs.items():
        words, best = WORD.findall(text.lower()), {}
        for at in range(0, len(words), D.STRIDE):
            score = Counter()
            for w in set(words[at : at + D.PASSAGE]):
                for k in having.get(w, ()):
                    score[k] += weight[k][w]
            for k, s in score.items():
                if s >= D.LEVEL * sum(weight[k].values()) * 0.9999:
                    best[parts[k][0]] = max(s, best.get(parts[k][0], 0))
        for item, s in best.items():
            if all(share(p, words) >= D.OVERLAP for p in runs[item]):
                want[i, item] = s
    return want


def test_contaminated_documents(spark, sf):
    want = contaminated_pairs(spark, sf, texts(spark, sf))
    got = {(r.doc_id, r.item_id): r.score for r in Q.op8_decontaminate(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def labels_of(text):
    """All labels and the score, every template tried at every start of its grid."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    base = {label for phrase, label in L.BASE.items() if f" {phrase} " in f" {' '.join(words)} "}
    found, score = set(base), 1.0 if base else 0.0
    have = set(words)
    for label, keys, own in L.TEMPLATES:
        own = own.split()
        if sum(w in have for w in own) < L.MATCH * len(own):
            continue
        wide = L.slack(len(own))
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for s in range(-len(own) // wide * wide, len(words) + wide, wide):
            share = sum(any(abs(i - s - j) <= wide for i in places.get(w, ())) for j, w in enumerate(own)) / len(own)
            part = " " + " ".join(words[max(0, s - wide) : max(0, s + len(own) + wide)]) + " "
            if share >= L.MATCH and all(f" {k} " in part for k in keys):
                found.add(label)
                score = max(score, share)
    return ",".join(sorted(found)), score


def test_licence_labels(spark, sf):
    docs = {i: t for i, t in texts(spark, sf).items()}
    got = {r.doc_id: (r.labels, r.score) for r in Q.op9_licenses(spark, sf).collect()}
    for i, t in docs.items():
        want = labels_of(t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9


@pytest.mark.parametrize("k", range(len(L.TEMPLATES)))
def test_templates_are_found_when_edited(spark, k):
    label, keys, own = L.TEMPLATES[k]
    words = own.split()
    rng = np.random.default_rng(k)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 900, n)]
    more = words[:1] + ["inserted"] + words[1:]
    rows = [" ".join(filler(300) + words + filler(300)), " ".join(filler(40) + more).title(), " ".join(words + filler(5)), " ".join(filler(900)), " ".join(w for w in words if w not in keys[0].split())]
    if len(words) >= 40:
        rows.append(" ".join(words[: len(words) // 3] + ["so", "it", "is"] + words[len(words) // 3 :]))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(frame).collect()}
    assert all(got[i][0] == labels_of(t)[0] and abs(got[i][1] - labels_of(t)[1]) < 1e-9 for i, t in enumerate(rows))
    assert all(label in got[i][0].split(",") for i in (0, 1, 2, *range(5, len(rows)))) and got[3] == ("", 0.0)


def test_sample_bounds(spark):
    rows = [(i, "x" * (3000 if i % 2 else 10), f"l{i % 3}") for i in range(600)] + [(None, "y", "l0"), (700, None, "l1"), (701, "z", None), (3, "x", "l0")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    per = lambda *a: Counter(r[2] for r in labelled_texts(df, df, "id", "text", "lang", *a))
    assert per(50, 100) == {"l0": 50, "l1": 50, "l2": 50} and per(500, 100)["l1"] == 100
    assert set(per(50, 100, 900).values()) == {3}
    with pytest.raises(ValueError, match="3 labels"):
        per(50, 100, 1)
    least = [r[0] for r in df.where("length(text) <= 100 AND lang = 'l1' AND id IS NOT NULL").select("id", F.xxhash64("id").alias("h")).orderBy("h").limit(5).collect()]
    assert {r[0] for r in labelled_texts(df, df, "id", "text", "lang", 5, 100) if r[2] == "l1"} == set(least)
    assert labelled_texts(df.limit(0), df, "id", "text", "lang", 5, 100) == []


def test_sample_of_shared_ids(spark):
    rows = [(1, "alpha beta", "en"), (1, "alpha beta", "en"), (1, "gamma", "de"), (2, "delta", "de"), (None, "x", "de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert labelled_texts(df, df, "id", "text", "lang", 9, 100) == [(1, "alpha beta", "en"), (1, "gamma", "de"), (2, "delta", "de")]
    marks = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, 1), (None, 1)], "id long, lang int")
    assert labelled_texts(df, marks, "id", "text", "lang", 9, 100) == [(1, "alpha beta", 0), (1, "gamma", 0)]
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    got = labelled_texts(hot, hot, "id", "text", "lang", 20, 100)
    assert len(got) == 20 and sum(len(r[1]) for r in got) <= 20 * 100


def test_pipeline_stage_by_stage(spark, sf):
    """Every stage's rows against plain loops over what the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = [f for _, f in pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = pipeline.cut(stage[0](spark, docs, sf))
    kept = {r.doc_id for r in Q.op1_quality_rules(spark, sf).collect() if r.kept}
    first = {r.doc_id: r for r in one.collect()}
    assert first.keys() == kept and all(len(BLANK.findall(r.text)) >= 50 for r in first.values())

    two = pipeline.cut(stage[1](spark, one, sf))
    second = {r.doc_id: r for r in two.collect()}
    assert all(second[i] == first[i] for i in second)
    grams = {}
    for i, r in first.items():
        w = BLANK.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        grams[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    ids, near, far = sorted(first), {}, {i: i for i in first}

    def root(up, i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            s = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            for up, least in ((near, 0.88), (far, 0.7)):
                if s >= least:
                    a, b = sorted((root(up, i), root(up, j)))
                    up[b] = a
    # one row of each class at least, none of whose likes at 0.88 stand before it
    assert {i for i in ids if root(far, i) == i} <= second.keys() <= {i for i in ids if root(near, i) == i}

    three = pipeline.cut(stage[2](spark, two, sf))
    seen, want = set(), {}
    for i in sorted(second):
        w = BLANK.findall(second[i].text)
        gone = set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone |= set(range(j, j + 20))
            seen.add(key)
        if len(gone) < len(w):
            want[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else second[i].text
    third = {r.doc_id: r.text for r in three.collect()}
    assert third == want

    four = pipeline.cut(stage[3](spark, three, sf))
    hits = {i for i, _ in contaminated_pairs(spark, sf, third)}
    fourth = {r.doc_id: r.text for r in four.collect()}
    assert fourth == {i: t for i, t in third.items() if i not in hits}

    out = pipeline.cut(stage[4](spark, four, sf))
    assert {r.doc_id: r.text for r in decode_pieces(out).collect()} == fourth and all(r.lossless for r in out.collect())
