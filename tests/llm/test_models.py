"""Quality rules, language ID, ranking, LM mixing: brute force and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dwellspark.llm import queries as Q
from dwellspark.llm.language import fit_language_model, identify_language
from dwellspark.llm import mixing
from dwellspark.llm import quality_rules as quality
from dwellspark.llm.mixing import lm_scores
from dwellspark.llm.quality_rank import features, rank_quality, train
from dwellspark.llm.quality_rules import base_counts, quality_rules
from dwellspark.llm.samples import remainder

EDGE = [(1, None, None, None), (2, "", "en", "s"), (3, "x " * 30_000, "en", "s"), (4, "a b\n\na b\na b", None, "s"), (4, "a b\n\na b\na b", None, "s"), (5, "é, ñ %% <b>\x0bz", "es", None)]
SCHEMA = "doc_id long, text string, lang string, source string"


def counts(text):
    w = (text or "").encode().split()
    n, grams, hit = len(w), Counter(zip(w, w[1:], w[2:])), set()
    for j in range(n - 2):
        if grams[tuple(w[j : j + 3])] > 1:
            hit |= {j, j + 1, j + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark, sf):
    edge = spark.createDataFrame(EDGE, SCHEMA)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    for r in base_counts(edge.unionByName(docs)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)


def test_rules_reject_junk_and_keep_clean(spark, sf):
    got = {r.doc_id: r for r in Q.op1_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got.values())


def test_repeats_alone_are_rejected(spark):
    """Half the lines, or much of the words, repeated: out by distance, whatever else."""
    rng = np.random.default_rng(6)
    body = lambda: [" ".join(f"{w:x}" for w in rng.integers(4096, 65536, 10)) for _ in range(int(rng.integers(18, 24)))]
    clean = {i: "\n".join(body()) for i in range(200)}
    lines = {1000 + i: "\n".join(f"{x}\nmenu" for x in body()) for i in range(3)}
    words = {2000 + i: "\n".join(b + [" ".join(b[:6])]) for i, b in enumerate(body() for _ in range(3))}
    rows = [(i, t, "en", "s") for i, t in {**clean, **lines, **words}.items()]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values()) and sum(got[i].kept for i in clean) >= 198
    assert all(got[i].n_repeat_words == 0 < got[i].n_dup_lines for i in lines) and all(got[i].n_dup_lines == 0 < got[i].n_repeat_words for i in words)
    assert not any(got[i].kept for i in (*lines, *words))


def plain_estimate(x, share=quality.SHARE):
    """Centre and factor of one group, from all its rows at once."""
    spread = np.array([v[1] for v in quality.STATS.values()])

    def factor(cov):
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(rest, spread[i] ** 2)) if i == j else rest / low[j, j]
        return low

    rounded = np.floor(x * 64 + 0.5) / 64
    q = np.percentile(rounded, [25, 50, 75], axis=0)
    centre, low = q[1], factor(np.diag(np.maximum((q[2] - q[0]) / 1.349, spread) ** 2))
    for _ in range(quality.STEPS):
        d2 = (np.linalg.solve(low, (x - centre).T) ** 2).sum(axis=0)
        bins = np.minimum(np.floor(16 * np.log2(d2 + 1)), 1000)
        last = next(b for b in np.unique(bins) if (bins <= b).sum() >= share * len(x))
        own, before = x[bins <= last], np.log(np.diag(low)).sum()
        centre, low = own.mean(axis=0), factor(quality.CONSISTENT * np.cov(own.T, bias=True))
        if abs(np.log(np.diag(low)).sum() - before) <= quality.SETTLED:
            break
    return centre, low


def test_distances_against_numpy(spark, sf, monkeypatch):
    """The whole query's kept and d2, one language and source after the other."""
    monkeypatch.setattr(quality, "SETTLED", 0.0)
    monkeypatch.setattr(quality, "STEPS", 2)
    monkeypatch.setattr(quality, "SALT_ROWS", 7)
    monkeypatch.setattr(quality, "LEAST_ROWS", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    groups, stats = {}, {}
    for r in docs.select("doc_id", "text", "lang", "source").collect():
        n, chars, symbols, dup, rep = counts(r.text)
        lines = sum(bool(x.encode().split()) for x in (r.text or "").split("\n"))
        failed = n < 50 or 100 * rep > 50 * n
        assert got[r.doc_id].base_failed == failed
        if not failed:
            stats[r.doc_id] = [math.log(n + 1), chars / n, math.sqrt(100 * symbols / n), math.sqrt(100 * dup / max(lines, 1)), math.log(1 + 100 * rep / n)]
            groups.setdefault((r.lang, r.source), []).append(r.doc_id)
    checked = 0
    for ids in groups.values():
        if len(ids) >= 3:
            x = np.array([stats[i] for i in ids])
            centre, low = plain_estimate(x)
            d2 = (np.linalg.solve(low, (x - centre).T) ** 2).sum(axis=0)
            assert [got[i].d2 for i in ids] == pytest.approx(d2.tolist(), rel=1e-4, abs=1e-5)
            assert [got[i].kept for i in ids] == [d <= quality.CUT for d in d2]
            checked += len(ids)
    assert checked > 100


def test_repeats_of_a_very_long_text(spark):
    text = " ".join(f"{i:x}" for i in range(2_000_000))
    df = spark.createDataFrame([(1, text), (2, text[:500_000] + " 0 1 2 3")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in base_counts(df).select("doc_id", "n_repeat_words").collect()} == {1: 0, 2: 8}


def test_rules_edges(spark):
    df = spark.createDataFrame([(*r, 1) for r in EDGE], SCHEMA + ", kept int")
    assert len(quality_rules(df).collect()) == len(EDGE) and quality_rules(df.limit(0)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in Q.op5_language(spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_language_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language_model(docs)
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "123 !?", 1.0), (4, "the thing " * 50_000, 1.0), (None, "der und", 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(df, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en"
    none = fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in identify_language(df, none).collect()} == {"und"} and identify_language(df.limit(0), model).count() == 0


def test_ranking_held_out(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in Q.op6_quality_rank(spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) for r in held)


def test_ranking_edges(spark):
    texts = pa.array(["good words here. " * 9, "bad bad bad bad bad ### ***"] * 9, pa.string())
    model = train(features(texts), np.array([1, 0] * 9), 0.5, pairs=2000, epochs=3)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 300_000, 1), (4, "good words here. " * 9, 1), (5, "bad bad bad bad bad ### ***", 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in rank_quality(df, model).collect()}
    assert got[1] == got[2] and got[4] > 0.3 > got[5] and all(0 <= s <= 1 for s in got.values())
    assert rank_quality(df.limit(0), model).count() == 0
    assert train(features(texts), np.ones(18), 1.0).score(features(texts)).min() > 0.3


def test_lm_base_and_totals(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op4_lm_mixing(spark, sf).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in docs.items()}
    c = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    total = sum(c.values())
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 * abs(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.bits_per_byte for r in held]) < 3.5 and len(got) == len(docs)


def extreme_mixer(seed, spread=127):
    rng = np.random.default_rng(seed)
    bits = mixing.table_bits(1)
    model = mixing.Mixer(mixing.Code(rng.integers(0, 99, 256)), bits, rng.integers(-spread, spread + 1, sum(1 << b for b in bits)).astype(np.int8))
    model.weights = rng.normal(0.5, 0.4, model.weights.shape).astype(np.float32)
    return model


def test_mixer_is_a_distribution():
    """After any context the chances of all byte values (the end is one) add up to 1."""
    for seed in range(5):
        model = extreme_mixer(seed)
        for context in np.random.default_rng(seed).integers(0, 2**32, (20, len(mixing.ORDERS)), dtype=np.uint32):
            own, value, gate, x = model.inputs(np.arange(256, dtype=np.uint8), np.tile(context, (256, 1)))
            chance = model.chances((model.weights.take(gate, 0) * x) @ mixing._SUM, mixing._AGAINST[value]).astype(float)
            whole = np.ones(256)
            np.multiply.at(whole, own, chance.prod(axis=1))
            assert whole.sum() == pytest.approx(1, abs=1e-6)


def test_mixer_against_a_plain_one(monkeypatch):
    """One text after the other, one byte, one bit and one input at a time."""
    monkeypatch.setattr(mixing, "SEGMENT", 100)
    model = extreme_mixer(7, 40)
    texts = ["The cat. " * 30, "", None, "a", "\u00e9\u4e2d " * 40, "zzz qqq 123 " * 9]
    want = []
    for t in texts:
        data, offsets = mixing._ended(pa.array([t]))
        ctx = np.stack(list(mixing.contexts(data, offsets)), 1)
        cost, added, moves = 0.0, np.zeros((4, 7)), []
        for i, byte in enumerate(data):
            if i % 100 == 0:
                added, moves = np.zeros((4, 7)), []
            elif i % 100 % mixing.STEP == 0:
                added, moves = added + sum(moves), []
            rank, group = int(model.code.rank[byte]), 0
            while True:
                value = min(rank - 15 * group, 15)
                rows = [int(mixing._rows(ctx[i, k : k + 1], np.array([group]), int(model.bits[k]))[0] + model.first[k]) for k in range(6)]
                known = [int(model.table[r + 1]) & 1 for r in rows]
                gate = known[3] + 2 * known[4] + 4 * known[5] + 8 * (group > 0)
                weights, move = model.weights[gate].reshape(7, 4).T.astype(float), np.zeros((4, 7))
                for t in range(4):
                    x = np.array([int(model.table[r + (1 << t | value >> 4 - t)]) / 16 for r in rows] + [mixing.BIAS])
                    z = min(11.0, max(-11.0, float((weights[t] + added[t]) @ x)))
                    bit = value >> 3 - t & 1
                    p = 1 / (1 + math.exp(-z))
                    cost -= math.log2(p if bit else 1 - p)
                    move[t] = mixing.RATE * (bit - p) * x
                moves.append(move)
                if value < 15:
                    break
                group += 1
        want.append(cost)
    assert model.log2_losses(pa.array(texts)).tolist() == pytest.approx(want, rel=1e-4)


def test_mixer_codes_every_byte_value_once():
    code = mixing.Code(np.arange(256))
    own, group, value = code.events(np.arange(256, dtype=np.uint8))
    paths = {}
    for o, v in zip(own.tolist(), value.tolist()):
        paths.setdefault(o, []).append(v)
    assert len({tuple(p) for p in paths.values()}) == 256 and all(set(p[:-1]) <= {15} and p[-1] < 15 for p in paths.values())
    data, offsets = mixing._ended(pa.array(["ab cab", "", None, "b cab"]))
    one, _, three, _, _, word = mixing.contexts(data, offsets)
    assert one.dtype == word.dtype == np.uint32 and word[5] == word[13] and word[4] != word[5] and three[5] == three[13] and one[0] == one[9]


def test_mixer_beats_the_base_on_held_out_texts(spark):
    held = [r for r in Q.op4_lm_mixing(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)


def test_lm_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm_scores(df, remainder("doc_id", 10) >= 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 2, 2), (1, 3, 3), (1, 3, 3)]
    assert {r.n_known for r in lm_scores(df, remainder("doc_id", 10) < 0).collect()} == {0}


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "The the " * 4000, 0), (4, "the", 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in lm_scores(df, remainder("doc_id", 10) >= 0).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[1].score == got[2].score and got[3].n_known == 8001
    assert lm_scores(df.limit(0), remainder("doc_id", 10) >= 0).count() == 0


def test_mixer_counts_in_one_pass(spark, tmp_path):
    """The largest tables are counted from one pass over the texts, and log-odds are
    those of each bit's counts."""
    texts = ["The cat. Qué 中!", "", None, "a cat", "zzz 123 " * 40]
    log = tmp_path / "rows"

    def note(batches):
        for b in batches:
            with open(log, "ab") as f:
                f.write(b"x" * b.num_rows)
            yield b

    docs = spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(note, "text string")
    data, offsets = mixing._ended(pa.array(texts))
    code, bits = mixing.Code(np.bincount(data, minlength=256)), mixing.table_bits(1 << 30)
    got = mixing.predictors(docs, code, bits)
    assert log.stat().st_size == len(texts)
    own, group, value = code.events(data)
    want, base = np.zeros(len(got), np.int8), 0
    for k, context in enumerate(mixing.contexts(data, offsets)):
        counts = {}
        for row, v in zip(mixing._rows(context[own], group, bits[k]).tolist(), value.tolist()):
            for t in range(4):
                counts.setdefault(base + row + (1 << t | v >> 4 - t), [0, 0])[v >> 3 - t & 1] += 1
        for slot, (zero, one) in counts.items():
            x = int(np.clip(np.rint(16 * math.log((one + 0.3) / (zero + 0.3))), -127, 127))
            want[slot] = x & -2 | (zero + one >= mixing.KNOWN) if slot % 16 == 1 else x
        base += 1 << bits[k]
    assert (got == want).all()
