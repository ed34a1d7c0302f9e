"""Piece encoding: against the library without dropout, and lossless with it."""

import numpy as np
import pyarrow as pa
import pytest

from dwellspark.llm.pieces import DROPOUT, decode, decode_pieces, default_model, encode, encode_pieces, load, segment, segment_one

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["Hello world", " two  blanks ", "a\nb\tc", "café ▁ mark", "\U0001f600中文 ไ", "", "   ", "x" * 700, "<s> </s> <0x41> <unk>", "the the the the", "1234567890 " * 30]


def test_equals_library_without_dropout(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    ids, bounds, _, _ = encode(load(default_model()), pa.array(texts), np.arange(len(texts), dtype=np.uint64), dropout=0)
    for k, t in enumerate(texts):
        if "▁" not in t:
            assert ids[bounds[k] : bounds[k + 1]].tolist() == sp.encode(t), t[:80]


def test_rounds_equal_agenda():
    model, rng = load(default_model()), np.random.default_rng(3)
    words = ["▁" + "".join(rng.choice(list("theandionr"), rng.integers(1, 14))) for _ in range(300)]
    symbol = np.array([model.space if c == "▁" else model.of_char[ord(c)] for w in words for c in w])
    unit = np.repeat(np.arange(len(words)), [len(w) for w in words])
    keys = rng.integers(0, 2**63, len(words), dtype=np.uint64)
    u, s, p = segment(model, symbol, unit, keys, 0.3)
    for k in range(len(words)):
        want = segment_one(model, symbol[unit == k].tolist(), int(keys[k]), 0.3)
        assert p[u == k].tolist() == [x for x, _ in want]


def test_dropout_varies_and_decodes(spark):
    model, texts = load(default_model()), pa.array(["the thinking another " * 40] * 20 + TEXTS)
    ids, bounds, _, _ = encode(model, texts, np.arange(len(texts), dtype=np.uint64), dropout=0.3)
    assert len({tuple(ids[bounds[k] : bounds[k + 1]]) for k in range(20)}) > 10
    back, at = decode(model, ids, bounds)
    assert [back[at[k] : at[k + 1]].tobytes().decode() for k in range(len(texts))] == texts.to_pylist()
    again = encode(model, texts, np.arange(len(texts), dtype=np.uint64), dropout=0.3)[0]
    assert (again == ids).all() and not len(ids) == len(encode(model, texts, np.arange(len(texts), dtype=np.uint64), dropout=0.3, seed=5)[0])


def test_frequent_words_split_at_the_dropout_rate():
    """A word of one merge is split in a share of its occurrences near the rate, and
    a longer one has many segmentations."""
    model, n = load(default_model()), 400
    ids, bounds, _, _ = encode(model, pa.array(["a " * 50] * n), np.random.default_rng(7).integers(0, 2**63, n, dtype=np.uint64), dropout=0.1)
    # 50 times " a", each one piece or two, and the blank at the end
    split = (np.diff(bounds) - 51) / 50
    assert abs(split.mean() - 0.1) < 0.01 and (split > 0).mean() > 0.95
    ids, bounds, _, _ = encode(model, pa.array([" ".join(["international"] * 2000)]), np.zeros(1, np.uint64), dropout=0.1)
    spelled = [bytes(model.bytes[model.start[i] : model.start[i] + model.length[i]]).decode() for i in ids]
    at = [k for k, x in enumerate(spelled) if x.startswith(" ")] + [len(spelled)]
    assert len({tuple(spelled[a:b]) for a, b in zip(at, at[1:])}) > 20


def test_occurrences_equal_their_own_agenda(monkeypatch):
    """The shortcut for occurrences without a skipped candidate changes nothing."""
    from dwellspark.llm import pieces

    model, texts = load(default_model()), pa.array(["the thinking another international café " * 60] * 5 + TEXTS)
    ids = np.arange(len(texts), dtype=np.uint64)
    some = encode(model, texts, ids, dropout=0.1)
    monkeypatch.setattr(pieces, "_varied", lambda keys, *_: np.arange(len(keys)))
    each = encode(model, texts, ids, dropout=0.1)
    assert (some[0] == each[0]).all() and (some[1] == each[1]).all()


def test_encode_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (None, "null id", "y"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_pieces(df, dropout=DROPOUT)
    got = out.collect()
    assert all(r.lossless for r in got if r.doc_id != 90) and [r for r in got if r.doc_id == 90][0].ids is None
    assert sorted((r.doc_id, r.text) for r in decode_pieces(out).collect() if r.doc_id is not None) == sorted((i, t) for i, t, _ in rows if i is not None and i != 90) + [(90, None)]
    assert encode_pieces(df.limit(0)).count() == 0
