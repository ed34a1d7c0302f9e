"""Language ID: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled_texts
from .text import flat, pieces

BUCKETS = 1 << 15
DIM = 16
#: bounds of the training sample: texts per language, characters of a text
PER_LANG, MOST_CHARS = 800, 20_000
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


@dataclass
class LanguageModel:
    """``table``: what each bucket adds to each language's logit (embedding times
    softmax weights); ``heat``: temperature fitted on rows kept out of training;
    ``least``: calibrated probability under which a prediction is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0


def _buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the 2- and 3-byte subword at each place; BUCKETS where a
    subword would leave its text or holds no letter."""
    x = _FOLD[data]
    n = len(x)
    pad = np.r_[x, np.zeros(2, np.uint32)]
    two = pad[:n] * np.uint32(0x9E3779B1) + pad[1 : n + 1] * np.uint32(0x85EBCA6B)
    three = two + pad[2 : n + 2] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    out = np.empty((2, n), np.int64)
    for k, h in enumerate((two, three)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[k] = h >> np.uint32(32 - BUCKETS.bit_length() + 1)
        for back in range(1, k + 2):
            ends = offsets[1:] - back
            out[k, ends[(ends >= offsets[:-1])]] = BUCKETS
    out[0, (pad[:n] == 32) & (pad[1 : n + 1] == 32)] = BUCKETS
    out[1, (pad[:n] == 32) & (pad[1 : n + 1] == 32) & (pad[2 : n + 2] == 32)] = BUCKETS
    return out


def train(rows: list[tuple[int, str, str]], epochs: int = 6, rate: float = 8.0, batch: int = 16, seed: int = 7) -> LanguageModel:
    """Fit by stochastic gradient descent; one row in five sets temperature and rejection."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    feats, y = [], np.array([langs.index(r[2]) for r in rows])
    for _, text, _ in rows:
        data, offsets = flat(pa.array([text]))
        b, c = np.unique(_buckets(data, offsets), return_counts=True)
        own = b < BUCKETS
        feats.append((b[own], c[own] / max(1, c[own].sum())))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    held = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~held)
    steps, done = epochs * (len(learn) // batch + 1), 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            step = rate * (1 - done / steps)
            done += 1
            some = order[i : i + batch]
            h = np.stack([feats[k][1] @ e[feats[k][0]] for k in some])
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ w.T
            w -= step * h.T @ p
            bias -= 0.1 * step * p.sum(0)
            for k, g in zip(some, back):
                e[feats[k][0]] -= step * 20 * feats[k][1][:, None] * g
    model = LanguageModel(langs, np.r_[e @ w, np.zeros((1, len(langs)))], bias)
    check = np.flatnonzero(held)
    if len(check):
        z = np.stack([feats[k][1] @ model.table[feats[k][0]] + bias for k in check])
        losses = {}
        for heat in np.geomspace(0.25, 8, 21):
            s = z / heat
            s -= s.max(1, keepdims=True)
            losses[heat] = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(check)), y[check]]))
        model.heat = min(losses, key=losses.get)
        s = np.exp((z - z.max(1, keepdims=True)) / model.heat)
        right = s.argmax(1) == y[check]
        if right.any():
            model.least = float(np.quantile((s / s.sum(1, keepdims=True)).max(1)[right], 0.01))
    return model


def scores(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best language's number and calibrated probability of each text of one piece."""
    data, offsets = flat(column)
    n, z = len(column), np.zeros((len(column), len(model.langs)))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        at = offsets[:-1][full]
        total = np.zeros(len(full))
        for b in _buckets(data, offsets):
            total += np.add.reduceat((b < BUCKETS).astype(np.float64), at)
            for k in range(len(model.langs)):
                z[full, k] += np.add.reduceat(model.table[:, k][b], at)
        z[full] /= np.maximum(total, 1)[:, None]
    z = (z + model.bias) / model.heat
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p[np.arange(n), p.argmax(1)]


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on a sample of at most PER_LANG whole texts of each language."""
    return train(labelled_texts(docs, docs, id_col, text_col, lang_col, PER_LANG, MOST_CHARS))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, accepted)`` of each whole text.

    Null texts, texts without a letter and a model without languages give
    ``und`` with score 0. ``accepted`` is false below the model's rejection
    threshold; callers who want ``und`` there replace lang_pred by it. Very long
    texts are read whole; of equally likely languages the first by name is taken;
    repeated rows fare alike and each gives its row; other columns are not read;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1)):
                part, letter = b.column(1).slice(i, n), b.column(2).slice(i, n).to_numpy(zero_copy_only=False).astype(bool)
                if model.langs:
                    best, p = scores(model, part)
                    pred = np.where(letter, np.array(model.langs, object)[best], UNKNOWN)
                    p = np.where(letter, p, 0.0)
                else:
                    pred, p = np.full(n, UNKNOWN, object), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(pred, pa.string()), pa.array(p), pa.array(letter & (p >= model.least))],
                    [id_col, "lang_pred", "score", "accepted"],
                )

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(id_col, text_col, letter).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, accepted boolean")
