"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, drop
from .text import BLANKS, by_row, flat, pieces, spans, word_hashes

#: rows of a part in which pairs are made, pairs of each row, Newton steps and their ridge
PER_PART, SHIFTS, STEPS, RIDGE = 4096, 4, 12, 1e-3
#: score at which a text is called good
GOOD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _STOP | BLANKS)
_SIGN[0x80:] = False


def features(column: pa.Array) -> np.ndarray:
    """Features of each text of one piece; all zero for a text without words."""
    data, offsets = flat(column)
    starts, ends, first = spans(data, offsets)
    rows = len(column)
    out = np.zeros((rows, 14))
    n = np.diff(first)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    row, words = by_row(first), n[full]

    def per_byte(mask):
        total = np.r_[0, np.cumsum(mask[data])]
        return (total[offsets[1:]] - total[offsets[:-1]])[full]

    def per_word(values):
        return np.bincount(row, values, rows)[full]

    size = (ends - starts).astype(float)
    shouted = _UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, ends - 1)]] & (size > 1)
    h = word_hashes(data, starts, ends)
    again = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
    order = np.lexsort((h, row))
    seen = np.r_[False, (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])]
    bare = per_word((_SIGN[data[starts]] & (size == 1)).astype(float))
    tailed = per_word((_SIGN[data[ends - 1]] & (size > 1)).astype(float))
    mean = per_word(size) / words
    out[full] = np.stack(
        [
            np.log1p(words), np.minimum(words / 50, 1), mean, np.sqrt(np.maximum(per_word(size**2) / words - mean**2, 0)),
            np.sqrt(per_byte(_SIGN) / words), np.sqrt(bare / words), np.sqrt(tailed / words), np.sqrt(per_byte(_UPPER) / words),
            per_word(shouted.astype(float)) / words, per_byte(_DIGIT) / words, per_byte(_STOP) / words,
            per_word(again.astype(float)) / words, per_word(seen[np.argsort(order)].astype(float)) / words, np.ones(len(full)),
        ],
        axis=1,
    )
    return out


@dataclass
class RankModel:
    """Standardising centre and spread, weights, and the map to 0..1: a raw score
    at ``cut`` (a quantile of the training scores) becomes GOOD."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.expand(f) @ self.weights

    def expand(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.centre) / self.spread, -8, 8)
        return np.hstack([z, z * z])

    def score(self, f: np.ndarray) -> np.ndarray:
        x = self.slope * (self.raw(f) - self.cut) + np.log(GOOD / (1 - GOOD))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(f: np.ndarray, label: np.ndarray, share_good: float, pairs: int = 40_000, epochs: int = 12, rate: float = 0.05, seed: int = 11) -> RankModel:
    """Learn from ``pairs`` preferences (a good text over a bad one): logistic loss
    on the difference of their features, by gradient descent over shuffled pairs.
    The cut is where pairs of both kinds of errors balance: the score quantile
    that leaves ``1 - share_good`` of a corpus mixed like the labels below it."""
    width = f.shape[1]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    centre, spread = f.mean(0) if len(f) else np.zeros(width), (f.std(0) if len(f) else np.zeros(width)) + 1e-6
    model = RankModel(centre, spread, np.zeros(2 * width))
    if not len(good) or not len(bad):
        model.cut = -2.0 if len(good) or not len(bad) else 2.0
        return model
    rng = np.random.default_rng(seed)
    z = np.clip((f - centre) / spread, -8, 8)
    z = np.hstack([z, z * z])
    w, pace = model.weights, np.full(2 * width, 1e-3)
    for _ in range(epochs):
        a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
        for i in range(0, pairs, 256):
            d = z[a[i : i + 256]] - z[b[i : i + 256]]
            g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(0) + 1e-4 * w
            pace += g * g
            w -= rate * g / np.sqrt(pace)
    s = model.raw(f)
    mass = np.where(label == 1, share_good / len(good), (1 - share_good) / len(bad))
    order = np.argsort(s)
    below = np.cumsum(mass[order])
    at = min(int(np.searchsorted(below, 1 - share_good)), len(s) - 2)
    model.cut = float((s[order][at] + s[order][at + 1]) / 2)
    best = None
    for slope in np.geomspace(0.05, 20, 40):
        model.slope = slope
        p = np.clip(model.score(f), 1e-6, 1 - 1e-6)
        loss = -float(np.sum(mass * np.where(label == 1, np.log(p), np.log(1 - p))))
        if best is None or loss < best[0]:
            best = loss, slope
    model.slope = best[1]
    return model


def _labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, h, f): features of every text whose id has one label; rows alike in id and
    features are one. Features meet labels, not texts. Written, to be dropped by the caller."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1)):
                f = pa.array(list(features(b.column(1).slice(i, n))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), f], ["id", "f"])

    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    rows = texts.mapInArrow(run, f"id {kind}, f array<double>").join(of.where("label = most").drop("most"), "id").distinct()
    return cut(rows.select(F.col("label").cast("int").alias("label"), F.xxhash64("id", "f").alias("h"), "f"))


def _summed(rows: DataFrame, columns: list[str], work, size: int) -> np.ndarray:
    """Sum of the ``size`` numbers that ``work`` makes of each batch of ``rows``."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += work(*(np.asarray(c.flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    got = rows.select(*columns).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.i] = r.v
    return out


def _pairs(rows: DataFrame, n: int, model: RankModel) -> DataFrame:
    """Differences (good less bad) of squared-out features: rows are dealt into parts by hash,
    and within a part each row of either label meets some of the other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        label = table.column("label").to_numpy()
        z = model.expand(np.array(table.column("f").to_pylist(), float).reshape(len(label), -1))
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        k = np.arange(max(len(good), len(bad)) if len(good) and len(bad) else 0)
        d = [z[good[(k + s * 7) % len(good)]] - z[bad[(k + s * 11) % len(bad)]] for s in range(SHIFTS)] if len(k) else []
        return pa.table({"d": pa.array(list(np.concatenate(d)) if d else [], pa.list_(pa.float64()))})

    part = F.pmod("h", F.lit(1 + n // PER_PART))
    return cut(rows.withColumn("part", part).groupBy("part").applyInArrow(run, "d array<double>"))


def _quantile(rows: DataFrame, model: RankModel, share_good: float, n_good: int, n_bad: int) -> float:
    """The raw score that leaves ``1 - share_good`` of a corpus mixed like the labels
    below it: by counts of bins, then of bins of the bin that holds it, twice."""

    def run(batches):
        for b in batches:
            f = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.raw(f))], ["label", "s"])

    scored = rows.select("label", "f").mapInArrow(run, "label int, s double")
    weight = F.sum(F.when(F.col("label") == 1, share_good / n_good).otherwise((1 - share_good) / n_bad))
    below, low, width = 0.0, 0.0, 1 / 64
    inside = scored
    for _ in range(3):
        bins = sorted((r.b, r.w) for r in inside.groupBy(F.floor((F.col("s") - low) / width).alias("b")).agg(weight.alias("w")).collect())
        for b, w in bins:
            at = b
            if below + w >= 1 - share_good:
                break
            below += w
        low, size, width = low + at * width, width, width / 1024
        inside = inside.where((F.col("s") >= low) & (F.col("s") < low + size))
    return low + size


def fit_quality_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RankModel:
    """Fit on every whole text with a label (0 or 1); ids with both are left out.

    Sums over all rows give centre and spread; weights are the least logistic loss over
    pairs of a good and a bad row, by Newton steps, each a sum over all pairs; cut and
    slope are from all rows' scores. Only sums come to the driver.
    """
    known = labels.where(f"{label_col} IN (0, 1)")
    counts = {r[label_col]: r["count"] for r in known.groupBy(label_col).count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = _labelled_features(docs, known, id_col, text_col, label_col)
    first = _summed(rows, ["label", "f"], lambda y, f: np.r_[len(y), y.sum(), f.sum(0)], 16)
    n, good = int(first[0]), int(first[1])
    centre = first[2:] / max(1, n)
    spread = np.sqrt(_summed(rows, ["f"], lambda f: ((f - centre) ** 2).sum(0), 14) / max(1, n)) + 1e-6
    model = RankModel(centre, spread, np.zeros(28))
    if not good or good == n:
        model.cut = -2.0 if good or not n else 2.0
        drop(rows)
        return model
    pairs = _pairs(rows, n, model)
    for _ in range(STEPS):
        w = model.weights

        def slopes(d):
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            return np.r_[len(d), -p @ d, ((d * (p * (1 - p))[:, None]).T @ d).ravel()]

        got = _summed(pairs, ["d"], slopes, 1 + 28 + 28 * 28)
        if not got[0]:
            break
        g, h = got[1:29] / got[0] + RIDGE * w, got[29:].reshape(28, 28) / got[0] + RIDGE * np.eye(28)
        step = np.linalg.solve(h, g)
        model.weights = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.cut = _quantile(rows, model, share, good, n - good)
    grid = np.geomspace(0.05, 20, 40)
    mass = np.array([(1 - share) / (n - good), share / good])

    def losses(y, f):
        x = np.clip(grid[:, None] * (model.raw(f) - model.cut) + np.log(GOOD / (1 - GOOD)), -13.8, 13.8)
        return (np.log1p(np.exp(np.where(y == 1, -x, x))) * mass[y]).sum(1)

    model.slope = float(grid[np.argmin(_summed(rows, ["label", "f"], losses, 40))])
    drop(pairs, rows)
    return model


def rank_quality(docs: DataFrame, model: RankModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``: 0..1, higher where label 1 is likelier. Null and empty
    texts are scored as texts without words; repeated rows score alike and each
    gives its row; very long texts are read whole; other columns are not read; an
    empty table gives no rows, and a model from empty labels one score for all."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1)):
                s = model.score(features(b.column(1).slice(i, n)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(s)], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")
