"""Periodic runs: stretches of words that repeat themselves at a fixed distance.

A run is a stretch of words with smallest period q, at least ``max(12, 2q)`` words
long, that can't be made longer on either side with that period. All runs of a
text are found: periods under ``SHORT`` by comparing each word with the word q
places before it; longer ones scale by scale. A scale stands for the periods
from P up to 2P: windows of P words pick their least-hashed gram of P/2 words,
a window and its copy one period later pick the same gram, so equal picked grams
P to 2P apart are where a run may be, and it is then extended both ways.

Grams that repeat themselves within half their length lie in a run that a lower
scale has found, and aren't picked; so an equal gram stands at most a few times
within 2P words and pairs stay few, however repetitive a text is. A period made
of nothing but such grams stands across two touching runs of one shorter period,
whose phases give every period that fits.

Hashes only say where to look: each run is compared word by word before it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, pieces, run_hashes

#: least length of a run, and the first period that is looked for by grams
LEAST, SHORT = 12, 32
_NONE = np.zeros((0, 3), np.int64)
_TOP = np.uint64(2**64 - 1)


def _stretches(codes: np.ndarray, lag: int) -> np.ndarray:
    """(start, end, lag) of the longest stretches with period ``lag``."""
    at = np.flatnonzero(codes[lag:] == codes[:-lag])
    need = max(LEAST, 2 * lag) - lag
    if len(at) < need:
        return _NONE
    cuts = np.flatnonzero(np.diff(at) != 1)
    first = at[np.concatenate(([0], cuts + 1))]
    last = at[np.concatenate((cuts, [len(at) - 1]))]
    ok = last - first + 1 >= need
    return np.stack([first[ok], last[ok] + 1 + lag, np.full(ok.sum(), lag)], axis=1)


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or largest) value of each w neighbours, by prefixes and suffixes of blocks."""
    pick, pad = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n = len(x)
    room = np.full(-(-n // w) * w, pad, np.uint64)
    room[:n] = x
    blocks = room.reshape(-1, w)
    front = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], front[w - 1 : n])


def _marked(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [low, high)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step[:n]) > 0


def _reach(values: np.ndarray, at: np.ndarray, lag: np.ndarray, forth: bool) -> np.ndarray:
    """How far the words from (or, backwards, before) ``at`` equal those ``lag`` later,
    by hash: never less than the truth."""
    n = len(values)
    room = n - at - lag if forth else at
    got = np.zeros(len(at), np.int64)
    step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
    while step:
        more = got + step
        fits = np.flatnonzero(more <= room)
        a, x = at[fits], more[fits]
        low, high = (a, a + x) if forth else (a - x, a)
        same = run_hashes(values, low, high) == run_hashes(values, low + lag[fits], high + lag[fits])
        got[fits[same]] += step
        step >>= 1
    return got


def _extend(codes: np.ndarray, values: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """The longest stretch with period ``lag`` around each seed, where it is a run."""
    seeds = np.unique(np.stack([at, lag], axis=1), axis=0)
    low = seeds[:, 0] - _reach(values, seeds[:, 0], seeds[:, 1], False)
    high = seeds[:, 0] + _reach(values, seeds[:, 0], seeds[:, 1], True) + seeds[:, 1]
    long = high - low >= np.maximum(LEAST, 2 * seeds[:, 1])
    found = np.unique(np.stack([low, high, seeds[:, 1]], axis=1)[long], axis=0)
    out = [_NONE]
    for s, e, q in found.tolist():
        wrong = np.flatnonzero(codes[s : e - q] != codes[s + q : e])
        if not len(wrong):
            out.append(np.array([[s, e, q]]))
        else:  # hashes agreed where words don't: what is between the places that differ
            edges = np.concatenate(([s - 1], wrong + s, [e - q]))
            ok = np.diff(edges) - 1 >= max(LEAST, 2 * q) - q
            out.append(np.stack([edges[:-1][ok] + 1, edges[1:][ok] + q, np.full(ok.sum(), q)], axis=1))
    return np.concatenate(out)


def _pairs(where: np.ndarray, hashes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with equal hashes that stand ``low`` to ``high`` (left out) apart."""
    order = np.lexsort((where, hashes))
    where, hashes = where[order], hashes[order]
    at, lag, k = [], [], 1
    alive = np.arange(len(where))
    while len(alive):
        alive = alive[alive + k < len(where)]
        apart = where[alive + k] - where[alive]
        ok = (hashes[alive + k] == hashes[alive]) & (apart < high)
        alive, apart = alive[ok], apart[ok]
        far = apart >= low
        at.append(where[alive[far]])
        lag.append(apart[far])
        k += 1
    return np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*lag, np.zeros(0, np.int64)])


def _touching(codes: np.ndarray, runs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of periods from ``low`` to ``high`` that stand across two touching runs of
    one shorter period: wherever the runs' phases agree."""
    runs = runs[(runs[:, 2] <= low // 4) & (runs[:, 1] - runs[:, 0] >= low)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    near = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1])) if len(runs) > 1 else []
    at, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in near:
        (s1, e1, p), (s2, e2, _) = runs[k].tolist(), runs[k + 1].tolist()
        ahead = np.lib.stride_tricks.sliding_window_view(codes[s2 : s2 + 2 * p - 1], p)
        phase = np.flatnonzero((ahead == codes[s1 : s1 + p]).all(axis=1))
        for r in phase[:1].tolist():
            first = low + (s2 + r - s1 - low) % p
            q = np.arange(first, min(high, e1 - s1 + 1, e2 - s2 + 1), p)
            seed = np.maximum(s1, s2 - q)
            ok = (seed < e1) & (seed + q < e2)
            at.append(seed[ok])
            lag.append(q[ok])
    return np.concatenate(at), np.concatenate(lag)


def find_runs(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of several texts of numbered words, by start,
    end and period. ``first`` has where each text begins in ``codes`` (n + 1 values)."""
    sizes = np.diff(first)
    out = [_NONE]
    texts = np.flatnonzero(sizes >= LEAST)
    period = 1
    while len(texts):
        # texts end to end, each closed by a word that is nowhere else
        n = sizes[texts]
        base = np.concatenate(([0], np.cumsum(n + 1)))
        shift = np.repeat(first[texts] - base[:-1], n + 1)
        place = np.arange(base[-1]) + shift
        ends = base[1:] - 1
        place[ends] = 0
        line = codes[place].astype(np.int64)
        line[ends] = -1 - np.arange(len(texts))
        back = np.concatenate((shift, [0]))
        if period == 1:
            here = np.concatenate([_stretches(line, q) for q in range(1, min(SHORT, len(line)))] or [_NONE])
            period = SHORT
        else:
            gram, window = period // 2, period - period // 2 + 1
            values = mix(line.astype(np.uint64))
            at = np.arange(len(line) - gram + 1)
            grams = run_hashes(values, at, at + gram)
            np.minimum(grams, _TOP - np.uint64(1), out=grams)
            # runs of lower scales, in this line's places
            old = np.concatenate(out)
            owner = np.searchsorted(first, old[:, 0], "right") - 1
            to = np.full(len(sizes), -1, np.int64)
            to[texts] = base[:-1] - first[texts]
            moved = old + np.stack([to[owner], to[owner], np.zeros_like(owner)], axis=1)
            moved = moved[np.isin(owner, texts)]
            inner = moved[(2 * moved[:, 2] <= gram) & (moved[:, 1] - moved[:, 0] >= gram)]
            plain = ~_marked(len(grams), inner[:, 0], inner[:, 1] - gram + 1)
            ranked = np.where(plain, grams, _TOP)
            picked = np.zeros(len(grams), bool)
            if len(grams) >= window:
                least = np.full(len(grams) + window - 1, np.uint64(0))
                least[window - 1 : len(grams)] = _sliding(ranked, window, True)
                picked = plain & (_sliding(least, window, False) == ranked)
            where = np.flatnonzero(picked)
            seeds = [_pairs(where, grams[where], period, 2 * period), _touching(line, moved, period, 2 * period)]
            at, lag = (np.concatenate([s[k] for s in seeds]) for k in (0, 1))
            here = _extend(line, values, at, lag) if len(at) else _NONE
            period *= 2
        out.append(here + np.stack([back[here[:, 0]], back[here[:, 0]], np.zeros(len(here), np.int64)], axis=1))
        texts = texts[sizes[texts] >= 2 * period]
        out = [_smallest(np.concatenate(out))]
    return out[0] if len(out) == 1 else _smallest(np.concatenate(out))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of the periods of one stretch, all multiples of the smallest, that one."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = np.zeros(len(runs), bool)
    again[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    return runs[~again]


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, and each row's first word (n + 1)."""
    parts = pc.split_pattern_regex(pc.fill_null(text, ""), r"[\x09-\x0D\x20]+")
    flat = parts.flatten()
    kept = pc.not_equal(flat, "")
    ends = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False))))
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return flat.filter(kept), ends[offsets]


OUT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _described(words: pa.Array, first: np.ndarray) -> dict[str, list]:
    codes = words.dictionary_encode().indices.to_numpy()
    runs = find_runs(codes, first)
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    edge = np.searchsorted(owner, np.arange(len(first)))
    gone = _marked(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])
    left = words.filter(pa.array(~gone)).to_pylist()
    ends = np.concatenate(([0], np.cumsum(~gone)))[first]
    got = {k: [] for k in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")}
    for i in range(len(first) - 1):
        mine = runs[edge[i] : edge[i + 1]]
        all_runs = sorted(((s - first[i], e - s, q) for s, e, q in mine.tolist()), key=lambda r: (r[0], r[2]))
        best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        got["n_words"].append(int(first[i + 1] - first[i]))
        got["n_runs"].append(len(all_runs))
        for k, v in zip(("start", "length", "period"), best):
            got[k].append(v if v is None else int(v))
        got["exponent_milli"].append(None if best[0] is None else int(1000 * best[1] // best[2]))
        got["runs"].append([{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in all_runs])
        got["collapsed"].append(" ".join(left[ends[i] : ends[i + 1]]))
    return got


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_runs, the longest run (start, length,
    period, exponent_milli; of equal lengths the first, then that of the shorter
    period; nulls without one), all ``runs`` by start and period, and the
    ``collapsed`` text: words that some run repeats left out, the rest joined by
    one blank.

    A row's result depends on its text alone: nothing is shuffled, equal rows have
    equal results, and null ids stay null. Null and empty texts have no words and
    no runs; very long texts are worked on whole, in memory of some 200 bytes a
    word; an empty table gives no rows. Other columns are not read.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in pieces(b.column("text")):
                words, first = _words(b.column("text").slice(i, n))
                got = _described(words, first)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, n), *(pa.array(got[f.name], f.type) for f in fields)], ["id", *(f.name for f in fields)])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    long = pa.int64()
    run = pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))
    fields = [*(pa.field(k, long) for k in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")), pa.field("runs", run), pa.field("collapsed", pa.string())]
    return slim.mapInArrow(step, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of ``docs``, one text in ten made periodic from a word on, by the crc32
    of its id: the words there repeat the first of them. Rows without an id stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    x = docs.select(id_col, text_col).withColumns({"_g": F.floor(h / 10).cast("long"), "_w": F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)")))})
    x = x.withColumn("_n", F.size("_w").cast("long"))
    x = x.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    x = x.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)
    word = lambda i: F.get(F.col("_w"), F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), word), " ")
    return x.withColumn(text_col, F.when(F.col("_n") > 0, made).otherwise(F.col(text_col))).select(id_col, text_col)
