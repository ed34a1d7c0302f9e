"""SentencePiece merges with seeded dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import flat, mix, pieces, word_hashes

SEED, DROPOUT = 20_240_501, 0.1
#: characters of a unit from which its agenda is a heap
LONG = 256
#: occurrences with a skipped candidate that are segmented at once
SLAB = 1 << 15
#: bytes of text that are encoded at once
PORTION = 1 << 18
SPACE, MARK = 0x20, "▁"


class PieceModel:
    """Merge-type model: piece bytes, scores, and what each pair merges to.

    A pair is looked up in tables of 2**20 slots; pairs that collide in one
    table stand in the next.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.space = ids[MARK]
        self.of_char[ord(MARK)] = -1
        self.of_byte = np.zeros(256, np.int32)
        raw = [b""] * self.size
        for i in range(self.size):
            if sp.is_byte(i):
                self.of_byte[int(names[i][3:5], 16)] = i
                raw[i] = bytes([int(names[i][3:5], 16)])
        for name, i in ids.items():
            raw[i] = name.replace(MARK, " ").encode()
        self.length = np.array([len(r) for r in raw])
        self.start = np.r_[0, np.cumsum(self.length)[:-1]]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        pairs = {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                a, b = ids.get(name[:cut]), ids.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs, self.scores = pairs, self.score.tolist()
        keys, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.tables = []
        for k in range(6):
            if not len(keys):
                break
            slot = self._slot(keys, k)
            _, one = np.unique(slot, return_index=True)
            table = np.full(1 << 20, -1, np.int64), np.full(1 << 20, -1, np.int32)
            table[0][slot[one]], table[1][slot[one]] = keys[one], merged[one]
            self.tables.append(table)
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, merged = keys[rest], merged[rest]
        if len(keys):
            raise ValueError("merge pairs don't fit the tables")

    @staticmethod
    def _slot(keys: np.ndarray, k: int) -> np.ndarray:
        odd = np.uint64(0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82A * k & (2**64 - 1) | 1)
        return (keys.astype(np.uint64) * odd >> np.uint64(44)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair merges to, or -1; -1 merges with nothing."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.size + b)
        out = np.full(len(key), -1, np.int32)
        for k, (keys, merged) in enumerate(self.tables):
            slot = self._slot(key, k)
            hit = keys[slot] == key
            out[hit] = merged[slot[hit]]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def skipped(key: np.ndarray, start, middle, end, dropout: float) -> np.ndarray:
    """Whether the candidate that would merge [start, middle) and [middle, end) of
    a unit is skipped: a hash of the unit's key and the three places."""
    if dropout <= 0:
        return np.zeros(len(key), bool)
    place = (np.asarray(start).astype(np.uint64) << np.uint64(42)) ^ (np.asarray(middle).astype(np.uint64) << np.uint64(21)) ^ np.asarray(end).astype(np.uint64)
    return (mix(mix(key ^ place * np.uint64(0xD6E8FEB86659FD93)) + place) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


_WORD = 2**64 - 1


def _mixed(h: int) -> int:
    """``mix`` of one Python int."""
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _WORD
    return h ^ h >> 31


def segment_one(model: PieceModel, symbols: list[int], key: int, dropout: float) -> list[tuple[int, int]]:
    """(piece, end) of one unit by an agenda: candidates leave it by score, then
    place; a skipped candidate does not come back. Plain ints, as numpy calls on
    single values would take most of the time."""
    n, least = len(symbols), dropout * 2.0**53
    piece, end = list(symbols), list(range(1, n + 1))
    left, alive, agenda = list(range(-1, n - 1)), [True] * n, []
    pairs, scores, size = model.pairs, model.scores, model.size

    def offer(i: int):
        j = end[i]
        if j < n and piece[i] >= 0 and piece[j] >= 0:
            m = pairs.get(piece[i] * size + piece[j])
            if m is None:
                return
            if least > 0:  # as in ``skipped``
                place = i << 42 ^ j << 21 ^ end[j]
                if _mixed(_mixed(key ^ place * 0xD6E8FEB86659FD93 & _WORD) + place & _WORD) >> 11 < least:
                    return
            heapq.heappush(agenda, (-scores[m], i, j, end[j], m))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, j, e, m = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == e):
            continue
        piece[i], end[i], alive[j] = m, e, False
        if e < n:
            left[e] = i
            offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [(piece[i], end[i]) for i in range(n) if alive[i]]


def segment(model: PieceModel, symbol: np.ndarray, unit: np.ndarray, keys: np.ndarray, dropout: float, offered: list | None = None):
    """Pieces of many units at once: (unit, first symbol, piece), in order.

    Each round takes the top candidate of every unit's agenda (best score, then
    leftmost) that its hash doesn't skip, and merges it, until no unit has one.
    Units of LONG or more symbols are done one by one with a heap. ``offered``
    takes the candidates of the others: (unit, start, middle, end).
    """
    done = []
    sizes = np.bincount(unit, minlength=len(keys))
    edges = np.r_[0, np.cumsum(sizes)]
    start = np.arange(len(unit)) - edges[unit]
    for u in np.flatnonzero(sizes >= LONG):
        got = segment_one(model, symbol[edges[u] : edges[u + 1]].tolist(), int(keys[u]), dropout)
        begin = np.r_[0, [e for _, e in got[:-1]]].astype(np.int64)
        done.append((np.full(len(got), u), begin, np.array([p for p, _ in got], np.int32)))
    live = sizes[unit] < LONG
    u, s, p, e = unit[live], start[live], symbol[live].astype(np.int32), start[live] + 1
    merged = _candidates(model, u, s, p, e, keys, dropout, np.arange(len(u)), np.full(len(u), -1, np.int32), offered)
    while len(u):
        rank = np.where(merged >= 0, model.score[merged], -np.inf)
        heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        best = np.maximum.reduceat(rank, heads)
        group = np.cumsum(np.r_[0, u[1:] != u[:-1]])
        top = np.flatnonzero((rank == best[group]) & (rank > -np.inf))
        top = top[np.r_[True, group[top][1:] != group[top][:-1]]] if len(top) else top
        over = best[group] == -np.inf
        if over.any():
            done.append((u[over], s[over], p[over]))
        p[top], e[top] = merged[top], e[top + 1]
        stay = ~over
        stay[top + 1] = False
        moved = np.zeros(len(u), bool)
        moved[top] = True
        before = top[(top > 0)] - 1
        before = before[u[before] == u[before + 1]]
        moved[before] = True
        u, s, p, e, merged, moved = (x[stay] for x in (u, s, p, e, merged, moved))
        if len(u):
            merged = _candidates(model, u, s, p, e, keys, dropout, np.flatnonzero(moved), merged, offered)
    u, s, p = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((s, u))
    return u[order], s[order], p[order].astype(np.int32)


def _candidates(model, u, s, p, e, keys, dropout, at, merged, offered=None):
    """Renew what the symbols at ``at`` merge to with their right neighbours."""
    last = at == len(u) - 1
    nxt = np.where(last, at, at + 1)
    m = model.merge(p[at], p[nxt])
    m[last | (u[nxt] != u[at])] = -1
    ok = np.flatnonzero(m >= 0)
    if offered is not None:
        offered.append((u[at[ok]], s[at[ok]], s[nxt[ok]], e[nxt[ok]]))
    if dropout > 0:
        m[ok[skipped(keys[u[at[ok]]], s[at[ok]], s[nxt[ok]], e[nxt[ok]], dropout)]] = -1
    merged[at] = m
    return merged


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one behind the other."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)


def _varied(keys: np.ndarray, which: np.ndarray, long: np.ndarray, offered: list, dropout: float) -> np.ndarray:
    """Occurrences (by their units ``which``) with a key that skips any candidate
    offered to their unit without dropout; all of long units."""
    u, start, middle, end = (np.concatenate(x) for x in zip(*offered))
    order = np.argsort(u, kind="stable")
    start, middle, end = start[order], middle[order], end[order]
    many = np.bincount(u, minlength=len(long))
    first = np.cumsum(many) - many
    found, left = [np.flatnonzero(long[which])], np.flatnonzero(~long[which])
    for c in range(int(many.max(initial=0))):
        left = left[many[which[left]] > c]
        at = first[which[left]] + c
        hit = skipped(keys[left], start[at], middle[at], end[at], dropout)
        found.append(left[hit])
        left = left[~hit]
    return np.sort(np.concatenate(found))


def encode(model: PieceModel, column: pa.Array, id_hash: np.ndarray, seed: int = SEED, dropout: float = DROPOUT):
    """Ids of all texts of one piece, and where each text's begin (n + 1).

    A text gets one blank in front and is cut into units (blanks, then what
    follows up to the next blank); no piece of the vocabulary crosses units.
    An occurrence's key is a hash of its text's id, its number in the text and
    its unit. Equal units are segmented once without dropout; an occurrence with a key
    that skips none of the candidates of that run has the same pieces, each other
    one is segmented by itself. Characters without a piece become byte pieces.
    """
    data, offsets = flat(column)
    rows = len(column)
    filled = np.diff(offsets) > 0
    at = offsets[:-1][filled]
    data = np.insert(data, at, SPACE)
    offsets = offsets + np.r_[0, np.cumsum(filled)]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64), data, offsets
    blank = data == SPACE
    head = blank & ~np.r_[False, blank[:-1]]
    head[offsets[:-1][filled]] = True
    starts = np.flatnonzero(head)
    ends = np.r_[starts[1:], len(data)]
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    number = np.arange(len(starts)) - first[row]
    h = word_hashes(data, starts, ends)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    # symbols of the different units
    size = (ends - starts)[one]
    raw = data[_gather(starts[one], size)]
    edge = np.r_[0, np.cumsum(size)]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    width = np.diff(np.r_[lead, len(raw)])
    padded = np.r_[raw, np.zeros(3, np.uint8)].astype(np.int64)
    code = np.select(
        [width == 1, width == 2, width == 3],
        [padded[lead], (padded[lead] & 0x1F) << 6 | padded[lead + 1] & 0x3F, (padded[lead] & 0x0F) << 12 | (padded[lead + 1] & 0x3F) << 6 | padded[lead + 2] & 0x3F],
        (padded[lead] & 0x07) << 18 | (padded[lead + 1] & 0x3F) << 12 | (padded[lead + 2] & 0x3F) << 6 | padded[lead + 3] & 0x3F,
    )
    symbol = np.where(code == SPACE, model.space, model.of_char[np.minimum(code, 0x10FFFF)])
    unit = np.searchsorted(edge, lead, "right") - 1
    char0 = np.searchsorted(lead, edge[:-1])
    symbols = np.diff(np.r_[char0, len(lead)])
    if dropout > 0:
        key = mix(h ^ mix(mix(id_hash[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)))
        offered, long = [], symbols >= LONG
        short = ~long[unit]
        parts = [segment(model, symbol[short], unit[short], h[one], 0, offered)]
        varied = _varied(key, which, long, offered, dropout)
        for i in range(0, len(varied), SLAB):
            some = varied[i : i + SLAB]
            own = symbols[which[some]]
            u, s, p = segment(model, symbol[_gather(char0[which[some]], own)], np.repeat(np.arange(len(some)), own), key[some], dropout)
            parts.append((u + len(one) + i, s, p))
        u, s, p = (np.concatenate(x) for x in zip(*parts))
    else:
        varied = np.zeros(0, np.int64)
        u, s, p = segment(model, symbol, unit, h[one], 0)
    # forms: units without a skipped candidate, then single occurrences
    of, form = np.r_[np.arange(len(one)), which[varied]], which.copy()
    form[varied] = len(one) + np.arange(len(varied))
    # a symbol without a piece becomes its bytes
    place = char0[of[u]] + s
    many = np.where(p < 0, width[place], 1)
    flat_p = np.repeat(p, many)
    byte = np.flatnonzero(flat_p < 0)
    flat_p[byte] = model.of_byte[raw[_gather(lead[place], many)[byte]]]
    per_form = np.bincount(u, many, len(of)).astype(np.int64)
    form_at = np.r_[0, np.cumsum(per_form)]
    count = per_form[form]
    ids = flat_p[_gather(form_at[form], count)]
    total = np.r_[0, np.cumsum(count)]
    return ids, total[first], data, offsets


def decode(model: PieceModel, ids: np.ndarray, bounds: np.ndarray):
    """Bytes of all texts and where each begins: pieces' bytes one behind the
    other, without the blank put in front of each."""
    length = model.length[ids]
    out = model.bytes[_gather(model.start[ids], length)]
    at = np.r_[0, np.cumsum(length)][bounds]
    drop = np.zeros(len(out), bool)
    drop[at[:-1][np.diff(at) > 0]] = True
    return out[~drop], at - np.r_[0, np.cumsum(np.diff(at) > 0)]


def encode_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
    seed: int = SEED, dropout: float = DROPOUT,
) -> DataFrame:
    """``(id, ids array<int>, n_pieces, lossless)``: each whole text's piece ids, and
    whether decoding them gives back its very bytes.

    A null text gives null ids and a null ``lossless``, an empty one no ids. Rows
    that repeat (same id and text) get the same ids; the same text under
    another id gets other segmentations unless ``dropout`` is 0. Rows with a null id
    share one key, as rows with any one id do. Very long texts are encoded whole, in
    memory of some 100 bytes a character; other columns are not read, whatever
    their names; an empty table gives no rows. Of merges with one score the first in
    the text comes first. The model is read on each executor from ``model_path``.
    """
    path = model_path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for b in batches:
            for i, n in pieces(b.column(1), PORTION):
                part = b.column(1).slice(i, n)
                hashed = b.column(2).slice(i, n).to_numpy(zero_copy_only=False).view(np.uint64)
                ids, bounds, _, _ = encode(model, part, hashed, seed, dropout)
                back, at = decode(model, ids, bounds)
                data, offsets = flat(part)
                same = np.diff(at) == np.diff(offsets)
                if same.all():
                    wrong = np.add.reduceat(np.r_[back != data, False], np.minimum(offsets[:-1], len(data))) if len(data) else np.zeros(n)
                    same &= ~((wrong > 0) & (np.diff(offsets) > 0))
                else:
                    same = np.array([back[at[k] : at[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(n)])
                gone = ~np.asarray(part.is_valid())
                arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.r_[gone, False]), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), arrays, pa.array(np.diff(bounds), mask=gone), pa.array(same, mask=gone)],
                    [id_col, "ids", "n_pieces", "lossless"],
                )

    return docs.select(id_col, text_col, F.xxhash64(F.col(id_col)).alias("h")).mapInArrow(run, f"{id_col} {kind}, ids array<int>, n_pieces long, lossless boolean")


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``(id, text)`` from piece ids; a null list gives a null text, an empty one an empty
    text. Rows are independent: repeated and null ids stay, long lists are decoded
    whole, other columns are not read, an empty table gives no rows."""
    path = model_path or default_model()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for b in batches:
            ids = b.column(1)
            bounds = np.r_[0, np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))]
            back, at = decode(model, ids.flatten().to_numpy(zero_copy_only=False), bounds)
            texts = [back[at[k] : at[k + 1]].tobytes().decode() if ok else None for k, ok in enumerate(np.asarray(ids.is_valid()).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
