"""LM scoring: hashed-context bit predictors under online, gated logistic mixing."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop
from .text import BLANKS, FOLD, flat, mix_int, pieces, spans, word_hashes

#: contexts: the last 1, 2, 3, 4 and 6 bytes, and the word so far
ORDERS = (1, 2, 3, 4, 6, 0)
#: log2 of the most slots of each context's table, and of the least
MOST_BITS, LEAST_BITS = (15, 20, 22, 23, 23, 23), 15
#: a byte is coded in groups of DIGIT bits: the most frequent MORE bytes by their
#: rank in the first group, the next MORE by MORE and their rank in the second, ...
DIGIT, MORE = 4, 15
#: values of one row of counts; the least table has as many
CHUNK = 1 << LEAST_BITS
#: bytes over which weights adapt before they start anew, and between two moves of them
SEGMENT, STEP = 1 << 13, 32
RATE = 0.004
#: one training text in so many sets the weights and is not counted
DEVELOP, ROUNDS, RIDGE, START = 32, 5, 20.0, 0.3
#: end of a text; no UTF-8 text holds this byte
END = 0xFF
#: bytes of text handled at once when counting, when scoring, and in a block of words
COUNT_PIECE, SCORE_PIECE, BLOCK_PIECE = 2 << 20, 2 << 20, 8 << 20
#: bytes whose contexts are hashed at once, segments that are mixed side by side, and
#: groups of bits summed at once: what they need stays in a core's cache
HASH_PIECE, LANES, SUM_PIECE = 1 << 17, 128, 1 << 12
#: units of a predictor's log-odds, the bias's input, and visits that make a context known
UNIT, BIAS, KNOWN = 16, 0.3, 3
#: contexts whose being known picks the weights, and sets of weights
GATES, SETS = (3, 4, 5), 16
_N = len(ORDERS) + 1
_HASH = np.uint32(0x9E3779B1)
_WORD_HASH, _WORD_BACK = 0x01000193, pow(0x01000193, -1, 1 << 32)
#: by value of a group and place: the node that leads to the bit there, and the
#: bit's sign turned round, or 0 where the value is none
_PATH = np.array([[1 << t | v >> DIGIT - t for t in range(DIGIT)] for v in range(1 << DIGIT)])
_AGAINST = np.array([[(1 - 2 * (v >> DIGIT - 1 - t & 1)) * (v >> DIGIT == 0) for t in range(DIGIT)] for v in range(2 << DIGIT)], np.float32)
#: what an input is multiplied by before it is mixed: predictions, then the bias
_SCALE = np.array([1 / UNIT] * len(ORDERS) + [BIAS], np.float32)[:, None]
#: adds up what the inputs give at each place
_SUM = np.tile(np.eye(DIGIT, dtype=np.float32), (_N, 1))
_STOP = np.uint64(mix_int(0x5AFE))
_powers: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _ended(column: pa.Array):
    """Lower-case texts with END behind each, and where each begins."""
    data, offsets = flat(column)
    return np.insert(FOLD[data], offsets[1:], END), offsets + np.arange(len(offsets))


def _so_far(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the part of the current word that stands before each byte."""
    n = len(data)
    if len(_powers[0]) <= n:
        room = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_WORD_HASH, _WORD_BACK)):
            p = np.full(room, base, np.uint32)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p, dtype=np.uint32)
    total = np.zeros(n + 1, np.uint32)
    np.cumsum((data.astype(np.uint32) + np.uint32(1)) * _powers[0][:n], dtype=np.uint32, out=total[1:])
    at = np.zeros(n, np.int64)
    new = np.flatnonzero(BLANKS[data[:-1]]) + 1
    at[new], at[starts] = new, starts
    np.maximum.accumulate(at, out=at)
    return (total[:-1] - total[at]) * _powers[1][at]


def contexts(data: np.ndarray, offsets: np.ndarray):
    """Context hashes at each byte, of what stands before it in its text; one
    context after the other, as each is as large as four times the text."""
    starts, h, order = offsets[:-1], np.full(len(data), 0x7F4A7C15, np.uint32), 0
    wide = data.astype(np.uint32)
    for want in ORDERS:
        while order < want:
            order += 1
            h[order:] ^= wide[:-order]
            for j in range(order):
                # what stands before the text is taken out again
                at = starts + j
                at = at[(at < offsets[1:]) & (at >= order)]
                h[at] ^= wide[at - order]
            h *= np.uint32(0x01000193)
            h += np.uint32(order)
        own = h * _HASH if want else _so_far(data, starts) * _HASH
        own ^= own >> np.uint32(15)
        own *= np.uint32(0x846CA68B)
        own ^= own >> np.uint32(13)
        own *= _HASH
        yield own


def _rows(context: np.ndarray, group: np.ndarray, bits: int, later: np.ndarray | None = None) -> np.ndarray:
    """First of the slots that a context's predictors have for one group of bits.
    The slot of a node (1 and the group's bits so far) lies behind it. ``later``:
    where ``group`` isn't the first one, if known."""
    later = np.flatnonzero(group) if later is None else later
    h, own = context.copy(), context[later]
    h[later] = (own ^ own >> np.uint32(16) ^ (group[later] * 0x2C1B3C6D).astype(np.uint32)) * _HASH
    h >>= np.uint32(32 + DIGIT - bits)
    h <<= np.uint32(DIGIT)
    return h


class Code:
    """Ranks of the bytes by frequency, and how many groups of bits they have."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.empty(256, np.uint8)
        self.rank[np.argsort(-counts, kind="stable")] = np.arange(256)
        self.many = self.rank.astype(np.int64) // MORE + 1

    def events(self, byte: np.ndarray):
        """Groups of bits that code the bytes, in order: byte's place, group, value."""
        many = self.many.take(byte)
        own = np.repeat(np.arange(len(byte)), many)
        value, group = self.rank.take(byte).take(own), np.zeros(len(own), np.int64)
        place = np.flatnonzero(many > 1)
        more = many[place] - 1
        which = np.arange(1, more.sum() + 1) - np.repeat(np.cumsum(more) - more, more)
        later = np.repeat(np.cumsum(many)[place] - many[place], more) + which
        group[later] = which
        value[later] -= (MORE * which).astype(np.uint8)
        return own, group, np.minimum(value, np.uint8(MORE), out=value)


def _hashed(column: pa.Array, data: np.ndarray, offsets: np.ndarray):
    """Spans of whole texts of about HASH_PIECE bytes, and their contexts in turn."""
    for i, n in pieces(column, HASH_PIECE):
        a, b = offsets[i], offsets[i + n]
        yield a, b, contexts(data[a:b], offsets[i : i + n + 1] - a)


def byte_counts(docs: DataFrame, learn: F.Column, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How often each byte, and the end, stands in all texts to learn from; and the
    bytes of all texts."""

    def count(batches):
        n = np.zeros(257, np.int64)
        for b in batches:
            mine = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n[256] += flat(b.column(0))[1][-1]
            n[:256] += np.bincount(FOLD[flat(b.column(0).filter(pa.array(mine)))[0]], minlength=256)
            n[END] += mine.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(n)], ["byte", "n"])

    out = np.zeros(257, np.int64)
    for r in docs.select(text_col, F.coalesce(learn, F.lit(False))).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out[:256], int(out[256])


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """Tables grow with the bytes learned from, to a bound of memory."""
    want = max(LEAST_BITS, int(max(n_bytes, 1) - 1).bit_length())
    return tuple(min(most, want) for most in MOST_BITS)


def predictors(docs: DataFrame, code: Code, bits: tuple[int, ...], text_col: str = "text") -> np.ndarray:
    """Log-odds of a 1 in each slot over all texts, in UNITs, one context's table
    behind the other. A row's slot 1 is even, or odd where the row was visited KNOWN
    times; its slot 0 has no use.

    Each task counts whole texts into its own tables, by the value that a context's
    group of bits takes, and gives their rows of CHUNK values, compressed; rows of
    one chunk are summed where they meet, one at a time, and the bits' counts are
    sums of the values'. The driver sees one byte a slot.
    """
    out, first = np.zeros(sum(1 << b for b in bits), np.int8), np.cumsum((0, *(1 << b for b in bits)))

    def count(batches):
        tables = [np.zeros(1 << b, np.uint32) for b in bits]
        for b in batches:
            for i, n in pieces(b.column(0), COUNT_PIECE):
                column = b.column(0).slice(i, n)
                data, offsets = _ended(column)
                slots: list[list[np.ndarray]] = [[] for _ in bits]
                for s, e, hashes in _hashed(column, data, offsets):
                    own, group, value = code.events(data[s:e])
                    later = np.flatnonzero(group)
                    for k, context in enumerate(hashes):
                        slots[k].append(_rows(context.take(own), group, bits[k], later) | value)
                for k, table in enumerate(tables):
                    # each slot once, in order
                    slot, slots[k] = np.concatenate(slots[k]), []
                    slot.sort()
                    new = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                    table[slot[new]] += np.diff(np.r_[new, len(slot)]).astype(np.uint32)
        for k, table in enumerate(tables):
            rows = table.reshape(-1, CHUNK)
            full = [j for j, r in enumerate(rows) if r.any()]
            blobs = [pa.compress(rows[j].tobytes(), "zstd", asbytes=True) for j in full]
            yield pa.RecordBatch.from_arrays([pa.array([(k << 16) + j for j in full], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, blob in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(pa.decompress(blob.as_buffer(), CHUNK * 4, "zstd"), np.uint32)
                if c in total:
                    total[c] += own
                else:
                    total[c] = own.astype(np.uint64)
        for c, counts in total.items():
            n, both = counts.reshape(-1, 1 << DIGIT).astype(np.float64), np.zeros((CHUNK >> DIGIT, 1 << DIGIT, 2))
            for t in reversed(range(DIGIT)):
                both[:, 1 << t : 2 << t] = n.reshape(-1, 1 << t, 2)
                n = n[:, 0::2] + n[:, 1::2]
            odds = np.clip(np.rint(UNIT * np.log((both[:, :, 1] + 0.3) / (both[:, :, 0] + 0.3))), -127, 127).astype(np.int8)
            odds[:, 1] = odds[:, 1] & -2 | (n[:, 0] >= KNOWN)
            blob = pa.compress(odds.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "odds"])

    parts = docs.select(text_col).mapInArrow(count, "chunk int, counts binary")
    for r in parts.repartition(192, "chunk").mapInArrow(add, "chunk int, odds binary").toLocalIterator():
        at = first[r.chunk >> 16] + (r.chunk & 0xFFFF) * CHUNK
        out[at : at + CHUNK] = np.frombuffer(pa.decompress(r.odds, CHUNK, "zstd"), np.int8)
    return out


class Mixer:
    """Predictors, and the sets of weights that each segment starts from: one for
    each gate (first or later group, and which contexts are known). A set is flat:
    each input's weights at the places of a group."""

    def __init__(self, code: Code, bits: tuple[int, ...], table: np.ndarray):
        self.code, self.bits, self.table = code, np.array(bits), table
        self.first = np.cumsum((0, *(1 << b for b in bits)))[:-1]
        self.weights = np.full((SETS, _N * DIGIT), START, np.float32)

    @cached_property
    def packed(self) -> np.ndarray:
        """For each row and value of a group, the predictions on the way to it, one
        byte each: one place to look at instead of DIGIT. Made in each worker."""
        rows = self.table.reshape(-1, 1 << DIGIT)
        out = np.empty((len(rows), 1 << DIGIT, DIGIT), np.int8)
        for t in range(DIGIT):
            out[:, :, t] = rows.take(_PATH[:, t], 1)
        return out.reshape(-1).view(np.uint32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "packed"}

    def found(self, byte: np.ndarray, hashes, out: np.ndarray | None = None):
        """The groups of bits of some bytes, in order: byte's place, value, set of
        weights, and the packed predictions, a row of ``out`` for each context."""
        own, group, value = self.code.events(byte)
        gate, later = (group > 0).astype(np.uint8), np.flatnonzero(group)
        out = np.empty((len(ORDERS), len(own)), np.uint32) if out is None else out
        for k, (context, bits) in enumerate(zip(hashes, self.bits.tolist())):
            row = _rows(context.take(own, mode="clip"), group, bits, later)
            row |= value
            self.packed[self.first[k] : self.first[k] + (1 << bits)].take(row, mode="clip", out=out[k])
        for k in reversed(GATES):
            gate = gate << np.uint8(1) | (out[k] & np.uint32(1)).astype(np.uint8)
        return own, value, gate, out

    def inputs(self, byte: np.ndarray, context: np.ndarray):
        """What the groups of bits of some bytes are predicted from: byte's place,
        value, set of weights, and the inputs, laid out like a set."""
        own, value, gate, found = self.found(byte, context.T)
        return own, value, gate, self._laid_out(found)

    @staticmethod
    def _laid_out(found: np.ndarray) -> np.ndarray:
        x = np.empty((found.shape[1], _N * DIGIT), np.float32)
        np.multiply(np.ascontiguousarray(found.T).view(np.int8), np.float32(1 / UNIT), out=x[:, :-DIGIT])
        x[:, -DIGIT:] = BIAS
        return x

    @staticmethod
    def chances(z: np.ndarray, against: np.ndarray) -> np.ndarray:
        """Of each bit, from the log-odds of a 1, which are clipped on both sides so
        that the chances of a 0 and of a 1 add up to 1."""
        np.clip(z, np.float32(-11), np.float32(11), out=z)
        z *= against
        np.exp(z, out=z)
        z += 1
        return np.reciprocal(z, out=z)

    def log2_losses(self, column: pa.Array) -> np.ndarray:
        """Bits that each text (and its end) costs.

        Texts are cut into segments that are coded side by side, STEP bytes at a
        time. The gate's weights, and what the segment has added to them, mix the
        log-odds; after each step the segment's weights move along the gradient
        of the step's cost.

        Inputs stay in UNITs, weights are scaled instead. A step is a grid of groups
        of bits by segments for each input; places behind a segment's groups of this
        step have no sign: their bits cost one each, which is taken off, and move nothing.
        """
        data, offsets = _ended(column)
        edge = np.zeros(len(data) + 1, np.int64)
        np.cumsum(self.code.many.take(data), out=edge[1:])
        found, value, gate = np.empty((len(ORDERS), edge[-1]), np.uint32), np.empty(edge[-1], np.uint8), np.empty(edge[-1], np.uint8)
        for s, e, hashes in _hashed(column, data, offsets):
            own = slice(edge[s], edge[e])
            _, value[own], gate[own], _ = self.found(data[s:e], hashes, found[:, own])
        size = np.diff(offsets)
        many = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), many)
        begin = offsets[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(begin + SEGMENT, offsets[1:][text]) - begin
        # alike in groups of bits a byte, so that grids are full, then in length
        order = np.lexsort((-length, (edge[begin + length] - edge[begin]) * 8 // np.maximum(length, 1)))
        order = np.concatenate([g[np.argsort(-length[g], kind="stable")] for g in np.split(order, range(LANES, len(order), LANES))])
        text, begin, length = text[order], begin[order], length[order]
        # an input's weights at the places of a group, as one number of 16 bytes
        sets = np.ascontiguousarray((self.weights.reshape(SETS, _N, DIGIT) * _SCALE).transpose(1, 0, 2)).view(np.complex128)[:, :, 0]
        rate = np.float32(-RATE) * _SCALE * _SCALE
        cost = np.zeros(len(order))
        for low in range(0, len(order), LANES):
            start, end, own_cost = begin[low : low + LANES], (begin + length)[low : low + LANES], cost[low : low + LANES]
            added = np.zeros((_N, len(start) * DIGIT), np.float32)
            for j in range(0, int(length[low]), STEP):
                a = int(np.searchsorted(-length[low : low + LANES], -j, "left"))
                here, next_ = edge.take(start[:a] + j), edge.take(np.minimum(start[:a] + j + STEP, end[:a]))
                deep = int((next_ - here).max())
                at = here + np.arange(deep)[:, None]
                outside = at >= next_
                at = at.ravel()
                x = found.take(at, 1, mode="clip").view(np.int8).astype(np.float32).reshape(_N - 1, deep, -1)
                w = sets.take(gate.take(at, mode="clip"), 1, mode="clip").view(np.float32).reshape(_N, deep, -1)
                w += added[:, None, : a * DIGIT]
                against = _AGAINST.take(value.take(at, mode="clip") | outside.ravel().view(np.uint8) << np.uint8(DIGIT), 0, mode="clip").reshape(deep, -1)
                z = np.einsum("ksl,ksl->sl", w[:-1], x)
                z += w[-1]
                chance = self.chances(z, against)
                both = chance[:, 0::2] * chance[:, 1::2]
                own_cost[:a] -= np.log2(both[:, 0::2] * both[:, 1::2]).sum(0, np.float64) + DIGIT * outside.sum(0)
                np.subtract(1, chance, out=chance)
                chance *= against
                added[:-1, : a * DIGIT] += np.einsum("ksl,sl->kl", x, chance) * rate[:-1]
                added[-1, : a * DIGIT] += chance.sum(0) * rate[-1]
        return np.bincount(text, cost, len(size))

    def sums(self, column: pa.Array) -> np.ndarray:
        """Slope and curvature of the cost by the weights, over all bits of the texts."""
        out = np.zeros((SETS, DIGIT, _N, _N + 1))
        data, offsets = _ended(column)
        for s, e, hashes in _hashed(column, data, offsets):
            _, value, gate, found = self.found(data[s:e], hashes)
            order = np.argsort(gate, kind="stable")
            edge = np.searchsorted(gate[order], np.arange(SETS + 1))
            for g, i, j in ((g, i, min(i + SUM_PIECE, edge[g + 1])) for g in range(SETS) for i in range(edge[g], edge[g + 1], SUM_PIECE)):
                own, against = self._laid_out(found.take(order[i:j], 1)), _AGAINST.take(value.take(order[i:j]), 0)
                chance = self.chances(own * self.weights[g] @ _SUM, against)
                slope = own.T @ (against * (1 - chance))
                curve = own.T @ (own * (chance * (1 - chance) @ _SUM.T))
                for t in range(DIGIT):
                    out[g, t, :, 0] += slope[t::DIGIT, t]
                    out[g, t, :, 1:] += curve[t::DIGIT, t::DIGIT]
        return out

    def move(self, sums: np.ndarray) -> None:
        """One Newton step of all sets, held near their start by a ridge."""
        weights = self.weights.reshape(SETS, _N, DIGIT).transpose(0, 2, 1).astype(np.float64)
        slope = sums[..., 0] + RIDGE * (weights - START)
        curve = sums[..., 1:] + RIDGE * np.eye(_N)
        moved = weights - np.linalg.solve(curve, slope[..., None])[..., 0]
        self.weights = moved.transpose(0, 2, 1).reshape(SETS, -1).astype(np.float32)


def fit_mixer(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text") -> Mixer:
    """Predictors counted over the whole texts where ``learn`` holds, but for one in
    DEVELOP, by hash of its id: from those the weights are fitted, by Newton steps
    whose sums are taken where the texts are."""
    counts, _ = byte_counts(docs, learn, text_col)
    code, bits = Code(counts), table_bits(int(counts.sum()))
    learn = F.coalesce(learn, F.lit(False))
    apart = F.pmod(F.xxhash64(id_col), F.lit(DEVELOP)) == 0
    model = Mixer(code, bits, predictors(docs.where(learn & ~apart), code, bits, text_col))
    develop = cut(docs.where(learn & apart).select(F.col(text_col).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the tables' bounded size; a worker unfolds it once
    for _ in range(ROUNDS):
        weights, shape = model.weights, (SETS, DIGIT, _N, _N + 1)

        def run(batches):
            own, out = shared.value, np.zeros(shape)
            own.weights = weights
            for b in batches:
                for i, n in pieces(b.column(0), SCORE_PIECE):
                    out += own.sums(b.column(0).slice(i, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["at", "x"])

        sums = np.zeros(shape)
        for r in develop.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums.flat[r["at"]] = r.x
        model.move(sums)
    shared.unpersist()
    drop(develop)
    return model


def bit_scores(docs: DataFrame, model: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, bits)``: total bits of each whole text and its end, whose
    quotient is bits per byte. A null text is scored as an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the tables' bounded size

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1), SCORE_PIECE):
                part = b.column(1).slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(np.diff(flat(part)[1])), pa.array(shared.value.log2_losses(part))], [id_col, "n_bytes", "bits"]
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, bits double")


# words of the base score


def _words(column: pa.Array):
    """Hashes of each text's lower-case words and its end, and each text's first."""
    parts, counts = [], []
    for i, n in pieces(column):
        data, offsets = flat(column.slice(i, n))
        data = FOLD[data]
        starts, ends, first = spans(data, offsets)
        parts.append(np.insert(word_hashes(data, starts, ends), first[1:], _STOP))
        counts.append(np.diff(first) + 1)
    return (np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))]) if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))


def _zip(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd"), kind)


def _blocks(docs: DataFrame, learn: F.Column, model: Mixer, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of BLOCK_PIECE bytes: a row for each bucket of a block's different
    words, with their counts in learning rows; and one row of its texts, as
    numbers of those words, with what the mixer gives them."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for b in (b.slice(i, n) for b in batches for i, n in pieces(b.column(1), BLOCK_PIECE)):
            cost = [shared.value.log2_losses(b.column(1).slice(i, n)) for i, n in pieces(b.column(1), SCORE_PIECE)]
            h, first = _words(b.column(1))
            words, which = np.unique(h, return_inverse=True)
            train = np.repeat(b.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            n = np.bincount(which[train], minlength=len(words)).astype("<u4")
            bucket = (words >> np.uint64(64 - bits)).astype(np.int32)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows = len(edge) - 1
            size = np.diff(flat(b.column(1))[1])
            texts = _zip(np.concatenate([[b.num_rows], np.diff(first), which]).astype("<u4"))
            numbers = _zip(np.concatenate([size.astype("<f8"), np.concatenate(cost).astype("<f8")]))
            ids = pa.ListArray.from_arrays(pa.array([0] * (rows + 1) + [b.num_rows], pa.int32()), b.column(0))
            none = pa.nulls(1, pa.binary())
            out = [
                pa.array(np.full(rows + 1, block)), pa.array(np.r_[bucket[edge[:-1]], 1 << bits].astype(np.int32)),
                pa.array([words[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:])] + [None], pa.binary()),
                pa.array([_zip(n[s:e]) for s, e in zip(edge[:-1], edge[1:])] + [None], pa.binary()), ids,
                pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array([texts], pa.binary())]) if rows else none,
                pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array([numbers], pa.binary())]) if rows else none,
            ]
            yield pa.RecordBatch.from_arrays(out, ["block", "bucket", "words", "n", "ids", "texts", "numbers"])
            block += 1

    schema = f"block long, bucket int, words binary, n binary, ids array<{kind}>, texts binary, numbers binary"
    return docs.select(id_col, text_col, F.coalesce(learn, F.lit(False))).mapInArrow(run, schema)


def _counted(words: DataFrame, parts: int) -> DataFrame:
    """(block, bucket, counts, total, kinds): where a bucket's words meet, their
    counts in all blocks, in each block's order; total and kinds once a bucket."""

    def flush(held):
        sizes = [len(h) for _, _, h, _ in held]
        _, which = np.unique(np.concatenate([h for _, _, h, _ in held]), return_inverse=True)
        c = np.bincount(which, np.concatenate([n for _, _, _, n in held]).astype(np.float64)).astype("<u8")
        blobs = [_zip(c[w]) for w in np.split(which, np.cumsum(sizes)[:-1])]
        rest = np.zeros(len(held) - 1, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[1] for x in held], pa.int64()), pa.array([x[0] for x in held], pa.int32()), pa.array(blobs, pa.binary()),
                pa.array(np.r_[int(c.sum()), rest]), pa.array(np.r_[int((c > 0).sum()), rest]),
            ],
            ["block", "bucket", "counts", "total", "kinds"],
        )

    def run(batches):
        held = []
        for b in batches:
            for bucket, block, words, n in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held and held[0][0] != bucket:
                    yield flush(held)
                    held = []
                held.append((bucket, block, np.frombuffer(words, "<u8"), _unzip(n, "<u4")))
        if held:
            yield flush(held)

    return words.select("bucket", "block", "words", "n").repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(
        run, "block long, bucket int, counts binary, total long, kinds long"
    )


def lm_scores(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, n_bytes, score, bits_per_byte)``
    of each row: the smoothed unigram base and the mixer, both learned from the rows
    where ``learn`` holds. Scores are log10 probabilities; the mixer's is of the
    whole lower-case text, blanks included, and its end.

    Texts are handled in blocks; the counts of a block's words come back to it by
    bucket of the words' hash, so no task and no broadcast holds the vocabulary.
    Null texts count as empty ones: one token, the end. Each row gets one row:
    repeated ids and null ids too, and very long texts are scored whole. Where
    ``learn`` is null a row is not learned from; with no learning rows both
    models are flat. Columns other than the two named are not read, but by
    ``learn``; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = fit_mixer(docs, learn, id_col, text_col)
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(5, (n_bytes >> 23).bit_length())
    both = cut(_blocks(docs, learn, model, bits, id_col, text_col))
    counted = cut(_counted(both.where("words IS NOT NULL"), min(1 << bits, 2048)))
    total, kinds = counted.agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    norm = total + add * (kinds + 1)
    none = F.lit(None)
    rows = counted.select("block", "bucket", "counts", none.cast(f"array<{kind}>").alias("ids"), none.cast("binary").alias("texts"), none.cast("binary").alias("numbers")).unionByName(
        both.where("words IS NULL").select("block", "bucket", none.cast("binary").alias("counts"), "ids", "texts", "numbers")
    )

    def score(batches):
        held = []
        for b in batches:
            for k, (counts, texts) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist())):
                if texts is None:
                    held.append(_unzip(counts, "<u8"))
                    continue
                c = np.concatenate(held).astype(np.float64)
                nums = _unzip(texts, "<u4").astype(np.int64)
                size, which = nums[1 : 1 + nums[0]], nums[1 + nums[0] :]
                edges = np.cumsum(size) - size
                octets, cost = np.split(_unzip(b.column(5)[k].as_py(), "<f8"), 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(3)[k].values, pa.array(size), pa.array(np.add.reduceat((c[which] > 0).astype(np.int64), edges)), pa.array(np.full(len(size), total)),
                        pa.array(np.add.reduceat(np.log10((c + add) / norm)[which], edges)), pa.array(octets.astype(np.int64)),
                        pa.array(cost * -np.log10(2)), pa.array(cost / np.maximum(octets, 1)),
                    ],
                    [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes", "score", "bits_per_byte"],
                )
                held = []

    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, n_bytes long, score double, bits_per_byte double"
    return rows.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(score, schema)
