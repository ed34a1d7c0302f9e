"""Benchmark decontamination: BM25 over test items, searched by block-max WAND."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import cut
from .text import flat, gram_hashes, pieces, spans, word_hashes

K1, B = 1.2, 0.75
#: words of a passage, and how far the next one starts behind it
PASSAGE, STRIDE = 128, 64
#: items (in order of the score they need) of one block of postings
BLOCK = 2
#: share of a block's need that its most frequent terms may bring unseen
UNSEEN = 0.5
#: share of an item's own score (its text as query) that a passage must reach
LEVEL = 0.6
#: words of the runs compared when verifying, and the share of the question's
#: and of the answer's runs that the document must hold
RUN, OVERLAP = 5, 0.5
#: words of test items indexed and sent out at a time
MOST_WORDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAKS = np.ones(256, bool)
_BREAKS[0x30:0x3A] = _BREAKS[0x61:0x7B] = _BREAKS[0x80:] = False


def _tokens(column: pa.Array):
    data, offsets = flat(column)
    data = _LOWER[data]
    starts, ends, first = spans(data, offsets, _BREAKS)
    return word_hashes(data, starts, ends), first


@dataclass
class ItemIndex:
    """Inverted index of one part of the test items.

    A test item longer than STRIDE words is indexed in sections of at most so many
    (``owner``: whose), so that each fits in some passage.
    Terms are sorted word hashes; ``post`` (n + 1) points into ``item`` and
    ``weight`` (BM25 contributions). ``need`` is the score that counts for each
    item. ``block_post`` points into ``block`` and ``block_max``, each term's
    largest weight in each block of items, without the block's most frequent
    terms; ``rest`` is what must come from the others for a block to matter.
    ``questions`` and ``answers`` are each item's runs and their length.
    """

    ids: list
    owner: np.ndarray
    terms: np.ndarray
    table: np.ndarray
    post: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    need: np.ndarray
    block_post: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    rest: np.ndarray
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[int, np.ndarray]]

    def look_up(self, h: np.ndarray):
        """Number of each word's term; -1 where no item has it."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        same = self.terms[at] == h[maybe]
        out[maybe[same]] = at[same]
        return out


def split_item(words: int, sentence_start: int | None) -> int:
    """Where the answer starts: the last sentence, or the second half."""
    return sentence_start if sentence_start and words // 4 <= sentence_start < words - RUN else words // 2


def build_index(items: list[tuple[object, str]], level: float = LEVEL) -> ItemIndex:
    """Index whole items; null and empty ones can't be found and are left out."""
    kept, hashes, cuts = [], [], []  # of items
    for i, text in items:
        h, _ = _tokens(pa.array([text], pa.string()))
        if len(h):
            last = text.rstrip().rstrip(".?!").rfind(". ")
            before = len(_tokens(pa.array([text[:last]], pa.string()))[0]) if last > 0 else None
            kept.append(i), hashes.append(h), cuts.append(split_item(len(h), before))
    runs = [(_runs(h[:c]), _runs(h[c:])) for h, c in zip(hashes, cuts)]
    owner = [k for k, h in enumerate(hashes) for _ in range(-(-len(h) // STRIDE))]
    hashes = [part for h in hashes for part in np.array_split(h, -(-len(h) // STRIDE))]
    n = len(hashes)
    flat_words = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
    terms, term = np.unique(flat_words, return_inverse=True)
    item = np.repeat(np.arange(n), [len(h) for h in hashes])
    pair, tf = np.unique(term * max(n, 1) + item, return_counts=True)
    t, d = pair // max(n, 1), pair % max(n, 1)
    df = np.bincount(t, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    size = np.array([len(h) for h in hashes], float)
    norm = K1 * (1 - B + B * size[d] / size.mean()) if n else np.zeros(0)
    weight = idf[t] * tf * (K1 + 1) / (tf + norm)
    need = level * np.bincount(d, weight, n)
    # items in order of need, so that a block's items need about the same
    rank = np.empty(n, np.int64)
    rank[np.argsort(need, kind="stable")] = np.arange(n)
    d, owner, need = rank[d], np.array(owner, np.int64)[np.argsort(rank)], np.sort(need)
    order = np.lexsort((d, t))
    t, d, weight = t[order], d[order], weight[order]
    # block maxima: each term's largest weight in each block that has it
    key, where = np.unique(t * max(n, 1) + d // BLOCK, return_inverse=True)
    top = np.zeros(len(key))
    np.maximum.at(top, where, weight)
    kt, kb = key // max(n, 1), key % max(n, 1)
    block_need = need[::BLOCK]
    # a block's most frequent terms, together under a share of its need, open nothing
    order = np.lexsort((top, -df[kt], kb))
    run = np.cumsum(top[order])
    heads = np.r_[True, kb[order][1:] != kb[order][:-1]] if len(kb) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(heads, np.arange(len(run)), 0)) if len(run) else np.zeros(0, np.int64)
    within = run - (run[start] - top[order][start]) if len(run) else run
    unseen = np.zeros(len(key), bool)
    unseen[order] = within <= UNSEEN * block_need[kb[order]]
    rest = block_need - np.bincount(kb, top * unseen, len(block_need)) if len(key) else block_need
    kt, kb, top = kt[~unseen], kb[~unseen], top[~unseen]
    table = np.zeros(1 << 20, bool)
    table[(terms >> np.uint64(44)).astype(np.int64)] = True
    post = lambda x: np.searchsorted(x, np.arange(len(terms) + 1))
    return ItemIndex(
        kept, owner, terms, table, post(t), d, weight, need, post(kt), kb, top, rest, [r[0] for r in runs], [r[1] for r in runs]
    )


def _runs(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Words of a run (RUN, or all of a shorter part), and a part's runs."""
    k = min(RUN, max(len(h), 1))
    return k, np.unique(gram_hashes(h, k))


def _expand(lo: np.ndarray, hi: np.ndarray):
    """(which range, index) of all indices of many ranges."""
    many = hi - lo
    return np.repeat(np.arange(len(lo)), many), np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)


def search(index: ItemIndex, term: np.ndarray, first: np.ndarray):
    """(row, item, score) of every passage and item whose BM25 score, each term
    of the passage counted once, reaches the item's need.

    A passage is two neighbouring halves of STRIDE words. Its upper bound on a
    block is the sum of its terms' block maxima; a block's most frequent terms
    are granted unseen. Only blocks whose bound reaches the least need in them
    are opened, their postings walked and exact scores taken; all else is
    skipped, safely.
    """
    size = np.diff(first)
    halves = -(-size // STRIDE)
    begin = np.cumsum(halves) - halves
    row = np.repeat(np.arange(len(size)), halves)
    half_at = first[:-1][row] + STRIDE * (np.arange(len(row)) - begin[row])
    hit = np.flatnonzero(term >= 0)
    hit = hit[index.block_post[term[hit] + 1] > index.block_post[term[hit]]]
    if not len(hit):
        return
    half = np.searchsorted(half_at, hit, "right") - 1
    width = len(index.terms) + 1
    once = np.unique(half * width + term[hit])
    half, t = once // width, once % width
    which, at = _expand(index.block_post[t], index.block_post[t + 1])
    blocks = len(index.rest)
    key, where = np.unique(half[which] * blocks + index.block[at], return_inverse=True)
    bound = np.bincount(where, index.block_max[at], len(key))
    # a passage starts at a half of its own or at the one before
    own, back = key // blocks, key - blocks
    back = back[(own > 0) & (row[np.maximum(own - 1, 0)] == row[own])]
    starts = np.union1d(key, back)

    def of(keys):
        spot = np.minimum(np.searchsorted(key, keys), len(key) - 1)
        return np.where(key[spot] == keys, bound[spot], 0)

    p = starts // blocks
    joined = (p + 1 < len(row)) & (row[np.minimum(p + 1, len(row) - 1)] == row[p])
    total = of(starts) + np.where(joined, of(starts + blocks), 0)
    for x in starts[total >= index.rest[starts % blocks] * 0.9999].tolist():
        p, k = x // blocks, x % blocks
        words = np.unique(term[half_at[p] : min(half_at[p] + PASSAGE, first[row[p] + 1])])
        words = words[words >= 0]
        _, at = _expand(index.post[words], index.post[words + 1])
        at = at[index.item[at] // BLOCK == k]
        score = np.bincount(index.item[at] - k * BLOCK, index.weight[at], BLOCK)
        need = index.need[k * BLOCK : (k + 1) * BLOCK]
        for j in np.flatnonzero(score[: len(need)] >= need * 0.9999):
            yield int(row[p]), int(index.owner[k * BLOCK + j]), float(score[j])


def _share(own: dict[int, np.ndarray], words: np.ndarray, part: tuple[int, np.ndarray]) -> float:
    """Share of a part's runs that stand in a document's words; ``own`` keeps the
    document's runs of each length."""
    k, runs = part
    if k not in own:
        own[k] = gram_hashes(words, k)
    return float(np.isin(runs, own[k]).mean()) if len(runs) else 1.0


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, score, question_overlap, answer_overlap)``: one row for each
    document and test item found in it.

    Every passage of PASSAGE words (a new one each STRIDE) of every whole text is
    a query; those that reach an item's need are verified: at least OVERLAP of
    the question's and of the answer's RUN-word runs must stand in the
    document; a question or answer of fewer words is one run of all its words,
    and an item of one word is all answer. Words are compared in lower case. Items are indexed in
    parts of bounded size, one at a time on the driver and broadcast; each part is
    one pass over the documents, whose rows are written before the next part is
    built. Null and empty texts and items match nothing; repeated items and
    documents each give their rows; very long texts are searched whole; columns
    other than the four named are not read; no items, no rows.
    """
    ikind, kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {ikind}, score double, question_overlap double, answer_overlap double"
    spark, own = docs.sparkSession, docs.select(id_col, F.lower(text_col).alias(text_col))
    parts = _parts(items, item_col, item_text_col)
    part, found = next(parts, []), None
    while part is not None:
        sent, part = spark.sparkContext.broadcast(build_index(part)), next(parts, None)
        one = own.mapInArrow(_searcher(sent, id_col, item_col, to_arrow_type(items.schema[item_col].dataType)), schema)
        if part is not None:
            one = cut(one)
            sent.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def _parts(items: DataFrame, item_col: str, item_text_col: str):
    """Test items as lists of some MOST_WORDS words, read from the table as they are asked for."""
    part, size = [], 0
    for r in items.select(F.col(item_col), F.lower(item_text_col)).where(F.col(item_text_col).isNotNull()).toLocalIterator():
        part.append((r[0], r[1]))
        size += len(r[1]) // 4 + 1
        if size > MOST_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _searcher(sent: Broadcast, id_col: str, item_col: str, ikind: pa.DataType):
    def run(batches):
        index = sent.value
        for b in batches:
            for i, n in pieces(b.column(1)):
                h, first = _tokens(b.column(1).slice(i, n))
                best: dict[tuple[int, int], float] = {}
                for row, item, score in search(index, index.look_up(h), first):
                    best[row, item] = max(score, best.get((row, item), 0))
                out = []
                last, own = -1, {}
                for (row, item), score in sorted(best.items()):
                    if row != last:
                        last, own = row, {}
                    words = h[first[row] : first[row + 1]]
                    q, a = _share(own, words, index.questions[item]), _share(own, words, index.answers[item])
                    if q >= OVERLAP and a >= OVERLAP:
                        out.append((row, index.ids[item], round(score, 6), q, a))
                rows = pa.array([r[0] for r in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n).take(rows), pa.array([r[1] for r in out], ikind), *(pa.array([r[k] for r in out], pa.float64()) for k in (2, 3, 4))],
                    [id_col, item_col, "score", "question_overlap", "answer_overlap"],
                )

    return run


