"""Substring dedup: matching statistics of documents against FM-index shards."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sieve import sieve
from .store import cut, drop
from .text import as_binary, flat, gram_hashes, mix, pieces, run_hashes, spans, word_hashes

WINDOW = 20
#: words of the runs whose least hash routes a window: few enough for long runs of
#: windows, too many to repeat by chance
GRAM = 9
#: bytes of one shard's segments
SHARD_BYTES = 3_000_000
#: places of one routing hash beyond which its windows are routed one by one
HOT_PLACES = 20_000


class Wavelet:
    """Wavelet matrix of an integer sequence: one packed bit row per level, with
    a count of ones every 64 bits; ``rank`` answers many questions at once."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n, self.rows, v = levels, len(values), [], values.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = (v >> level & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 + -len(bit) % 64, bool)], bitorder="little").view(np.uint64)
            ones = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.uint32)
            self.rows.append((packed, ones, int((~bit).sum())))
            v = np.concatenate([v[~bit], v[bit]])

    @staticmethod
    def _ones(packed, ones, at):
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[at >> 6].astype(np.int64) + np.bitwise_count(packed[at >> 6] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (packed, ones, zeros) in zip(range(self.levels - 1, -1, -1), self.rows):
            bit = (symbol >> level & 1).astype(bool)
            a, s = self._ones(packed, ones, at), self._ones(packed, ones, start)
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + s, start - s)
        return at - start


class FMIndex:
    """FM-index over integer words (1..), with backward search for many
    patterns at once. Suffixes are ordered by their first ``depth`` words, which
    is all that patterns of up to ``depth`` words need; only the wavelet rows of
    the transform are kept, neither suffixes nor words."""

    def __init__(self, words: np.ndarray, depth: int):
        rank, h = words.astype(np.int64), 1
        while h < depth:
            after = np.r_[rank[h:], np.full(min(h, len(rank)), -1)][: len(rank)] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
            h *= 2
        top = int(words.max(initial=0))
        self.before = np.r_[0, np.cumsum(np.bincount(words, minlength=top + 1))]
        bwt = words[np.argsort(rank, kind="stable") - 1]
        self.tree, self.n = Wavelet(bwt, max(1, top.bit_length())), len(words)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray):
        """Intervals of ``symbol`` followed by what the intervals stand for."""
        base = self.before[symbol]
        return base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)

    def matching(self, words: np.ndarray, ends: np.ndarray, longest: int, least: int = 1):
        """Matching statistics of a streamed text: for each end (exclusive), how
        many of the words before it, ``longest`` at most, stand together at
        ``least`` places of the index, and the interval of that match."""
        lo, hi, live = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.arange(len(ends))
        length = np.zeros(len(ends), np.int64)
        for step in range(1, longest + 1):
            live = live[ends[live] >= step]
            a, b = self.extend(lo[live], hi[live], words[ends[live] - step])
            on = b - a >= least
            live = live[on]
            lo[live], hi[live], length[live] = a[on], b[on], step
        return length, lo, hi


def repeats_in_shard(texts: pa.Array, window: int = WINDOW) -> list[np.ndarray]:
    """For segments in order of first place: which windows occur earlier.

    The segments' words are joined with a different separator behind each, so no
    match leaves its segment. The segments are streamed against the index; a
    window whose matching statistic reaches its whole length at two places or
    more is at the least place of its interval, or a repeat.
    """
    data, offsets = flat(texts)
    starts, ends, first = spans(data, offsets)
    words, sizes = word_hashes(data, starts, ends), np.diff(first)
    edges = np.r_[0, np.cumsum(sizes + 1)]
    _, own = np.unique(words, return_inverse=True)
    text = np.zeros(edges[-1], np.int64)
    inside = np.ones(edges[-1], bool)
    inside[edges[1:] - 1] = False
    text[inside] = own + len(sizes)
    text[~inside] = np.arange(len(sizes))
    index = FMIndex(text, window)
    counts = np.maximum(sizes - window + 1, 0)
    at = np.repeat(edges[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    length, lo, _ = index.matching(text, at + window, window, 2)
    shared = np.flatnonzero(length == window)
    kinds, which = np.unique(lo[shared], return_inverse=True)
    least = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(least, which, at[shared])
    later = np.zeros(len(at), bool)
    later[shared] = at[shared] > least[which]
    return np.split(later, np.cumsum(counts)[:-1])


def _least_at(x: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` neighbouring values stands, the first of equal ones."""
    at, d = np.arange(len(x)), 1
    while 2 * d <= span:
        later = x[d:] < x[:-d]
        x, at, d = np.where(later, x[d:], x[:-d]), np.where(later, at[d:], at[:-d]), 2 * d
    rest = span - d
    return np.where(x[rest:] < x[: len(x) - rest], at[rest:], at[: len(x) - rest]) if rest else at


class _Runs:
    """Anchors of all rows of one piece. An anchor is the place of the least-hashed
    GRAM words of a window; windows that follow each other with the same anchor
    make one run: ``row``, first window ``at``, windows ``size`` and ``route``."""

    def __init__(self, column: pa.Array, window: int):
        self.window = window
        self.data, offsets = flat(column)
        self.starts, self.ends, self.first = spans(self.data, offsets)
        self.words = word_hashes(self.data, self.starts, self.ends)
        counts = np.maximum(np.diff(self.first) - window + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        if not len(row):
            self.row = self.at = self.size = np.zeros(0, np.int64)
            self.route = np.zeros(0, np.uint64)
            return
        grams = gram_hashes(self.words, GRAM)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        anchor = _least_at(grams, window - GRAM + 1)[self.first[row] + at]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        self.row, self.at, self.size, self.route = row[new], at[new], np.diff(np.r_[new, len(row)]), grams[anchor[new]]

    def keep(self, which: np.ndarray) -> None:
        self.row, self.at, self.size, self.route = self.row[which], self.at[which], self.size[which], self.route[which]

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Turn each hot run into runs of one window; returns which runs are hot."""
        many = np.where(hot, self.size, 1)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hot, self.row, self.route = np.repeat(hot, many), np.repeat(self.row, many), np.repeat(self.route, many)
        self.at, self.size = np.repeat(self.at, many) + step, np.where(hot, 1, np.repeat(self.size, many))
        return hot

    def edges(self):
        """First and last (exclusive) word of each run's segment."""
        begin = self.first[self.row] + self.at
        return begin, begin + self.size + self.window - 1

    def segments(self) -> np.ndarray:
        return run_hashes(self.words, *self.edges())

    def again(self, seg: np.ndarray) -> np.ndarray:
        """Whether the same segment stands earlier in its document."""
        order = np.lexsort((seg, self.route, self.row))
        same = np.ones(max(len(order) - 1, 0), bool)
        for x in (seg, self.route, self.row):
            same &= x[order[1:]] == x[order[:-1]]
        out = np.zeros(len(order), bool)
        out[order[1:]] = same
        return out


def _place_keys(seg: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return seg ^ mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + at.astype(np.uint64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _routes(docs: DataFrame, window: int) -> DataFrame:
    """(route, n): how many runs each anchor hash starts, summed by batch."""

    def run(batches):
        for b in batches:
            parts = [_Runs(b.column(0).slice(i, n), window).route for i, n in pieces(b.column(0))]
            route, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([_long(route), pa.array(n)], ["route", "n"])

    return docs.select("text").mapInArrow(run, "route long, n long")


def _places(docs: DataFrame, window: int, often, hot) -> DataFrame:
    """(route, seg, id, part, at, size, hot, again): runs whose anchor may repeat."""

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(2)):
                runs = _Runs(b.column(2).slice(i, n), window)
                runs.keep(often.value.passes(runs.route))
                is_hot = runs.split(hot.value.passes(runs.route))
                seg, own = runs.segments(), pa.array(runs.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(runs.route), _long(seg), b.column(0).slice(i, n).take(own), b.column(1).slice(i, n).take(own),
                        pa.array(runs.at.astype(np.int32)), pa.array(runs.size.astype(np.int32)), pa.array(is_hot), pa.array(runs.again(seg)),
                    ],
                    ["route", "seg", "id", "part", "at", "size", "hot", "again"],
                )

    return docs.mapInArrow(run, "route long, seg long, id long, part int, at int, size int, hot boolean, again boolean")


def _texts_at(docs: DataFrame, window: int, often, wanted) -> DataFrame:
    """(route, seg, id, part, at, words): the text of segments at wanted places."""

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(2)):
                runs = _Runs(b.column(2).slice(i, n), window)
                runs.keep(often.value.passes(runs.route))
                seg, ids = runs.segments(), b.column(0).slice(i, n).to_numpy(zero_copy_only=False)
                on = wanted.value.passes(_place_keys(seg, ids[runs.row], runs.at))
                runs.keep(on)
                begin, end = runs.edges()
                raw, own = runs.data.tobytes(), pa.array(runs.row)
                words = [raw[s:e] for s, e in zip(runs.starts[begin].tolist(), runs.ends[end - 1].tolist())] if len(begin) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(runs.route), _long(seg[on]), b.column(0).slice(i, n).take(own), b.column(1).slice(i, n).take(own),
                        pa.array(runs.at.astype(np.int32)), pa.array(words, pa.binary()),
                    ],
                    ["route", "seg", "id", "part", "at", "words"],
                )

    return docs.mapInArrow(run, "route long, seg long, id long, part int, at int, words binary")


def _searched(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """(route, seg, flags): segments with windows that an earlier segment of their
    shard holds. A shard's index is built from all its segments, and each is
    streamed against it."""

    def search(batches):
        # rows come sorted by shard, then by first place
        shard, held = None, []
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if len(ids) else [0]
            for s, e in zip(edges[:-1], edges[1:]):
                if held and ids[s] != shard:
                    yield flags(held)
                    held = []
                shard = ids[s]
                held.append(b.slice(s, e - s))
        if held:
            yield flags(held)

    def flags(held):
        t = pa.Table.from_batches(held).combine_chunks()
        later = repeats_in_shard(t.column("words").chunk(0), window)
        some = [k for k, x in enumerate(later) if x.any()]
        blobs = pa.array([later[k].astype(np.uint8).tobytes() for k in some], pa.binary())
        some = pa.array(some, pa.int64())
        return pa.RecordBatch.from_arrays([t.column("route").chunk(0).take(some), t.column("seg").chunk(0).take(some), blobs], ["route", "seg", "flags"])

    return (
        texts.select(F.pmod("route", F.lit(shards)).alias("shard"), "route", "seg", "id", "part", "at", "words")
        .repartition(max(shards, 12), "shard")
        .sortWithinPartitions("shard", "id", "part", "at")
        .mapInArrow(search, "route long, seg long, flags binary")
    )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, part, runs array<struct<at int, size int, flags binary>>)``: each document's
    windows that also start earlier (a smaller id, or the same document). A run
    of ``size`` windows starts at ``at``; flags has a byte for each, null is all.
    ``part`` is the hash of the text: rows of one id follow each other by it, and
    rows of one id and text are one document given twice.

    1. Anchors are counted by hash. Equal windows have equal anchors at
       different places, so an anchor that stands once starts no repeat.
    2. The other anchors' runs of windows are segments, known by two hashes.
       Equal segments are pre-aggregated to their first place, so groups of
       copies don't gather anywhere; a hash with very many places is routed on
       window by window. Equal segments repeat whole.
    3. Where different segments share an anchor, the text at each one's first
       place is dealt to shards by route. A shard builds its FM-index and
       streams its segments against it.

    Two broadcast sieves of a fixed greatest size save shuffled rows; they let
    some needless rows pass, and decide nothing. The returned table is written.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("part"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    often = cut(_routes(docs, window).groupBy("route").agg(F.sum("n").alias("n")).where("n > 1"))
    of_routes, of_hot = sieve(often.select("route")), sieve(often.where(F.col("n") > HOT_PLACES).select("route"))
    drop(often)
    places = cut(_places(docs, window, of_routes, of_hot))
    single = places.where("NOT again")
    firsts = cut(single.groupBy("route", "seg", "size", "hot").agg(F.min(F.struct("id", "part", "at")).alias("place"), F.count("*").alias("n")))
    cold = firsts.where("NOT hot")
    kinds = cold.groupBy("route").agg(F.count("*").alias("kinds")).where("kinds > 1").select("route")
    mixed = cut(cold.join(kinds, "route", "left_semi").select("route", "seg", "place.*"))

    def place_keys(batches):
        for b in batches:
            seg, ids, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            yield pa.RecordBatch.from_arrays([_long(_place_keys(seg.view(np.uint64), ids, at))], ["key"])

    of_places = sieve(mixed.select("seg", "id", "at").mapInArrow(place_keys, "key long"))
    at_places = _texts_at(docs, window, of_routes, of_places).join(mixed, ["route", "seg", "id", "part", "at"], "left_semi")
    texts = cut(at_places.dropDuplicates(["route", "seg"]))
    shards = max(1, -(-(texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // SHARD_BYTES))
    later = cut(_searched(texts, shards, window))
    known = firsts.drop("size", "hot").join(later, ["route", "seg"], "left").where("n > 1 OR flags IS NOT NULL").drop("n")
    is_first = F.expr("id = place.id AND part = place.part AND at = place.at")
    hit = single.join(known, ["route", "seg"]).select("id", "part", "at", "size", F.when(is_first, F.col("flags")).alias("flags"), is_first.alias("first"))
    hit = hit.where("NOT first OR flags IS NOT NULL").drop("first")
    inner = places.where("again").select("id", "part", "at", "size", F.lit(None).cast("binary").alias("flags"))
    out = cut(hit.unionByName(inner).groupBy("id", "part").agg(F.collect_list(F.struct("at", "size", "flags")).alias("runs")))
    drop(places, firsts, mixed, texts, later)
    for shared in (of_routes, of_hot, of_places):
        shared.unpersist()
    return out


def _packed(docs: DataFrame) -> DataFrame:
    """(id, part, packed, size, ...): texts compressed for the shuffle; null stays null."""
    schema = docs.schema.simpleString()[7:-1].replace("text:string", "packed:binary,size:bigint", 1)

    def run(batches):
        for b in batches:
            raw, valid = as_binary(b.column(2)), b.column(2).is_valid().to_pylist()
            packed = pa.array([pa.compress(t.as_buffer(), "zstd", asbytes=True) if v else None for t, v in zip(raw, valid)], pa.binary())
            size = pa.array([len(t.as_buffer()) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, size, *b.columns[3:]], ["id", "part", "packed", "size", *b.schema.names[3:]])

    return docs.mapInArrow(run, schema)


def _unpacked(packed: pa.Array, size: pa.Array) -> list[bytes]:
    return [pa.decompress(p.as_buffer(), n.as_py(), "zstd", asbytes=True) if n.as_py() else b"" for p, n in zip(packed, size)]


def _portions(size: pa.Array, at_most: int = 2 << 20):
    """Slices (first row, rows) of about ``at_most`` bytes of text, one row at least."""
    edge, i = np.r_[0, np.cumsum(size.to_numpy(zero_copy_only=False))], 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + at_most, "right")) - 1)
        yield i, j - i
        i = j


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, kept string, n_words, n_removed, text, *carry)``: each row's text without
    its repeats; text is as it was where nothing was removed, else ``kept``.

    A window is ``window`` consecutive words of one document; each word covered by
    a window whose words also start earlier goes, and the others are joined by
    one space. Null and empty texts have no words and give an empty ``kept``;
    texts shorter than a window stay whole, very long ones are handled whole.
    Ids are integers. Rows of one id come in the order of their texts' hash; of
    rows with one id and text each gets the same result, as one document. Rows
    with a null id are kept whole, since they stand before or after nothing.
    Columns in ``carry`` go along with their row; others are not read, whatever
    their names; an empty table gives no rows.
    """
    found = repeated_windows(docs, id_col, text_col, window)
    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("part"), F.col(text_col).cast("string").alias("text"), *more)
    found = found.withColumn("id", F.col("id").cast(kind))
    both = _packed(rows).join(found, ["id", "part"], "left").select("id", "packed", "size", "runs", *(f"c{k}" for k in range(len(carry))))

    def run(batches):
        for b in (b.slice(i, n) for b in batches for i, n in _portions(b.column(2))):
            texts = _unpacked(b.column(1), b.column(2))
            words_of = [t.split() for t in texts]
            count = np.array([len(t) for t in words_of], np.int64)
            edge = np.r_[0, np.cumsum(count + 1)]
            runs = b.column(3)
            at, size, flags = (runs.flatten().field(k) for k in range(3))
            at, size = at.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), np.asarray(runs.value_lengths().fill_null(0)))
            begin = np.repeat(edge[row] + at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            whole = np.ones(len(begin), bool)
            some = np.asarray(flags.is_valid())
            whole[np.repeat(some, size)] = np.frombuffer(b"".join(flags.drop_null().to_pylist()), np.uint8).astype(bool)
            begin = begin[whole]
            change = np.bincount(begin, minlength=edge[-1] + 1) - np.bincount(begin + window, minlength=edge[-1] + 1)
            stay = np.cumsum(change) == 0
            gone = np.zeros(len(texts), np.int64)
            kept, valid = [], b.column(1).is_valid().to_pylist()
            for k, words in enumerate(words_of):
                own = stay[edge[k] : edge[k + 1] - 1]
                gone[k] = len(words) - int(own.sum())
                kept.append(b" ".join(compress(words, own.tolist()) if gone[k] else words))
            after = [(x if g else t) if v else None for x, t, g, v in zip(kept, texts, gone.tolist(), valid)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(after, pa.binary()).cast(pa.string()), *b.columns[4:],
                ],
                ["id", "kept", "n_words", "n_removed", "after", *(f"c{k}" for k in range(len(carry)))],
            )

    schema = f"id {kind}, kept string, n_words long, n_removed long, after string"
    schema += "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    named = [F.col("id").alias(id_col), "kept", "n_words", "n_removed", F.col("after").alias("text"), *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry))]
    return both.mapInArrow(run, schema).select(*named)
