"""SimHash near-dedup: exact links within a radius, by tiles of fingerprints."""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import cut
from .text import FOLD, as_binary, flat, mix, pieces, run_hashes, spans, word_hashes

RADIUS = 3
BLOCKS = 5
SHINGLE = 3
SEED = 42
#: rows of one side of a tile
TILE = 1024
#: a bucket with more different fingerprints than this is dealt out by tile pairs
MOST = 32 * TILE


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one text; no word gives zero, fewer words one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[j:] for j in range(shingle)))]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(grams), 1 << 15):
        part = grams[i : i + (1 << 15)]
        h = np.fromiter((digest(g, seed) for g in part), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(grams), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` for each row; a null or empty text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in as_binary(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of each pair (i, j); a label is the class's least index."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


#: pairs of a pair of tiles whose sketches are compared at once
PAIRS = 1 << 16


def _alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have sketches within SKETCH_RADIUS bits."""
    return np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= SKETCH_RADIUS


def near(x: np.ndarray, radius: int = RADIUS, tile: int = TILE, sketch: np.ndarray | None = None) -> np.ndarray:
    """Class (least index) of each of one bucket's fingerprints; pairs within the
    radius link, with ``sketch`` only where their sketches are alike too.

    Every pair of tiles is compared whole, by exclusive or and bit count; rows
    are in order of population count, so a pair of tiles whose counts differ
    by more than the radius is skipped: none of its pairs can be that near.
    """
    order = np.argsort(np.bitwise_count(x), kind="stable")
    y = x[order]
    count = np.bitwise_count(y).astype(np.int16)
    labels = np.arange(len(y))
    for s in range(0, len(y), tile):
        for t in range(s, len(y), tile):
            if count[t] - count[min(s + tile, len(y)) - 1] > radius:
                break
            i, j = np.nonzero(np.bitwise_count(y[s : s + tile, None] ^ y[None, t : t + tile]) <= radius)
            if s == t:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), PAIRS):
                a, b = i[c : c + PAIRS] + s, j[c : c + PAIRS] + t
                if sketch is not None:  # of pairs that aren't in one class yet
                    new = labels[a] != labels[b]
                    a, b = a[new], b[new]
                    ok = _alike(sketch, order[a], order[b])
                    a, b = a[ok], b[ok]
                labels = _merge(labels, a, b)
    back = np.empty(len(y), np.int64)
    back[order] = order[labels]
    return back


def _links_of(keys: np.ndarray, x: np.ndarray, nodes: np.ndarray, radius: int, sketch: np.ndarray | None = None):
    """Spanning links of all buckets in rows sorted by key, each compared in tiles."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    for e, size in zip(edges[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = near(x[e : e + size], radius, sketch=None if sketch is None else sketch[e : e + size])
        hit = np.flatnonzero(own != np.arange(size))
        found_a.append(nodes[e + hit])
        found_b.append(nodes[e + own[hit]])
    return np.concatenate(found_a), np.concatenate(found_b)


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``(fp, node)`` within the radius.

    Two fingerprints that differ in at most ``radius`` bits agree in
    ``blocks - radius`` of ``blocks`` blocks of bits, so a bucket per choice of
    so many blocks and their value holds every such pair; a bucket's tiles are
    then compared exactly. More blocks give more but smaller buckets: by default
    ten of 25 or 26 bits.
    """
    if not blocks > radius:
        raise ValueError("blocks must exceed the radius")
    edge = [64 * k // blocks for k in range(blocks + 1)]
    value = [F.shiftrightunsigned(F.col("fp"), a).bitwiseAND((1 << (b - a)) - 1) for a, b in pairwise(edge)]
    chosen = combinations(range(blocks), blocks - radius)
    keys = F.array(*(F.xxhash64(F.lit(n), *(value[k] for k in of)) for n, of in enumerate(chosen)))
    rows = distinct.select("fp", "node", F.explode(keys).alias("bucket"))
    return bucket_links(rows, radius, most)


def bucket_links(rows: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """Links (a, b) that join the fingerprints within the radius in each bucket of
    ``(fp, node, bucket)``, compared tile by tile.

    A bucket of more than ``most`` rows is dealt out by pairs of tiles (population
    count and part), each pair of tiles to its own unit, so that no task grows
    with it. A unit gives the links of a spanning forest, never all its pairs. Rows
    with a ``sketch`` (array of longs) link where these are alike too.
    """
    more = ["sketch"] if "sketch" in rows.columns else []
    rows = rows.withColumn("pop", F.bit_count("fp"))
    counts = rows.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    hot = counts.groupBy("bucket").agg(F.sum("n").alias("all")).where(F.col("all") > most).select("bucket")
    parts = counts.join(hot, "bucket").select("bucket", "pop", F.ceil(F.col("n") / (most // 4)).alias("parts"))
    tiles = parts.select("bucket", "pop", "parts", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    other = tiles.select("bucket", F.col("pop").alias("pop2"), F.col("part").alias("part2"))
    units = tiles.join(other, "bucket").where(F.abs(F.col("pop") - F.col("pop2")) <= radius).select(
        "bucket", "pop", "parts", "part",
        F.xxhash64("bucket", F.least(F.struct("pop", "part"), F.struct(F.col("pop2").alias("pop"), F.col("part2").alias("part"))),
                   F.greatest(F.struct("pop", "part"), F.struct(F.col("pop2").alias("pop"), F.col("part2").alias("part")))).alias("unit"),
    )
    plain = rows.join(hot, "bucket", "left_anti").select(F.xxhash64("bucket").alias("unit"), "fp", "node", *more)
    dealt = (
        rows.join(parts, ["bucket", "pop"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .join(units.drop("parts"), ["bucket", "pop", "part"])
        .select("unit", "fp", "node", *more)
    )

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if more:
                cols.append(b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))
            if rest is not None and len(b):
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            elif rest is not None:
                continue
            tail = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            rest = [c[tail:] for c in cols]
            yield out(*(c[:tail] for c in cols))
        if rest is not None:
            yield out(*rest)

    def out(keys, fps, nodes, sketch=None):
        a, b = _links_of(keys, fps.astype(np.int64).view(np.uint64), nodes, radius, None if sketch is None else sketch.view(np.uint64)) if len(keys) else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (
        plain.unionByName(dealt)
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(run, "a long, b long")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)``: which rows are linked at ``radius`` bits or fewer.

    component_id is the least id that can be reached, the row's own included.
    Copies share a fingerprint and are carried as one node (their least id).
    Null and empty texts have fingerprint 0 and are linked like any other; rows
    with a null id take part in no class and keep a null component unless they
    share a fingerprint with others. Very long texts are hashed whole; columns
    other than the two named are not read; an empty table gives no rows.
    """
    prints = cut(with_fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("node")))
    found = connected_components(near_links(distinct.where("node IS NOT NULL"), radius))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


#: bits of a sketch of 512 least hashes that differ at most: half of 1 - 0.77 of them
SKETCH, SKETCH_RADIUS = 512, 59


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, fp, keys, sketch): 64-bit SimHash of the shingles, a hash of each band of
    ``rows`` least shingle hashes, and one bit of each of SKETCH least hashes (two
    texts of similarity s agree in (1 + s) / 2 of these), of each whole text; no
    word gives zeros and no key."""
    turn = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64)).reshape(2, -1)

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1)):
                data, offsets = flat(b.column(1).slice(i, n))
                data = FOLD[data]
                starts, ends, first = spans(data, offsets)
                words, size = word_hashes(data, starts, ends), np.diff(first)
                many = np.maximum(size - shingle + 1, np.minimum(size, 1))
                row = np.repeat(np.arange(n), many)
                begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                h = run_hashes(words, begin, np.minimum(begin + shingle, first[row + 1]))
                some = np.flatnonzero(many)
                edge = (np.cumsum(many) - many)[some]
                fp, keys, agree = np.zeros(n, np.uint64), np.zeros((len(some), bands), np.uint64), np.zeros((n, SKETCH), np.uint8)
                if len(some):
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    total = np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
                    fp[some] = np.packbits(total * 2 > many[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
                    for k in range(SKETCH):
                        least = np.minimum.reduceat((h ^ turn[0, k]) * (turn[1, k] | np.uint64(1)), edge)
                        least = mix(least + turn[0, k])
                        agree[some, k] = (least & np.uint64(1)).astype(np.uint8)
                        if k < bands * rows:
                            keys[:, k // rows] = mix(keys[:, k // rows] ^ least)
                at = np.zeros(n + 1, np.int32)
                at[1:] = np.cumsum((many > 0) * bands)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).ravel()))
                words_of = np.packbits(agree, axis=1).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(words_of.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(fp.view(np.int64)), lists, sketch], ["id", "fp", "keys", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, fp long, keys array<long>, sketch array<long>")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 20, bands: int = 8, rows: int = 4) -> DataFrame:
    """``(id, fp, component_id)``: classes of texts whose ``shingle``-word shingles are
    similar by 0.8 or more.

    Texts that share the least shingle hashes of one band at least (98 of 100 pairs
    of similarity 0.8) are compared tile by tile: fingerprints within ``radius``
    bits, where 10 differ on average at 0.8, and sketches of 512 least hashes that
    put the similarity at 0.77 or more, which is 0.03 short of the bound as an
    estimate from so many is that exact. (Equal blocks of the fingerprint, as for
    a radius of 3, can't select at such radii.) component_id is the least id that can
    be reached; ids are of any type with an order, null only where a class has no
    other. Copies are one node; texts without a word (null ones too) are one
    class; very long texts are read whole; an empty table gives no rows, and other
    columns are not read.
    """
    of = ["fp", "keys", "sketch"]
    prints = cut(_signed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), shingle, bands, rows))
    distinct = cut(prints.groupBy(*of).agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    buckets = distinct.select("fp", "node", "sketch", F.explode("keys").alias("bucket"))
    found = connected_components(bucket_links(buckets, radius))
    classes = cut(distinct.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(least, "component").select(*of, "component_id"), of).select(F.col("id").alias(id_col), "fp", "component_id")
