"""A filter over 64-bit keys, built on executors, of a fixed greatest size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix

#: log2 of the bits of one slice, and of the slices that a sieve has at most (32 MB)
SLICE, MOST = 19, 9


class Sieve:
    """Two bits a key in one slice of bits. What was put in always passes; other
    keys pass now and then, so a sieve only saves work and decides nothing."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    @staticmethod
    def places(keys: np.ndarray, log: int):
        """A key's slice and its two bits there."""
        h = mix(keys)
        part = (h >> np.uint64(64 - log)).astype(np.int64) if log else np.zeros(len(h), np.int64)
        low = np.uint64((1 << SLICE) - 1)
        return part, (h & low).astype(np.int64), (h >> np.uint64(SLICE) & low).astype(np.int64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        part, a, b = self.places(keys, self.log)
        out = np.ones(len(keys), bool)
        for at in (a, b):
            at += part << SLICE
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def sieve(keys: DataFrame, most: int = MOST):
    """Broadcast Sieve of a column of longs. Each slice is filled where its keys
    meet; the driver sees 2**(SLICE + most) bits at most, whatever the corpus."""
    n, log = keys.count(), 0
    while log < most and n * 8 > 1 << SLICE + log:
        log += 1

    def dealt(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(Sieve.places(k.view(np.uint64), log)[0]), pa.array(k)], ["slice", "key"])

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            _, x, y = Sieve.places(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), log)
            part = b.column(0).to_numpy(zero_copy_only=False)
            for s in np.unique(part).tolist():
                bits = own.setdefault(s, np.zeros(1 << SLICE, bool))
                bits[x[part == s]] = bits[y[part == s]] = True
        for s, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    out, size = np.zeros(1 << SLICE + log - 3, np.uint8), 1 << SLICE - 3
    filled = keys.mapInArrow(dealt, "slice long, key long").repartition(min(1 << log, 128), "slice").mapInArrow(fill, "slice long, bits binary")
    for r in filled.toLocalIterator():
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Sieve(out, log))
