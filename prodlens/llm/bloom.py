"""A Bloom filter of 64-bit hashes with a bounded size, filled by Spark tasks slice by slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prodlens.llm.text import map_batches, mix

HASHES = 6
MOST_BITS = 2**28  # 32 MB; beyond about 20 million keys more and more strangers pass
SLICES = 64


def _place(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit of the filter for each hash."""
    return mix(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bits)


def build(keys: DataFrame, n: int, bits_per_key: int = 24) -> np.ndarray:
    """The filter of the one bigint column of ``keys``, about ``n`` rows. Each slice is filled by one
    task; the driver receives the finished slices, 32 MB at most together."""
    bits = min(MOST_BITS, max(2**16, 2 ** (bits_per_key * n).bit_length()))
    width, column = bits // SLICES, keys.columns[0]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = np.unique(batch.column(column).to_numpy()).view(np.uint64)
        places = np.unique(np.concatenate([_place(hashes, i, bits) for i in range(HASHES)]))
        rows = []
        for part in np.split(places, np.flatnonzero(np.diff(places // np.uint64(width))) + 1):
            rows.append((int(part[0]) // width, (part % np.uint64(width)).astype(np.uint32).tobytes()))
        slices, within = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(within, pa.binary())], names=["slice", "places"])

    def fill(batches):
        key, own = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("places").to_pylist()):
                if k != key:
                    if key is not None:
                        yield done()
                    key, own = k, np.zeros(width, bool)
                own[np.frombuffer(raw, np.uint32)] = True
        if key is not None:
            yield done()

    placed = map_batches(keys, work, "slice int, places binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(bits // 8, np.uint8)
    for row in placed.mapInArrow(fill, "slice int, bits binary").collect():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def contains(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be keys; one that is a key always passes."""
    bits, left = len(flags) * 8, np.arange(len(hashes))
    for i in range(HASHES):
        at = _place(hashes[left], i, bits)
        left = left[(flags[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out
