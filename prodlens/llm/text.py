"""Words, word hashes and shingles of whole texts, as NumPy arrays inside Spark tasks.

A word is a run of bytes that are not space or ``\\x09-\\x0D``; ``bytes.split()`` cuts exactly
there, and ``bytes.lower()`` lower-cases A-Z only. Texts therefore reach Python as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# words remembered per Python worker, and the longest of them; the memory is forgotten when full
REMEMBERED_WORDS = 150_000
LONGEST_REMEMBERED = 64
# a task holds arrays of some tens of bytes per byte of text for so much text at once
PART_BYTES = 2_000_000


def as_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


class Memory(dict):
    """A dictionary that computes a missing value from its key. It is bounded in bytes: it keeps at most
    ``limit`` keys and none longer than ``LONGEST_REMEMBERED``, which is computed each time."""

    every: list[Memory] = []

    def __init__(self, compute: Callable, limit: int = REMEMBERED_WORDS):
        super().__init__()
        self.compute, self.limit = compute, limit
        Memory.every.append(self)

    def __missing__(self, key):
        if len(key) > LONGEST_REMEMBERED:
            return self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_LAST_USER = [""]


def forget_others(user: str) -> None:
    """Empty all memories of this Python worker if operators of another module filled them, so that a
    worker that lives through many stages holds what one of them needs."""
    if _LAST_USER[0] != user:
        for memory in Memory.every:
            memory.clear()
        _LAST_USER[0] = user


_WORD_HASHES = Memory(xxhash.xxh64_intdigest)


def hash_words(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        acc ^= acc >> np.uint64(32)
    return mix(acc)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, lower-cased; a text with fewer words than
    ``width`` is one shingle of all its words, a text without words has none."""
    words = hash_words(text.lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``PART_BYTES`` of ``text`` or one row."""
    if not batch.num_rows:
        return
    if "text" not in batch.schema.names:
        yield batch
        return
    column = batch.column("text")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    ends, at = raw[column.offset : column.offset + batch.num_rows + 1].astype(np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_BYTES, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``work`` on every Arrow batch of ``df``, in parts of at most ``PART_BYTES`` of ``text`` or one row,
    so that what a task builds from texts stays small however many rows a batch has."""

    user = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(user)
        for batch in batches:
            for part in parts_of(batch):
                if (out := work(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, kind))
