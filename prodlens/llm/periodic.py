"""Runs of repeated words, found by convolution of blocks.

A run is a stretch of words with smallest period q, of length at least ``max(6, 4 q)``, that no
neighbouring word extends. At the scale of blocks of B words (B = 2, 4, 8, ...) the periods from
(2B - 1) / 3 to (4B - 2) / 3 are looked for; every period has one scale, and a run of such a
period holds a whole block that starts at a multiple of B, followed by its own repetition q words
on. For each block the sums of squared differences with all places of the window behind it
are computed at once, as a cyclic convolution by number-theoretic transforms modulo 65537. Words
count as small numbers there, small enough that no sum reaches the modulus, so a sum is the exact
integer and a place of zero mismatch is never missed. Each place's distance is a seed: the words
themselves are compared, and the stretch is extended to both sides until they differ.

Blocks of more than ``LARGEST`` words match by their first ``LARGEST`` words, in windows cut into sections;
the extension compares the rest.

What keeps the work near linear, without loss: a block deep inside a run of a period below a quarter of
the block cannot lie in a run of the scale's periods, so it is skipped; of a block that only
just lies in such a run, seeds count only where the run's end meets an end again, because two runs of
different periods share fewer words than both periods together. Neighbouring blocks with one distance
are extended once.

Texts are taken in parts of some megabytes; all texts of a part are one array with a
number of its own between two texts, so short texts share each transform.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import ship_package
from prodlens.llm.text import as_bytes, map_batches, mix

MODULUS, ROOT = 65537, 3
LARGEST = 1 << 14
SHORTEST, REPEATS = 6, 4
# one matrix product transforms so many numbers; longer transforms are made of two steps or three
RADIX = 64
# numbers transformed at once, and words compared at once
AT_ONCE = 1 << 19


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    table = np.empty(MODULUS - 1, np.int64)
    table[0] = 1
    for i in range(1, MODULUS - 1):
        table[i] = table[i - 1] * base % MODULUS
    return table[exponents % (MODULUS - 1)]


@functools.cache
def _powers() -> np.ndarray:
    return _power(ROOT, np.arange(MODULUS - 1))


@functools.cache
def _matrix(n: int, inverse: bool) -> np.ndarray:
    """The transform of n numbers; sums of n <= 64 products below 2^32 are exact in a double."""
    i = np.arange(n, dtype=np.int64)
    step = (MODULUS - 1) // n
    return _powers()[(-1 if inverse else 1) * step * np.outer(i, i) % (MODULUS - 1)].astype(np.float64)


@functools.cache
def _twiddles(rows: int, columns: int, inverse: bool) -> np.ndarray:
    step = (MODULUS - 1) // (rows * columns)
    angle = np.outer(np.arange(rows, dtype=np.int64), np.arange(columns, dtype=np.int64))
    return _powers()[(-1 if inverse else 1) * step * angle % (MODULUS - 1)]


def _reduce(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^48 modulo 65537, where 2^16 is -1 and 2^32 is 1."""
    x = (x & 0xFFFF) - ((x >> 16) & 0xFFFF) + (x >> 32)
    return x + MODULUS * (x < 0) - MODULUS * (x >= MODULUS)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row, without the division by the length on the way back."""
    many, n = x.shape
    if n <= RADIX:
        return _reduce((x.astype(np.float64) @ _matrix(n, inverse)).astype(np.int64))
    columns = n // RADIX
    # x[columns * r + c] by r, then twiddles, then by c
    first = x.reshape(many, RADIX, columns).transpose(0, 2, 1).reshape(-1, RADIX)
    first = _reduce((first.astype(np.float64) @ _matrix(RADIX, inverse)).astype(np.int64))
    first = _reduce(first.reshape(many, columns, RADIX) * _twiddles(columns, RADIX, inverse))
    second = transform(first.transpose(0, 2, 1).reshape(-1, columns), inverse)
    return second.reshape(many, RADIX, columns).transpose(0, 2, 1).reshape(many, n)


def mismatches(patterns: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row, the sum of squared differences of the pattern with the window at each lag
    that holds it. The window is a power of two, and no sum may reach the modulus."""
    width, size = patterns.shape[1], windows.shape[1]
    padded = np.zeros_like(windows)
    padded[:, 0] = patterns[:, 0]
    padded[:, size - width + 1 :] = patterns[:, :0:-1]  # the pattern backwards, so that products correlate
    product = _reduce(transform(padded) * transform(windows))
    lags = size - width + 1
    common = transform(product, inverse=True)[:, :lags]
    common = _reduce(common * pow(size, -1, MODULUS))
    squares = np.cumsum(windows * windows, axis=1)
    here = squares[:, width - 1 :] - np.pad(squares[:, : lags - 1], ((0, 0), (1, 0)))
    return (here + (patterns * patterns).sum(axis=1, keepdims=True) - 2 * common) % MODULUS


def scale_periods(block: int) -> tuple[int, int]:
    """The smallest and the largest period looked for with blocks of this length."""
    return -(-(2 * block - 1) // 3), (4 * block - 2) // 3


def _levels(words: np.ndarray, width: int) -> np.ndarray:
    """Words as numbers from 0, so few that ``width`` squared differences stay below the modulus."""
    most = math.isqrt((MODULUS - 1) // width) + 1
    return (mix(words.astype(np.uint64) + np.uint64(1)) % np.uint64(most)).astype(np.int64)


class _Known:
    """The run around a stretch of at least ``width`` words, among the runs found so far whose period
    is at most a quarter of that; there is at most one."""

    def __init__(self, runs: np.ndarray, width: int):
        runs = runs[(4 * runs[:, 2] <= width) & (runs[:, 1] - runs[:, 0] >= width)]
        self.runs = runs[np.argsort(runs[:, 0], kind="stable")]
        if len(self.runs):
            # the index of the run that reaches furthest among those that start no later
            ends = self.runs[:, 1]
            reach = np.maximum.accumulate(ends)
            self.furthest = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))

    def around(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the run that holds ``length`` words from each start; -1 where there is none."""
        low, high = np.full(len(starts), -1), np.full(len(starts), -1)
        if len(self.runs) and len(starts):
            at = np.searchsorted(self.runs[:, 0], starts, "right") - 1
            run = self.runs[self.furthest[np.maximum(at, 0)]]
            holds = (at >= 0) & (run[:, 1] >= starts + length)
            low[holds], high[holds] = run[holds, 0], run[holds, 1]
        return low, high


def _seeds(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances of zero mismatch; ``ends`` is where each block's text ends."""
    least, most = scale_periods(block)
    width = min(block, LARGEST)
    levels, size = _levels(words, width), 2 * width
    levels = np.concatenate([levels, np.zeros(size, np.int64)])
    lags = size - width + 1
    found_starts, found_distances = [], []
    at_once = max(1, AT_ONCE // size)
    for first in range(least, most + 1, lags):
        here = starts + first + width <= ends
        section, limit = starts[here], ends[here]
        for i in range(0, len(section), at_once):
            a, e = section[i : i + at_once], limit[i : i + at_once]
            patterns = levels[a[:, None] + np.arange(width)]
            windows = levels[a[:, None] + first + np.arange(size)]
            row, lag = np.nonzero(mismatches(patterns, windows) == 0)
            distance = first + lag
            inside = (distance <= most) & (a[row] + distance + width <= e[row])
            found_starts.append(a[row[inside]])
            found_distances.append(distance[inside])
    if not found_starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_starts), np.concatenate(found_distances)


def _equal_ahead(words: np.ndarray, left: np.ndarray, right: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words, at most ``most``, agree from ``left`` and ``right`` on in direction ``step``. The array
    ends with two different numbers on either side, so no comparison runs out of it."""
    count = np.zeros(len(left), np.int64)
    active, width = np.arange(len(left)), 8
    while len(active):
        for i in range(0, len(active), max(1, AT_ONCE // width)):
            some = active[i : i + max(1, AT_ONCE // width)]
            offset = count[some, None] + np.arange(width)
            a = np.clip(left[some, None] + step * offset, 0, len(words) - 1)
            b = np.clip(right[some, None] + step * offset, 0, len(words) - 1)
            same = words[a] == words[b]
            count[some] += np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            active[i : i + len(some)] = np.where(same.all(axis=1) & (count[some] < most), some, -1)
        active = active[active >= 0]
        width = min(2 * width, AT_ONCE)
    return np.minimum(count, most)


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, in order, in an array of texts. Text i is
    ``words[bounds[i] : bounds[i + 1] - 1]``; the last place of each holds a number that occurs nowhere else."""
    lengths = np.diff(bounds) - 1
    longest = int(lengths.max(initial=0))
    words = np.concatenate([[-1], words, [-2]])  # nothing agrees beyond either end
    runs = np.empty((0, 3), np.int64)
    block = 2
    while REPEATS * scale_periods(block)[0] <= longest:
        least, most = scale_periods(block)
        # blocks at multiples of the block length, counted from the start of the array
        starts = np.arange(block, len(words), block)
        text = np.searchsorted(bounds + 1, starts, "right") - 1
        inside = text < len(lengths)
        starts, text = starts[inside], text[inside]
        ends = bounds[text + 1]  # one more than the last word's place, because of the place in front
        fits = (starts + block + least <= ends) & (lengths[text] >= REPEATS * least)
        starts, ends = starts[fits], ends[fits]
        deep = _Known(runs, block).around(starts, block + least)[0] >= 0
        starts, ends = starts[~deep], ends[~deep]
        a, d = _seeds(words, starts, ends, block)
        width = min(block, LARGEST)
        low, high = _Known(runs, width).around(a, width)
        before, after = np.maximum(low - 1, 0), np.minimum(high, len(words) - 1)
        meets = words[before] == words[np.minimum(before + d, len(words) - 1)]
        meets |= words[after] == words[np.minimum(after + d, len(words) - 1)]
        kept = (low < 0) | meets
        a, d = a[kept], d[kept]
        whole = _equal_ahead(words, a, a + d, 1, block) >= block  # the words and not only their small numbers
        a, d = a[whole], d[whole]
        order = np.lexsort((a, d))
        a, d = a[order], d[order]
        head = np.ones(len(a), bool)
        head[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + block)
        tail = np.append(head[1:], True)[: len(a)]
        first, last, d = a[head], a[tail] + block, d[head]
        left = _equal_ahead(words, first - 1, first - 1 + d, -1, len(words))
        right = _equal_ahead(words, last, last + d, 1, len(words))
        stretch = np.stack([first - left, last + right + d, d], axis=1)
        long = stretch[:, 1] - stretch[:, 0] >= np.maximum(SHORTEST, REPEATS * d)
        runs = np.concatenate([runs, stretch[long]])
        # a stretch whose period is a multiple of its smallest one is found with that one as well
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[new]
        block *= 2
    runs[:, :2] -= 1
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _as_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    ends = np.cumsum([0, *(len(w) + 1 for w in split)])
    words = np.empty(ends[-1], np.int64)
    for i, w in enumerate(split):
        words[ends[i] : ends[i + 1] - 1] = [numbers.setdefault(x, len(numbers)) for x in w]
    words[ends[1:] - 1] = len(numbers) + np.arange(len(split))
    return words, ends, split


def describe_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of greatest exponent (start, length, period,
    exponent_milli), ``runs``, an array of all runs by start and period, and ``collapsed``, the words left
    when of each run only its first period stays, joined by one space.

    Null and empty texts have no runs and an empty ``collapsed``. Repeated rows are described each by
    itself, a null doc_id is kept, other columns are ignored, and no rows give no rows.
    """
    ship_package(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds, split = _as_array([t.as_py() for t in batch.column("text")])
        runs = find_runs(words, bounds)
        owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
        cuts = np.searchsorted(owner, np.arange(len(split) + 1))
        best, collapsed = [], []
        for i, tokens in enumerate(split):
            mine = runs[cuts[i] : cuts[i + 1]]
            mine[:, :2] -= bounds[i]
            if not len(mine):
                best.append((None,) * 4)
                collapsed.append(b" ".join(tokens))
                continue
            start, end, period = min(mine.tolist(), key=_Order)
            best.append((start, end - start, period, 1000 * (end - start) // period))
            change = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 1], -1)
            collapsed.append(b" ".join([t for t, depth in zip(tokens, np.cumsum(change).tolist()) if not depth]))
        parts = [pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])]
        listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
        columns = [batch.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*best)], listed, pa.array(collapsed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return map_batches(rows, work, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


class _Order:
    """Orders runs by falling exponent, an exact fraction, then by start and period."""

    def __init__(self, run: list[int]):
        self.start, self.end, self.period = run

    def __lt__(self, other: _Order) -> bool:
        mine, theirs = (self.end - self.start) * other.period, (other.end - other.start) * self.period
        return (-mine, self.start, self.period) < (-theirs, other.start, other.period)


def digest(described: DataFrame) -> DataFrame:
    """SHA-256 of the list of runs and of the collapsed text in their place."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat_ws("", F.transform(line, lambda s: F.concat(s, F.lit("\n"))))
    return described.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
