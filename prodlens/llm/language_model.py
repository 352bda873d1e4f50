"""Context-tree weighting over bytes, and word-unigram scores beside it.

A text is scored as its words, A-Z lower-cased, with one space between and a line end at the end,
byte by byte and each byte as eight binary decisions. A decision's context is the bits of its
byte so far and the last 0, 1 .. ``depth`` bytes. Every node (context, bits so far) holds the
Krichevsky-Trofimov estimate of the training bits seen there; a node's weighted probability is
half its own estimate and half the product of its children's. A bit's probability therefore
mixes the estimates of all depths along its context, each with the weight the training data gave it.

Training counts are kept as runs of ``depth + 1`` bytes (a gram): tasks count their texts, one
shuffle adds up. The nodes of contexts of ``JOINT`` bytes and more are weighted in buckets, dealt
out by the last ``JOINT`` bytes, which all their nodes share; the few nodes above are summed up by
one aggregate per level and joined back, so no task holds the tree of a frequent byte and none of
it comes to the driver. The result is one log-probability per gram. All grams of all texts are in
the table, those of training texts with their counts and all others with 0, so no lookup misses.

Texts are scored with the most frequent words and grams, which every task holds. What a text has
besides is joined with the rest of the tables, in rounds of texts that bound the disk.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import Stages
from prodlens.llm.text import as_bytes, forget_others, map_batches, mix, parts_of, signed

DEPTH = 5
# contexts from this length on are weighted inside one bucket
JOINT = 3
END = b"\n"
WORD, GRAM = 0, 1
SLICE_BYTES = 1_000_000
# words up to this length are hashed eight bytes at a time, all together
LANES_TO = 64
# counts that a task holds before it adds equal ones up, and those it sends at once
HELD_ROWS = 1_000_000
SENT_ROWS = 200_000
# so many of the most frequent are sent to every task (16 bytes a row); the rest is joined
MOST_WORDS = 2_000_000
MOST_GRAMS = 4_000_000
# a row of a text's words or grams of the rest holds so many of them
REST_ROWS = 1_000
# what one of them takes on disk until its round is over; a round takes at most half as much as all
# texts, or this
REST_BYTES = 40
ROUND_BYTES = 300_000_000
# Spark's setting to delete a query's shuffle files when it is over
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; exact to about 1e-13 for x >= 0.5."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a bit sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def normal(text: bytes, depth: int) -> bytes:
    """What a text is scored as, after ``depth`` bytes that are only context."""
    return END * depth + b" ".join(text.lower().split()) + END


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of the texts one after the other and each text's length, about a megabyte at a
    time: each byte takes some hundred bytes in arrays."""
    at, held = 0, 0
    for i, text in enumerate(texts, 1):
        held += len(text)
        if held >= SLICE_BYTES or i == len(texts):
            part = texts[at:i]
            yield np.frombuffer(b"".join(part), np.uint8), np.array([len(t) for t in part], np.int64)
            at, held = i, 0


def grams_of(data: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The gram of every byte of the texts but the first ``depth`` of each."""
    code = np.zeros(max(len(data) - depth, 0), np.int64)
    for i in range(depth + 1):
        code <<= 8
        code |= data[i : i + len(code)]
    own = np.ones(len(data), bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(depth):
        own[starts + i] = False
    return code[own[depth:]]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and where each starts."""
    apart = (data == 32) | (data == END[0])
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]  # texts begin and end with a line end
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    keys = sizes.astype(np.uint64)
    left = np.flatnonzero(sizes <= LANES_TO)
    at = 0
    while len(left):
        rest = np.minimum(sizes[left] - at, 8).astype(np.uint64)
        lane = eights[starts[left] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest))
        keys[left] = mix((keys[left] ^ lane) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LANES_TO):
        keys[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return signed(keys), starts


# the key of a text's end; a word's key is this one with the chance of any two hashes
END_KEY = np.int64(np.uint64(xxhash.xxh64_intdigest(END)).view(np.int64))


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, with the sum of their counts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Counts:
    """Counts of one kind that a task has not sent yet."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.rows = kind, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, n.astype(np.int64)))
        self.rows += len(keys)
        if self.rows >= HELD_ROWS:
            self.parts = [_added(*map(np.concatenate, zip(*self.parts)))]
            self.rows = len(self.parts[0][0])
            if self.rows >= HELD_ROWS // 2:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n = _added(*map(np.concatenate, zip(*self.parts)))
            for i in range(0, len(keys), SENT_ROWS):
                k, c = keys[i : i + SENT_ROWS], n[i : i + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, np.int32)), pa.array(k), pa.array(c)], names=["kind", "key", "n"])
        self.parts, self.rows = [], 0


def count_corpus(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): counts of words and grams in training texts; grams of other texts with 0.

    A task adds up what it has counted before it sends it, within ``HELD_ROWS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        words, grams = _Counts(WORD), _Counts(GRAM)
        for batch in batches:
            for part in parts_of(batch):
                texts, held = part.column("text").to_pylist(), part.column("held_out").to_pylist()
                train = [normal(t, depth) for t, h in zip(texts, held) if not h]
                for data, lengths in _slices(train):
                    yield from words.add(*np.unique(words_of(data)[0], return_counts=True))
                    yield from grams.add(*np.unique(grams_of(data, lengths, depth), return_counts=True))
                if train:
                    yield from words.add(np.array([END_KEY]), np.array([len(train)]))
                for data, lengths in _slices([normal(t, depth) for t, h in zip(texts, held) if h]):
                    keys = np.unique(grams_of(data, lengths, depth))
                    yield from grams.add(keys, np.zeros(len(keys), np.int64))
        yield from words.send()
        yield from grams.send()

    counted = docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _nodes(grams: np.ndarray, n: np.ndarray, depth: int, top: int):
    """For each bit of the grams' last byte: the bits before it, the bit, and the nodes of contexts
    from ``depth`` to ``top`` bytes, as (node of each gram, zeros, ones, weight of the own
    estimate); then the nodes of ``top`` bytes and the logs of their weighted probabilities."""
    byte = grams & 255
    for j in range(8):
        prefix, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
        weight, level = None, []
        for d in range(depth, top - 1, -1):
            context = (grams >> 8) & ((1 << (8 * d)) - 1)
            nodes, first, of = np.unique((context << 8) | prefix, return_index=True, return_inverse=True)
            zeros = np.bincount(of, n * (1 - bit), len(nodes))
            ones = np.bincount(of, n * bit, len(nodes))
            own = log_estimate(zeros, ones)
            if weight is None:
                weighted, stay = own, np.ones(len(nodes))
            else:  # the products of the children found in the round before
                below = np.bincount(of[child_first], weight, len(nodes))
                weighted = np.logaddexp(own, below) - np.log(2)
                stay = np.exp(own - np.log(2) - weighted)
            level.append((of, zeros, ones, stay))
            weight, child_first = weighted, first
        yield prefix, bit, level, nodes, weight


def _parent(node: Column, d: int) -> Column:
    """The node of the last ``d`` context bytes above a node, with the same bits so far."""
    context = F.shiftright(node, 8).bitwiseAND(F.lit((1 << (8 * d)) - 1))
    return F.shiftleft(context, 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def _level(children: DataFrame, d: int) -> DataFrame:
    """The nodes of ``d`` context bytes from those of one more: node, zeros, ones, weight, stay."""
    sums = children.groupBy(_parent(F.col("node"), d).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weight")])

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        zeros, ones, below = (batch.column(c).to_numpy() for c in ("zeros", "ones", "weight"))
        own = log_estimate(zeros, ones)
        weighted = np.logaddexp(own, below) - np.log(2)
        columns = [batch.column("node"), *map(pa.array, (zeros, ones, weighted, np.exp(own - np.log(2) - weighted)))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "zeros", "ones", "weight", "stay"])

    return map_batches(sums, weigh, "node long, zeros double, ones double, weight double, stay double")


def _written(stages: Stages, label: str, df: DataFrame) -> DataFrame:
    """``stages.write``, and the shuffle files behind the table are deleted."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stages.write(label, df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def weigh_trees(stages: Stages, grams: DataFrame, depth: int) -> DataFrame:
    """(key, n, logp): the model's log10 probability of every gram's last byte after the others."""
    top = min(depth, JOINT)
    buckets = 2 * int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucket(context: Column) -> Column:
        return F.pmod(F.xxhash64(context.bitwiseAND(F.lit((1 << (8 * top)) - 1))), F.lit(buckets)).alias("bucket")

    dealt = grams.select("key", "n", bucket(F.shiftright("key", 8)))

    def read(table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("key").to_numpy(), table.column("n").to_numpy().astype(float)

    def tops(table):
        found = [(nodes, level[-1][1], level[-1][2], weight) for _, _, level, nodes, weight in _nodes(*read(table), depth, top)]
        return pa.table(dict(zip(("node", "zeros", "ones", "weight"), map(pa.array, map(np.concatenate, zip(*found))))))

    found = _written(stages, "tops", dealt.groupBy("bucket").applyInArrow(tops, "node long, zeros double, ones double, weight double"))
    levels, below = [], found
    for d in range(top - 1, -1, -1):
        below = _written(stages, f"level{d}", _level(below, d))
        levels.append(below)
    # from the root down: a one has probability ``a`` by the estimates so far, which have the weight 1 - ``b``
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    above: DataFrame | None = None
    for d, level in enumerate(reversed(levels)):
        if above is None:
            above = level.select("node", (F.col("stay") * one).alias("a"), (1 - F.col("stay")).alias("b"))
            continue
        up = above.select(F.col("node").alias("up"), F.col("a").alias("a0"), F.col("b").alias("b0"))
        above = level.join(up, _parent(F.col("node"), d - 1) == F.col("up")).select(
            "node", (F.col("a0") + F.col("b0") * F.col("stay") * one).alias("a"), (F.col("b0") * (1 - F.col("stay"))).alias("b")
        )
    needed = found.select(bucket(F.shiftright("node", 8)), _parent(F.col("node"), top - 1).alias("node")).distinct().join(above, "node")

    def leaves(table, upper):
        keys, n = read(table)
        order = np.argsort(upper.column("node").to_numpy())
        nodes, a, b = (upper.column(c).to_numpy()[order] for c in ("node", "a", "b"))
        near, total = (keys >> 8) & ((1 << (8 * (top - 1))) - 1), np.zeros(len(keys))
        for prefix, bit, level, _, _ in _nodes(keys, n, depth, top):
            p = None
            for of, zeros, ones, stay in level:
                estimate = (np.where(bit, ones[of], zeros[of]) + 0.5) / (zeros[of] + ones[of] + 1)
                p = estimate if p is None else stay[of] * estimate + (1 - stay[of]) * p
            at = np.searchsorted(nodes, (near << 8) | prefix)
            total += np.log10(np.where(bit, a[at], 1 - b[at] - a[at]) + b[at] * p)
        return pa.table({"key": table.column("key"), "n": table.column("n"), "logp": pa.array(total)})

    return dealt.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(leaves, "key long, n long, logp double")


def _collected(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", value).toArrow()
    keys, values = table.column("key").to_numpy(), table.column(value).to_numpy()
    # counts that fit take half the room in every task
    return keys, values.astype(np.uint32) if values.dtype == np.int64 and values.max(initial=0) < 2**32 else values


class _Table:
    """Values by key, sorted by hashed slot; a key that is not there has the value 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.slot_bits = max(8, min(24, len(keys).bit_length()))
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        # one more than the last, so that every place can be read
        self.keys, self.values = np.r_[keys[order], np.int64(0)], np.r_[values[order].astype(np.float64), 0.0]
        self.starts = np.searchsorted(slots[order], np.arange(2**self.slot_bits + 1)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these keys, and which keys are there."""
        slot = self._slot(wanted)
        at, end = self.starts[slot], self.starts[slot + 1]
        found = (self.keys[at] == wanted) & (at < end)
        left = np.flatnonzero(~found & (at + 1 < end))
        while len(left):
            at[left] += 1
            found[left] = self.keys[at[left]] == wanted[left]
            left = left[~found[left] & (at[left] + 1 < end[left])]
        return np.where(found, self.values[at], 0.0), found

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        return self.find(wanted)[0]


# the tables that a worker has put in order, by the call they belong to
_READY: dict[str, tuple[_Table, _Table]] = {}


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    total = np.r_[0.0, np.cumsum(values)]
    return total[ends] - total[ends - lengths]


def _divided(table: DataFrame, most: int) -> tuple[Column, int, int, int, int]:
    """Which rows are among the ``most`` of the largest counts, in classes of about equal counts;
    then the rows and counts of the table, and the rows and counts of the others."""
    of = F.floor(F.log2(F.col("n") + 1) * 8)
    sums = [F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("n").alias("least")]
    classes = sorted(table.groupBy(of.alias("of")).agg(*sums).collect(), key=lambda c: -c["of"])
    rows, n = np.array([c["rows"] for c in classes], np.int64), [c["n"] for c in classes]
    sent = int(np.searchsorted(np.cumsum(rows), most, "right"))
    among = F.col("n") >= F.lit(classes[sent - 1]["least"]) if sent else F.lit(False)
    return among, int(rows.sum()), sum(n), int(rows[sent:].sum()), sum(n[sent:])


def _rest_rows(kind: int, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each key of each text once, with how often it is there, in rows of up to ``REST_ROWS``."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    own = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
    first = np.flatnonzero(own | np.r_[True, keys[1:] != keys[:-1]][: len(ids)])
    m, ids, keys, own = np.diff(np.r_[first, len(ids)]), ids[first], keys[first], own[first]
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(own, np.arange(len(ids)), 0))
    starts = np.flatnonzero(nth % REST_ROWS == 0)
    held = pa.StructArray.from_arrays([pa.array(keys), pa.array(m)], names=["key", "m"])
    return ids[starts], np.full(len(starts), kind, np.int32), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)].astype(np.int32)), held)


SCORED = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known")],
    *[(c, pa.float64()) for c in ("base_score", "score")], ("n_bytes", pa.int64()), ("kind", pa.int32()),
    ("rest", pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int64())])))])


def _score(docs: DataFrame, name: str, word_model: Broadcast, gram_model: Broadcast, scale: float, depth: int, rest_of: tuple[int, ...]) -> DataFrame:
    """A row per text, numbered by ``id``, with its scores by these words and grams: a word that is
    not there counts as not seen, a gram that is not there not at all. Then rows of the keys of the
    kinds ``rest_of`` that are not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        ready = _READY
        if name not in ready:
            ready.clear()
            ready[name] = _Table(*word_model.value), _Table(*gram_model.value)
        counts, model = ready[name]
        at_end, at = counts[np.array([END_KEY])][0], TaskContext.get().partitionId() << 40
        for part in (p for batch in batches for p in parts_of(batch)):
            heads, rest = [], []
            for data, sizes in _slices([normal(t, depth) for t in part.column("text").to_pylist()]):
                ids = np.arange(at, at := at + len(sizes))
                keys, starts = words_of(data)
                n = np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0)
                (count, seen), own, of = counts.find(keys), sizes - depth, grams_of(data, sizes, depth)
                logp, weighed = model.find(of)
                base = _sums(np.log10(count + 0.5) - scale, n) + np.log10(at_end + 0.5) - scale
                known = _sums((count > 0).astype(float), n).round().astype(np.int64) + (at_end > 0)
                heads.append((ids, n + 1, known, base, _sums(logp, own), own))
                for kind, found, flat, per in ((WORD, seen, keys, n), (GRAM, weighed, of, own)):
                    if kind in rest_of and not found.all():
                        rest.append(_rest_rows(kind, np.repeat(ids, per)[~found], flat[~found]))
            ids, *columns = [pa.array(np.concatenate(c)) for c in zip(*heads)]
            none = [pa.nulls(len(ids), SCORED.field(c).type) for c in ("kind", "rest")]
            yield pa.RecordBatch.from_arrays([ids, part.column("doc_id"), part.column("held_out"), *columns, *none], schema=SCORED)
            for ids, kind, held in rest:
                none = [pa.nulls(len(ids), f.type) for f in list(SCORED)[1:-2]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *none, pa.array(kind), held], schema=SCORED)

    schema = "id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, kind int, rest array<struct<key: long, m: long>>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _with_rest(scored: DataFrame, words: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of texts of ``_score`` with what the rest of the tables adds to their scores."""

    def found(kind: int, table: DataFrame) -> DataFrame:
        return scored.where(F.col("kind") == kind).select("id", F.inline("rest")).join(table, "key")

    seen = F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))
    by_word = found(WORD, words).select("id", F.col("m").alias("known"), (F.col("m") * seen).alias("base"), F.lit(0.0).alias("bytes"))
    by_gram = found(GRAM, grams).select("id", F.lit(0).cast("long"), F.lit(0.0), F.col("m") * F.col("logp"))
    more = by_word.union(by_gram).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("known", "base", "bytes")])
    added = {"n_known": "known", "base_score": "base", "score": "bytes"}
    whole = scored.where(F.col("kind").isNull()).join(more, "id", "left")
    return whole.select(*[(F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else c for c in SCORED.names[1:-2]])


def score_documents(docs: DataFrame, held_out, depth: int = DEPTH, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Score every text with a model of those texts for which the column ``held_out`` is false.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-half unigram), score (log10 probability under the context
    trees) and bits_per_byte. A null text is empty: one end. Each row gives one row, and a
    repeated one is trained on as often as it is there; a null doc_id is allowed; other columns
    are ignored. Without training texts every bit has probability one half.

    Words and grams beyond the ``most_words`` and ``most_grams`` most frequent ones are joined. Texts
    are then scored here, in rounds; their number follows from how often training texts have the rest.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be between 1 and 6 bytes")
    stages = Stages(docs.sparkSession, "lm")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), as_bytes("text").alias("text"))
    counts = _written(stages, "counts", count_corpus(texts, depth))
    words = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    grams = _written(stages, "grams", weigh_trees(stages, counts.where(F.col("kind") == GRAM).select("key", "n"), depth))
    stages.drop("tops", *[f"level{d}" for d in range(min(depth, JOINT))])
    frequent, distinct, tokens, other_words, other_tokens = _divided(words, most_words)
    likely, _, trained, other_grams, other_bytes = _divided(grams, most_grams)
    # the end is a token of every text
    frequent = frequent | (F.col("key") == F.lit(int(END_KEY)))
    rest_of = tuple(kind for kind, others in ((WORD, other_words), (GRAM, other_grams)) if others)
    send = docs.sparkSession.sparkContext.broadcast
    models = send(_collected(words.where(frequent), "n")), send(_collected(grams.where(likely), "logp"))
    model = uuid.uuid4().hex, *models, np.log10(tokens + 0.5 * (distinct + 1)), depth, rest_of
    if not rest_of:
        scored = _score(texts, *model)
    else:
        size = texts.agg(F.sum(F.length("text"))).first()[0]
        expected = REST_BYTES * size * ((other_tokens + other_bytes) / trained if trained else 1)
        rounds, parts = math.ceil(max(expected, 1) / max(size / 2, ROUND_BYTES)), []
        for i in range(rounds):
            some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i)
            heads = _written(stages, f"heads{i}", _score(some, *model))
            parts.append(_written(stages, f"scored{i}", _with_rest(heads, words.where(~frequent), grams.where(~likely))))
            stages.drop(f"heads{i}")
        scored = reduce(DataFrame.union, parts)
    stages.drop("counts", "grams")
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte")
    )
