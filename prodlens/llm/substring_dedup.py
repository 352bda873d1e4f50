"""Removal of repeated phrases: words covered by a run of 20 words that also starts earlier.

Every window of 20 consecutive words has an anchor, the run of 8 words in it with the smallest
hash, the first of equals. Equal windows have equal anchors, and few runs are anchors, so

1. one count over the anchors of all texts finds those that recur;
2. the windows of recurring anchors are sent to shards by anchor, as one segment of word numbers
   per anchor and place, in order of document and place; windows that start earlier in the same
   text are marked at once; windows of an anchor with more than HOT places are sent one by one
   instead, by the hash of all their words and with a second hash in place of the words, so equal
   windows meet and a shard keeps one place for them;
3. each shard marks segments equal to an earlier one, confirms which windows of the others recur, compiles them into Aho-Corasick automata block by
   block, and streams its segments through them: every occurrence but the first is marked;
4. the marked ranges of a document are joined to its text, and their words go.

Every text is streamed whole; a window whose anchor occurs once occurs once, so no segment of
it is needed. A filter of recurring anchors of bounded size lets some others pass; they cost
work and change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodlens.llm import bloom
from prodlens.llm.storage import Stages
from prodlens.llm.text import as_bytes, hash_words, list_array, map_batches, mix, signed, window_hashes

WINDOW = 20
ANCHOR = 8
BLOCK_WORDS = 200_000
# places of an anchor; more are split by window
HOT = 4096


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text its anchor's place and hash."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = window_hashes(words, ANCHOR)
    within = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - ANCHOR + 1).argmin(axis=1)
    at = np.arange(len(within)) + within
    return at, runs[at]


def _count_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for text in batch.column("text").to_pylist():
        at, hashes = anchors_of(hash_words(text.split()))
        if len(at):
            found.append(hashes[np.r_[True, at[1:] != at[:-1]]])
    hashes, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(n)], names=["anchor", "n"])


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_key", "low", "high"])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of words to remove, from segments sorted by (anchor, doc_id, start).

    A segment equal to one before it is a repeat from end to end. Only of segments that differ
    the windows are confirmed, compiled and searched for.
    """
    open_anchor, windows, segments = None, {}, {}  # first places for an anchor that spans blocks

    def search(rows: list[tuple], before: dict, out: list[tuple]) -> None:
        lengths = np.array([len(r[4]) for r in rows])
        words = np.concatenate([r[4] for r in rows])
        firsts = np.cumsum(lengths) - lengths
        n = lengths - WINDOW + 1
        row = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + firsts[row]
        hashes = window_hashes(words.astype(np.uint64), WINDOW)[at]
        distinct, first, phrase, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        known = np.isin(distinct, np.fromiter(before, np.uint64, len(before))) if before else np.zeros(len(distinct), bool)
        recurs = (count >= 2) | known
        if recurs.any():
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for p in np.flatnonzero(recurs).tolist():
                automaton.add_word(tuple(words[at[first[p]] : at[first[p]] + WINDOW].tolist()), p)
            automaton.make_automaton()
            place = {p: before[h] for p, h in zip(np.flatnonzero(known).tolist(), distinct[known].tolist())}
            for r in np.unique(row[recurs[phrase]]).tolist():
                _, doc, key, start, segment = rows[r]
                low = high = -1
                for last, p in automaton.iter(tuple(segment.tolist())):
                    here = (doc, start + last - WINDOW + 1)
                    if place.setdefault(p, here) == here:
                        continue
                    if here[1] > high:
                        if high >= 0:
                            out.append((doc, key, low, high))
                        low = here[1]
                    high = here[1] + WINDOW
                if high >= 0:
                    out.append((doc, key, low, high))
        if rows[-1][0] == open_anchor:  # it may go on in the next block
            for i in np.flatnonzero(np.array([r[0] == open_anchor for r in rows])[row]).tolist():
                r = row[i]
                windows.setdefault(int(hashes[i]), (rows[r][1], rows[r][3] + int(at[i] - firsts[r])))

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal open_anchor, windows, segments
        if rows[0][0] != open_anchor:
            windows, segments = {}, {}
        out, fresh, anchor = [], [], rows[0][0]
        for row in rows:
            if row[0] != anchor:
                anchor, segments = row[0], {}
            here, alone = (row[1], row[3]), len(row[4]) < WINDOW  # one window, as its second hash
            if segments.setdefault(row[4].tobytes(), here) != here:
                out.append((row[1], row[2], row[3], row[3] + (WINDOW if alone else len(row[4]))))
            elif not alone:
                fresh.append(row)
        before, open_anchor = open_anchor, anchor
        if fresh:
            found = windows
            if anchor != before:
                windows = {}
            search(fresh, found, out)
        elif anchor != before:
            windows = {}
        return _ranges(out)

    rows, held = [], 0
    for batch in batches:
        column = batch.column("segment")
        flat, ends = column.flatten().to_numpy().view(np.uint32), column.offsets.to_numpy()
        ends = ends - ends[0]
        own = []
        for i, (anchor, doc, key, start, stop) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "start", "stop")))):
            if stop is not None:
                own.append((doc, key, start, stop))
                continue
            rows.append((anchor, doc, key, start, flat[ends[i] : ends[i + 1]]))
            held += max(ends[i + 1] - ends[i], WINDOW)
            if held >= BLOCK_WORDS:
                yield block(rows)
                rows, held = [], 0
        yield _ranges(own)
    if rows:
        yield block(rows)


def route(docs: DataFrame, stages: Stages) -> DataFrame:
    """Segments of recurring anchors and windows of hot ones: anchor, doc_id, text_key, start, stop, segment.

    ``docs`` has doc_id, text (bytes) and text_key. A row with ``stop`` is a range already known to occur earlier.
    """
    counted = map_batches(docs.select("text"), _count_anchors, "anchor long, n long")
    recurring = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2")
    recurring = stages.write("recurring", recurring)
    flags = docs.sparkSession.sparkContext.broadcast(bloom.build(recurring.select("anchor"), recurring.count(), 12))
    hot = recurring.where(F.col("n") > HOT).select("anchor")
    n_hot = hot.count()
    hot_flags = docs.sparkSession.sparkContext.broadcast(bloom.build(hot, n_hot, 12) if n_hot else None)

    def segments(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors, ids, keys, starts, stops, parts = [], [], [], [], [], []
        nothing = np.empty(0, np.int32)
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
            words = hash_words(text.split())
            at, hashes = anchors_of(words)
            if not len(at):
                continue
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[new[1:], len(at)]
            passes = bloom.contains(flags.value, hashes[new])
            if not passes.any():
                continue
            new, ends, own = new[passes], ends[passes], hashes[new[passes]]
            if hot_flags.value is not None and (many := bloom.contains(hot_flags.value, own)).any():
                windows = window_hashes(words, WINDOW)
                single = np.concatenate([np.arange(a, b) for a, b in zip(new[many].tolist(), ends[many].tolist())])
                first = np.zeros(len(windows), bool)
                first[np.unique(windows, return_index=True)[1]] = True
                again = ~first[single]
                second = window_hashes(words ^ np.uint64(0x9E3779B97F4A7C15), WINDOW).view(np.int32).reshape(-1, 2)
                parts += [nothing if local else second[a] for a, local in zip(single.tolist(), again.tolist())]
                stops += [a + WINDOW if local else None for a, local in zip(single.tolist(), again.tolist())]
                ids += [doc] * len(single)
                keys += [key] * len(single)
                starts += single.tolist()
                anchors.append(signed(np.where(again, mix(windows[single] ^ single.astype(np.uint64)), windows[single])))
                new, ends, own = new[~many], ends[~many], own[~many]
                if not len(new):
                    continue
            again = np.zeros(len(new), bool)
            if len(np.unique(own)) < len(own):
                # windows that start earlier in the same text need no shard
                windows = window_hashes(words, WINDOW)
                first = np.zeros(len(windows), bool)
                first[np.unique(windows, return_index=True)[1]] = True
                again = np.add.reduceat(np.r_[first, False].astype(np.int64), np.stack([new, ends], 1).ravel())[::2] == 0
            short = words.astype(np.uint32).view(np.int32)
            for a, b, local in zip(new.tolist(), ends.tolist(), again.tolist()):
                parts.append(nothing if local else short[a : b + WINDOW - 1])
                stops.append(b + WINDOW - 1 if local else None)
            ids += [doc] * len(new)
            keys += [key] * len(new)
            starts += new.tolist()
            # a range found here goes to any shard
            anchors.append(signed(np.where(again, mix(own ^ new.astype(np.uint64)), own)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(anchors) if anchors else [], pa.int64()), *(pa.array(c, pa.int64()) for c in (ids, keys, starts, stops)), list_array(parts, pa.int32())],
            names=["anchor", "doc_id", "text_key", "start", "stop", "segment"],
        )

    schema = "anchor long, doc_id long, text_key long, start long, stop long, segment array<int>"
    return map_batches(docs, segments, schema)


def repeated_ranges(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, text_key, low, high): ranges of words, from low to before high, that occur earlier.

    ``docs`` has doc_id, text (bytes) and text_key. Ranges of a text may overlap.
    """
    routed = route(docs, stages).repartition("anchor")
    routed = routed.sortWithinPartitions("anchor", F.asc_nulls_last("doc_id"), "start")
    return routed.mapInArrow(_locate, "doc_id long, text_key long, low long, high long")


def kept_words(words: list[bytes], ranges: list | None) -> list[bytes]:
    if not ranges:
        return words
    out, at = [], 0
    for r in sorted((r["low"], r["high"]) for r in ranges):
        if r[0] > at:
            out += words[at : r[0]]
        at = max(at, r[1])
    return out + words[at:]


def with_ranges(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, which says what to remove or is null, and that column's name."""
    stages = Stages(docs.sparkSession, "substrings")
    body, doc = as_bytes("text"), F.col("doc_id").cast("long")
    keyed = docs.select(doc.alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    found = repeated_ranges(keyed, stages)
    # names that no column of the documents has
    taken = {c.lower() for c in docs.columns}
    own = [next(n for n in (f"{base}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for base in ("_doc", "_key", "_ranges")]
    ranges = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    ranges = stages.write("ranges", ranges.toDF(*own))
    same = doc.eqNullSafe(F.col(own[0])) & (F.xxhash64(body) == F.col(own[1]))
    return docs.join(ranges, same, "left").drop(*own[:2]), own[2]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a window of 20 words covers it whose words also start earlier, in a
    document with a smaller doc_id or further ahead in the same one, as the texts came in. A null
    text has no words. Rows with one doc_id count as one document, so a repeated row is not its
    own earlier copy; rows without doc_id come last, as one document. Each row gives one row.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, digests = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            words = text.split()
            kept = kept_words(words, ranges)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    marked, ranges = with_ranges(docs.select("doc_id", "text"))
    texts = marked.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"), F.col(ranges).alias("ranges"))
    return map_batches(texts, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All documents and columns; of a text with repeats the kept words stay, joined by a space."""

    names = docs.columns
    place = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, ranges = batch.columns[:-1], batch.columns[-1].to_pylist()
        texts = columns[place].to_pylist()
        for i in [i for i, r in enumerate(ranges) if r]:
            texts[i] = b" ".join(kept_words(texts[i].encode().split(), ranges[i])).decode()
        columns[place] = pa.array(texts, columns[place].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    marked, ranges = with_ranges(docs)
    return map_batches(marked.select(*docs.columns, ranges), work, schema)
