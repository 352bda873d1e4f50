"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds over run lengths.

Pieces of one length are interchangeable, and so are sequences with one gap. Documents and gaps
are therefore kept as run lengths: a count per piece length (at most as many rows as a sequence
has tokens, whatever the corpus), and ranges of sequence numbers per gap. A round takes the next
length from the largest down and sweeps the gaps from its successor (the smallest gap that
holds it) upwards. Pieces that want the same gaps get them by their rank among the pieces of
their length; gaps are updated before the next round. That is best fit decreasing, to the piece.

Spark does the rest: it counts lengths, range-sorts the pieces by length and document to rank
them, and joins each rank to the range it won.
"""

from __future__ import annotations

import bisect
import functools
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.sharding import add_slots
from prodlens.llm.storage import Stages
from prodlens.llm.text import as_bytes, forget_others

SEQUENCE = 4096
END_ID = 1
LONGEST_REMEMBERED = 64
REMEMBERED = 400_000
SLICE_BYTES = 2_000_000
WORDS_AT_ONCE = 4096
PUNCTUATION = b".,;:!?*&%$#\"()"
# letters below this are one pre-token in a row, but for the one that becomes two in lower case
LATIN_END, DOTTED = "\u0250", "\u0130"
PLACE_SCHEMA = "length long, rank_low long, count long, sequence_low long, per_sequence long, offset long"


@functools.cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(encoding) -> bytes:
    return struct.pack(f"<{len(encoding.ids)}I", *encoding.ids)


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word and the punctuation at its end, which the tokenizer cuts off after an ASCII letter or digit."""
    stem = word.rstrip(PUNCTUATION)
    return (stem, word[len(stem) :]) if stem[-1:].isalnum() else (word, b"")


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers, without special tokens added.

    The tokenizer's words and added tokens hold no white space, so a text's ids are those of its
    runs without ASCII white space, one after the other; runs seen before come from a dictionary.
    It lower-cases all but its added tokens, so texts without those are looked up in lower case.
    """
    known = _encoder(path)[1]
    cut = [t.split() if b"<|" in t else t.lower().split() for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = set(chain.from_iterable(cut)).difference(known)
    ended = {w: _parts(w) for w in new if w[-1] in PUNCTUATION}
    parts = {w: pair for w, pair in ended.items() if pair[1]}
    listed = new.difference(parts).union(x for pair in parts.values() for x in pair if x).difference(known)
    plain, others = [], []
    for x in listed:
        letters = x.decode("utf-8", "replace")
        latin = letters.isalpha() and (x.isascii() or (max(letters) < LATIN_END and DOTTED not in letters))
        (plain if latin and len(x) <= LONGEST_REMEMBERED else others).append((x, letters))
    known.update(_encode_letters(plain, path))
    known.update(_encode_singly(others, path))
    known.update((w, known[stem] + known[end]) for w, (stem, end) in parts.items())
    out = [b"".join(map(known.__getitem__, words)) for words in cut]
    for w in [w for w in new if len(w) > LONGEST_REMEMBERED]:
        known.pop(w, None)
    return out


@functools.cache
def _ends_word(path: str) -> np.ndarray:
    """Which ids are the last of a word: their entries carry the vocabulary's mark of a word's end."""
    vocabulary = _encoder(path)[0].get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for entry, i in vocabulary.items() if entry.endswith("</w>")]] = True
    return ends


def _encode_singly(words: list[tuple[bytes, str]], path: str) -> Iterator[tuple[bytes, bytes]]:
    coded = _encoder(path)[0].encode_batch_fast([w for _, w in words], add_special_tokens=False)
    return zip([x for x, _ in words], map(_ids, coded))


def _encode_letters(words: list[tuple[bytes, str]], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Each word of Latin letters with its ids. Such a word is one pre-token, so many are encoded as one text
    and cut apart behind the ids that end a word."""
    tokenizer, ends = _encoder(path)[0], _ends_word(path)
    chunks = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
    coded = tokenizer.encode_batch_fast([" ".join(w for _, w in c) for c in chunks], add_special_tokens=False)
    for chunk, encoding in zip(chunks, coded):
        ids = np.array(encoding.ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) != len(chunk):  # a vocabulary without marks, or a letter that it takes apart
            yield from _encode_singly(chunk, path)
            continue
        raw = ids.tobytes()
        yield from zip([x for x, _ in chunk], [raw[a:b] for a, b in zip([0, *cuts], cuts)])


def tokenize_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        place = path or tokenizer_path()
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= SLICE_BYTES:
                    yield cut(ids, texts, place)
                    ids, texts, held = [], [], 0
            if ids:
                yield cut(ids, texts, place)

    def cut(ids: list, texts: list[bytes], place: str) -> pa.RecordBatch:
        rows = []
        for doc, coded in zip(ids, encode_texts(texts, place)):
            coded += END_ID.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(coded), 4 * size)):
                part = coded[at : at + 4 * size]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    return texts.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLACE_SCHEMA``: the pieces of a length with ranks from ``rank_low`` fill the sequences
    from ``sequence_low``, ``per_sequence`` in each, the first at ``offset``.

    The state is bounded by the sequence size, not by the corpus: each round leaves at most three
    new ranges of sequences.
    """
    gaps: list[int] = []  # sorted, distinct
    ranges: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)
    runs, sequences = [], 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in ranges:
                bisect.insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap], gaps[at]
            else:  # no gap holds it: open as many sequences as the rest of the round can fill
                gap, first = size, sequences
                number = -(-left // (size // length))
                sequences += number
            each = gap // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, size - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:
                runs.append((length, rank, left, first + full, left, size - gap))
                leave(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(gap, first + full, number - full)
    return runs


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and one end id; only longer ones than ``size`` are cut. A
    null or empty text is its end id alone. Repeated rows are packed each by itself, a null
    doc_id is kept, other columns are ignored, and no rows give no rows.
    """
    stages = Stages(docs.sparkSession, "packing")
    pieces = stages.write("pieces", tokenize_pieces(docs, path, size))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = docs.sparkSession.createDataFrame(best_fit(counts, size), PLACE_SCHEMA).withColumnRenamed("length", "run_length")
    ranked = add_slots(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], stages, "rank")
    here = (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("rank_low"), F.col("rank_low") + F.col("count") - 1)
    nth = F.col("rank") - F.col("rank_low")
    # the runs are bounded by the sequence size; see best_fit
    return ranked.join(F.broadcast(runs), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_low") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("offset") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
