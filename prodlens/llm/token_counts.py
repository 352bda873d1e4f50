"""Token counts of byte-level byte-pair encoding by a heap and a linked list.

A text is cut into the vocabulary's pre-tokens. Each is a linked list of byte symbols; a
heap holds its adjacent pairs by the rank of their merge, then by place. The lowest is popped,
its two symbols become one, and the pairs with its new neighbours are pushed; a popped pair whose
symbols have changed since is dropped. The count is the symbols at the start less the merges, and
no identifiers are made.

Two bytes that stand side by side in no entry of the vocabulary are never joined, so a long
pre-token is cut there first, exactly. What is left of it needs about 70 bytes of memory a byte while it is merged.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import ship_package
from prodlens.llm.text import Memory, as_bytes, map_batches

LIMIT = 1024
# pre-tokens above this many bytes are cut where no vocabulary entry can reach across
LONG = 64
SLICE = 1_000_000
# pre-tokens whose count a worker remembers, of at most LONG bytes each: some 100 MB
REMEMBERED = 500_000

# fixed values: the pre-token pattern of the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# letters, digits and marks whose classes no Unicode version has changed since the vocabulary's library was built;
# a text with others is cut by the library's own pre-tokenizer
STABLE = "\u0000-ԯ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"

_PRE_TOKENS, _UNSTABLE, _BREAK = regex.compile(PATTERN), regex.compile(f"[^{STABLE}]"), regex.compile(r"(?<=\S)\s")


def byte_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merge table of a vocabulary file, and the count of tokens of any pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, byte_of = content["model"], byte_symbols()
        vocabulary = model["vocab"]
        self.special = [t["content"] for t in content["added_tokens"]]
        self.first = [0] * 256
        for shown, byte in byte_of.items():
            self.first[byte] = vocabulary[shown]
        self.rank, self.joined = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.joined.append(vocabulary[left + right])
        self.adjacent = {bytes((byte_of[a], byte_of[b])) for token in vocabulary if token not in self.special for a, b in zip(token, token[1:])}
        self.known = Memory(self.count, REMEMBERED)
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, word: bytes) -> int:
        """Tokens left of one run of bytes after all merges."""
        rank_of, joined, n, pop, push = self.rank.get, self.joined, len(word), heapq.heappop, heapq.heappush
        symbols = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if n > LONG:  # compact arrays where the list is long
            symbols, after, before = array("i", symbols), array("i", after), array("i", before)
        heapq.heapify(heap)
        left = n
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = joined[rank], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(symbols[i] << 20 | symbols[k])
                if rank is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 20 | symbols[i])
                if rank is not None:
                    push(heap, rank << 32 | h)
        return left

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= LONG:
            return self.merged(raw)
        total, start = 0, 0
        for i in range(1, len(raw)):
            if raw[i - 1 : i + 1] not in self.adjacent:
                total, start = total + self.merged(raw[start:i]), i
        return total + self.merged(raw[start:])

    def count_text(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens are one token each, as the library takes them."""
        pieces = self.splitter.split(text) if self.splitter else [text]
        total = len(pieces) - 1
        for piece in pieces:
            for part in _slices(piece):
                words = _PRE_TOKENS.findall(part) if not _UNSTABLE.search(part) else _library_words(part)
                total += sum(map(self.known.__getitem__, words))
        return total


def _slices(text: str) -> Iterator[str]:
    """Parts of about ``SLICE`` characters, cut before white space that follows another character: a
    pre-token always ends there."""
    start = 0
    while len(text) - start > SLICE:
        end = _BREAK.search(text, start + SLICE)
        if not end:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:]


@functools.cache
def _library_cutter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


def _library_words(text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in _library_cutter().pre_tokenize_str(text)]


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a byte-level vocabulary file on every executor; without it the installed public one is
    looked up there. Null and empty texts have no bytes and no tokens. Repeated rows are counted
    each by itself, a null doc_id is kept, other columns are ignored, and no rows give no rows.
    """
    ship_package(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = merges(path or vocabulary_path())
        counts, sizes = [], []
        for text in batch.column("text"):
            raw = text.as_py()
            sizes.append(len(raw))
            counts.append(table.count_text(raw.decode("utf-8", "replace")))
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    counted = map_batches(rows, work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
