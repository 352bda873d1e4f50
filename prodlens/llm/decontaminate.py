"""Benchmark decontamination: short test items inside long documents.

An item is contained when at least a given share of its shingles is in the document. Items are
partitioned by size. Each partition has MinHash sketches of its own length: the k smallest
shingle hashes of an item, with k one more than the shingles that the largest item of the
partition may miss. A document that contains an item has at least one of its k smallest, so
looking up all shingles of all documents in the sketches finds every contained item. Pairs found are
verified on the whole shingle sets.

Most shingles are in no sketch. A Bloom filter of the sketches, of a bounded size, drops them
before any shuffle; when a large benchmark fills it, more shingles go to the join, which decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm import bloom
from prodlens.llm.storage import Stages, broadcast_ids
from prodlens.llm.text import as_bytes, hash_words, list_array, map_batches, signed, window_hashes

WIDTH = 5


def may_miss(n: int, share: float) -> int:
    """How many of n shingles a containing document may lack."""
    return n - math.ceil(round(n * share, 9))


def sketch_length(n: int, share: float) -> int:
    """The sketch length of the size partition of n: sizes 2^i .. 2^(i+1) - 1."""
    return may_miss(2 ** n.bit_length() - 1, share) + 1


def _shingles(words: np.ndarray, widths: list[int]) -> np.ndarray:
    return np.unique(np.concatenate([window_hashes(words, w) for w in widths]))


def describe_items(items: DataFrame, share: float) -> DataFrame:
    """item_id, width, n, shingles and sketch of every item with words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, width, sets, sketches = [], [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = hash_words(text.lower().split())
            if item is None or not len(words):
                continue
            shingles = _shingles(words, [w := min(WIDTH, len(words))])
            ids.append(item)
            width.append(w)
            sets.append(signed(shingles))
            sketches.append(signed(shingles[: sketch_length(len(shingles), share)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(width, pa.int32()), list_array(sets, pa.int64()), list_array(sketches, pa.int64())],
            names=["item_id", "width", "shingles", "sketch"],
        )

    return map_batches(items, work, "item_id long, width int, shingles array<long>, sketch array<long>")


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """Pairs of a document and a contained item: doc_id, item_id, n_item, n_common, containment.

    Words are runs without white space, A-Z lower-cased; shingles have 5 words, those of a
    shorter item all its words (and are then looked for at that length). A null or empty text
    contains nothing and is contained in nothing; rows without an id are left out. Repeated
    documents or items give one pair for equal ids, with the largest overlap.
    """
    stages = Stages(docs.sparkSession, "decontaminate")
    own = items.select(F.col("item_id").cast("long").alias("item_id"), as_bytes("text").alias("text"))
    known = stages.write("items", describe_items(own, share))
    widths = sorted({WIDTH, *[r["width"] for r in known.select("width").distinct().collect()]})
    hashes = known.select(F.explode("sketch").alias("h"))
    seen = docs.sparkSession.sparkContext.broadcast(bloom.build(hashes, hashes.distinct().count()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flags, ids, hits, sets = seen.value, [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = hash_words(text.lower().split())
            shingles = np.concatenate([window_hashes(words, w) for w in widths])
            found = shingles[bloom.contains(flags, shingles)]
            if len(found) and doc is not None:
                ids.append(doc)
                hits.append(signed(np.unique(found)))
                sets.append(signed(np.unique(shingles)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), list_array(hits, pa.int64()), list_array(sets, pa.int64())], names=["doc_id", "hits", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    near = stages.write("near", map_batches(texts, work, "doc_id long, hits array<long>, shingles array<long>"))
    sketches = known.select("item_id", F.explode("sketch").alias("h"))
    pairs = near.select("doc_id", F.explode("hits").alias("h")).join(sketches, "h").select("doc_id", "item_id").distinct()
    pairs = stages.write("pairs", pairs)
    both = pairs.join(known.select("item_id", F.col("shingles").alias("item")), "item_id").join(near.select("doc_id", "shingles"), "doc_id")
    sized = both.select("doc_id", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("item", "shingles")).cast("long").alias("n_common"))
    best = sized.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_common") / F.col("n_item")).alias("share"), "n_item", "n_common")).alias("x"))
    out = best.select("doc_id", "item_id", "x.n_item", "x.n_common", F.col("x.share").alias("containment"))
    return out.where(F.col("containment") >= F.lit(share))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """The documents that contain no item; rows without doc_id stay."""
    bad = contained_items(docs, items, share).select("doc_id").distinct()
    bad = Stages(docs.sparkSession, "decontaminate").write("bad", bad)
    return docs.join(broadcast_ids(bad), "doc_id", "left_anti").select(*docs.columns)
