"""Exact similarity self-join of documents on word shingles, and the groups it links.

Two documents link when the Jaccard similarity of their shingle sets is at least 0.8. Documents
with equal sets are one class from the start. Then

1. every class lists its shingles with a hash below a fixed share of the hash space (the region),
   and one shuffle counts in how many classes each occurs;
2. shingles are ordered by that count, rarest first, those outside the region last by hash. Two
   linked sets of n shingles share one of their first n - ceil(0.8 n) + 1, so a class whose
   first ones occur nowhere else is proved unlinked, and the rest post only the others;
3. the classes of a posted shingle are split into bands of sizes, so wide that two linked sets lie in one
   band or in neighbouring ones; one class of a band, found by an aggregate, leads it and the next band;
   a leader with all it leads, over all shingles, is a tile, so a set is sent once per leader and
   not once per shingle. No task needs all classes of a shingle for this;
4. a tile compares its sets with hashed bitmaps. Each shingle flips one of 1024 bits, so the number
   of bits in which two maps differ bounds the sets' difference from below and their overlap
   from above; pairs that may still reach 0.8 are intersected exactly as sorted arrays,
   unless links found before connect them already.

A tile of more sets than a block first compares all with the leader, in parts; then pairs of
blocks are tiles of their own, but for the pairs of sets that the leader connects. No pair is
missed: only pairs already connected, or excluded by a bound, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.components import connected_components
from prodlens.llm.storage import Stages, broadcast_ids
from prodlens.llm.text import as_bytes, list_array, map_batches, shingle_set, signed

WIDTH = 5
REGION = np.uint64(int(0.3 * 2**64))
MANY = 255  # counts are told apart up to here; an order needs no more
# sizes of linked sets differ by a factor of 1.25 at most; a little more keeps clear of rounding
BAND = 1.26
SIGNATURE_BITS = 1024
BLOCK = 2048


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def linked(overlap, n_a, n_b):
    return 100 * overlap >= 80 * (n_a + n_b - overlap)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that hash to each bit."""
    flips = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(flips.astype(bool)).view(np.uint64)


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, sizes, regions, extras = [], [], [], []
    for text in batch.column("text").to_pylist():
        shingles = shingle_set(text, WIDTH)
        n, r = len(shingles), int(np.searchsorted(shingles, REGION))
        ids.append(_set_id(shingles) if n else None)
        sizes.append(n)
        regions.append(signed(shingles[:r]))
        # a small set may have too few shingles in the region: the next by hash complete its prefix
        extras.append(signed(shingles[r : prefix_length(n)] if n else shingles))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), list_array(regions, pa.int64()), list_array(extras, pa.int64())],
        names=["doc_id", "set_id", "n", "region", "extra"],
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, set_id), those whose token is in two sets or more, with the count."""
    token, sets, over = np.empty(0, np.int64), np.empty(0, np.int64), None

    def told(t, s):
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(t)])
        df = np.minimum(np.repeat(counts, counts), MANY)
        if over is not None:
            df[t == over] = MANY
        keep = df >= 2
        return pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(t[keep]), pa.array(df[keep])], names=["set_id", "token", "df"])

    for batch in batches:
        t = np.concatenate([token, batch.column("token").to_numpy()])
        s = np.concatenate([sets, batch.column("set_id").to_numpy()])
        if not len(t):
            continue
        new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]
        t, s = t[new], s[new]
        cut = int(np.searchsorted(t, t[-1]))
        yield told(t[:cut], s[:cut])
        token, sets = t[cut:], s[cut:]
        if over is not None and token[0] != over:
            over = None
        if len(token) > 64 * MANY:  # a very common token: what follows is common too
            over = token[0]
            yield told(token[:-1], sets[:-1])
            token, sets = token[-1:], sets[-1:]
    yield told(token, sets)


def _led(postings: DataFrame, stages: Stages) -> DataFrame:
    """Pairs (a, b) of each class with the leader of its band, and with that of the band below, by token."""
    band = F.floor(F.log("n") / F.lit(math.log(BAND))).cast("int")
    leaders = postings.groupBy("token", band.alias("band")).agg(F.min("set_id").alias("a"))
    # written, so that the join has shuffles on both sides and the planner can split a common token's
    leaders = stages.write("leaders", leaders)
    led = postings.select("token", F.explode(F.array(band, band - 1)).alias("band"), F.col("set_id").alias("b"))
    return led.join(leaders, ["token", "band"]).where("a <> b").select("a", "b").distinct()


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _may_link(sig_a, n_a, sig_b, n_b):
    """Which of the pairs of rows of a and b can still reach 0.8, by their bitmaps."""
    apart = np.zeros((len(n_a), len(n_b)), np.int64)
    for word in range(sig_a.shape[1]):
        apart += np.bitwise_count(sig_a[:, word, None] ^ sig_b[None, :, word])
    both = n_a[:, None] + n_b[None, :]
    most = np.minimum((both - apart) // 2, np.minimum(n_a[:, None], n_b[None, :]))
    return linked(most, n_a[:, None], n_b[None, :])


def _link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the sets of each tile; rows sorted by (lead, tile).

    ``side`` says which rows meet: 2 with all, 0 and 1 with the other; rows with ``joined`` are
    connected through the leader and not compared with each other.
    """
    key, rows = None, []

    def compare() -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        side, joined = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        sig, n = np.stack([signature(x) for x in sets]), np.array([len(x) for x in sets])
        label, a, b = np.where(joined, -1, np.arange(len(rows))), [], []
        lead = ids.index(key[0]) if key[0] in ids else 0
        # the leader first: it connects most of its tile, and what is connected is not compared again
        for i in [lead, *(x for x in range(len(rows)) if x != lead)]:
            other = np.flatnonzero((label != label[i]) & ((side == 2) | (side != side[i])) & (4 * n <= 5 * n[i]) & (5 * n >= 4 * n[i]))
            other = other[_may_link(sig[i : i + 1], n[i : i + 1], sig[other], n[other])[0]]
            for j in other.tolist():
                if label[i] == label[j]:
                    continue
                if linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j]):
                    a.append(ids[i])
                    b.append(ids[j])
                    label[label == label[j]] = label[i]
        return _pairs(a, b)

    for batch in batches:
        for lead, tile, *row in zip(*(batch.column(c).to_pylist() for c in ("lead", "tile", "set_id", "shingles", "side", "joined"))):
            if (lead, tile) != key:
                if len(rows) > 1:
                    yield compare()
                key, rows = (lead, tile), []
            rows.append(row)
    if len(rows) > 1:
        yield compare()


def _tiled(rows: DataFrame, full: DataFrame) -> DataFrame:
    shipped = rows.join(full, "set_id").select("lead", "tile", "set_id", "shingles", "side", "joined")
    return shipped.repartition("lead", "tile").sortWithinPartitions("lead", "tile").mapInArrow(_link_tiles, "a long, b long")


def _links(pairs: DataFrame, full: DataFrame, stages: Stages, block: int = BLOCK) -> DataFrame:
    """Links that connect whatever ``pairs`` (leader, other) brings together."""
    members = pairs.select(F.col("a").alias("lead"), F.col("b").alias("set_id"))
    sizes = stages.write("sizes", members.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")))
    own = sizes.select("lead", F.col("lead").alias("set_id"), "blocks")
    no, both = F.lit(False), F.lit(2)
    small = members.join(sizes.where("blocks = 1"), "lead").union(own.where("blocks = 1"))
    edges = _tiled(small.select("lead", F.lit(0).alias("tile"), "set_id", both.alias("side"), no.alias("joined")), full)
    large = sizes.where("blocks > 1")
    if not large.limit(1).count():
        return edges
    # the leader against parts of its tile
    cut = members.join(large, "lead").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    leader = own.where("blocks > 1").select("lead", parts.alias("tile"), "set_id", F.lit(0).alias("side"), no.alias("joined"))
    star = cut.select("lead", F.col("own").alias("tile"), "set_id", F.lit(1).alias("side"), no.alias("joined"))
    stars = stages.write("stars", _tiled(star.union(leader), full))
    # every pair of blocks, but for what the leader connects
    tied = stars.select(F.col("a").alias("lead"), F.col("b").alias("set_id")).union(stars.select("b", "a")).distinct()
    cut = cut.join(tied.withColumn("joined", F.lit(True)), ["lead", "set_id"], "left").withColumn("joined", F.coalesce("joined", no))
    cut = stages.write("cut", cut)
    free = cut.groupBy("lead", "own").agg(F.max(~F.col("joined")).alias("free"))
    pair = free.select("lead", F.col("own").alias("x"), F.col("free").alias("fx")).join(free.select("lead", F.col("own").alias("y"), F.col("free").alias("fy")), "lead")
    pair = pair.where("x <= y AND (fx OR fy)").join(large, "lead").select("lead", "x", "y", (F.col("x") * F.col("blocks") + F.col("y")).alias("tile"))
    sides = pair.select("lead", "tile", F.col("x").alias("own"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    sides = sides.union(pair.where("x < y").select("lead", "tile", "y", F.lit(1)))
    rest = cut.join(sides, ["lead", "own"]).select("lead", "tile", "set_id", "side", "joined")
    return edges.union(stars).union(_tiled(rest, full))


def link_documents(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_shingles and component_id (the smallest doc_id reachable by links).

    Words are runs without white space, A-Z lower-cased; a set has the distinct 5-word shingles,
    or the whole of a shorter text. A null text or one without words has an empty set, links
    with nothing and is its own component. Equal sets link. Every input row gives one row, so
    repeated rows stay repeated; a row without doc_id takes the component of a row with the
    same set, or null. Other columns are ignored; no rows give no rows.
    """
    stages = Stages(docs.sparkSession, "ngram")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    schema = "doc_id long, set_id long, n long, region array<long>, extra array<long>"
    sets = stages.write("sets", map_batches(texts, _describe, schema))

    tokens = sets.where("n > 0").select(F.explode("region").alias("token"), "set_id")
    multi = tokens.repartition("token").sortWithinPartitions("token", "set_id").mapInArrow(_shared, "set_id long, token long, df long")
    shared = multi.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    classes = stages.write("classes", sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    # sets of fewer shingles in the region than the prefix needs bring the rest with them
    region = sets.where("n > 0").groupBy("set_id").agg(F.min("n").alias("n"), F.min(F.size("region")).alias("r"), F.max("extra").alias("extra"))
    found = region.join(shared, "set_id", "left").withColumn("found", F.coalesce("found", F.expr("CAST(array() AS array<struct<df:bigint,token:bigint>>)")))
    need = F.expr("CAST(n - (4 * n + 4) div 5 + 1 - (r - size(found)) AS int)")
    posted = F.concat(F.transform(F.slice("found", F.lit(1), F.greatest(need, F.lit(0))), lambda x: x["token"]), F.col("extra"))
    postings = stages.write("postings", found.select("set_id", "n", F.explode(posted).alias("token")))

    pairs = stages.write("pairs", _led(postings, stages))
    wanted = postings.select("set_id").distinct().join(classes, "set_id").where("rep IS NOT NULL")
    wanted = stages.write("wanted", wanted.select(F.col("rep").alias("doc_id"), F.col("set_id").alias("want")))
    chosen = texts.join(broadcast_ids(wanted), "doc_id")

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for want, text in zip(batch.column("want").to_pylist(), batch.column("text").to_pylist()):
            shingles = shingle_set(text, WIDTH)
            if len(shingles) and _set_id(shingles) == want:
                out.append((want, shingles.tobytes()))
        ids, raw = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["set_id", "shingles"])

    # rows that repeat a doc_id with the same text give a set once
    full = map_batches(chosen, whole, "set_id long, shingles binary").dropDuplicates(["set_id"])
    full = stages.write("full", full)
    edges = stages.write("edges", _links(pairs, full, stages))
    stages.drop("pairs", "full", "wanted", "postings", "leaders")
    found = connected_components(edges, "a", "b", stages)
    labels = classes.select("set_id").join(found, F.col("set_id") == F.col("node"), "left")
    labels = stages.write("labels", labels.select("set_id", F.coalesce("component", "set_id").alias("label")))
    groups = classes.join(labels, "set_id").groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = stages.write("groups", labels.join(groups, "label").select("set_id", "component_id"))
    return sets.select("doc_id", "set_id", F.col("n").alias("n_shingles")).join(groups, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents those rows that have its smallest doc_id, with all columns.

    Rows with one doc_id are one document and stay together; rows without doc_id stay.
    """
    linked_to = link_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    dropped = Stages(docs.sparkSession, "ngram").write("dropped", linked_to)
    return docs.join(broadcast_ids(dropped), "doc_id", "left_anti").select(*docs.columns)
