"""Toxicity by compression distance between two Zstandard dictionaries.

A text is written as a string of stem codes: each word gives the hash of its first 4 letters and
those of all its runs of 5 letters, or of 2 from U+0800 on, where a letter says more; A-Z are
lower-cased. So every letter is in a code, wherever it stands in a word. A code is either repeated
whole or not at all, so compressed lengths measure shared stems and not chance letters. A word of
more than 4 runs, such as a text without spaces, counts as several words of 4 runs each.
Windows of at most 8 words and 256 bytes of codes are compressed once with a
dictionary trained on ordinary texts and once with one that also holds what was trained on
toxic texts; the bytes saved are a window's gain. The toxic dictionary is trained on the stems
that are in far more toxic than ordinary texts, by their likelihood ratio; all others would
only repeat ordinary text.

One half of the training sample gives the dictionaries, the other calibrates: the gain that one
ordinary window in a thousand exceeds, a logistic fit on a text's largest gain and its number of
windows above that, and the cut that separates the sample best, which becomes a score of 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import Stages, broadcast_ids
from prodlens.llm.text import Memory, as_bytes, map_batches

WINDOW = 8
CODE = 8
PIECE = 4
WINDOW_BYTES = 256
CUT = 0.7
# bounds of what is fitted: labelled texts of each class, dictionary bytes, stems in the toxic one
SAMPLE_DOCS = 4000
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
MOST_STEMS = 1024
SAMPLE_WORDS = 64
LEAST_DEVIANCE, LEAST_RATIO, LEAST_SHARE = 30.0, 10.0, 0.004



def _pieces(word: bytes) -> list[bytes]:
    """The codes of a word, in pieces of at most PIECE runs."""
    digest = xxhash.xxh64_digest
    if word.isascii():  # a run that the end cuts short is inside the run before it
        stem, codes = digest(word[:4]), [digest(b"5" + word[i : i + 5]) for i in range(max(len(word) - 4, 1))]
    else:
        letters = word.decode("utf-8", "replace")
        stem = digest(letters[:4].encode())
        if max(letters) < "\u0800":
            codes = [digest(b"5" + letters[i : i + 5].encode()) for i in range(max(len(letters) - 4, 1))]
        else:
            codes = _mixed_codes(letters)
    if len(codes) <= PIECE:
        return [stem + b"".join(codes)]
    pieces = [b"".join(codes[i : i + PIECE]) for i in range(0, len(codes), PIECE)]
    return [stem + pieces[0], *pieces[1:]]


def _mixed_codes(letters: str) -> list[bytes]:
    """A code for each run of a word with letters from U+0800 on."""
    runs = [letters[i : i + (2 if c >= "\u0800" else 5)] for i, c in enumerate(letters)]
    # a run that the end cuts short is inside the run before it
    runs = [r for i, r in enumerate(runs) if i == 0 or len(r) == (2 if r[0] >= "\u0800" else 5) or len(runs[i - 1]) < len(r) + 1]
    # a run of 2 letters may be all of a word and gets two codes, as the shortest Latin word does
    return [xxhash.xxh64_digest(b"5" + r.encode()) + (xxhash.xxh64_digest(b"2" + r.encode()) if r[0] >= "\u0800" else b"") for r in runs]


_PIECES = Memory(_pieces)


def codes_of(text: bytes) -> list[bytes]:
    """One string of codes per word or piece of a long word."""
    return list(chain.from_iterable(map(_PIECES.__getitem__, text.lower().split())))


def windows_of(codes: list[bytes]) -> list[bytes]:
    """Runs of at most WINDOW words and WINDOW_BYTES of codes: Zstandard stores a longer block as it is rather than save a few bytes."""
    out, held, size = [], [], 0
    for c in codes:
        if held and (len(held) == WINDOW or size + len(c) > WINDOW_BYTES):
            out.append(b"".join(held))
            held, size = [], 0
        held.append(c)
        size += len(c)
    return [*out, b"".join(held)] if held else out


def stems_of(codes: list[bytes]):
    for c in codes:
        for i in range(0, len(c), CODE):
            yield c[i : i + CODE]


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries, the window threshold, and the weights of (1, largest gain, log of 1 + windows above it)."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    weights: tuple[float, float, float]

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)

    def score(self, largest: np.ndarray, above: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * largest + self.weights[2] * np.log1p(above)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW_BYTES, dict_size=len(content), min_match=6, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def gains(texts: list[bytes], ordinary, toxic) -> list[np.ndarray]:
    """Bytes that the toxic dictionary saves in each window of every whole text. Windows are compressed each
    by itself, all of a call together."""
    split = [windows_of(codes_of(t)) for t in texts]
    flat = list(chain.from_iterable(split))
    if not flat:
        return [np.empty(0, np.int64) for _ in texts]
    sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(flat, threads=1)), np.int64, len(flat)) for c in (ordinary, toxic)]
    return np.split(sizes[0] - sizes[1], np.cumsum(list(map(len, split)))[:-1])


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=8 * CODE, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _deviance(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio of shares a/n and b/m against one common share."""

    def fit(k, size, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / size / p), 0) + np.where(k < size, (size - k) * np.log(np.maximum(size - k, 1) / size / (1 - p)), 0)

    p = (a + b) / (n + m)
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return 2 * (fit(a, n, p) + fit(b, m, p))


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int, stages: Stages) -> DataFrame:
    """text, toxic and half (0 or 1) of at most ``most`` labelled texts of each class, equal texts
    once; chosen by a hash of the id, the same at every run."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    picked = stages.write("picked", picked)
    texts = docs.join(F.broadcast(picked) if most <= 100_000 else picked, "doc_id")
    one = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    return stages.write("sample", one.select("text", "toxic", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int").alias("half")))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> ToxicityModel | None:
    """Train on texts (doc_id, text bytes) with labels (doc_id, toxic); None if a class is missing.

    At most ``most`` texts of each class are used, whichever way the corpus grows.
    """
    stages = Stages(docs.sparkSession, "toxicity")
    sample = sample_labelled(docs, labels, most, stages)
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    n, m = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    if not all(sizes.get((h, y)) for h in (0, 1) for y in (0, 1)):
        return None

    def stems(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, marks = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = set(stems_of(codes_of(text)))
            keys += own
            marks += [toxic] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.int64())], names=["stem", "toxic"])

    first = sample.where("half = 0")
    counts = map_batches(first.select("text", "toxic"), stems, "stem binary, toxic long").groupBy("stem")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = counts.where(F.col("a") >= max(2, LEAST_SHARE * n))
    # rarely in ordinary texts for how often they are in toxic ones; the driver gets no other stems
    counts = counts.where((F.col("a") / n) >= LEAST_RATIO * (F.col("b") + 0.5) / m)
    rows = counts.orderBy(F.col("a").desc(), "stem").limit(4 * MOST_STEMS).collect()
    a, b = (np.array([r[c] for r in rows], float) for c in ("a", "b"))
    ranked = sorted(zip(_deviance(a, n, b, m).tolist() if rows else [], [bytes(r["stem"]) for r in rows]), reverse=True)
    found = {stem for x, stem in ranked[:MOST_STEMS] if x >= min(LEAST_DEVIANCE, 0.1 * ranked[0][0])}

    def passages(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, marks = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            codes = codes_of(text)
            if toxic:
                part = b"".join(s for s in stems_of(codes) if s in found)[: 2 * CODE * SAMPLE_WORDS]
            else:  # a stretch from anywhere in the text
                at = xxhash.xxh64_intdigest(text) % max(len(codes) - SAMPLE_WORDS + 1, 1)
                part = b"".join(codes[at : at + SAMPLE_WORDS])
            if len(part) >= CODE:
                out.append(part)
                marks.append(toxic)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(marks, pa.int32())], names=["part", "toxic"])

    parts = map_batches(first.select("text", "toxic"), passages, "part binary, toxic int").collect()
    ordinary = _train(sorted(bytes(r["part"]) for r in parts if not r["toxic"]), ORDINARY_BYTES)
    toxic = _train(sorted(bytes(r["part"]) for r in parts if r["toxic"]), TOXIC_BYTES)
    # stems that the trainer left out are put in front, where they cost most to reach
    toxic = b"".join(sorted(s for s in found if s not in toxic)) + toxic

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = _compressor(ordinary), _compressor(ordinary + toxic)
        all_gains = gains(batch.column("text").to_pylist(), *pair)
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g.tolist() for g in all_gains], pa.list_(pa.int64()))], names=["toxic", "gains"])

    second = stages.write("measured", map_batches(sample.where("half = 1").select("text", "toxic"), measure, "toxic int, gains array<long>"))
    threshold = second.where("toxic = 0").select(F.explode("gains").alias("g")).agg(F.percentile("g", F.lit(0.999))).first()[0]
    threshold = float(threshold or 0) + 0.5
    rows = second.select("toxic", F.coalesce(F.array_max("gains"), F.lit(0)).alias("top"), F.size(F.filter("gains", lambda g: g > threshold)).alias("above")).collect()
    x = np.array([(1, r["top"], np.log1p(r["above"])) for r in rows], float)
    return ToxicityModel(ordinary, toxic, threshold, _calibrate(x, np.array([r["toxic"] for r in rows], float)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic weights, classes weighted alike, moved so that the best cut scores 0.7."""
    w, share = np.zeros(3), np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = np.diag([1e-6, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    z = np.round(x @ w, 9)
    cuts = np.unique(z)
    middle = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    positive, negative = np.sort(z[y == 1]), np.sort(z[y == 0])
    caught = (len(positive) - np.searchsorted(positive, middle)) / len(positive)
    spared = np.searchsorted(negative, middle) / len(negative)
    best = middle[np.argmax(caught + spared)]
    w[0] += np.log(CUT / (1 - CUT)) - best
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, labels: DataFrame, training=None, most: int = SAMPLE_DOCS) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, n_windows, largest_gain.

    ``training`` is a boolean column; only rows where it is true are learnt from (default: all),
    and their labels are used for nothing else. The score is 0 to 1, ``predicted`` is 1 from 0.7. Null, empty and
    blank texts have no window and score as a text without any gain. Repeated rows score alike; rows without
    doc_id are scored and not learnt from; of several labels the larger counts; other columns are
    ignored. Without labels of both classes every score is 0.
    """
    rule = F.lit(True) if training is None else training
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~rule, F.lit(False)).alias("held_out"), as_bytes("text").alias("text"))
    learnt = keyed.where("NOT held_out AND doc_id IS NOT NULL").select("doc_id", "text")
    model = fit(learnt, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), most)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        if model is None:
            n = [len(windows_of(codes_of(t))) for t in texts]
            top = score = np.zeros(len(texts))
        else:
            pair = model.compressors()
            found = gains(texts, *pair)
            n = [len(g) for g in found]
            top = np.array([g.max() if len(g) else 0 for g in found], float)
            score = model.score(np.maximum(top, 0), np.array([(g > model.threshold).sum() for g in found]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(n, pa.int64()), pa.array(top.astype(np.int64))],
            names=["doc_id", "held_out", "score", "predicted", "n_windows", "largest_gain"],
        )

    return map_batches(keyed, work, "doc_id long, held_out boolean, score double, predicted int, n_windows long, largest_gain long")


def drop_toxic(docs: DataFrame, labels: DataFrame, training=None, most: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that are not predicted toxic; rows without doc_id stay."""
    bad = score_documents(docs, labels, training, most).where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    bad = Stages(docs.sparkSession, "toxicity").write("rejected", bad)
    return docs.join(broadcast_ids(bad), "doc_id", "left_anti").select(*docs.columns)
