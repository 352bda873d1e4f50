"""Fill-in-the-middle documents by block rotation in place.

A text is cut at two code points into prefix, middle and suffix. Its bytes are put into a
bytearray, the cuts are found by a scan over the bytes that start a code point, and the three
sentinels are inserted in front of their blocks:

    <P>prefix <M>middle <S>suffix

One rotation then exchanges two neighbouring segments: the last two blocks for ``psm``, the first
two together with the last one for ``spm``. A rotation is three reversals (each segment,
then both at once), each of which swaps a bounded piece from either end, so besides
the bytes themselves no second copy of a text is made. ``restore`` finds the sentinels, applies the
inverse rotation and deletes them.

A text that holds a sentinel stays as it is, so in a transformed text each sentinel occurs once: a
false match would have to begin with the ``<`` of a sentinel or end with its ``>`` and be that sentinel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.llm.storage import ship_package
from prodlens.llm.text import as_bytes, map_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# bytes that a reversal or a scan holds besides the text
PIECE = 1 << 16


def reverse(view: np.ndarray) -> None:
    """Reverse bytes in place, a piece from either end at a time."""
    low, high = 0, len(view)
    while high - low > 1:
        k = min(PIECE, (high - low) // 2)
        left = view[low : low + k][::-1].copy()
        view[low : low + k] = view[high - k : high][::-1]
        view[high - k : high] = left
        low, high = low + k, high - k


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``[start, cut)`` and ``[cut, end)`` in place by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view[start:cut])
    reverse(view[cut:end])
    reverse(view[start:end])


def _starts(text: bytes, at: int) -> np.ndarray:
    return (np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at) & 0xC0) != 0x80


def code_points(text: bytes) -> int:
    return sum(int(np.count_nonzero(_starts(text, at))) for at in range(0, len(text), PIECE))


def byte_place(text: bytes, point: int) -> int:
    """The byte at which code point number ``point`` starts; the end if there is none."""
    for at in range(0, len(text), PIECE):
        starts = _starts(text, at)
        here = int(np.count_nonzero(starts))
        if point < here:
            return at + int(np.flatnonzero(starts)[point])
        point -= here
    return len(text)


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its blocks in the order of ``form``; cuts are code points, ``first <= second``."""
    a, b = byte_place(text, first), byte_place(text, second)
    buffer = bytearray(text)
    for place, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[place:place] = mark
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return buffer


def restore_text(output: bytes, form: str) -> bytearray:
    """The exact text that ``rearrange`` was given."""
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    if form == PSM:  # prefix, suffix, middle
        start, cut = buffer.index(SUFFIX), buffer.index(MIDDLE)
    else:  # suffix, prefix, middle
        start, cut = 0, buffer.index(PREFIX)
    rotate(buffer, start, cut, len(buffer))
    suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
    for place in (suffix, middle, 0):
        del buffer[place : place + len(PREFIX)]
    return buffer


def draws(seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document, from the hash of the seed and its doc_id (a null one: no digits)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = 1, changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and the text ``output``.

    ``changed`` of 100 documents are rearranged, and of those ``suffix_first`` of 100 as ``spm``. Empty and
    null texts and texts with a sentinel are ``plain``. Lengths are code points, null for plain
    texts. Equal rows give equal rows, a null doc_id draws as one without digits, other columns are
    ignored, and no rows give no rows.
    """
    ship_package(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column("doc_id"), batch.column("text")
        lengths, forms, prefixes, middles, outputs = [], [], [], [], []
        for text, drawn in zip(texts, batch.column("draws")):
            text, (h1, h2, h3, h4) = text.as_py(), drawn.as_py()
            n = code_points(text)
            lengths.append(n)
            if not text or h3 % 100 >= changed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                forms.append(PLAIN), prefixes.append(None), middles.append(None), outputs.append(text)
                continue
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            form = SPM if h4 % 100 < suffix_first else PSM
            forms.append(form), prefixes.append(first), middles.append(second - first)
            outputs.append(rearrange(text, first, second, form))
        columns = [ids, pa.array(lengths, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                   pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"), draws(seed).alias("draws"))
    out = map_batches(rows, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame) -> DataFrame:
    """Adds ``restored``, the text rebuilt from ``output`` and ``form`` alone; all other columns of
    ``fill_in_middle`` stay. A null output is restored as an empty text."""
    ship_package(transformed.sparkSession)
    kept = [c for c in transformed.columns if c != "output"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [restore_text(t.as_py(), f.as_py()) for t, f in zip(batch.column("text"), batch.column("form"))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "restored"])

    rows = transformed.select(*kept, as_bytes("output").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored binary"
    out = map_batches(rows, work, schema)
    return out.select(*kept, F.col("text").cast("string").alias("output"), F.col("restored").cast("string").alias("restored"))


def digest(restored: DataFrame) -> DataFrame:
    """SHA-256 of outputs and restored texts in place of the texts."""
    sha = {c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")}
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha["output"], sha["restored"])
