"""Shingle, phrase, packing and pipeline operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm_data import EDGE_TEXTS, docs_of, prose, words  # noqa: F401
from pyspark.sql import functions as F

from prodlens.llm import decontaminate, ngram_join, packing, substring_dedup
from prodlens.llm.components import connected_components
from prodlens.llm.storage import Stages

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = SPLIT.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def mixed_corpus():
    """Exact and near copies in chains, a common line, short and empty texts, repeats of rows."""
    rng, rows = random.Random(3), []
    line = words(99, 14)
    for i in range(60):
        w = words(i, rng.randrange(30, 90))
        if i % 3 == 0:
            w[5:5] = line
        rows.append((i, " ".join(w)))
    base = words(500, 60)
    for i in range(40):  # a chain: each differs a little from the one before
        base = list(base)
        base[rng.randrange(60)] = f"z{i}"
        rows.append((100 + i, " ".join(base).upper() if i % 5 == 0 else "\n".join(base)))
    rows += [(200 + i, prose(1000, 50)) for i in range(12)] + [(5, rows[5][1])] * 2 + EDGE_TEXTS + [(300, "one")]
    rows += [(400, "a a a a a a a a"), (401, "a a a a a"), (402, "A  a\ta a a a")]
    return rows


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None))


def test_links_match_brute_force(docs_of):
    rows = mixed_corpus()
    got = ngram_join.link_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == brute_links(rows)


def test_links_in_blocks_match(spark, docs_of, monkeypatch):
    """Tiles of more sets than a block take the other way; the result is the same."""
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, full, stages: links(pairs, full, stages, 6))
    rows = mixed_corpus()
    got = ngram_join.link_documents(docs_of(rows)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == brute_links(rows)


def test_links_of_nothing(docs_of):
    assert ngram_join.link_documents(docs_of([])).count() == 0
    assert ngram_join.keep_one(docs_of([(1, None), (2, "a b"), (3, "a b")])).count() == 2


def test_overlap_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        common, a, b = (rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
        apart = np.bitwise_count(ngram_join.signature(x) ^ ngram_join.signature(y)).sum()
        assert apart <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(7, 7)]
    comp = {}
    for a, b in edges:
        if a != b:
            x, y = comp.get(a, {a}), comp.get(b, {b})
            for n in x | y:
                comp[n] = x | y
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b", Stages(spark, "t")).collect()}
    assert got == {n: min(c) for n, c in comp.items()}
    assert connected_components(df.limit(0), "a", "b", Stages(spark, "t")).count() == 0


def brute_removed(rows):
    where = {}
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        w = SPLIT.findall(t or "")
        for i in range(len(w) - 19):
            k, here = tuple(w[i : i + 20]), (order(d), i)
            where[k] = min(where.get(k, here), here)
    out = []
    for d, t in rows:
        w = SPLIT.findall(t or "")
        gone = {i + j for i in range(len(w) - 19) if where[tuple(w[i : i + 20])] < (order(d), i) for j in range(20)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((order(d), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def phrase_corpus():
    rng = random.Random(8)
    passage, rows = words(77, 45), []
    for i in range(50):
        w = words(2000 + i, rng.randrange(15, 70))
        if i % 2:
            cut = rng.randrange(0, 20)
            w[3:3] = passage[cut : cut + rng.randrange(18, 26)]
        if i % 7 == 0:
            w += w[:25]
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    rows += [(60, " ".join(["same"] * 70)), (61, " ".join(["same"] * 30)), (62, rows[3][1]), (3, rows[3][1]), (63, rows[5][1].upper())]
    return rows + EDGE_TEXTS + [(None, prose(7, 40))]


@pytest.mark.parametrize("block", [60, 200_000])
def test_repeats_match_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    rows = phrase_corpus()
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2], r[3]) for r in substring_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == brute_removed(rows)


def test_windows_of_a_hot_anchor_are_split(spark, docs_of, monkeypatch):
    """A line of 12 words in every text among other words: no shard key holds more than a few distinct segments."""
    monkeypatch.setattr(substring_dedup, "HOT", 8)
    line, same = prose(77, 12), prose(78, 30)
    rows = [(i, f"{prose(5000 + i, 15)} {line} {prose(6000 + i % 50, 15)}" + (f" {same} {same}" if i % 3 == 0 else "")) for i in range(100)]
    rows += [(None, f"{prose(5001, 15)} {line}"), (7, rows[7][1])] + phrase_corpus()
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2], r[3]) for r in substring_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == brute_removed(rows)
    keyed = docs_of(rows).selectExpr("doc_id", "cast(text AS binary) AS text", "xxhash64(text) AS text_key")
    routed = substring_dedup.route(keyed.where("text IS NOT NULL"), Stages(spark, "test")).where("stop IS NULL")
    assert routed.groupBy("anchor").agg(F.count_distinct("segment").alias("n")).agg(F.max("n")).first()[0] <= 8


def test_blocks_of_one_anchor(monkeypatch):
    """An anchor whose segments span several blocks keeps what it has seen."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 20)
    segment = list(range(1, 21))
    batch = pa.RecordBatch.from_pydict(
        {"anchor": [5] * 4, "doc_id": [1, 2, 3, 3], "text_key": [0] * 4, "start": [0, 4, 0, 9], "stop": pa.array([None] * 4, pa.int64()), "segment": pa.array([segment] * 4, pa.list_(pa.int32()))}
    )
    out = [r for b in substring_dedup._locate(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["low"], r["high"]) for r in out] == [(2, 4, 24), (3, 0, 20), (3, 9, 29)]


def test_drop_repeats_keeps_clean_texts_and_columns(docs_of):
    rows = phrase_corpus()
    df = docs_of(rows).withColumnsRenamed({"source": "_ranges", "lang": "_doc"})
    out = substring_dedup.drop_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    removed = {r[0]: r[2] for r in substring_dedup.remove_repeats(df).collect()}
    texts = dict(rows)
    for r in out.collect():
        if r["doc_id"] is not None and not removed[r["doc_id"]]:
            assert r["text"] == texts[r["doc_id"]]
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0


def test_contained_items_match_brute_force(spark, docs_of):
    rng, items, rows = random.Random(4), [(1, prose(1, 12)), (2, prose(2, 40)), (3, "Short One"), (4, None), (5, " "), (None, prose(9, 9)), (6, prose(6, 1))], []
    for i in range(40):
        w = words(3000 + i, rng.randrange(5, 400))
        if i % 4 == 0:
            part = prose(1 + i % 2, 12 if i % 2 == 0 else 40).split()
            if i % 8 == 0:
                part[0] = "changed"
            w[2:2] = [x.upper() for x in part]
        if i % 10 == 1:
            w[1:1] = ["short", "ONE"]
        rows.append((i, " ".join(w)))
    rows += EDGE_TEXTS + [(50, prose(2, 40)), (50, "other"), (51, "short one")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", __import__("pyspark").sql.functions.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in decontaminate.contained_items(docs_of(rows), table).collect()}
    want = {}
    for i, t in items:
        w = SPLIT.findall(low(t))
        if i is None or not w:
            continue
        k = min(5, len(w))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, text in rows:
            v = SPLIT.findall(low(text))
            common = len(own & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)})
            if d is not None and common / len(own) >= 0.8:
                want[(d, i)] = max(want.get((d, i), (0, 0)), (len(own), common))
    assert got == want and len(want) > 10
    assert decontaminate.contained_items(docs_of(rows), table.limit(0)).count() == 0
    assert decontaminate.contained_items(docs_of([]), table).count() == 0
    left = decontaminate.drop_contaminated(docs_of(rows), table)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def check_packing(rows, out, size):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for d, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((d is None, d or 0, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing_is_whole_and_tight(docs_of):
    rng = random.Random(6)
    rows = [(i, prose(i, rng.randrange(0, 120))) for i in range(150)] + EDGE_TEXTS + [(1, prose(1, 30))] * 2 + [(700, prose(700, 3000)), (701, "<|endoftext|> x")]
    out = packing.pack(docs_of(rows), size=256).collect()
    n = check_packing(rows, out, 256)
    assert n <= 1.02 * sum(r["length"] for r in out) / 256 + 1
    assert packing.pack(docs_of([])).count() == 0


def test_best_fit_is_best_fit_decreasing():
    """The rounds over run lengths fill as many sequences as the same rule piece by piece."""
    rng = random.Random(9)
    for size in (7, 50, 300):
        lengths = [rng.randint(1, size) for _ in range(400)]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(size - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.best_fit(counts, size)
        assert max(first + -(-n // each) for _, _, n, first, each, _ in runs) == len(gaps)
        assert {n: sum(r[2] for r in runs if r[0] == n) for n in counts} == counts


def test_tokens_of_words_are_those_of_the_whole_text():
    """Ids looked up word by word against the tokenizer's ids of the text as it stands."""
    import random

    from tokenizers import Tokenizer

    from prodlens.llm import packing

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(6)
    pool = list("abcXYZ019 .,;:!?*&%$#\"()'`[]{}<>|/-_=+~^@ \t\n\x00\x1c\x7féÉßñç中文🙂‘’“”…—") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "...", "  "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))).encode() for _ in range(3000)]
    latin = [chr(c) for c in range(0xC0, 0x250)] + list("aeinst")
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randrange(1, 9))) for _ in range(40)).encode() for _ in range(300)]
    coded = packing.encode_texts(texts, packing.tokenizer_path())
    whole = tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
    assert coded == [packing._ids(e) for e in whole]
