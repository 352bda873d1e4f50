"""Fill-in-the-middle, periodic runs and token counts against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import EDGE_TEXTS, docs_of, prose  # noqa: F401
from prodlens.llm import catalog, infilling, periodic, token_counts

LONG_TEXT = prose(5, 700_000) + " " + "é中🙂" * 50_000  # some megabytes


def with_clashes(docs):
    names = ["n", "form", "output", "restored", "draws", "start", "length", "period", "runs", "n_tokens", "held_out"]
    return docs.select("*", *[F.lit("own").alias(c) for c in names])


# fill in the middle


def cut_by_hand(doc_id, text):
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_fill_in_middle_equals_slices_and_comes_back(spark, docs_of):
    rows = [(i, prose(i, i % 40) + "é<🙂P>中" * (i % 3)) for i in range(300)] + EDGE_TEXTS
    rows += [(7, "a<P>b"), (8, "<M"), (8, "<M"), (11, "<"), (12, "P>"), (13, "S><"), (14, LONG_TEXT)]
    out = infilling.restore(infilling.fill_in_middle(with_clashes(docs_of(rows)))).collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == sorted((str(i), *cut_by_hand(i, t)) for i, t in rows)
    assert sorted(r["restored"] for r in out) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert infilling.digest(infilling.restore(infilling.fill_in_middle(docs_of([])))).count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 2 * infilling.PIECE + 1, 5 * infilling.PIECE])
def test_rotation_in_place(size):
    rng = random.Random(size)
    data = rng.randbytes(size)
    for cut in {0, size, size // 3, size // 2}:
        buffer = bytearray(data)
        infilling.rotate(buffer, 0, cut, size)
        assert buffer == data[cut:] + data[:cut]


def test_code_points_are_scanned_across_pieces():
    text = "aé中🙂" * infilling.PIECE
    raw = text.encode()
    assert infilling.code_points(raw) == len(text)
    for point in (0, 1, 65_535, 65_536, 100_001, len(text)):
        assert infilling.byte_place(raw, point) == len(text[:point].encode())


# periodic runs


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def described_by_hand(text):
    words = (text or "").encode().split()
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), [tuple(r) for r in runs], collapsed


def periodic_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        n, kinds = rng.randrange(1, rng.choice([12, 60, 300])), rng.choice([1, 2, 3, 40])
        words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if rng.random() < 0.4:
            unit = ["a"] * rng.randrange(1, 12) + ["b"]
            words = unit * rng.randrange(1, 9) + words[:3] + unit * rng.randrange(1, 15)
        yield " ".join(words)


def test_runs_equal_brute_force(spark, docs_of):
    rows = list(enumerate(periodic_texts(1, 400))) + EDGE_TEXTS + [(5000, "x " * 3000), (5000, "x " * 3000)]
    out = periodic.describe_runs(with_clashes(docs_of(rows))).collect()
    got = sorted((str(r["doc_id"]), r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out)
    assert got == sorted(((str(i), *described_by_hand(t)) for i, t in rows), key=lambda r: r)
    assert periodic.digest(periodic.describe_runs(docs_of([]))).count() == 0


def test_long_runs_beyond_one_transform():
    unit = ["a"] * 30_000 + ["b"]
    texts = [" ".join(unit * 5), LONG_TEXT, " ".join(["a"] * 200_000)]
    words, bounds, _ = periodic._as_array([t.encode() for t in texts])
    runs = periodic.find_runs(words, bounds)
    own = [[tuple(map(int, r)) for r in runs - [bounds[i], bounds[i], 0] if 0 <= r[0] < len(texts[i].split())] for i in (0, 2)]
    assert own[1] == [(0, 200_000, 1)]
    assert own[0] == sorted([(0, 150_005, 30_001)] + [(k * 30_001, k * 30_001 + 30_000, 1) for k in range(5)], key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("size", [4, 64, 128, 4096, 8192, 32768])
def test_transform_gives_exact_mismatches(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, periodic.MODULUS, (2, size))
    assert (periodic._reduce(periodic.transform(periodic.transform(x), True) * pow(size, -1, periodic.MODULUS)) == x).all()
    width = size // 2
    top = int(periodic._levels(np.arange(100_000), width).max())
    assert top * top * width < periodic.MODULUS
    patterns, windows = rng.integers(0, top + 1, (2, width)), rng.integers(0, top + 1, (2, size))
    got = periodic.mismatches(patterns, windows)
    for lag in rng.integers(0, width + 1, 20):
        assert (got[:, lag] == ((patterns - windows[:, lag : lag + width]) ** 2).sum(axis=1)).all()


def test_every_period_has_a_scale():
    for q in range(1, 100_000):
        block = 2
        while periodic.scale_periods(block)[1] < q:
            block *= 2
        assert periodic.scale_periods(block)[0] <= q and 2 * block + q - 1 <= 4 * q


def test_planted_repeats(spark, docs_of):
    rows = [(i, prose(i, 3 + i % 50)) for i in range(200)] + EDGE_TEXTS
    got = {(r["doc_id"], r["text"]) for r in catalog.plant_repeats(docs_of(rows)).collect()}
    want = set()
    for i, text in rows:
        words, h = [w.decode() for w in (text or "").encode().split()], zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
        want.add((i, text))
    assert got == want


# token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


def strings(seed, many):
    rng = random.Random(seed)
    pool = "abc  \n\t'sdé!?中文かナ🙂 ՘Ᲊ0123٣=-\x00 　\x1c\x85ıß"
    extra = ["<|endoftext|>", "ing", "'ll", "    ", "====", "<|endoftext", "̀", "\U0003fc3b"]
    for _ in range(many):
        yield "".join(rng.choice(extra) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randrange(200)))


def test_counts_equal_the_library(spark, docs_of, library):
    rows = list(enumerate(strings(1, 1500))) + EDGE_TEXTS
    rows += [(9000, LONG_TEXT), (9001, "=" * 100_000), (9001, "=" * 100_000), (9002, "x y" * 400_000), (9003, " " * 50_000 + "a"), (9004, "abcdefghij" * 9000)]
    out = token_counts.count_tokens(with_clashes(docs_of(rows))).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out)
    coded = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = [(str(i), len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(rows, coded)]
    assert got == sorted(want)
    assert token_counts.count_tokens(docs_of([])).count() == 0


def test_stable_characters_are_cut_alike(library):
    stable = token_counts.regex.compile(f"[{token_counts.STABLE}]")
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000 or not stable.match(chr(code)):
            continue
        for text in (f"a{chr(code)}", f"1{chr(code)}", f"!{chr(code)}", f" {chr(code)}a"):
            assert token_counts._PRE_TOKENS.findall(text) == token_counts._library_words(text), hex(code)


def test_long_words_are_not_remembered():
    from prodlens.llm import text

    memory = text.Memory(len)
    assert [memory[b"x" * 1_000_000 + str(i).encode()] for i in range(3)] == [1_000_001] * 3 and not memory
    assert memory[b"short"] == 5 and len(memory) == 1
    text.forget_others("one")
    memory[b"again"]
    text.forget_others("one")
    assert memory
    text.forget_others("other")
    assert not memory
