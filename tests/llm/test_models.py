"""Toxicity, language model, embeddings and the pipeline."""

from __future__ import annotations

import math
import random
import subprocess
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm_data import EDGE_TEXTS, docs_of, prose, words  # noqa: F401
from prodlens.llm import embeddings, language_model, toxicity


def toxic_corpus(n=400):
    """Every fourth text holds some of a few marker words with changing ends."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        w = words(i, rng.randrange(20, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["Vermin", "grobz", "SLUDG"]) + rng.choice(["a", "ent", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark, docs_of):
    rows, labels = toxic_corpus()
    rows = rows + EDGE_TEXTS + [(8, rows[8][1])]
    known = spark.createDataFrame([*labels, (8, 0), (3, None), (None, 1), (99999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    training = F.col("doc_id") % 3 != 1
    out = toxicity.score_documents(docs_of(rows), known, training).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] in (9090, 9091, 9092))
    # labels of held-out rows change nothing
    flipped = known.withColumn("toxic", F.when(training, F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.score_documents(docs_of(rows), flipped, training).collect()
    assert Counter(r["score"] for r in out) == Counter(r["score"] for r in again)
    left = toxicity.drop_toxic(docs_of(rows), known, training)
    assert left.columns == docs_of([]).columns and left.where("doc_id = 1").count() == 1 and left.where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("kind", ["chinese", "compound"])
def test_toxicity_reads_whole_words(spark, docs_of, kind):
    """Markers deep inside words: texts without spaces, and ends of compounds."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        bad, marker = int(i % 4 == 0), rng.choice(["毒蛇", "虫害"] if kind == "chinese" else ["vermin", "sludge"])
        if kind == "chinese":
            parts = ["".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(4)) for _ in range(30)]
            parts = parts[:15] + [marker] * bad + parts[15:]
            rows.append((i, "".join(parts)))
        else:
            w = words(i, 60)
            rows.append((i, " ".join(w[:30] + [f"underground-{marker}"] * bad + [f"underground-{w[0]}"] + w[30:])))
        labels.append((i, bad))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_documents(docs_of(rows), known, F.col("doc_id") % 3 != 1).where("held_out").collect()
    truth = dict(labels)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in out) >= 0.95 * len(out)


def test_toxicity_plain_words_are_coded_directly(monkeypatch):
    """Only words with letters from U+0800 on go through runs of two widths; all get the codes of their runs."""

    def by_definition(word):
        letters, wide = word.decode("utf-8", "replace"), lambda c: c >= "\u0800"
        runs = [letters[i : i + (2 if wide(c) else 5)] for i, c in enumerate(letters)]
        runs = [r for i, r in enumerate(runs) if i == 0 or len(r) == (2 if wide(r[0]) else 5) or len(runs[i - 1]) < len(r) + 1]
        codes = [toxicity.xxhash.xxh64_digest(b"5" + r.encode()) + (toxicity.xxhash.xxh64_digest(b"2" + r.encode()) if wide(r[0]) else b"") for r in runs]
        parts = [b"".join(codes[i : i + toxicity.PIECE]) for i in range(0, len(codes), toxicity.PIECE)]
        return [toxicity.xxhash.xxh64_digest(letters[:4].encode()) + parts[0], *parts[1:]]

    rng = random.Random(9)
    some = ["".join(rng.choice("abz.\u00e9\u0436\u07ff\u0800\u4e2d\U0001f600") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    some += [bytes(rng.randrange(33, 256) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    some += [letter.encode() * n for letter in ("a", "\u00e9") for n in range(1, 80)]
    assert [toxicity._pieces(w) for w in some] == [by_definition(w) for w in some]
    monkeypatch.setattr(toxicity, "_mixed_codes", None)
    for word in ("plain", "sentences", "a", "caf\u00e9", "\u0436\u0436\u0436\u0436\u0436\u0436"):
        assert toxicity._pieces(word.encode()) == by_definition(word.encode())


def test_toxicity_codes_cover_every_letter():
    for word in ("a", "abcd", "worthless", "毒", "毒蛇虫", "x毒蛇ab", "привет", "a" * 15 + "bcdefgh" * 30):
        codes = list(toxicity.stems_of(toxicity.codes_of(word.encode())))
        for i in range(len(word)):
            assert list(toxicity.stems_of(toxicity.codes_of((word[:i] + "\u0416" + word[i + 1 :]).encode()))) != codes


def test_toxicity_without_both_classes(spark, docs_of):
    rows, labels = toxic_corpus(20)
    none = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs_of(rows), none).collect()} == {0.0}
    assert toxicity.score_documents(docs_of([]), none).count() == 0


def brute_ctw(train, texts, depth):
    """Context-tree weighting by its definition, node by node."""
    nodes = defaultdict(lambda: [0, 0])
    canon = lambda t: b" ".join(t.lower().split()) + b"\n"

    def bits(t):
        data = b"\n" * depth + canon(t)
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i], (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1

    for t in train:
        for context, prefix, bit in bits(t):
            for d in range(depth + 1):
                nodes[(context[depth - d :], prefix)][bit] += 1
    children = defaultdict(list)
    for context, prefix in nodes:
        if context:
            children[(context[1:], prefix)].append((context, prefix))
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def pw(key):
        if key not in memo:
            own = pe(*nodes[key]) if key in nodes else 0.0
            memo[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(map(pw, children[key]))) - math.log(2)
        return memo[key]

    out = []
    for t in texts:
        total = 0.0
        for context, prefix, bit in bits(t):
            p = None
            for d in range(depth, -1, -1):
                key = (context[depth - d :], prefix)
                n = nodes.get(key, [0, 0])
                estimate = (n[bit] + 0.5) / (sum(n) + 1)
                stay = math.exp(pe(*n) - math.log(2) - pw(key)) if d < depth else 1.0
                p = estimate if p is None else stay * estimate + (1 - stay) * p
            total += math.log10(p)
        out.append(total)
    return out


LM_ROWS = [(i, " ".join(words(i, 12, 30))) for i in range(24)] + EDGE_TEXTS + [(3, " ".join(words(3, 12, 30)))]


@pytest.mark.parametrize("limits, depth", [((10**6, 10**6), 2), ((0, 0), 2), ((10**6, 10**6), 1), ((10**6, 10**6), 4)])
def test_language_model_matches_its_definition(docs_of, limits, depth):
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    out = language_model.score_documents(docs_of(LM_ROWS), held, depth, *limits).collect()
    assert len(out) == len(LM_ROWS)
    is_held = lambda d: d is not None and d % 4 == 1
    train = [(t or "").encode() for d, t in LM_ROWS if not is_held(d)]
    counts = Counter(w for t in train for w in [*t.lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (d, t), score in zip(LM_ROWS, brute_ctw(train, [(t or "").encode() for _, t in LM_ROWS], depth)):
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((d is None, d or 0, is_held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out]
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:6] == w[:6] and g[6:] == pytest.approx(w[6:], abs=1e-6)


def test_language_model_scores_in_rounds_as_in_one(docs_of, monkeypatch):
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    run = lambda *limits: sorted(language_model.score_documents(docs_of(LM_ROWS), held, 2, *limits).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    whole, written, write = run(10**6, 10**6), [], language_model.Stages.write
    monkeypatch.setattr(language_model.Stages, "write", lambda self, label, df: written.append(label) or write(self, label, df))
    for name, value in (("REST_BYTES", 10), ("ROUND_BYTES", 1), ("REST_ROWS", 3)):
        monkeypatch.setattr(language_model, name, value)
    for limits in ((40, 100), (10**6, 100), (40, 10**6)):
        written.clear()
        parts = run(*limits)
        assert len(parts) == len(whole) and ("heads1" in written or limits[1] == 10**6)
        for a, b in zip(parts, whole):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_language_model_joins_rare_words_within_its_disk(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.random() ** 4 * 3000)}" for _ in range(150))) for i in range(3000)]
    docs = docs_of(rows)
    docs.count()
    folders = [spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0], spark.conf.get("spark.checkpoint.dir")]

    def used():
        return int(subprocess.run(["du", "-scB1", *folders], capture_output=True, text=True).stdout.split("\n")[-2].split("\t")[0])

    most, over, before = [0], threading.Event(), used()
    watch = threading.Thread(target=lambda: [most.append(used()) for _ in iter(lambda: over.wait(0.05), True)])
    watch.start()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as tables of some GB
    try:
        scored = language_model.score_documents(docs, F.col("doc_id") % 5 == 1, 5, 2000, 10**6).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        over.set()
        watch.join()
    assert len(scored) == len(rows)
    assert max(*most, used()) - before < 4 * sum(len(t) for _, t in rows)


def test_words_of_a_slice_are_told_apart_by_their_bytes():
    texts = [b"", b"a", b"a a\x00 \x00a ab", b"x" * 8 + b" " + b"x" * 9, b"y" * 64 + b" " + b"y" * 65 + b" " + b"y" * 65, " ".join(words(5, 40, 60)).encode()]
    every = [language_model.normal(t, 3) for t in texts]
    keys, starts = language_model.words_of(np.frombuffer(b"".join(every), np.uint8))
    flat = [w for t in texts for w in t.split()]
    assert len(keys) == len(flat) == len(starts) and len(set(keys)) == len(set(flat))
    assert len(set(zip(keys, flat))) == len(set(flat))


def test_counts_are_added_up_within_bounds(monkeypatch):
    monkeypatch.setattr(language_model, "HELD_ROWS", 50)
    monkeypatch.setattr(language_model, "SENT_ROWS", 7)
    held, want, got = language_model._Counts(1), Counter(), Counter()
    rng = np.random.default_rng(3)
    sent = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 60, 30))
        want.update(dict.fromkeys(keys.tolist(), 2))
        sent += held.add(keys, np.full(len(keys), 2))
        assert held.rows < 50
    sent += held.send()
    for batch in sent:
        assert batch.num_rows <= 7
        for r in batch.to_pylist():
            got[r["key"]] += r["n"]
    assert got == want and not list(held.send())


def test_a_table_gives_zero_for_other_keys():
    keys = np.arange(-500, 500, 3)
    table = language_model._Table(keys, keys * 2 + 1.0)
    asked = np.arange(-600, 600)
    assert table[asked].tolist() == [2.0 * k + 1 if k in set(keys.tolist()) else 0.0 for k in asked.tolist()]
    assert language_model._Table(keys[:0], keys[:0])[asked].tolist() == [0.0] * len(asked)


def test_language_model_edges(docs_of):
    empty = language_model.score_documents(docs_of([]), F.lit(False), 2)
    assert empty.count() == 0
    untrained = language_model.score_documents(docs_of([(1, "ab")]), F.lit(True), 2).first()
    assert untrained["score"] == pytest.approx(-24 * math.log10(2)) and untrained["train_tokens"] == 0
    with pytest.raises(ValueError):
        language_model.score_documents(docs_of([]), F.lit(False), 9)


def vectors(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = rng.standard_normal(24)
            for _ in range(rng.integers(1, 4)):
                rows.append((at, (base + 0.13 * rng.standard_normal(24)).tolist(), label))
                at += 1
    base = rng.standard_normal(24)
    rows += [(at + i, (base + 0.1 * rng.standard_normal(24)).tolist(), 0) for i in range(60)]  # more than a list holds
    at += 60
    rows += [(at + i, rows[0][1], 0) for i in range(30)] + [(at + 30, [2 * x for x in rows[0][1]], 0), (at + 31, rows[0][1], 1)]
    at += 40
    rows += [(at, None, 0), (at + 1, [], 0), (at + 2, [0.0] * 24, 0), (at + 3, [None] + [1.0] * 23, 0), (at + 4, [float("nan")] + [1.0] * 23, 0)]
    rows += [(at + 5, [float("inf")] * 24, 0), (at + 6, [1.0, 2.0], 0), (at + 7, [2.0, 4.0], 0), (at + 8, rows[1][1] + [0.0], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    return rows, spark.createDataFrame(rows, schema).withColumn("cls", F.lit("clash"))


@pytest.mark.parametrize("block", [16, 512])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows, df = vectors(spark)
    out = {r["vec_id"]: r for r in embeddings.link_vectors(df).collect()}
    assert len(out) == len(rows)
    ok = lambda v: bool(v) and None not in v and np.isfinite(v).all() and np.any(v)
    links = defaultdict(set)
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a is not None and a == b and ok(v) and ok(w) and len(v) == len(w) and np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    for i, _, _ in rows:
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        r = out[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), min(reached), i == min(reached))


def check_links(rows, df):
    out = {r["vec_id"]: r for r in embeddings.link_vectors(df).collect()}
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    links = (unit @ unit.T >= 0.98) & ~np.eye(len(rows), dtype=bool)
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(links[todo.pop()]).tolist()) - reached
            reached |= new
            todo += new
        assert (out[i]["n_links"], out[i]["component_id"]) == (links[i].sum(), min(reached))
    return links


def test_vectors_of_full_lists_link_to_other_components(spark):
    """Two groups of near copies: every list is full of its own group, and links between the groups are farther."""
    rng, rows = np.random.default_rng(5), []
    for x in (0.0, np.arccos(0.981)):
        centre = np.r_[np.cos(x), np.sin(x), np.zeros(30)]
        rows += [(len(rows) + i, (centre + 0.002 * rng.standard_normal(32)).tolist(), 0) for i in range(200)]
    links = check_links(rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert links[:200, 200:].any()


def test_vectors_of_a_poor_graph_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TRIES", 1)
    monkeypatch.setattr(embeddings, "TABLES", 1)
    monkeypatch.setattr(embeddings, "_refine", lambda lists, classes, k: lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos"))
    rng, rows = np.random.default_rng(6), []
    for _ in range(300):
        base = rng.standard_normal(24)
        rows += [(len(rows) + i, (base + 0.08 * rng.standard_normal(24)).tolist(), 0) for i in range(2)]
    check_links(rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_vectors_of_nothing(spark):
    _, df = vectors(spark)
    assert embeddings.link_vectors(df.limit(0)).count() == 0
    assert [r["n_links"] for r in embeddings.link_vectors(df.where("embedding IS NULL")).collect()] == [0]


def test_pipeline_decisions(spark, docs_of, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline
    from test_documents import brute_links, brute_removed, check_packing, shingles

    rows, labels = toxic_corpus(300)
    rows = rows + [(1001, rows[1][1]), (1002, rows[2][1] + " more"), (1003, prose(4000, 40) + " " + " ".join(rows[3][1].split()[:30] * 1))]
    rows += [(1004, prose(4001, 30) + " " + prose(1, 20)), (1005, None), (1006, "")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, out = docs_of(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else []
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        if name == "toxicity":
            truth = dict(labels)
            wrong = [d for d, _ in before if (d in after) == bool(truth.get(d, 0))]
            assert len(wrong) <= 0.03 * len(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, _, c in brute_links(before) if d == c}
        elif name == "substring_dedup":
            removed = {d[1]: n for d, _, n, _ in brute_removed(before)}
            assert set(after) == {d for d, _ in before} and sum(n > 0 for n in removed.values()) >= 1
            for d, t in before:
                assert len((after[d] or "").split()) == len((t or "").split()) - removed[d]
        elif name == "decontamination":
            own = shingles(prose(1, 20))
            assert set(after) == {d for d, t in before if len(own & shingles(t)) < 0.8 * len(own)} and 1 not in after
        else:
            check_packing(before, docs.collect(), 4096)
        out[name] = docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out["packing"]
