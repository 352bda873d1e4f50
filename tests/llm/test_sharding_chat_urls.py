from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_data import EDGE_TEXTS, docs_of, prose  # noqa: F401
from prodlens.llm import chat, sharding, urls


def test_shards_are_gapless_and_few_records_move(spark, docs_of):
    rows = [(i, prose(i, 5)) for i in range(600)] + [(1, prose(1, 5))] * 3 + EDGE_TEXTS
    out = sharding.shard_documents(docs_of(rows), [1.0] * 8, [1.0] * 9).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["shard"] for r in out if r["doc_id"] == 1} == {next(r["shard"] for r in out if r["doc_id"] == 1)}
    texts = dict(rows)
    for r in out:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))


def test_weights_and_refusals(spark, docs_of):
    out = sharding.shard_documents(docs_of([(i, "x") for i in range(4000)]), [3.0, 1.0, 0.0])
    n = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.6 < n[0] / n[1] < 3.4
    for bad in ([], [0.0], [-1.0, 2.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.lit(1), bad)
    assert sharding.shard_documents(docs_of([]), [1.0]).count() == 0


TURNS = [
    (1, 0, "user", "a<b> \\s \\"), (1, 1, "user", ""), (1, 2, "assistant", "</turn>\n<turn:user>x"), (1, 3, "assistant", "<and>"),
    (1, 4, "user", None), (2, 5, None, "x"), (2, None, "assistant", "first \U0001f600"), (2, 5, None, "x"), (3, 0, "r>o<l\\e", "\\l\\g"), (None, 0, "user", "n"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.format_conversations(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_formatted(made).collect()}
    want = {}
    for c, t, role, text in sorted(TURNS, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    formatted = {r["conv_id"]: r["formatted"] for r in made.collect()}
    assert formatted[1].count("<turn:") == 3 and formatted[1].count("<and>") == 2  # adjacent turns of a role share a block
    row = {r["conv_id"]: r for r in chat.digest(made).collect()}[1]
    assert row["n_turns"] == 5 and row["formatted_chars"] == len(formatted[1])
    loss = "</turn>\n<turn:user>x<and>"
    assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    listed = "".join(f"{role}\n{text}\n" for role, text in want[1])
    assert row["turns_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(df)).count() == 0


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "x://example.net", None), (3, None, None), (4, "no scheme/net/", None),
        (5, "http://notexample.net/en/", None), (6, "http://h.org?x/fr/", None), (7, "http://b.org/fr/://c", None), (8, "http://É.com/De/", None),
    ]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")]
    labels = spark.createDataFrame([], "page_id long, bad int")
    out = {r["page_id"]: r for r in urls.filter_pages(page(spark, rows), labels, rules, limit=0.9).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[2]["path"], out[2]["rule"]) == ("", None)
    assert (out[3]["host"], out[4]["host"], out[4]["path"]) == ("", "", "")
    assert (out[5]["rule"], out[5]["verdict"]) == ("net/", "block")
    assert (out[6]["host"], out[6]["path"], out[6]["rule"]) == ("h.org", "", None)
    assert out[7]["rule"] == "org/fr/" and out[8]["host"] == "É.com"


def test_reputation_shrinks_and_blocks_only_on_evidence(spark):
    pages, labels = [], []
    for i in range(300):
        host = "bad.x.com" if i < 100 else f"h{i % 5}.y.com" if i < 299 else "few.z.com"
        pages.append((i, f"http://{host}/p", "h"))
        labels.append((i, int(i < 90 or i == 299)))
    pages += [(400, "http://new.x.com/", None), (0, "http://bad.x.com/p", None), (None, "http://h1.y.com/", None)]
    labels += [(0, None), (5, 0), (None, 1)]
    out = urls.filter_pages(page(spark, pages), spark.createDataFrame(labels, "page_id long, bad int"), limit=0.5).collect()
    assert len(out) == len(pages)
    verdict = {r["host"]: r["verdict"] for r in out}
    mean = {r["host"]: r["mean"] for r in out}
    assert verdict["bad.x.com"] == "block" and verdict["h1.y.com"] == "allow"
    assert mean["h1.y.com"] < mean["new.x.com"] < 0.9 + 1e-9  # an unseen host has its domain's estimate
    assert urls.filter_pages(page(spark, []), spark.createDataFrame(labels, "page_id long, bad int")).count() == 0


def test_suffixes_users_and_ports(spark):
    want = {
        "b.co.uk": ("co.uk", "b.co.uk"), "x.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "xco.uk": ("uk", "xco.uk"),
        "a.com:8080": ("com", "a.com"), "me:pw@w.a.com:": ("com", "a.com"), "a@b@c.io": ("io", "c.io"), "y.github.io": ("github.io", "y.github.io"),
        "": ("", ""), "localhost:1": ("localhost", "localhost"), "a.": ("", "a."), ".com": ("com", ".com"), "a.com:80\n": ("com:80\n", "a.com:80\n"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    suffix, domain = urls.host_levels(F.col("host"), urls.PUBLIC_SUFFIXES)
    assert {r[0]: (r[1], r[2]) for r in hosts.select("host", suffix, domain).collect()} == want
    plain = hosts.select("host", urls.host_levels(F.col("host"))[0].alias("s")).collect()
    assert {r.host: r.s for r in plain}["b.co.uk"] == "uk"


def test_sites_below_a_public_suffix_do_not_share_labels(spark):
    pages = [(i, f"http://bad.co.uk/{i}") for i in range(40)] + [(100, "http://other.co.uk/"), (101, "http://new.bad.co.uk:81/")]
    pages += [(200 + i, f"http://good{i}.co.uk/") for i in range(40)]
    labels = [(i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)]
    rows = urls.filter_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), (), urls.PUBLIC_SUFFIXES).collect()
    mean = {r["host"]: r["mean"] for r in rows}
    assert mean["other.co.uk"] < 0.6 < 0.8 < mean["new.bad.co.uk:81"]


def test_time_of_a_long_conversation_grows_with_its_turns(spark):
    import time

    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("word <x> " * 40).alias("text"))
        start = time.perf_counter()
        row = chat.digest(chat.format_conversations(turns)).first()
        assert row.n_turns == n
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(8_000) for _ in range(2)), seconds(64_000)
    assert large < 8 * small * 2.5 + 2


def shard_by_hand(key, weights):
    """Hash of key, shard and salt one after the other, each the seed of the next; the best score wins."""
    import math
    import struct

    import xxhash

    scores = []
    for i, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), xxhash.xxh64_intdigest(struct.pack("<i", i), h))
        if weight > 0:
            scores.append((-weight / math.log(((h >> 11) + 0.5) / 2.0**53), i))
    return max(scores)[1]


def test_shards_recomputed_by_hand(spark, docs_of):
    rows = [(i * 7919 - 500_000, prose(i, 3)) for i in range(2000)] + [(None, "x")]
    weights, grown = [1.0, 2.0, 0.0, 0.5], [1.0, 2.0, 0.0, 0.5, 1.0]
    out = sharding.shard_documents(docs_of(rows), weights, grown).collect()
    for r in out:
        assert (r.shard, r.grown_shard) == (shard_by_hand(r.doc_id, weights), shard_by_hand(r.doc_id, grown))
    for shard in {r.shard for r in out}:
        mine = sorted((r for r in out if r.shard == shard), key=lambda r: r.slot)
        ids = [-(2**63) if r.doc_id is None else r.doc_id for r in mine]
        assert ids == sorted(ids) and [r.slot for r in mine] == list(range(len(mine)))
