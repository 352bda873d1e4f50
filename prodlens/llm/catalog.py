"""The registered queries of the operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.llm import (
    chat, decontaminate, embeddings, infilling, language_model, ngram_join, packing, periodic, sharding, substring_dedup, token_counts, toxicity, urls,
)

REGISTRY, ORACLES = {}, {}


def registered(name: str, sql: str | None = None):
    def add(query):
        REGISTRY[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40, [1.0] * 41)


# a conversation whose texts hold control strings of well-known templates and an escape
TRAP = r"\### Assistant: </turn> ok"

OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS written,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS named
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(written + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE named + 15 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@registered("op5_chat", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(table(spark, sf_dir, "conversations").select(*columns).union(extra)))


URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
BAD_SHARE, BAD_Z = 0.15, 1.645

OP10_SQL = r"""
WITH known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), seen AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), sites AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(host, '^[\s\S]*@|:[0-9]*\z', '', 'g') AS site
  FROM seen LEFT JOIN known USING (page_id) GROUP BY host
), hosts AS (
  SELECT host, n, bad, suffix,
    CASE WHEN length(site) > length(suffix) THEN string_split(left(site, length(site) - length(suffix) - 1), '.')[-1] || '.' || suffix ELSE site END AS domain
  FROM (SELECT *, regexp_extract(site, '(?:^|\.)(SUFFIXES|[^.]*)\z', 1) AS suffix FROM sites)
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix
), sk AS (SELECT coalesce(1 / least(greatest(sum(n * (bad / n - m) * (bad / n - m) / (m * (1 - m)) - 1) / sum(n - 1), 1 / 10001), 1 / 1.01::DOUBLE) - 1, 10) AS k FROM s0 WHERE n >= 2),
s AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, sk),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(s.m) AS m FROM hosts JOIN s USING (suffix) GROUP BY suffix, domain),
dk AS (SELECT coalesce(1 / least(greatest(sum(n * (bad / n - m) * (bad / n - m) / (m * (1 - m)) - 1) / sum(n - 1), 1 / 10001), 1 / 1.01::DOUBLE) - 1, 10) AS k FROM d0 WHERE n >= 2),
d AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m FROM d0, dk),
h0 AS (SELECT host, hosts.n, hosts.bad, d.m FROM hosts JOIN d USING (suffix, domain)),
hk AS (SELECT coalesce(1 / least(greatest(sum(n * (bad / n - m) * (bad / n - m) / (m * (1 - m)) - 1) / sum(n - 1), 1 / 10001), 1 / 1.01::DOUBLE) - 1, 10) AS k FROM h0 WHERE n >= 2),
h AS (SELECT host, n, bad, (bad + k * m) / (n + k) AS mean, n + k + 1 AS size FROM h0, hk),
judged AS (
  SELECT page_id, host, path, n, bad, mean, mean - 1.645 * sqrt(mean * (1 - mean) / size) AS bound,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen JOIN h USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN bound > 0.15 THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled, bad::BIGINT AS n_bad, round(mean, 6) AS mean, round(bound, 6) AS bound
FROM judged
"""


OP10_SQL = OP10_SQL.replace("SUFFIXES", "|".join(urls.PUBLIC_SUFFIXES).replace(".", r"\."))


@registered("op10_url_filters", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose label says low quality are the bad outcomes."""
    bad = F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_pages(pages, labels, URL_RULES, urls.PUBLIC_SUFFIXES, BAD_SHARE, BAD_Z)


# words, distinct shingles and their number per document; the oracles of both shingle operators start with it
SHINGLES_SQL = r"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words
)
"""

OP4_SQL = f"""
WITH RECURSIVE {SHINGLES_SQL},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
commons AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM commons JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reached AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached ON node = d.doc_id GROUP BY d.doc_id
"""


@registered("op4_ngram_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH {SHINGLES_SQL},
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM items
), sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
"""


@registered("op7_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS start,
    unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' '))) AS phrase
  FROM words WHERE len(w) >= 20
), marked AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1
), covered AS (
  SELECT DISTINCT doc_id, start + i AS place FROM marked, (SELECT unnest(range(20)) AS i)
), kept AS (
  SELECT doc_id, list(place) AS gone FROM covered GROUP BY doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@registered("op6_substring_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@registered("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@registered("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return language_model.score_documents(table(spark, sf_dir, "documents"), held_out)


@registered("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity_training())


def toxicity_training():
    """Rows whose crc32(doc_id as text) mod 3 is 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


OP9_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reached AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id JOIN reached ON node = vec_id GROUP BY vec_id
"""


@registered("op9_embedding_near_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), numbers AS (
  SELECT *, length(text) AS n, ('0x' || hex[1:8])::UBIGINT::BIGINT AS h1, ('0x' || hex[9:16])::UBIGINT::BIGINT AS h2,
    ('0x' || hex[17:24])::UBIGINT::BIGINT AS h3, ('0x' || hex[25:32])::UBIGINT::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), blocks AS (
  SELECT *, '<P>' || substr(text, 1, a) AS p, '<S>' || substr(text, b + 1) AS s, '<M>' || substr(text, a + 1, b - a) AS m FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM blocks
"""


@registered("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digest(infilling.restore(infilling.fill_in_middle(table(spark, sf_dir, "documents"))))


# every run holds two equal stretches of 4 words a period apart; chains of such pairs are the runs
OP12_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS o,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS digits
  FROM documents
), hashed AS (
  SELECT row, doc_id, o, len(o) AS n, xor(4294967295, list_reduce(range(9 * len(digits)), lambda c, i:
    CASE WHEN i % 9 = 0 THEN xor(c, digits[i // 9 + 1]) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT)) AS h
  FROM split
), chosen AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS k FROM hashed
), planted AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i:
    CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (n - a) // k) + 1] END) END AS w
  FROM chosen
), places AS (
  SELECT row, n, unnest(range(1, n - 2)) AS i, unnest(list_transform(range(1, n - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS gram
  FROM planted WHERE n >= 4
), pairs AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.row = y.row AND x.gram = y.gram AND y.i > x.i AND y.i - x.i <= x.n // 4
), chained AS (
  SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS chain FROM pairs
), stretches AS (
  SELECT row, q, min(i) - 1 AS start, count(*) + 3 + q AS length FROM chained GROUP BY row, q, chain
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length
), listed AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best
  FROM runs GROUP BY row
), gone AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), words AS (
  SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM planted
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)
"""


def plant_repeats(docs: DataFrame) -> DataFrame:
    """Texts of the documents whose hash ends in 0 run in a circle from a drawn word on, words joined by one
    space; others stay. A null doc_id has no hash and stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    drawn = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    a = F.pmod(F.col("g"), n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(F.col("g"), F.lit(8))))
    placed = drawn.select("doc_id", "text", "w", a.cast("int").alias("a"), p.cast("int").alias("p"), (n - a).cast("int").alias("left"))
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("left") / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), F.col("left"))), " ")
    return placed.select("doc_id", F.when(F.size("w") > 0, text).otherwise(F.col("text")).alias("text"))


@registered("op12_periodic_runs", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.describe_runs(plant_repeats(table(spark, sf_dir, "documents"))))


@registered("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))
