"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import (
    bpe, byte_bpe, conversation_trie, decontamination, embeddings, filter_audit, packing, pii, repeats,
    scoring, simhash, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


# The tokenizer file; another place can be named where it is installed elsewhere.
TOKENIZER = os.environ.get("SALESMART_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")

RANKS = os.environ.get("SALESMART_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

MULTI_RANKS = os.environ.get("SALESMART_MULTI_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id"
    )


@query
def op2_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words()
    return marked.selectExpr(
        "doc_id", "n_words", f"{n_hit} AS n_hit", "bigint(size(item_ids)) AS n_items",
        "sha2(concat_ws(',', item_ids), 256) AS items_sha256", "size(runs) > 0 AS contaminated",
    )


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLE_SQL["op2_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
placed AS (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM placed),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
gram AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item_id FROM gram JOIN win USING (n, s)),
marked AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit)
    GROUP BY r),
met AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS varchar) AS item FROM hit WHERE item_id IS NOT NULL)
    GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (r) LEFT JOIN met USING (r)
"""


@query
def op10_bpe(spark, sf_dir):
    ids = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, decoded=True)
    return ids.selectExpr(
        "doc_id", "bigint(octet_length(ids) / 4) AS n_tokens", "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


@query
def op3_warc(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL["op3_warc"] = """
WITH page AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (
    SELECT *, CASE WHEN payload_bytes >= 1000
        THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM page)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first THEN first END AS refers_to
FROM placed
"""


@query
def op4_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (scored["score"] >= 0.5).cast("int").alias("predicted"),
    )


@query
def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda x: x["base"])
    counts = [pii.of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op5_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), RANKS)
    return packed.select(
        "doc_ids", "offsets", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )


@query
def op1_lm_scoring(spark, sf_dir):
    return scoring.score_corpus(table(spark, sf_dir, "documents"))


@query
def op9_repeats(spark, sf_dir):
    found = repeats.remove(table(spark, sf_dir, "documents"))
    n_removed = "aggregate(runs, 0L, (n, x) -> n + x.end - x.start)"
    return found.selectExpr(
        "doc_id", "n_bytes", f"{n_removed} AS n_removed", "bigint(size(runs)) AS n_spans",
        "sha2(kept, 256) AS kept_sha256",
    )


# Texts as hexadecimal: two letters a byte.
ORACLE_SQL["op9_repeats"] = """
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n,
        hex(encode(coalesce(text, ''))) AS h FROM documents),
span AS (
    SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k
    FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM doc WHERE n >= 400)),
twice AS (SELECT k FROM span GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM span SEMI JOIN twice USING (k)),
marked AS (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new
    FROM hit),
run AS (
    SELECT r, min(i) AS s, max(i) + 400 AS e
    FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
gap AS (
    SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM run
    UNION ALL SELECT r, coalesce(max(e), 0), any_value(n) FROM doc LEFT JOIN run USING (r) GROUP BY r),
kept AS (
    SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
    FROM gap JOIN doc USING (r) GROUP BY r),
total AS (SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed FROM run GROUP BY r)
SELECT doc_id, CAST(n AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM doc JOIN kept USING (r) LEFT JOIN total USING (r)
"""


@query
def op13_byte_bpe(spark, sf_dir):
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, decoded=True)
    return ids.selectExpr(
        "doc_id", "bigint(octet_length(ids) / 4) AS n_tokens", "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


@query
def op11_conversation_trie(spark, sf_dir):
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


# CRC-32 by its table, made by rule; a node is known by the joined keys of its turns.
ORACLE_SQL["op11_conversation_trie"] = """
WITH RECURSIVE tab(i, k, v) AS (
    SELECT i, 0, i FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tab WHERE k < 8),
id AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS varchar) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, k, v) AS (
    SELECT c, s, 0, CAST(4294967295 AS bigint) FROM id
    UNION ALL
    SELECT c, s, crc.k + 1, xor(crc.v // 256, tab.v)
    FROM crc JOIN tab ON tab.k = 8 AND tab.i = xor(crc.v % 256, CAST(ascii(substr(s, crc.k + 1, 1)) AS bigint))
    WHERE crc.k < length(s)),
asked AS (SELECT c, c - c % 20 AS base, xor(v, 4294967295) % 4 AS h FROM crc WHERE k = length(s)),
turn AS (
    SELECT conv_id AS c, turn,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS j FROM turn),
part AS (
    SELECT a.c, 0 AS own, p.j, p.key, p.words FROM asked a JOIN placed p ON p.c = a.base AND p.j <= a.h
    UNION ALL
    SELECT a.c, 1, p.j, p.key, p.words FROM asked a JOIN placed p ON p.c = a.c AND p.j > a.h),
deep AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, j) AS d FROM part),
path AS (
    SELECT c, d, words, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS p FROM deep
    UNION ALL SELECT c, 0, 0, '' FROM id),
node AS (SELECT d, p, min(c) AS m, count(*) AS n, any_value(words) AS words FROM path GROUP BY d, p),
kid AS (
    SELECT d - 1 AS d, p[:32 * (d - 1)] AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
one AS (
    SELECT node.*, coalesce(kids, 0) AS kids, CAST(kids IS NULL AS int) AS leaf, (n - 1) * words AS saved
    FROM node LEFT JOIN kid USING (d, p)),
tree AS (
    SELECT path.d, path.p, sum(leaf) AS leaves, sum(saved) AS saved
    FROM one JOIN path ON path.c = one.m AND path.d <= one.d GROUP BY path.d, path.p),
tail AS (
    SELECT p, string_agg(c, ',' ORDER BY c) AS ends
    FROM (SELECT c, arg_max(p, d) AS p FROM path GROUP BY c) GROUP BY p)
SELECT one.m AS conv_id, CAST(one.d AS bigint) AS depth, up.m AS parent_conv_id, one.n AS n_convs,
    CAST(one.kids AS bigint) AS n_children, CAST(leaves AS bigint) AS n_leaves,
    CAST(tree.saved AS bigint) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM one JOIN tree USING (d, p) LEFT JOIN tail USING (p)
    LEFT JOIN node up ON up.d = one.d - 1 AND up.p = one.p[:32 * (one.d - 1)]
"""


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op12_filter_audit"] = """
WITH known AS (
    SELECT doc_id, coalesce(max(CAST(quality = 1 AS int)), 0) AS good,
        coalesce(max(CAST(toxic = 1 AS int)), 0) AS toxic FROM labels GROUP BY doc_id),
doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
judged AS (
    SELECT doc_id, part, CAST(len(w) < 200 AS int) AS a,
        CAST(100 * len(list_distinct(w)) < 50 * len(w) AS int) AS b,
        CAST(100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) AS int) AS c,
        CAST(regexp_matches(x, '[#$%&*|]') AS int) AS d,
        CAST(coalesce(min(doc_id) OVER (PARTITION BY x) < doc_id, false) AS int) AS e FROM doc),
cell AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
        sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM judged LEFT JOIN known USING (doc_id) GROUP BY ALL),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, bit)),
perm AS (
    SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letter p, letter q, letter r, letter s, letter t
    WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
step AS (
    SELECT filter_order, CAST(k AS int) AS step, bits[k] AS bit,
        CAST(coalesce(list_sum(bits[:k - 1]), 0) AS bigint) AS before
    FROM perm, range(1, 6) r(k)),
told AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cell, step GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed,
    CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails,
    CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley
FROM told
"""
