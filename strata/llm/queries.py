"""One registered query per operator of this subpackage, each over its whole
table with production parameters; ``SQL`` holds DuckDB oracles where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import bpe, chat, conv_trie, decontam, embed_dedup, html_text, langid, minhash, packing, periodic, quality, sharding, token_scan
from strata.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return deco


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_scan.token_counts(table(spark, sf_dir, "documents"), shared_path(spark, "token-files"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_sample(docs, ~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_chat_formatting", """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(md5(coalesce('r' || role, 'null') || '|' || coalesce('t' || text, 'null')), '') OVER o) AS cum
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, cum, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, cum),
kept AS (SELECT conv_id, n_copies FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = whole.n AND p.cum = whole.cum))
SELECT conv_id, CAST(floor((pos - 1) / 256) AS BIGINT) AS part, count(*) AS n_turns, n_copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM p JOIN kept USING (conv_id) GROUP BY conv_id, part, n_copies""")
def op3(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op4_decontamination", """
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item, least(len(w), 13) AS n, w[p:p + least(len(w), 13) - 1] AS g
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
spot AS (
  SELECT doc_id, n, p, w[p:p + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.p, spot.n, win.item FROM spot JOIN win ON spot.n = win.n AND spot.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op4(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_token_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op6_embedding_near_dedup", """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n ON n.a = vec_id""")
def op6(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Shards are the unit in which a training job streams and shuffles documents.
SHARD_BYTES = 1 << 20


@query("op8_sharding", f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
lvl AS (SELECT unnest(generate_series(0, 40)) AS depth),
tot AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS b, min(h) = max(h) AS one FROM d, lvl GROUP BY 1, 2),
pick AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(tot.depth) AS depth FROM d JOIN tot ON d.h >> (60 - tot.depth) = tot.prefix
  WHERE tot.b <= {SHARD_BYTES} OR tot.one GROUP BY ALL)
SELECT doc_id, 's' || CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> (60 - depth)), 60, '0'), CAST(depth AS INT)) END AS shard,
       CAST(depth AS BIGINT) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes
FROM pick""")
def op8(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op9_html_extraction")
def op9(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_bpe_round_trip")
def op10(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_prefix_trie", """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, chars
  FROM (SELECT *, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars
        FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (
  SELECT DISTINCT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)) AS r FROM t),
h AS (SELECT c, xor(r, CAST(4294967295 AS BIGINT)) % 6 AS h, c - c % 100 AS base FROM bits),
heads AS (SELECT h.c, t.pos, t.d, t.chars FROM h JOIN t ON t.c = h.base AND t.pos <= h.h),
own AS (SELECT h.c, t.pos - h.h + (SELECT count(*) FROM heads WHERE heads.c = h.c) AS pos, t.d, t.chars FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
turns AS (SELECT * FROM heads UNION ALL SELECT * FROM own),
members AS (
  SELECT c, pos, string_agg(d, '') OVER (PARTITION BY c ORDER BY pos) AS key, chars, pos = count(*) OVER (PARTITION BY c) AS ends FROM turns
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM turns) FROM h),
node AS (
  SELECT key, pos AS depth, min(c) AS conv, count(*) AS n, min(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends FROM members GROUP BY key, pos),
kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS kids FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (key)),
below AS (SELECT a.key, count(*) FILTER (WHERE b.kids = 0) AS leaves, sum((b.n - 1) * b.chars) AS saved FROM full_node a JOIN full_node b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT f.conv AS conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv AS parent_conv_id, f.n AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN below USING (key) LEFT JOIN full_node p ON f.depth > 0 AND p.key = left(f.key, length(f.key) - 32)""")
def op11(spark, sf_dir):
    return conv_trie.prefix_trie(table(spark, sf_dir, "conversations"), conv_trie.rebuilt)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"), periodic.planted)


@query("op13_quality_classifier")
def op13(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
