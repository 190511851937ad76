"""Registered queries of this package: one ``opN_<name>`` per operator over
its whole table, with production parameters, and DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.sources.io import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import byte_bpe

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(read_table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks, pattern))


@query("op7_bag_minhash")
def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import near_dup

    return near_dup.classes(read_table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import toxicity

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import secrets

    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents")))


_EXTRA_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op4_chat", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
         sum(length(role) + length(text) + 18 + len(regexp_extract_all(role, '(<\\*/?s>|\[\\*(?:/?INST|END)\])'))
             + len(regexp_extract_all(text, '(<\\*/?s>|\[\\*(?:/?INST|END)\])'))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, CAST(chars + 7 AS BIGINT) AS formatted_chars
FROM g""")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import chat

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(_EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.conversations(rows.unionByName(extra)))


@query("op5_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import top_k

    return top_k.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import packing

    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM g""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import warc

    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


@query("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import fingerprint

    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import pii

    docs = read_table(spark, sf_dir, "documents")
    return pii.digests(pii.scan(docs, pii.train(docs)))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import periodic_runs

    return periodic_runs.digests(periodic_runs.find(periodic_runs.planted(read_table(spark, sf_dir, "documents"))))


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import quality

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: crc32 of a conversation's decimal id; the constants are the polynomial and
#: the start value of CRC-32.
_CRC = """
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c // 2, (c % 2) * 3988292384), i)) AS t),
crc AS (
  SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                            lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), poly)"""


@query("op13_prefix_trie", _CRC + """,
t AS (SELECT conv_id AS c, k, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos
      FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                   strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT crc.c, 0 AS own, pos, k, bytes FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND pos < h
      UNION ALL SELECT crc.c, 1, pos, k, bytes FROM crc JOIN t ON t.c = crc.c AND pos >= h),
p AS (SELECT c, bytes, row_number() OVER w AS depth, count(*) OVER (PARTITION BY c) AS n,
             sha256(string_agg(k, ',') OVER w) AS pid FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
e AS (SELECT c, depth, pid, bytes, n FROM p
      UNION ALL SELECT crc.c, 0, '', 0, coalesce(x.n, 0) FROM crc LEFT JOIN (SELECT c, max(n) AS n FROM p GROUP BY c) x USING (c)),
f AS (SELECT *, lag(pid) OVER (PARTITION BY c ORDER BY depth) AS parent FROM e),
g AS (SELECT depth, pid, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM f GROUP BY depth, pid),
kids AS (SELECT parent AS pid, depth - 1 AS depth, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY 1, 2),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, q.conv_id AS parent_conv_id
      FROM g LEFT JOIN kids USING (depth, pid) LEFT JOIN g q ON q.pid = g.parent AND q.depth = g.depth - 1),
s AS (SELECT e.depth, e.pid, sum(coalesce(CAST(v.n_children = 0 AS BIGINT), 0)) OVER w AS leaves, sum(coalesce((v.n_convs - 1) * v.bytes, 0)) OVER w AS saved
      FROM e LEFT JOIN v ON v.depth = e.depth AND v.pid = e.pid AND v.conv_id = e.c
      WINDOW w AS (PARTITION BY e.c ORDER BY e.depth DESC)),
u AS (SELECT depth, pid, CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM s GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM v JOIN u USING (depth, pid)""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabstat.llm import prefix_trie

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(rows)))
