"""The driver's queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_remainder, table
from .chat import link_tool_calls
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup, with_digest
from .fill_in_middle import fill_in_middle, output_digest
from .hard_negatives import hard_negatives
from .language import identify_language, train_language
from .lm import score_texts
from .packing import pack_documents
from .pii import find_pii, pii_digest
from .quality import ACCEPT_AT, score_quality, train_quality
from .sentencepiece_codec import codec_digest
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = with_digest(docs, exact_dedup(docs))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.lo < w.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t
  FROM pos ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT_AT).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


TOOL_SCHEMAS = {
    "lookup": {"limit": ("integer", True), "query": ("string", True)},
    "search": {"limit": ("integer", False), "query": ("string", True)},
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations``, read as a protocol: a user turn is a call named by its
    turn, waiting for the call two turns before; an assistant turn answers the call of the turn before."""
    c = table(spark, sf_dir, "conversations")
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    tool = F.element_at(F.array(F.lit("lookup"), F.lit("search"), F.lit("write")), (F.col("turn") % 3 + 1).cast("int"))
    args = F.to_json(F.struct(F.col("text").alias("query"), F.when(F.col("turn") % 5 != 4, F.col("turn")).alias("limit")))
    return link_tool_calls(c.select(
        "conv_id", "turn", F.when(user, "call").when(bot, "result").otherwise("message").alias("kind"), "role",
        F.col("text").alias("content"),
        F.when(user, F.concat(F.lit("c"), "turn")).when(bot, F.concat(F.lit("c"), F.col("turn") - 1)).alias("call_id"),
        F.when(user, tool).alias("name"), F.when(user, args).alias("arguments"),
        F.when(user & (F.col("turn") >= 2), F.concat(F.lit("c"), F.col("turn") - 2)).alias("after")), TOOL_SCHEMAS)


OP10_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'c' || turn WHEN 'assistant' THEN 'c' || (turn - 1) END AS call_id,
         CASE turn % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'search' ELSE 'write' END AS name
  FROM conversations),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM m WHERE kind = 'call'
    AND NOT EXISTS (SELECT 1 FROM m p WHERE p.conv_id = m.conv_id AND p.turn = m.turn - 2 AND p.kind = 'call')
  UNION ALL
  SELECT m.conv_id, m.turn, lv.level + 1 FROM lv JOIN m ON m.conv_id = lv.conv_id AND m.turn = lv.turn + 2
    AND m.kind = 'call'),
j AS (
  SELECT m.*, c.level,
         EXISTS (SELECT 1 FROM m r WHERE r.conv_id = m.conv_id AND r.kind = 'result' AND r.turn = m.turn + 1) AS answered
  FROM m LEFT JOIN lv c ON c.conv_id = m.conv_id AND c.turn = CASE kind WHEN 'result' THEN m.turn - 1 ELSE m.turn END)
SELECT conv_id, turn, kind, call_id,
       CASE kind WHEN 'message' THEN 0 WHEN 'call' THEN 1 + 2 * level ELSE 2 + 2 * level END AS step,
       CASE WHEN kind = 'message' THEN 'ok'
            WHEN kind = 'result' THEN CASE WHEN level IS NULL THEN 'orphan' ELSE 'ok' END
            WHEN name = 'write' THEN 'invalid: unknown tool'
            WHEN name = 'lookup' AND turn % 5 = 4 THEN 'invalid: missing limit'
            WHEN text IS NULL THEN 'invalid: missing query'
            WHEN NOT answered THEN 'no result' ELSE 'ok' END AS status,
       CASE kind
         WHEN 'call' THEN '{"arguments":{' || CASE WHEN turn % 5 <> 4 THEN '"limit":' || turn ELSE '' END
              || CASE WHEN turn % 5 <> 4 AND text IS NOT NULL THEN ',' ELSE '' END
              || CASE WHEN text IS NOT NULL THEN '"query":' || CAST(to_json(text) AS VARCHAR) ELSE '' END
              || '},"call_id":"' || call_id || '","name":"' || name || '","role":"call"}'
         WHEN 'result' THEN '{"call_id":"' || call_id || '"'
              || CASE WHEN text IS NOT NULL THEN ',"content":' || CAST(to_json(text) AS VARCHAR) ELSE '' END
              || ',"role":"result"}'
         ELSE '{' || CASE WHEN text IS NOT NULL THEN '"content":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END
              || '"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS json
FROM j
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.withColumn("label", moved), anchor=F.col("id") % 100 == 0, positives=5, negatives=10,
                          low=30, high=90, scale=256)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 4) == 2
    model = train_language(docs.where(~held_out))
    out = identify_language(docs, model, carry={"held_out": held_out})
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_digest(fill_in_middle(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS u3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS u4 FROM d),
f AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u3 >= 90 THEN 'plain'
              WHEN u4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_tool_calls": op10_tool_calls,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language": op12_language,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op1_embedding_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL,
              "op10_tool_calls": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
