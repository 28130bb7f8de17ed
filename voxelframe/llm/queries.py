"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, lm_score, mixing, near_dup, quality, sharding, substring_dedup, topk, toxicity
from .common import table

#: The piece vocabulary of the language model; a parameter of its query.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"))
    out = sharding.shard(slim, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM t
), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM w),
m AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x),
c AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS p FROM g JOIN m ON g.x = m.x AND m.least < g.doc_id),
k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM t)
SELECT t.doc_id, len(t.ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM t LEFT JOIN (
  SELECT k.doc_id, count(c.p) AS n, string_agg(CASE WHEN c.p IS NULL THEN k.word END, ' ' ORDER BY k.p) AS kept
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id) r ON r.doc_id = t.doc_id
"""


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, threshold=80)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""


def _fold(folds: int) -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds


def op7_lm_score(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", _fold(7) == 2)
    out = lm_score.score(docs, ~F.col("held_out"), vocabulary)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, table(spark, sf_dir, "labels"), _fold(5) != 0)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = quality.score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "keep")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_table(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Query]:
    return {
        "op1_shard": op1_shard,
        "op2_decontaminate": op2_decontaminate,
        "op3_top_k": op3_top_k,
        "op4_substrings": op4_substrings,
        "op5_lines": op5_lines,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_lm_score": op7_lm_score,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_mix": op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op4_substrings": OP4_SQL, "op5_lines": OP5_SQL, "op6_near_duplicates": OP6_SQL}
