"""Registered queries of this subpackage: one of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S
from tokenloom.llm import bpe, embedding_dedup, exact_dedup, html_text, mixing, near_dedup, quality, sharding, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    S.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, calibrated probability and decision for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, columns=["doc_id"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.decode_bpe(bpe.encode_bpe(docs, columns=["doc_id"]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a group of near copies, with the one that stays and the number of documents near to itself."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of sources: document, source and the number of its copy."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.repeat_by_epochs(docs.select("doc_id", "source"), mixing.source_epochs(docs))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal stretch of words covered by 50-word passages that occur twice or more."""
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose whole text an earlier document has, with that document."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).where("doc_id <> duplicate_of")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, archived by digest and put together again."""
    records = warc.new_archive(_table(spark, sf_dir, "pages"))
    return records.select(F.col("record").alias("page_id"), "digest", F.decode("bytes", "UTF-8").alias("content"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, in the shard's partition, sorted by id."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class, connected by cosines of at least 0.95, and the number of others so near."""
    return embedding_dedup.near_classes(_table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])


OP5_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
) WHERE doc_id <> duplicate_of
"""

OP6_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, sum(n) OVER () AS total, CASE WHEN n > 0 THEN pow(n / sum(n) OVER (), 0.7) ELSE 0 END AS w FROM sizes),
sorted AS (
  SELECT *, 4 * n / w AS full_at,
    coalesce(sum(4 * n) OVER (ORDER BY 4 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
    sum(w) OVER (ORDER BY 4 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM weighted WHERE w > 0
),
level AS (SELECT arg_min((total - clamped) / open_w, full_at) FILTER (WHERE (total - clamped) / open_w <= full_at) AS l FROM sorted),
epochs AS (
  SELECT source, CASE WHEN l IS NULL THEN 4 ELSE least(4, l * w / n) END AS e FROM sorted, level
  UNION ALL SELECT source, 1 FROM weighted WHERE n = 0
),
times AS (
  SELECT doc_id, d.source, floor(e + 1e-9)::INT + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < e - floor(e + 1e-9) THEN 1 ELSE 0 END AS k
  FROM documents d JOIN epochs p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, unnest(range(1, k + 1))::INT AS copy FROM times
"""

OP4_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
),
passages AS (SELECT doc_id, i - 1 AS s, array_to_string(ws[i : i + 49], ' ') AS t FROM texts, unnest(range(1, len(ws) - 48)) AS u(i)),
repeated AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS n FROM passages) WHERE n > 1),
begun AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS b FROM repeated),
numbered AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM begun)
SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) - min(s) + 50)::BIGINT AS n_words FROM numbered GROUP BY doc_id, k
"""

OP7_SQL = """
WITH d AS (SELECT page_id, url, html, sha256(html) AS digest, chr(13) || chr(10) AS nl FROM pages)
SELECT page_id, digest,
  'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || nl
  || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Type: text/html' || nl || 'WARC-Payload-Digest: sha256:' || coalesce(digest, '') || nl
  || 'Content-Length: ' || coalesce(strlen(html), 0) || nl || nl || coalesce(html, '') || nl || nl AS content
FROM d
"""

OP8_SQL = """
WITH k AS (SELECT doc_id, sum(coalesce(strlen(text), 0))::HUGEINT AS b FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS (SELECT doc_id, sum(b) OVER (ORDER BY doc_id) - b AS below, sum(b) OVER () AS total FROM k),
q AS (SELECT doc_id, below, total, greatest(16, (total + 67108863) // 67108864) AS n FROM p)
SELECT d.doc_id, text, lang, source, n_chars, CASE WHEN d.doc_id IS NULL OR total = 0 THEN 0 ELSE least(n - 1, (below * n) // total) END::INT AS shard
FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
"""

OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, p.b FROM reached r JOIN p ON r.other = p.a)
SELECT vec_id, class_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT vec_id, min(other) AS class_id FROM reached GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS links FROM p GROUP BY a) USING (vec_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_bpe, op3_near_dedup, op4_suffix_dedup, op5_exact_dedup, op6_mixing, op7_warc, op8_sharding, op9_embedding_dedup, op10_html_text)}
ORACLE_SQL: dict[str, str] = {"op4_suffix_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op7_warc": OP7_SQL, "op8_sharding": OP8_SQL, "op9_embedding_dedup": OP9_SQL}
