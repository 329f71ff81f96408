"""The corpus operators over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import (
    ann,
    decontaminate,
    filter_audit,
    html_extract,
    line_dedup,
    mixing,
    near_dedup,
    secret_scan,
    sharding,
    spelling,
    token_counts,
    toxicity,
    warc,
)
from skirmish.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, shard_bits, shard_rows, shard_bytes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    size = F.coalesce("bytes", F.lit(0))
    return sharding.assign_shards(docs, size=size).drop("bytes")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_rows of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, start, end, tokens, crossing, doc_tokens of every line of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents")).drop("name")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 neighbours of every 20th vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, changed_ids of every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, copies, links, class_doc_id, class_line_no of every line."""
    return line_dedup.line_members(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record."""
    return warc.archive(table(spark, sf_dir, "pages")).drop("url", "payload")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by part, order of the filters and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan,
        op2_sharding,
        op3_near_dedup,
        op4_token_counts,
        op5_mixing,
        op6_ann,
        op7_decontaminate,
        op8_line_dedup,
        op9_toxicity,
        op10_warc,
        op11_spelling,
        op12_filter_audit,
        op13_html_extract,
    )
    return {f.__name__: f for f in found}


_NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
         lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM d WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM runs a JOIN runs b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE c >= 0.8 * (s.n + t.n - c)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id <> b.doc_id
), reach AS (
  SELECT doc_id, doc_id AS r FROM d
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
), classes AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows FROM classes
"""


_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), v AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS kept,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i::INT, 5))::INT) AS parts FROM p
), b AS (
  SELECT *, array_to_string(list_transform(parts, lambda q: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((q >> s) & 31), 1)), '')), '') AS payload_digest FROM v
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to FROM b
"""


def sql_twins() -> dict[str, str]:
    return {
        "op2_sharding": sharding.sql_twin(),
        "op3_near_dedup": _NEAR,
        "op6_ann": ann.sql_twin(),
        "op10_warc": _WARC,
        "op12_filter_audit": filter_audit.sql_twin(),
    }
