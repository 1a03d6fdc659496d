"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import references
from docketry.plans import corpus_queries, reference_queries
from docketry.sources.tables import table, tidy


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All references to chunks, and all to sources: (ref_table, record_key, ref_field, ref_key, created_at), each once."""
    dev, sft = table(spark, folder, "retrieval_dev"), table(spark, folder, "sft")
    cited = dev.select(F.lit("retrieval_dev").alias("ref_table"), F.col("example_id").alias("record_key"), F.lit("evidence.chunk_id").alias("ref_field"), F.explode("evidence.chunk_id").alias("ref_key"), "created_at")
    used = sft.select(F.lit("sft"), "record_id", F.lit("source_chunk_ids"), F.explode("source_chunk_ids"), "created_at")
    reports = dev.select(F.lit("retrieval_dev").alias("ref_table"), F.col("example_id").alias("record_key"), F.lit("report_id").alias("ref_field"), F.col("report_id").alias("ref_key"), "created_at")
    clean = lambda df: df.withColumn("ref_key", tidy("ref_key")).where("ref_key IS NOT NULL").distinct()
    return clean(cited.union(used)), clean(reports)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    to_chunks, to_sources = _references(spark, folder)
    chunks = references.existence_deltas(table(spark, folder, "chunks"), tidy("chunk_id"))
    sources = references.existence_deltas(table(spark, folder, "sources"), tidy("source_document_id"))
    judged = references.judged_references(to_chunks, chunks).unionByName(references.judged_references(to_sources, sources))
    return judged.where("reason IS NOT NULL").withColumn("period", F.date_format("created_at", "yyyy-MM"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "record_key", "ref_field", "ref_key", "reason", "period").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references per table, field, period and reason, with the number of records and of keys."""
    return (
        p6_found(spark, folder)
        .groupBy("ref_table", "ref_field", "period", "reason")
        .agg(F.count("*").alias("n_references"), F.countDistinct("record_key").alias("n_records"), F.countDistinct("ref_key").alias("n_keys"))
    )


def p6_current(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that have references and, after all changes, no row: the current state of the signed counts."""
    to_chunks, to_sources = _references(spark, folder)
    chunks = references.existence_deltas(table(spark, folder, "chunks"), tidy("chunk_id"))
    sources = references.existence_deltas(table(spark, folder, "sources"), tidy("source_document_id"))
    report = lambda refs, there, name: references.orphan_report(references.reference_deltas(refs), there).select(F.lit(name).alias("target"), F.col("key").alias("ref_key"), "refs", "ever")
    return report(to_chunks, chunks, "chunks").unionByName(report(to_sources, sources, "sources"))


QUERIES = {f.__name__: f for f in (p6_found, p6_report, p6_current)} | reference_queries.QUERIES | corpus_queries.QUERIES

_P6 = r"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'retrieval_dev' AS ref_table, example_id AS record_key, 'evidence.chunk_id' AS ref_field, lower(regexp_replace(e.chunk_id, '^\s+|\s+$', '', 'g')) AS ref_key, created_at, 'c' AS kind
    FROM (SELECT example_id, created_at, unnest(evidence) AS e FROM retrieval_dev)
    UNION ALL SELECT 'sft', record_id, 'source_chunk_ids', lower(regexp_replace(k, '^\s+|\s+$', '', 'g')), created_at, 'c' FROM (SELECT record_id, created_at, unnest(source_chunk_ids) AS k FROM sft)
    UNION ALL SELECT 'retrieval_dev', example_id, 'report_id', lower(regexp_replace(report_id, '^\s+|\s+$', '', 'g')), created_at, 's' FROM retrieval_dev)
  WHERE ref_key <> ''),
there AS (
  SELECT 'c' AS kind, lower(regexp_replace(chunk_id, '^\s+|\s+$', '', 'g')) AS k, ingested_at AS i, deleted_at AS d FROM chunks
  UNION ALL SELECT 's', lower(regexp_replace(source_document_id, '^\s+|\s+$', '', 'g')), ingested_at, deleted_at FROM sources),
judged AS (
  SELECT r.ref_table, r.record_key, r.ref_field, r.ref_key, r.created_at,
    coalesce(bool_or(t.i <= r.created_at AND (t.d IS NULL OR t.d > r.created_at)), false) AS sound,
    count(t.k) AS rows_of_key, coalesce(bool_or(t.i <= r.created_at), false) AS seen
  FROM refs r LEFT JOIN there t ON t.kind = r.kind AND t.k = r.ref_key GROUP BY 1, 2, 3, 4, 5),
found AS (
  SELECT DISTINCT ref_table, record_key, ref_field, ref_key,
    CASE WHEN rows_of_key = 0 THEN 'missing' WHEN seen THEN 'deleted' ELSE 'late' END AS reason, strftime(created_at, '%Y-%m') AS period
  FROM judged WHERE NOT sound)
"""

ORACLES = {
    "p6_found": _P6 + "SELECT ref_table, record_key, ref_field, ref_key, reason, period FROM found",
    "p6_current": _P6 + """
SELECT CASE r.kind WHEN 'c' THEN 'chunks' ELSE 'sources' END AS target, r.k AS ref_key, r.refs,
  CAST((SELECT count(*) FROM there t WHERE t.kind = r.kind AND t.k = r.k AND t.i IS NOT NULL) AS BIGINT) AS ever
FROM (SELECT kind, ref_key AS k, count(*) AS refs FROM refs GROUP BY 1, 2) r
WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.kind = r.kind AND t.k = r.k AND t.i IS NOT NULL AND t.d IS NULL)""",
    "p6_report": _P6 + """
SELECT ref_table, ref_field, period, reason, count(*) AS n_references, count(DISTINCT record_key) AS n_records, count(DISTINCT ref_key) AS n_keys
FROM found GROUP BY 1, 2, 3, 4""",
} | reference_queries.ORACLES | corpus_queries.ORACLES
