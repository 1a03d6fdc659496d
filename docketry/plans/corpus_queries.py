"""Queries of pages, chunks and corpora, each over its whole tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators import chunking
from docketry.sources.tables import table

#: Characters of a page; documents come without pages.
PAGE = 3000


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0) div {PAGE}), i -> substring(text, cast(i * {PAGE} + 1 AS int), {PAGE}))")
    own = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("document_id"), "lang", F.posexplode(text).alias("at", "text"))
    return own.select("document_id", (F.col("at") + 1).alias("page_number"), "text", "lang")


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunked_pages(_pages(spark, folder)).drop("text")


def chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the characters that its chunks hold, each counted once, without white space."""
    own = chunking.chunked_pages(_pages(spark, folder))
    before = Window.partitionBy("document_id", "page_start").orderBy("start_offset").rowsBetween(Window.unboundedPreceding, -1)
    fresh = own.withColumn("_done", F.greatest(F.coalesce(F.max("end_offset").over(before), F.lit(0)), "start_offset"))
    text = F.expr("substring(text, cast(_done - start_offset + 1 AS int))")
    n = F.length(F.regexp_replace(text, r"(?U)\s+", "")).cast("bigint")
    return fresh.groupBy("document_id").agg(F.sum(n).alias("n_chars"), F.count_distinct("page_start").alias("n_pages"))


def chunk_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as chunks of their own, spoiled by language: French ones in capitals, German ones with a page too many; of
    documents of several pages the last is left out."""
    pages = _pages(spark, folder)
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("last"))
    placed = chunking.page_spans(pages).join(last, "document_id").where("last = 1 OR page_number < last")
    text = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    cut = placed.select(
        F.concat_ws("/", "document_id", "page_number").alias("chunk_id"), "document_id", text.alias("text"), "start_offset", "end_offset",
        F.col("page_number").alias("page_start"), F.when(F.col("lang") == "de", F.col("page_number") + 1).otherwise(F.col("page_number")).alias("page_end"),
    )
    found = chunking.chunk_problems(cut.where("end_offset > start_offset"), pages, 320)
    return found.groupBy("document_id", "problem").agg(F.count("*").alias("n"))


def document_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The content digest by which a frozen table is known, of each language's documents, as it would be written.

    It is a sum of 48 bits per row modulo 2^64 as a signed number, so it is the plain sum until that passes 2^63, at
    about 65,000 rows of a language.
    """
    own = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), "text")
    row = F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), "lang", F.coalesce("text", F.lit("\u0002"))), 256)
    whole, turn = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")), F.lit(Decimal(2**64))
    over = whole % turn
    return own.groupBy("lang").agg(F.count("*").alias("n_rows"), F.when(over >= Decimal(2**63), over - turn).otherwise(over).cast("bigint").alias("digest"))


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_coverage, chunk_problems, document_digest)}

_PAGES = f"""
ln AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lang, text, greatest(length(text) - 1, 0) // {PAGE} + 1 AS n FROM documents WHERE text IS NOT NULL),
pg AS (SELECT document_id, lang, n, p, substr(text, (p - 1) * {PAGE} + 1, {PAGE}) AS t FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM ln))"""
_BLANK = r"[\s\p{Z}\x{85}]+"

ORACLES = {
    "chunk_coverage": rf"""WITH {_PAGES},
c AS (SELECT document_id, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS c FROM pg)
SELECT document_id, CAST(sum(c) AS BIGINT) AS n_chars, count(*) AS n_pages FROM c WHERE c > 0 GROUP BY 1""",
    "chunk_problems": rf"""WITH {_PAGES},
kept AS (SELECT * FROM pg WHERE (n = 1 OR p < n) AND t <> ''),
f AS (SELECT document_id, unnest(list_filter([CASE WHEN lang = 'fr' AND upper(t) <> t THEN 'text_differs' END, CASE WHEN lang = 'de' THEN 'page_range' END,
    CASE WHEN length(regexp_replace(CASE WHEN lang = 'fr' THEN upper(t) ELSE t END, '^{_BLANK}|{_BLANK}$', '', 'g')) < 320 THEN 'tiny_chunk' END], lambda x: x IS NOT NULL)) AS problem FROM kept
  UNION ALL SELECT document_id, 'uncovered_page' FROM pg WHERE n > 1 AND p = n AND regexp_replace(t, '{_BLANK}', '', 'g') <> '')
SELECT document_id, problem, count(*) AS n FROM f GROUP BY 1, 2""",
    "document_digest": """SELECT coalesce(lang, '?') AS lang, count(*) AS n_rows,
  CAST(sum(CAST('0x' || substr(sha256(doc_id || chr(1) || coalesce(lang, '?') || chr(1) || coalesce(text, chr(2))), 1, 12) AS BIGINT)) AS BIGINT) AS digest FROM documents GROUP BY 1""",
}
