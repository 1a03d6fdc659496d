"""Constraints between tables; each returns the rows that break it, so that an empty result means sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and n_rows of keys that occur more than once; null keys don't count."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def missing_parents(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key, n_rows) of keys of rows without a row in parents. Keys are counted before they are compared."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return counted.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def unequal_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has (left_only or right_only), from a full outer join of different keys."""
    a = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_l", F.lit(True))
    b = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full")
    return both.where("_l IS NULL OR _r IS NULL").select(key, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of wanted whose keys aren't in done: what a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def span_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, problem) of chunks whose offsets or pages are out of order, or whose text isn't as long as its span."""
    rules = {
        "negative_start": F.col("start_offset") < 0,
        "empty_span": F.col("end_offset") <= F.col("start_offset"),
        "length_differs": F.length("text") != F.col("end_offset") - F.col("start_offset"),
        "pages_reversed": F.col("page_end") < F.col("page_start"),
        "page_below_one": F.col("page_start") < 1,
    }
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.explode(broken).alias("problem")).distinct()


def uncovered_pages(chunks: DataFrame) -> DataFrame:
    """(document_id, page) between the first and last page of a document that no chunk covers.

    A range join without one: chunks are spread to their pages, documents to the pages they should have.
    """
    own = chunks.where("document_id IS NOT NULL AND page_start IS NOT NULL AND page_end >= page_start")
    have = own.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
    due = own.groupBy("document_id").agg(F.min("page_start").alias("a"), F.max("page_end").alias("b")).select("document_id", F.explode(F.sequence("a", "b")).alias("page"))
    return due.join(have, ["document_id", "page"], "left_anti")


def evidence_violations(examples: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(example_id, chunk_id, problem) of evidence that doesn't hold: unknown chunk, unknown source, source not declared
    by the example, quote not in the chunk word for word. examples (example_id, evidence, declared ARRAY<STRING>), chunks
    (chunk_id, document_id, text), sources (source_document_id, document_id)."""
    cited = examples.select("example_id", "declared", F.explode("evidence").alias("e")).select("example_id", "declared", "e.chunk_id", "e.quote")
    held = cited.join(chunks.select("chunk_id", "document_id", "text"), "chunk_id", "left").join(sources.select("document_id", "source_document_id"), "document_id", "left")
    problem = F.when(F.col("text").isNull(), "unknown_chunk").when(F.col("source_document_id").isNull(), "unknown_source")
    problem = problem.when(~F.array_contains("declared", F.col("source_document_id")), "undeclared_source").when(~F.contains("text", "quote"), "quote_not_found")
    return held.select("example_id", "chunk_id", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def scope_violations(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """(example_id, problem) of examples whose report is unknown or of another event, family or split than they say."""
    s = sources.select(F.col("source_document_id").alias("report_id"), F.col("event_id").alias("_e"), F.col("event_family_id").alias("_f"), F.col("split").alias("_s"))
    held = examples.join(s, "report_id", "left")
    rules = {"unknown_report": F.col("_e").isNull(), "event_differs": F.col("event_id") != F.col("_e"), "family_differs": F.col("event_family_id") != F.col("_f"), "split_differs": F.col("split") != F.col("_s")}
    return held.select("example_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("problem")).distinct()


def example_problems(examples: DataFrame) -> DataFrame:
    """(example_id, problem) of examples (example_id, question, split, answerable, reference_answer, evidence, provenance)
    that contradict themselves: without a question, answerable without an answer or evidence, unanswerable with either,
    reviewed by their author, without a source, or synthetic although held out for the test. Null arrays count as empty."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    able, answered, cited = F.coalesce("answerable", F.lit(False)), filled("reference_answer"), F.coalesce(F.size("evidence") > 0, F.lit(False))
    rules = {
        "no_question": ~filled("question"),
        "no_answer": able & ~answered,
        "no_evidence": able & ~cited,
        "answer_unexpected": ~able & answered,
        "evidence_unexpected": ~able & cited,
        "own_reviewer": F.array_contains("provenance.reviewers", F.col("provenance.author")),
        "no_source": F.coalesce(F.size("provenance.source_document_ids") == 0, F.lit(True)),
        "synthetic_test": F.col("provenance.is_synthetic") & (F.lower(F.trim("split")) == "test"),
    }
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return examples.where("example_id IS NOT NULL").select("example_id", F.explode(broken).alias("problem")).distinct()


def record_problems(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, problem) of supervised records (record_id, messages) that don't hold.

    roles: not system, user and assistant in this order; not_json: the last message isn't an object; unknown_chunk: it
    cites a chunk that isn't in chunks (chunk_id, text); quote_not_found: a quote isn't in the chunk but for white space.
    Citations meet the chunks in one join by id, so chunks are read once whatever the number of records.
    """
    roles = F.transform("messages", lambda m: F.lower(F.trim(m["role"])))
    content = F.try_element_at("messages", F.lit(-1))["content"]
    own = records.where("record_id IS NOT NULL").select("record_id", roles.alias("roles"), content.alias("content"))
    expected = F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    shape = F.array_compact(F.array(F.when(~F.coalesce(F.col("roles") == expected, F.lit(False)), "roles"), F.when(F.json_object_keys("content").isNull(), "not_json")))
    whole = F.when(F.json_object_keys("content").isNotNull(), F.get_json_object("content", "$.citations"))  # not of an object that stops
    spans = F.from_json(whole, "array<struct<chunk_id:string,quote:string>>")
    cited = own.select("record_id", F.explode(spans).alias("c")).select("record_id", F.lower(F.trim("c.chunk_id")).alias("chunk_id"), "c.quote").where("chunk_id IS NOT NULL AND quote IS NOT NULL").distinct()
    known = chunks.where("chunk_id IS NOT NULL").select(F.lower(F.trim("chunk_id")).alias("chunk_id"), "text", F.lit(True).alias("known"))
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    held = F.when(F.col("known").isNull(), "unknown_chunk").when(~F.coalesce(F.contains(flat("text"), F.trim(flat("quote"))), F.lit(False)), "quote_not_found")
    return own.select("record_id", F.explode(shape).alias("problem")).union(cited.join(known, "chunk_id", "left").select("record_id", held.alias("problem")).where("problem IS NOT NULL")).distinct()
