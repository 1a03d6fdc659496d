"""Queries of the corpus, retrieval and evaluation operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import PUNCTUATION, STOP_WORDS, compatible_words, tokens
from docketry.operators import answers, evaluation, integrity, metrics, retrieval, selection, training_records
from docketry.session import cut_lineage
from docketry.sources import snapshots
from docketry.sources.tables import marked, one_per_key, one_per_key_in_place, table, tidy

FRACTIONS = (("train", 0.8), ("development", 0.1), ("test", 0.1))
TERMS = ["engine", "runway", "pilot", "weather", "landing", "inspection"]


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "chunks"), "chunk_id", ["document_id", "text", "kind"])


def _test(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "retrieval_test"), "example_id", ["question", "evidence", "answerable", "reference_answer", "split"])


def _sft(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "sft"), "record_id", ["messages", "event_family_id"])


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _test(spark, folder).select(F.col("example_id").alias("query_id"), F.col("question").alias("text"))


def _top(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return retrieval.bm25_topk(_chunks(spark, folder).select("chunk_id", "text"), _questions(spark, folder), k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_top(spark, folder, 10))


def _in_own_report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with their document as scope, and the questions of retrieval_dev whose report is known with that, in a checkpoint."""
    sources = one_per_key(table(spark, folder, "sources"), "source_document_id", ["sha256"])
    dev = one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["question", "report_id"])
    asked = dev.join(sources, dev["report_id"] == sources["source_document_id"]).select(F.col("example_id").alias("query_id"), F.concat(F.lit("doc-"), "sha256").alias("scope"), F.col("question").alias("text"))
    chunks = one_per_key_in_place(table(spark, folder, "chunks"), "chunk_id", ["document_id", "text"])
    return chunks.select("chunk_id", F.col("document_id").alias("scope"), "text"), cut_lineage(asked)


def bm25_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of retrieval_dev within their report."""
    return _rounded(retrieval.scoped_bm25(*_in_own_report(spark, folder), 5))


def _in_reports(spark: SparkSession, folder: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Chunks, and questions of retrieval_dev, with what they belong to: a report (its document), an event."""
    sources = one_per_key(table(spark, folder, "sources"), "source_document_id", ["sha256", "event_id"]).select("source_document_id", F.concat(F.lit("doc-"), "sha256").alias("document"), "event_id")
    scope = F.col("document") if by == "report" else tidy("event_id")
    dev = one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["question", "report_id", "event_id"])
    of_report = dev.drop("event_id").join(sources, dev["report_id"] == sources["source_document_id"], "left").select(F.col("example_id").alias("query_id"), scope.alias("scope"), F.col("question").alias("text"))
    of_event = dev.select(F.col("example_id").alias("query_id"), tidy("event_id").alias("scope"), F.col("question").alias("text"))
    owner = sources.where("document IS NOT NULL").groupBy("document").agg(F.min(scope).alias("scope"))
    chunks = _chunks(spark, folder).join(F.broadcast(owner) if by == "event" else owner, F.col("document_id") == F.col("document")).select("chunk_id", "scope", "text")
    return chunks, of_report if by == "report" else of_event


def hybrid_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Both rankings within the event that a question names, fused."""
    chunks, asked = _in_reports(spark, folder, "event")
    return _rounded(retrieval.scoped_fused(chunks, asked, 5, 100, weight=0.25))


def empty_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose report has no chunk, which a service refuses."""
    chunks, asked = _in_reports(spark, folder, "report")
    return retrieval.empty_scopes(chunks, asked)


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(retrieval.dense_topk(vectors, asked, 10))


def _candidates(spark: SparkSession, folder: str, k: int) -> DataFrame:
    held = _top(spark, folder, k).join(_chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    asked = _questions(spark, folder).select("query_id", F.col("text").alias("question"))
    return held.join(asked, "query_id")


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 ranks fused with ranks by the share of the question's terms: 100 candidates of all chunks from each side."""
    lexical = _top(spark, folder, 100)
    other = retrieval.overlap_topk(_chunks(spark, folder).select("chunk_id", "text"), _questions(spark, folder), 100)
    return _rounded(retrieval.fused(lexical, other, 10, weight=0.25))


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    held = _candidates(spark, folder, 20)
    return _rounded(retrieval.reranked(held, F.round(retrieval.overlap(F.col("question"), F.col("text")), 9), 5))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    own = retrieval.bounded_context(_candidates(spark, folder, 10).select("query_id", "chunk_id", "rank", "text"), 4000)
    return own.select("query_id", "chunk_id", "rank", F.length("text").cast("bigint").alias("n_chars"))


def context_passage(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.context_passage(_candidates(spark, folder, 1).select("query_id", "question", "text"))


def term_spread(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.term_spread(_chunks(spark, folder))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return _test(spark, folder).select(F.col("example_id").alias("query_id"), F.explode("evidence.chunk_id").alias("chunk_id")).distinct()


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scores = metrics.retrieval_scores(_top(spark, folder, 10), _gold(spark, folder), _questions(spark, folder))
    return scores.select("query_id", F.col("n_gold").cast("bigint").alias("n_gold"), *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def retrieval_slices(spark: SparkSession, folder: str) -> DataFrame:
    scores = metrics.retrieval_scores(_top(spark, folder, 10), _gold(spark, folder), _questions(spark, folder))
    held = scores.join(_test(spark, folder).withColumnRenamed("example_id", "query_id"), "query_id")
    kinds = _gold(spark, folder).join(_chunks(spark, folder).select("chunk_id", "kind"), "chunk_id").groupBy("query_id").agg(F.collect_set("kind").alias("kinds"))
    slices = {"answerable": F.col("answerable"), "query": metrics.query_kind("question"), "split": tidy("split")}
    out = metrics.sliced(held.join(kinds, "query_id", "left"), slices, ["recall", "reciprocal_rank", "ndcg"], {"content": F.col("kinds")})
    return out.select("slice", "examples", "scored", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def family_splits(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "selection").select(tidy("event_family_id").alias("family"))
    return selection.family_splits(own, "family", FRACTIONS, "42")


def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "selection").select(tidy("event_family_id").alias("family"), tidy("proposed_split").alias("split"))
    return selection.leaking_families(own, "family", "split")


def first_per_event(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "selection").select("event_id", tidy("source_id").alias("source_id"), tidy("event_family_id").alias("family"))
    return selection.first_per_key(own, "event_id", "source_id", ["family"])


def replacement_events(spark: SparkSession, folder: str) -> DataFrame:
    """For the smallest event of each split, the event drawn in its place."""
    own = table(spark, folder, "selection").select("event_id", tidy("proposed_split").alias("split"))
    rejected = own.where("split IS NOT NULL").groupBy("split").agg(F.min("event_id").alias("event_id"))
    return selection.replacements(own.select("event_id"), rejected, "7")


def event_features(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have each feature."""
    own = one_per_key(table(spark, folder, "selection"), "event_id", ["occurred_on", "metadata"])
    named = {n: F.col(f"metadata.{n}") for n in ("severity", "event_type", "weather", "report_type")}
    return own.select(F.explode(selection.features(F.col("occurred_on"), named)).alias("feature")).groupBy("feature").agg(F.count("*").alias("n_records"))


def diverse_events(spark: SparkSession, folder: str) -> DataFrame:
    own = one_per_key(table(spark, folder, "selection"), "event_id", ["occurred_on", "metadata"])
    named = {n: F.col(f"metadata.{n}") for n in ("severity", "event_type", "weather", "report_type")}
    return selection.diverse(own.select(F.col("event_id").alias("source_id"), selection.features(F.col("occurred_on"), named).alias("features")), 40, "42")


def discovery_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over the time in which reports were published, per split."""
    own = table(spark, folder, "sources").where("published_at IS NOT NULL AND split IS NOT NULL")
    spans = own.groupBy("split").agg(F.min(F.to_date("published_at")).alias("first"), F.max(F.to_date("published_at")).alias("last"))
    return selection.discovery_windows(spans, 12, 31).select("split", "number", "begins", "ends")


def repeated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.repeated_keys(table(spark, folder, "chunks"), ["chunk_id"])


def equal_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several documents have: digest, documents, and the first of them."""
    own = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return own.groupBy("sha256").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc_id")).where("n_documents > 1")


def orphan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of chunks that no published source in use has."""
    sources = table(spark, folder, "sources").where("published_at IS NOT NULL AND deleted_at IS NULL").select(F.concat(F.lit("doc-"), "sha256").alias("document_id"))
    return integrity.missing_parents(table(spark, folder, "chunks"), "document_id", sources, "document_id")


def family_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Families that only selection or only sources has."""
    own = lambda name: table(spark, folder, name).select(tidy("event_family_id").alias("family"))
    return integrity.unequal_sides(own("selection"), own("sources"), "family")


def pending_events(spark: SparkSession, folder: str) -> DataFrame:
    """Selected events whose report isn't among the sources yet."""
    wanted = table(spark, folder, "selection").select("event_id").distinct()
    return integrity.pending(wanted, table(spark, folder, "sources"), ["event_id"])


def span_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as they are, but those of tables end one character late and those of scans have their pages swapped."""
    own = table(spark, folder, "chunks").withColumn("end_offset", F.col("end_offset") + (F.col("kind") == "table").cast("int"))
    scan = F.coalesce(F.col("kind") == "ocr", F.lit(False))
    swapped = own.withColumn("first", F.when(scan, F.col("page_end")).otherwise(F.col("page_start"))).withColumn("page_end", F.when(scan, F.col("page_start")).otherwise(F.col("page_end")))
    return integrity.span_violations(swapped.withColumn("page_start", F.col("first")))


def uncovered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that no chunk of running text covers."""
    return integrity.uncovered_pages(table(spark, folder, "chunks").where("kind = 'text'"))


def evidence_violations(spark: SparkSession, folder: str) -> DataFrame:
    dev = one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["evidence", "provenance"])
    sources = one_per_key(table(spark, folder, "sources"), "source_document_id", ["sha256"]).select("source_document_id", F.concat(F.lit("doc-"), "sha256").alias("document_id"))
    return integrity.evidence_violations(dev.select("example_id", "evidence", F.col("provenance.source_document_ids").alias("declared")), _chunks(spark, folder), sources)


def scope_violations(spark: SparkSession, folder: str) -> DataFrame:
    dev = one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["report_id", "event_id", "event_family_id", "split"])
    return integrity.scope_violations(dev, one_per_key(table(spark, folder, "sources"), "source_document_id", ["event_id", "event_family_id", "split"]))


def chunk_lengths(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "chunks").select(F.length("text").alias("n"))
    return metrics.half_even_percentiles(lengths, "n", {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0})


def chunk_kinds(spark: SparkSession, folder: str) -> DataFrame:
    own = _chunks(spark, folder)
    return own.groupBy("kind").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, answer and first quote of the records whose last message is a plain JSON object."""
    content = F.element_at("messages", -1)["content"]
    return _sft(spark, folder).where(F.size("messages") > 0).select("record_id", F.get_json_object(content, "$.answer").alias("answer"), F.get_json_object(content, "$.citations[0].quote").alias("quote")).where("answer IS NOT NULL AND quote IS NOT NULL")


def token_f1(spark: SparkSession, folder: str) -> DataFrame:
    own = _answered(spark, folder)
    words = own.withColumn("a", compatible_words("answer")).withColumn("b", compatible_words("quote"))
    return words.select("record_id", F.round(metrics.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), metrics.exact_match(F.col("answer"), F.col("quote")).alias("exact"))


def numeric_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the answer gives the first number of the quote."""
    own = _answered(spark, folder).withColumn("target", F.try_element_at(F.regexp_extract_all("quote", F.lit(r"\b\d[\d,]*\b"), F.lit(0)), F.lit(1)))
    own = own.where("target IS NOT NULL").withColumn("number", F.regexp_replace("target", ",", "").cast("double"))
    return own.select("record_id", metrics.numeric_match(F.col("answer"), F.col("number")).alias("matched"))


def citation_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of retrieval_dev that names known chunks, against all of it."""
    dev = one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["evidence"])
    cited = dev.select("example_id", F.explode("evidence").alias("e"))
    known = cited.join(table(spark, folder, "chunks").select("chunk_id").distinct(), F.col("e.chunk_id") == F.col("chunk_id"), "left_semi").groupBy("example_id").agg(F.collect_set("e").alias("known"))
    held = dev.join(known, "example_id", "left")
    kind = F.array().cast("array<struct<chunk_id:string,quote:string>>")
    # Every example also cites a chunk that doesn't exist, so that precision is a share.
    cites = F.array_append(F.coalesce("known", kind), F.struct(F.lit("nowhere").alias("chunk_id"), F.lit("nothing").alias("quote")))
    precision, recall = metrics.citation_scores(cites, F.coalesce("evidence", kind))
    return held.select("example_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


def _processed(spark: SparkSession, folder: str) -> DataFrame:
    """The last message of each record on the chunks that the record names, as raw and out, with the words of raw."""
    own = one_per_key(table(spark, folder, "sft"), "record_id", ["messages", "created_at", "ingested_at"]).withColumn("raw", F.try_element_at("messages", F.lit(-1))["content"])
    context = F.concat_ws("\n", F.transform(F.filter("messages", lambda m: tidy(m["role"]) == "user"), lambda m: m["content"]))
    ids = F.regexp_extract_all(context, F.lit(r'<chunk id="([^"]*)">'), F.lit(1))
    texts = F.regexp_extract_all(context, F.lit(r'(?s)<chunk id="[^"]*">\s*(.*?)\s*</chunk>'), F.lit(1))
    words = F.size(F.filter(F.split(F.coalesce("raw", F.lit("")), r"\s+"), lambda w: w != ""))
    return own.withColumn("out", answers.postprocess(F.col("raw"), ids, texts)).withColumn("words", words)


def processed_answers(spark: SparkSession, folder: str) -> DataFrame:
    return _processed(spark, folder).select("record_id", "out.answer", F.size("out.citations").cast("bigint").alias("n_citations"), "out.abstained", "out.abstention_reason", F.array_join("out.warnings", ",").alias("warnings"))


#: Words of a completion from which on an object that isn't closed counts as cut off at the end of the budget.
COMPLETION_WORDS = 60


def failure_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Primary failures of the records' last messages; an abstention counts as right where it gives a reason of its own."""
    own = _processed(spark, folder)
    right = F.col("out.abstained") & (F.col("out.abstention_reason") != answers.UNSUPPORTED)
    failure = answers.failure_class(F.col("raw"), F.col("out.warnings"), F.col("out.abstained"), right, F.col("words"), F.lit(COMPLETION_WORDS))
    return own.groupBy(F.coalesce(failure, F.lit("none")).alias("failure")).agg(F.count("*").alias("n_records"))


def contract_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of outcomes per form of the output, with the lag of its arrival as latency."""
    text = F.coalesce(F.trim("raw"), F.lit(""))
    form = F.when(text == "", "empty").when(text.startswith("```"), "fenced").when(text.startswith("{"), "object").otherwise("plain")
    lag = F.timestamp_diff("MICROSECOND", "created_at", "ingested_at") / 1000.0
    rows = _processed(spark, folder).select(form.alias("form"), F.col("out.answer").isNotNull().alias("correct"), "out.warnings", "out.abstained", lag.alias("latency_ms"))
    out = answers.contract_summary(rows, "form")
    return out.select("form", "count", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith(("rate", "closed"))], F.round("mean_latency_ms", 1).alias("mean_latency_ms"))


def sentence_quality(spark: SparkSession, folder: str) -> DataFrame:
    return training_records.quality_report(_chunks(spark, folder), "text")


def best_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return training_records.best_sentence(_chunks(spark, folder), "chunk_id", "text", TERMS)


def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return _sft(spark, folder).select("record_id", training_records.token_estimate(F.col("messages")).cast("bigint").alias("n_tokens"))


def chat_rendering(spark: SparkSession, folder: str) -> DataFrame:
    return _sft(spark, folder).select("record_id", F.sha2(training_records.rendered_chat(F.col("messages")), 256).alias("rendered_sha256"))


def training_rounds(spark: SparkSession, folder: str) -> DataFrame:
    best = best_sentences(spark, folder).join(_chunks(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    return training_records.round_robin(best, "document_id", "chunk_id", "sentence", 200, 4)


def neighbour_records(spark: SparkSession, folder: str) -> DataFrame:
    return training_records.neighbours(_sft(spark, folder), "record_id")


def public_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of held-out items that may be shown: no question, answer or evidence."""
    own = one_per_key(table(spark, folder, "retrieval_test"), "example_id", ["event_family_id", "report_id", "split"])
    return own.select("example_id", "event_family_id", "report_id", "split")


def family_token_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens per source and language, with totals per source and overall (null where rolled up)."""
    own = table(spark, folder, "documents").select(F.coalesce(tidy("source"), F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"), "n_tokens", tokens("text").alias("t"))
    return own.rollup("source", "lang").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"), F.sum(F.size("t").cast("bigint")).alias("n_terms"))


def report_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the reports of selected events may be fetched, and if not, why."""
    problem = snapshots.url_problem(F.col("report_url"), ["dockets.inquiry.example"])
    return table(spark, folder, "selection").groupBy(F.coalesce(problem, F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("n_rows"))


def snapshot_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Different bodies per partition of the content-addressed store."""
    own = snapshots.with_digest(table(spark, folder, "documents").select("text"), "text").where("sha256 IS NOT NULL")
    return own.groupBy("prefix").agg(F.countDistinct("sha256").alias("n_bodies"), F.count("*").alias("n_rows"))


def event_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and month, with the field of their JSON properties."""
    own = table(spark, folder, "events").select(tidy("event_type").alias("event_type"), F.date_format("ts", "yyyy-MM").alias("month"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return own.groupBy("event_type", "month").agg(F.count("*").alias("n_events"), F.count("k").alias("n_with_k"), F.sum("k").alias("sum_k"))


def key_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which sources doesn't have exactly one row."""
    own = lambda name: table(spark, folder, name).select(tidy("event_id").alias("event_id"))
    return evaluation.key_differences(own("selection"), own("sources"), "event_id")


def _dev(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "retrieval_dev"), "example_id", ["question", "split", "answerable", "reference_answer", "evidence"])


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    """(example_id, chunk_id, passage, text): of the best chunk in its report the sentence nearest to a question; of the
    text what the passage needs to be found there, so that no text goes further."""
    chunks, asked = _in_own_report(spark, folder)
    first = cut_lineage(retrieval.scoped_bm25(chunks, asked, 1).select("query_id", "chunk_id"))
    # Only the texts of chunks that are the best of a question are shuffled, and few others: the set has bits for four times as many.
    found = marked(table(spark, folder, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "document_id", "text", "ingested_at"), "chunk_id", first.select(F.xxhash64("chunk_id").alias("hash")), 4 * first.count()).where("marked")
    best = first.join(asked.select("query_id", F.col("text").alias("question")), "query_id").join(one_per_key(found, "chunk_id", ["document_id", "text"]).select("chunk_id", "text"), "chunk_id")
    nearest = retrieval.nearest_sentence(F.col("question"), F.col("text"))
    # Texts that aren't blank have a passage; to ask for the passage would find it twice.
    own = best.where(F.trim("text") != "").select(F.col("query_id").alias("example_id"), "chunk_id", "text", nearest.alias("passage"))
    return own.withColumn("text", F.when(F.contains("text", "passage"), F.col("passage")).otherwise(""))


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of passages as answers that cite themselves; questions without one abstain."""
    dev = _dev(spark, folder)
    cited = F.when(F.col("passage").isNotNull(), F.array(F.struct("chunk_id", F.col("passage").alias("quote"))))
    given = F.when(F.col("chunk_id").isNotNull(), F.create_map("chunk_id", "text"))
    held = dev.select("example_id").join(_passages(spark, folder), "example_id", "left")
    predictions = held.select("example_id", F.col("passage").alias("answer"), cited.alias("citations"), F.col("passage").isNull().alias("abstained"), given.alias("chunks"))
    return evaluation.answer_scores(dev, predictions).join(dev.select("example_id", "answerable", tidy("split").alias("split")), "example_id")


def extracted_answers(spark: SparkSession, folder: str) -> DataFrame:
    scores = _extracted(spark, folder)
    rounded = [F.round(c, 6).alias(c) for c in ("citation_precision", "citation_recall", "span_validity")]
    return scores.select("example_id", "answer_correct", *rounded, "abstention_correct", F.array_join("failures", ",").alias("failures"))


def extracted_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.answer_summary(_extracted(spark, folder), {"answerable": F.col("answerable"), "split": F.col("split")})
    return out.select("slice", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("slice", "n")])


def generation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as generated texts, with and without the number of their chunk."""
    lag = table(spark, folder, "retrieval_dev").groupBy("example_id").agg(F.min(F.timestamp_diff("MICROSECOND", "created_at", "ingested_at") / 1000.0).alias("latency_ms"))
    top = _passages(spark, folder).select("example_id", "passage", F.array("chunk_id").alias("ids")).join(lag, "example_id")
    variants = F.array(F.struct(F.lit("rag").alias("variant"), F.concat("passage", F.lit(" [1]")).alias("text")), F.struct(F.lit("passage").alias("variant"), F.col("passage").alias("text")))
    used = F.length("v.text").cast("bigint")
    spread = top.select("example_id", "ids", "latency_ms", F.explode(variants).alias("v")).select("example_id", "v.variant", "v.text", F.col("ids").alias("retrieved_chunk_ids"), F.col("ids").alias("context_chunk_ids"), "latency_ms", used.alias("completion_tokens"), F.lit(0).cast("bigint").alias("prompt_tokens"))
    out = evaluation.generation_summary(evaluation.generation_scores(spread, _dev(spark, folder)))
    means = ("exact_match", "token_f1", "gold_coverage", "citation_precision", "citation_recall", "refusal_correct")
    return out.select("variant", "examples", *[F.round(c, 6).alias(c) for c in means], F.round("mean_latency_ms", 1).alias("mean_latency_ms"), "completion_tokens")


def task_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Passages scored by the kind of what is asked: a number of the reference answer, all of it, or nothing at all."""
    number = F.try_element_at(F.regexp_extract_all("reference_answer", F.lit(r"\b\d[\d,]*\b"), F.lit(0)), F.lit(1))
    strategy = F.when(~F.coalesce("answerable", F.lit(False)), "abstention_v1").when(F.col("value").isNotNull(), "numeric_exact_or_tolerance_v1").otherwise("required_key_facts_v1")
    tasks = _dev(spark, folder).withColumn("value", F.regexp_replace(number, ",", "").cast("double")).withColumn("strategy", strategy)
    held = tasks.join(_passages(spark, folder).select("example_id", "passage"), "example_id", "left")
    blank = lambda kind: F.lit(None).cast(kind)
    target = F.struct(F.col("value"), F.lit(0.0).alias("tolerance"), blank("date").alias("day"), blank("string").alias("clock"), blank("array<string>").alias("required"), blank("string").alias("label"))
    correct = evaluation.task_correct(F.col("strategy"), F.col("passage"), target, F.array("reference_answer"))
    out = evaluation.task_summary(held.select("strategy", correct.alias("correct")), "strategy", "correct")
    return out.withColumn("accuracy", F.round("accuracy", 6))


def quote_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of both retrieval tables as it stands in its chunk."""
    cited = _dev(spark, folder).select("example_id", "evidence").union(_test(spark, folder).select("example_id", "evidence"))
    return evaluation.quote_spans(cited.select("example_id", F.explode("evidence").alias("e")).select("example_id", "e.chunk_id", "e.quote"), _chunks(spark, folder))


def evidence_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _test(spark, folder).select("example_id", F.sha2(evaluation.evidence_prompt(F.col("question"), F.col("evidence")), 256).alias("prompt_sha256"))


def example_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Examples as they are, but synthetic ones are held out for the test, and drafts without reviewers count as unanswerable."""
    drafts = F.coalesce(F.size("provenance.reviewers") == 0, F.lit(False))
    own = table(spark, folder, "retrieval_dev").withColumn("answerable", F.col("answerable") & ~drafts)
    return integrity.example_problems(own.withColumn("split", F.when(F.col("provenance.is_synthetic"), F.lit("test")).otherwise(F.col("split"))))


def record_problems(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.record_problems(_sft(spark, folder), _chunks(spark, folder))


_QUERIES = (
    key_differences, extracted_answers, extracted_summary, generation_summary, task_accuracy, quote_spans, evidence_prompts, example_problems, record_problems,
    report_urls, snapshot_prefixes, event_profile,
    bm25_topk, bm25_scoped, dense_topk, hybrid_rrf, hybrid_scoped, empty_scopes, rerank_topk, context_budget, context_passage, term_spread, retrieval_metrics, retrieval_slices, family_splits, split_leakage,
    first_per_event, replacement_events, event_features, diverse_events, discovery_windows, repeated_chunks, equal_documents, orphan_documents, family_coverage, pending_events,
    span_violations, uncovered_pages, evidence_violations, scope_violations, chunk_lengths, chunk_kinds, token_f1, numeric_matches, citation_scores, failure_classes, contract_outcomes,
    processed_answers, sentence_quality, best_sentences, token_budget, chat_rendering, training_rounds, neighbour_records, public_manifest, family_token_sums,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# ---------------------------------------------------------------- the same in SQL


def _tok(x: str) -> str:
    return rf"regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+(?:[-./][\p{{L}}\p{{N}}_]+)*')"


def _words(x: str) -> str:
    """The words of generations; the texts of the tables hold no compatibility characters but those that lower maps."""
    return rf"regexp_extract_all(replace(lower(nfc_normalize(coalesce({x}, ''))), 'ß', 'ss'), '[\p{{L}}\p{{N}}_-]+')"


def _flat(x: str) -> str:
    """NFC, line feeds, single blanks within lines, nothing at the ends."""
    return rf"trim(regexp_replace(regexp_replace(replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\t\v\f\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10))"


def _tidy(x: str) -> str:
    return rf"nullif(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '')"


_BASE = f"""
ch AS (SELECT chunk_id, max(text) AS text, max(document_id) AS document_id, max(kind) AS kind FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
qs AS (SELECT example_id AS query_id, max(question) AS text FROM retrieval_test WHERE example_id IS NOT NULL GROUP BY 1),
tk AS MATERIALIZED (SELECT chunk_id, {_tok('text')} AS t FROM ch),
dl AS (SELECT chunk_id, CAST(len(t) AS DOUBLE) AS l FROM tk),
tf AS MATERIALIZED (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tk) GROUP BY 1, 2),
df AS MATERIALIZED (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(avg(l), 1.0) AS a FROM dl)"""
_SCORE = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)))"
_BM25 = _BASE + f""",
qt AS (SELECT DISTINCT query_id, unnest({_tok('text')}) AS term FROM qs),
sc AS (SELECT query_id, chunk_id, {_SCORE} AS s FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2),
al AS (SELECT q.query_id, c.chunk_id, coalesce(s, 0.0) AS s FROM qs q CROSS JOIN ch c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = c.chunk_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS INT) AS rank FROM al QUALIFY rank <= 100)"""
_OVER = f"""
ov AS (SELECT r.query_id, r.chunk_id, r.rank, r.s, c.text,
  CAST(len(list_intersect(list_distinct({_tok('q.text')}), {_tok('c.text')})) AS DOUBLE) / greatest(len(list_distinct({_tok('q.text')})), 1) AS o
  FROM rk r JOIN ch c USING (chunk_id) JOIN qs q USING (query_id) WHERE r.rank <= 30)"""
_METRIC = """,
gold AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT example_id AS query_id, unnest(evidence).chunk_id AS chunk_id FROM retrieval_test) WHERE chunk_id IS NOT NULL),
fd AS (SELECT g.query_id, count(*) AS n_gold, count(r.rank) AS f, min(r.rank) AS first, coalesce(sum(1 / log2(r.rank + 1)), 0.0) AS gain
  FROM gold g LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) r ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id GROUP BY 1),
hits AS (SELECT query_id, count(*) AS h FROM rk WHERE rank <= 10 GROUP BY 1),
ms AS (SELECT q.query_id, coalesce(n_gold, 0) AS n_gold, CAST(f AS DOUBLE) / n_gold AS recall,
  CASE WHEN n_gold > 0 THEN coalesce(1.0 / first, 0.0) END AS reciprocal_rank,
  CASE WHEN n_gold > 0 THEN gain / list_sum([1 / log2(i + 1) for i in range(1, least(n_gold, h) + 1)]) END AS ndcg
  FROM qs q LEFT JOIN fd USING (query_id) LEFT JOIN hits USING (query_id))"""
_ROUNDED = "round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg"
_SF = "sf AS (SELECT record_id, any_value(messages) AS messages FROM sft WHERE record_id IS NOT NULL GROUP BY 1)"
_CONTENT = "messages[-1].content"
_ANSWERED = f"""{_SF},
an AS (SELECT record_id, j ->> '$.answer' AS answer, j ->> '$.citations[0].quote' AS quote
  FROM (SELECT record_id, CASE WHEN json_valid({_CONTENT}) THEN CAST({_CONTENT} AS JSON) END AS j FROM sf WHERE len(messages) > 0)
  WHERE answer IS NOT NULL AND quote IS NOT NULL)"""
_PROCESSED = rf"""sm AS (SELECT record_id, any_value(messages) AS messages, any_value(created_at) AS created_at, max(ingested_at) AS ingested_at FROM sft WHERE record_id IS NOT NULL GROUP BY 1),
rw AS (SELECT record_id, created_at, ingested_at, messages[-1].content AS raw, array_to_string([m.content for m in messages if {_tidy('m.role')} = 'user'], chr(10)) AS ctx FROM sm),
cx AS (SELECT *, regexp_extract_all(ctx, '<chunk id="([^"]*)">', 1) AS ids, [{_flat('x')} for x in regexp_extract_all(ctx, '(?s)<chunk id="[^"]*">\s*(.*?)\s*</chunk>', 1)] AS texts, {_flat("coalesce(raw, '')")} AS norm FROM rw),
cd AS (SELECT *, CASE WHEN length(norm) >= 6 AND starts_with(norm, '```') AND ends_with(norm, '```') THEN trim(regexp_replace(substr(norm, 4, length(norm) - 6), '^(?i:json)', ''), ' ' || chr(10)) ELSE norm END AS cand FROM cx),
js AS (SELECT *, CASE WHEN json_valid(cand) THEN CAST(cand AS JSON) END AS j FROM cd),
ty AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND list_sort(json_keys(j)) = ['abstained', 'abstention_reason', 'answer', 'citations'] AND json_type(j, '$.abstained') = 'BOOLEAN'
    AND json_type(j, '$.answer') IN ('VARCHAR', 'NULL') AND json_type(j, '$.abstention_reason') IN ('VARCHAR', 'NULL') AND json_type(j, '$.citations') = 'ARRAY', false) AS shaped FROM js),
cs AS (SELECT *, CASE WHEN shaped THEN CAST(j -> '$.citations' AS JSON[]) ELSE [] END AS cits, shaped AND (j ->> '$.abstained') = 'true' AS declared FROM ty),
ct AS (SELECT *, len(list_filter(cits, lambda c: NOT coalesce(json_type(c) = 'OBJECT' AND list_sort(json_keys(c)) = ['chunk_id', 'quote'] AND json_type(c, '$.chunk_id') = 'VARCHAR' AND json_type(c, '$.quote') = 'VARCHAR', false))) > 0 AS odd,
  [{{'c': {_flat("x ->> '$.chunk_id'")}, 'q': {_flat("x ->> '$.quote'")}}} for x in cits] AS pairs FROM cs),
kp AS (SELECT *, [p for p in pairs if p.c <> '' AND p.q <> '' AND list_contains(ids, p.c) AND contains(texts[list_position(ids, p.c)], p.q)] AS good FROM ct),
wn AS (SELECT *, {_flat("coalesce(j ->> '$.answer', '')")} AS said, CASE WHEN len(ids) <> len(texts) OR len(ids) <> len(list_distinct(ids)) THEN 'duplicate_evidence' WHEN norm = '' THEN 'empty_output' WHEN length(raw) > 16384 THEN 'output_too_long'
    WHEN j IS NULL THEN 'invalid_json' WHEN NOT shaped THEN 'malformed_output' WHEN declared THEN CASE WHEN json_type(j, '$.answer') <> 'NULL' OR len(cits) > 0 THEN 'malformed_output' ELSE '' END WHEN odd THEN 'malformed_output' END AS w FROM kp),
po AS (SELECT record_id, raw, created_at, ingested_at, said, good,
  CASE WHEN w IS NOT NULL THEN w ELSE array_to_string(list_filter([CASE WHEN len(good) < len(pairs) THEN 'invalid_citation' END, CASE WHEN said = '' OR len(good) = 0 THEN 'insufficient_evidence' END], lambda x: x IS NOT NULL), ',') END AS warnings,
  w IS NOT NULL OR said = '' OR len(good) = 0 AS abstained,
  CASE WHEN w = '' THEN coalesce(nullif({_flat("coalesce(j ->> '$.abstention_reason', '')")}, ''), 'insufficient evidence') ELSE 'insufficient evidence' END AS reason FROM wn),
pr AS (SELECT record_id, raw, created_at, ingested_at, CASE WHEN NOT abstained THEN said END AS answer, CASE WHEN abstained THEN 0 ELSE len(list_distinct(good)) END AS n_citations, abstained, CASE WHEN abstained THEN reason END AS abstention_reason, warnings FROM po)"""
_SENT = r"string_split(regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))"
_COUNT = lambda m: f"len(string_split(s, '{m}'))"
# Sentences have single blanks by then, so the rules are said by comparisons and short patterns of their own.
_REASON = rf"""CASE WHEN length(s) NOT BETWEEN 80 AND 320 OR right(s, 1) NOT IN ('.', '!', '?') THEN 'length_or_termination'
  WHEN NOT regexp_matches(left(s, 1), '\p{{Lu}}|\p{{Nd}}') THEN 'sentence_fragment'
  WHEN regexp_matches(s, '^[0-9]+ [A-Z]') OR regexp_matches(s, '\b[0-9]+ (A|An|The) [a-z]') THEN 'footnote_fragment'
  WHEN contains(s, '•') OR regexp_matches(s, '\b[0-9] [0-9]\b') THEN 'list_or_page_fragment'
  WHEN string_split(lower(s), ' ')[1] IN ('exemplar', 'figure', 'table') THEN 'document_boilerplate'
  WHEN substr(s, 2, 1) = '-' AND left(s, 1) BETWEEN 'A' AND 'Z' AND substr(s, 3, 1) BETWEEN '0' AND '9' THEN 'reference_or_heading'
  WHEN regexp_matches(lower(s), '\bsection [0-9]') THEN 'section_cross_reference'
  WHEN regexp_matches(string_split(s, ' ')[1], '^[0-9]?[0-9]:[0-9][0-9]:[0-9][0-9]\b') THEN 'transcript_fragment'
  WHEN regexp_matches(s, '[.!?][”"]? (A|According|An|As|At|He|In|It|On|She|That|The|They|This|We) ') THEN 'fused_sentences'
  WHEN regexp_matches(lower(s), '^(continue|do|ensure|maintain)\b') OR regexp_matches(lower(s), '^if .+, (continue|do|ensure|maintain)\b') THEN 'isolated_operational_instruction'
  WHEN contains(lower(s), 'http') OR regexp_matches(s, '\b[0-9]+(\.[0-9]+){{1,3}} [A-Z][A-Za-z]') THEN 'heading_or_url'
  WHEN regexp_matches(s, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])[b-z] [a-z]{{2,}}([^\p{{L}}\p{{N}}\p{{M}}_]|$)') OR regexp_matches(lower(s), '\ba re\b') THEN 'split_word'
  WHEN contains(s, ' .') OR contains(s, ' ,') OR contains(s, ' ;') OR contains(s, ' )') OR regexp_matches(s, '[,.)][A-Za-z]') THEN 'broken_punctuation'
  WHEN {_COUNT('“')} <> {_COUNT('”')} OR {_COUNT('"')} % 2 = 0 THEN 'unbalanced_quote'
  WHEN regexp_matches(s, '(^|[^\p{{L}}\p{{N}}_])[A-Za-z0-9]{{2,}} - ?[A-Za-z0-9]') OR regexp_matches(s, '(^|[^\p{{L}}\p{{N}}_])[A-Za-z0-9]{{2,}}- [A-Za-z0-9]') OR regexp_matches(s, '(^|[^\p{{L}}\p{{N}}_])[a-z]{{2,}}[A-Z]{{2,}}([^\p{{L}}\p{{N}}_]|$)')
    OR regexp_matches(s, '[0-9][0-9][a-z][a-z][a-z]+([^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(s, '\b[A-Z][A-Za-z]{{3,}}[0-9]{{4}}\b') OR regexp_matches(s, '(^|[^\p{{L}}\p{{N}}_])[A-Z] [A-Z][A-Za-z]?([^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(s, '\b[A-Z]-([A-Z]-)+ *[A-Z]\b') THEN 'ocr_fragment' END"""
_PLAIN = lambda x: rf"array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\s+', ' ', 'g')), ' '), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"
_FEATURE = lambda c: f"coalesce(nullif(lower(trim(metadata.{c})), ''), 'unknown')"
_SCOPED = _BASE + f""",
so AS (SELECT source_document_id, max('doc-' || sha256) AS scope FROM sources GROUP BY 1),
dq AS (SELECT example_id AS query_id, max(question) AS text, max(report_id) AS report_id FROM retrieval_dev GROUP BY 1),
sq AS (SELECT query_id, text, scope FROM dq JOIN so ON dq.report_id = so.source_document_id),
pr AS (SELECT q.query_id, c.chunk_id FROM sq q JOIN ch c ON c.document_id = q.scope),
qt AS (SELECT DISTINCT query_id, unnest({_tok('text')}) AS term FROM sq),
sc AS (SELECT query_id, chunk_id, {_SCORE} AS s FROM pr JOIN qt USING (query_id) JOIN tf USING (chunk_id, term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2),
al AS (SELECT query_id, chunk_id, coalesce(s, 0.0) AS s FROM pr LEFT JOIN sc USING (query_id, chunk_id))"""
_PASSAGE = _SCOPED + rf""",
ex AS (SELECT example_id, any_value(coalesce(answerable, false)) AS able, any_value(reference_answer) AS ref, any_value(evidence) AS evidence, any_value({_tidy('split')}) AS split FROM retrieval_dev WHERE example_id IS NOT NULL GROUP BY 1),
top AS (SELECT query_id, chunk_id FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) = 1),
wt AS (SELECT query_id, chunk_id, c.text, list_filter(list_distinct({_tok('q.text')}), lambda t: length(t) >= 3 AND t NOT IN {STOP_WORDS}) AS asked,
  string_split(regexp_replace(c.text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM top JOIN sq q USING (query_id) JOIN ch c USING (chunk_id)),
st2 AS (SELECT query_id, chunk_id, text, asked, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM wt),
pa AS (SELECT query_id AS example_id, chunk_id, text, substr(sentence, 1, 420) AS passage FROM st2 WHERE length(trim(sentence)) > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(asked, list_distinct({_tok('sentence')}))) DESC, pos) = 1),
gd AS (SELECT DISTINCT example_id, e.chunk_id AS c, e.quote AS q FROM (SELECT example_id, unnest(evidence) AS e FROM ex)),
gn AS (SELECT example_id, count(*) AS n FROM gd GROUP BY 1)"""
_EXTRACTED = _PASSAGE + f""",
ht AS (SELECT DISTINCT pa.example_id FROM pa JOIN gd ON gd.example_id = pa.example_id AND gd.c = pa.chunk_id AND gd.q = pa.passage),
sr AS (SELECT ex.example_id, able, split, passage IS NULL AS p, coalesce(n, 0) AS n, ht.example_id IS NOT NULL AS h, coalesce(length(ref) > 0 AND {_PLAIN('passage')} = {_PLAIN('ref')}, false) AS same
  FROM ex LEFT JOIN pa USING (example_id) LEFT JOIN gn USING (example_id) LEFT JOIN ht USING (example_id)),
ms AS (SELECT example_id, able, split, p, CASE WHEN p THEN NOT able ELSE same END AS answer_correct, CASE WHEN NOT p THEN h::INT::DOUBLE WHEN n = 0 THEN 1.0 ELSE 0.0 END AS citation_precision,
  CASE WHEN n > 0 THEN h::INT / n WHEN p THEN 1.0 ELSE 0.0 END AS citation_recall, 1.0::DOUBLE AS span_validity, p = NOT able AS abstention_correct, n FROM sr)"""

ORACLES = {
    "key_differences": f"""WITH a AS (SELECT DISTINCT {_tidy('event_id')} AS event_id FROM selection), b AS (SELECT {_tidy('event_id')} AS event_id, count(*) AS n FROM sources GROUP BY 1)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN n IS NULL THEN 'missing' WHEN a.event_id IS NULL THEN 'extra' ELSE 'repeated' END AS problem
FROM (FROM a WHERE event_id IS NOT NULL) a FULL JOIN (FROM b WHERE event_id IS NOT NULL) b ON a.event_id = b.event_id WHERE n IS NULL OR a.event_id IS NULL OR n > 1""",
    "extracted_answers": f"""WITH {_EXTRACTED}
SELECT example_id, answer_correct, round(citation_precision, 6) AS citation_precision, round(citation_recall, 6) AS citation_recall, span_validity, abstention_correct,
  array_to_string(list_filter([CASE WHEN NOT p AND able AND NOT answer_correct THEN 'answer_mismatch' END, CASE WHEN NOT p AND citation_precision < 1 THEN 'incorrect_citation' END, CASE WHEN NOT p AND NOT able THEN 'missed_abstention' END,
  CASE WHEN n > 0 AND citation_recall < 1 THEN 'missing_gold_citation' END, CASE WHEN p AND able THEN 'unexpected_abstention' END], lambda x: x IS NOT NULL), ',') AS failures FROM ms""",
    "extracted_summary": f"""WITH {_EXTRACTED},
sl AS (SELECT *, unnest(['overall', 'answerable:' || able, 'split:' || coalesce(split, 'none')]) AS slice FROM ms)
SELECT slice, count(*) AS n, round(avg(answer_correct::INT), 6) AS answer_accuracy, round(avg(citation_precision), 6) AS citation_precision, round(avg(citation_recall), 6) AS citation_recall, avg(span_validity) AS span_validity,
  round(avg(abstention_correct::INT), 6) AS abstention_accuracy, round(coalesce(avg((NOT able)::INT) FILTER (WHERE p), 1.0), 6) AS abstention_precision, round(coalesce(avg(p::INT) FILTER (WHERE NOT able), 1.0), 6) AS abstention_recall FROM sl GROUP BY 1""",
    "generation_summary": rf"""WITH {_PASSAGE},
gv AS (SELECT example_id, able, ref, evidence, chunk_id, unnest([{{'variant': 'rag', 't': passage || ' [1]'}}, {{'variant': 'passage', 't': passage}}]) AS v FROM pa JOIN ex USING (example_id)),
gt AS (SELECT example_id, v.variant AS variant, v.t AS t, able, ref, chunk_id, list_distinct([e.chunk_id for e in coalesce(evidence, [])]) AS gold, {_words('v.t')} AS a, {_words('ref')} AS b,
  list_distinct([CAST(x AS INT) for x in regexp_extract_all(v.t, '\[(\d{{1,9}})\]', 1)]) AS cited FROM gv),
gs AS (SELECT *, CAST(coalesce(list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in list_distinct(list_intersect(a, b))]), 0) AS DOUBLE) AS k FROM gt)
SELECT variant, count(*) AS examples, round(avg(CASE WHEN ref IS NOT NULL THEN (a = b)::INT END), 6) AS exact_match,
  round(avg(CASE WHEN ref IS NULL THEN NULL WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * k / (len(a) + len(b)) END), 6) AS token_f1,
  round(avg(CASE WHEN len(gold) > 0 AND variant = 'rag' THEN list_contains(gold, chunk_id)::INT / len(gold) END), 6) AS gold_coverage,
  round(avg(CASE WHEN able THEN CASE WHEN len(cited) > 0 THEN list_contains(cited, 1)::INT / len(cited) ELSE 0.0 END END), 6) AS citation_precision, round(avg(CASE WHEN able THEN list_contains(cited, 1)::INT END), 6) AS citation_recall,
  round(avg(CASE WHEN NOT able THEN regexp_matches(array_to_string(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_-]+'), ' '), 'do not know|does not specify|not specified|insufficient')::INT END), 6) AS refusal_correct,
  round(avg(l), 1) AS mean_latency_ms, CAST(sum(length(t)) AS BIGINT) AS completion_tokens FROM gs JOIN (SELECT example_id, min((epoch_us(ingested_at) - epoch_us(created_at)) / 1000.0) AS l FROM retrieval_dev GROUP BY 1) USING (example_id) GROUP BY 1""",
    "record_problems": rf"""WITH {_SF},
ow AS (SELECT record_id, messages, CASE WHEN json_valid({_CONTENT}) AND json_type(CASE WHEN json_valid({_CONTENT}) THEN CAST({_CONTENT} AS JSON) END) = 'OBJECT' THEN CAST({_CONTENT} AS JSON) END AS j FROM sf),
ci AS (SELECT DISTINCT record_id, lower(trim(c ->> '$.chunk_id')) AS chunk_id, c ->> '$.quote' AS quote FROM (SELECT record_id, unnest(CAST(j -> '$.citations' AS JSON[])) AS c FROM ow)),
kn AS (SELECT lower(trim(chunk_id)) AS chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)
SELECT record_id, unnest(list_filter([CASE WHEN coalesce([lower(trim(m.role)) for m in messages] <> ['system', 'user', 'assistant'], true) THEN 'roles' END, CASE WHEN j IS NULL THEN 'not_json' END], lambda x: x IS NOT NULL)) AS problem FROM ow
UNION SELECT record_id, CASE WHEN kn.chunk_id IS NULL THEN 'unknown_chunk' ELSE 'quote_not_found' END FROM ci LEFT JOIN kn USING (chunk_id)
WHERE ci.chunk_id IS NOT NULL AND quote IS NOT NULL AND (kn.chunk_id IS NULL OR NOT coalesce(contains(regexp_replace(text, '\s+', ' ', 'g'), trim(regexp_replace(quote, '\s+', ' ', 'g'))), false))""",
    "quote_spans": r"""WITH ch AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
ev AS (SELECT example_id, unnest(evidence) AS e FROM retrieval_dev UNION ALL SELECT example_id, unnest(evidence) FROM retrieval_test),
ci AS (SELECT DISTINCT example_id, e.chunk_id AS chunk_id, e.quote AS quote FROM ev WHERE example_id IS NOT NULL),
tx AS (SELECT ci.*, text, regexp_replace(quote, '[\s\p{Z}]+', '', 'g') AS q, strpos(regexp_replace(text, '[\s\p{Z}]+', '', 'g'), regexp_replace(quote, '[\s\p{Z}]+', '', 'g')) AS pos FROM ci LEFT JOIN ch USING (chunk_id)),
pl AS (SELECT *, CASE WHEN q <> '' AND pos > 0 THEN list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(substr(text, i, 1), '[\s\p{Z}]')) END AS places FROM tx)
SELECT example_id, chunk_id, quote, substr(text, places[pos], places[pos + length(q) - 1] - places[pos] + 1) AS span FROM pl""",
    "evidence_prompts": """WITH t AS (SELECT example_id, max(question) AS question, any_value(evidence) AS evidence FROM retrieval_test WHERE example_id IS NOT NULL GROUP BY 1),
e AS (SELECT example_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS pos FROM t),
b AS (SELECT example_id, e.chunk_id AS c, min(pos) AS a, string_agg(coalesce(e.quote, ''), chr(10) ORDER BY pos) AS q FROM e GROUP BY 1, 2),
j AS (SELECT example_id, string_agg('<chunk id="' || coalesce(c, '') || '">' || chr(10) || q || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY a) AS x FROM b GROUP BY 1)
SELECT example_id, sha256(coalesce(question || chr(10) || chr(10), '') || coalesce(x, '<no_evidence />')) AS prompt_sha256 FROM t LEFT JOIN j USING (example_id)""",
    "example_problems": """WITH o AS (SELECT example_id, question, coalesce(trim(reference_answer), '') AS ref, coalesce(len(evidence), 0) AS n, provenance AS p,
  coalesce(answerable, false) AND NOT coalesce(len(provenance.reviewers) = 0, false) AS able FROM retrieval_dev WHERE example_id IS NOT NULL),
f AS (SELECT example_id, 'no_question' AS problem FROM o WHERE coalesce(trim(question), '') = '' UNION ALL SELECT example_id, 'no_answer' FROM o WHERE able AND ref = '' UNION ALL SELECT example_id, 'no_evidence' FROM o WHERE able AND n = 0
  UNION ALL SELECT example_id, 'answer_unexpected' FROM o WHERE NOT able AND ref <> '' UNION ALL SELECT example_id, 'evidence_unexpected' FROM o WHERE NOT able AND n > 0
  UNION ALL SELECT example_id, 'own_reviewer' FROM o WHERE list_contains(p.reviewers, p.author) UNION ALL SELECT example_id, 'no_source' FROM o WHERE coalesce(len(p.source_document_ids), 0) = 0
  UNION ALL SELECT example_id, 'synthetic_test' FROM o WHERE p.is_synthetic)
SELECT DISTINCT example_id, problem FROM f""",
    "report_urls": r"""SELECT CASE WHEN report_url IS NULL OR trim(report_url) = '' THEN 'missing' WHEN NOT regexp_matches(report_url, '^[a-z]+://[^/]+') THEN 'malformed' WHEN NOT starts_with(lower(report_url), 'https://') THEN 'not_https'
  WHEN regexp_matches(report_url, '^[a-z]+://[^/]*@') THEN 'credentials' WHEN regexp_matches(report_url, '^[a-z]+://[^/]*:\d+(/|$)') AND NOT regexp_matches(report_url, '^[a-z]+://[^/]*:443(/|$)') THEN 'port'
  WHEN regexp_extract(lower(report_url), '^[a-z]+://([^/:]+)', 1) <> 'dockets.inquiry.example' THEN 'host' ELSE 'allowed' END AS verdict, count(*) AS n_rows FROM selection GROUP BY 1""",
    "snapshot_prefixes": "SELECT substr(sha256(text), 1, 2) AS prefix, count(DISTINCT sha256(text)) AS n_bodies, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "event_profile": "SELECT lower(trim(event_type)) AS event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n_events, count(props ->> '$.k') AS n_with_k, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1, 2",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, rank, round(s, 6) AS score FROM rk WHERE rank <= 10",
    "bm25_scoped": f"""WITH {_SCOPED}
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS INT) AS rank, round(s, 6) AS score FROM al QUALIFY rank <= 5""",
    "dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS s FROM v q CROSS JOIN v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INT) AS rank, round(greatest(s, 0.0), 6) AS score FROM p QUALIFY rank <= 10""",
    "hybrid_rrf": f"""WITH {_BM25},
nq AS (SELECT query_id, count(*) AS m FROM qt GROUP BY 1),
oh AS (SELECT query_id, chunk_id, count(*) AS h FROM qt JOIN tf USING (term) GROUP BY 1, 2),
oa AS (SELECT al.query_id, al.chunk_id, coalesce(h, 0) / greatest(coalesce(m, 1), 1) AS o FROM al LEFT JOIN oh USING (query_id, chunk_id) LEFT JOIN nq USING (query_id)),
o2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(o, 9) DESC, chunk_id) AS r2 FROM oa QUALIFY r2 <= 100),
fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(0.25::DOUBLE / (60 + rank), 0) + coalesce(0.75::DOUBLE / (60 + r2), 0) AS s
  FROM rk a FULL JOIN o2 b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS INT) AS rank, round(s, 6) AS score FROM fu QUALIFY rank <= 10""",
    "hybrid_scoped": f"""WITH {_BASE},
ow AS (SELECT 'doc-' || sha256 AS document_id, min({_tidy('e')}) AS scope FROM (SELECT source_document_id, max(sha256) AS sha256, max(event_id) AS e FROM sources WHERE source_document_id IS NOT NULL GROUP BY 1) WHERE sha256 IS NOT NULL GROUP BY 1),
dq AS (SELECT example_id AS query_id, max(question) AS text, {_tidy('max(event_id)')} AS scope FROM retrieval_dev WHERE example_id IS NOT NULL GROUP BY 1),
pr AS (SELECT query_id, chunk_id FROM dq JOIN ow USING (scope) JOIN ch USING (document_id)),
qt AS (SELECT DISTINCT query_id, unnest({_tok('text')}) AS term FROM dq),
sa AS (SELECT chunk_id FROM ch JOIN ow USING (document_id) WHERE scope IS NOT NULL OR scope IS NULL),
tk2 AS (SELECT chunk_id, t FROM tk SEMI JOIN sa USING (chunk_id)),
st2 AS (SELECT CAST(count(*) AS DOUBLE) AS n2, greatest(avg(len(t)), 1.0) AS a2 FROM tk2),
df2 AS (SELECT term, CAST(count(*) AS DOUBLE) AS df2 FROM tf SEMI JOIN sa USING (chunk_id) GROUP BY 1),
sc AS (SELECT query_id, chunk_id, sum(ln(1 + (n2 - df2 + 0.5) / (df2 + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a2))) AS s, count(*) AS h
  FROM pr JOIN qt USING (query_id) JOIN tf USING (chunk_id, term) JOIN df2 USING (term) JOIN dl USING (chunk_id), st2 GROUP BY 1, 2),
nq AS (SELECT query_id, count(*) AS m FROM qt GROUP BY 1),
al AS (SELECT query_id, chunk_id, coalesce(s, 0.0) AS s, coalesce(h / m, 0.0) AS o FROM pr LEFT JOIN sc USING (query_id, chunk_id) LEFT JOIN nq USING (query_id)),
b1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY round(o, 9) DESC, chunk_id) AS r2 FROM al),
fu AS (SELECT query_id, chunk_id, CASE WHEN r1 <= 100 THEN 0.25::DOUBLE / (60 + r1) ELSE 0 END + CASE WHEN r2 <= 100 THEN 0.75::DOUBLE / (60 + r2) ELSE 0 END AS s FROM b1 WHERE r1 <= 100 OR r2 <= 100)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS INT) AS rank, round(s, 6) AS score FROM fu QUALIFY rank <= 5""",
    "empty_scopes": f"""WITH so AS (SELECT source_document_id, max('doc-' || sha256) AS scope FROM sources WHERE source_document_id IS NOT NULL GROUP BY 1),
d AS (SELECT example_id, max(report_id) AS r FROM retrieval_dev WHERE example_id IS NOT NULL GROUP BY 1)
SELECT example_id AS query_id, scope FROM d LEFT JOIN so ON d.r = so.source_document_id WHERE scope IS NULL OR scope NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)""",
    "rerank_topk": f"""WITH {_BM25}, {_OVER},
k AS (SELECT query_id, chunk_id, round(o, 9) AS o, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(o, 9) DESC, rank, chunk_id) AS INT) AS r FROM ov WHERE rank <= 20 QUALIFY r <= 5)
SELECT query_id, chunk_id, r AS rank, round(o - min(o) OVER (PARTITION BY query_id), 6) AS score FROM k""",
    "context_budget": f"""WITH {_BM25},
p AS (SELECT query_id, chunk_id, rank, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM rk JOIN ch USING (chunk_id) WHERE rank <= 10 AND length(trim(text)) > 0)
SELECT query_id, chunk_id, rank, CAST(least(n, 4000 - b) AS BIGINT) AS n_chars FROM p WHERE b < 4000""",
    "term_spread": f"WITH {_BASE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1",
    "retrieval_metrics": f"WITH {_BM25}{_METRIC} SELECT query_id, CAST(n_gold AS BIGINT) AS n_gold, {_ROUNDED} FROM ms",
    "retrieval_slices": f"""WITH {_BM25}{_METRIC},
ex AS (SELECT example_id AS query_id, any_value(answerable) AS answerable, max(question) AS question, max(lower(trim(split))) AS split FROM retrieval_test GROUP BY 1),
kd AS (SELECT query_id, list(DISTINCT 'content:' || kind) AS kinds FROM gold JOIN ch USING (chunk_id) WHERE kind IS NOT NULL GROUP BY 1),
sl AS (SELECT ms.*, unnest(list_concat(coalesce(kinds, ['content:none']), ['overall', 'split:' || coalesce(split, 'none'), 'answerable:' || coalesce(CAST(answerable AS VARCHAR), 'none'),
  'query:' || CASE WHEN len(list_filter(regexp_extract_all(question, '[A-Z0-9-]+'), lambda t: length(t) >= 5 AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]'))) > 0 THEN 'identifier' ELSE 'natural-language' END])) AS slice
  FROM ms JOIN ex USING (query_id) LEFT JOIN kd USING (query_id))
SELECT slice, count(*) AS examples, count(recall) AS scored, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg FROM sl GROUP BY 1""",
    "family_splits": f"""WITH f AS (SELECT DISTINCT {_tidy('event_family_id')} AS family FROM selection WHERE {_tidy('event_family_id')} IS NOT NULL),
d AS (SELECT family, sha256('42' || chr(0) || family) AS digest FROM f),
n AS (SELECT count(*) AS n FROM f),
q AS (SELECT n, floor(n * 0.8) AS a, floor(n * 0.1) AS b, n * 0.8 - floor(n * 0.8) AS ra, n * 0.1 - floor(n * 0.1) AS rb FROM n),
w AS (SELECT a + CASE WHEN n - a - 2 * b >= 1 AND (ra >= rb OR n - a - 2 * b >= 3) THEN 1 WHEN n - a - 2 * b = 3 THEN 1 ELSE 0 END AS a,
  b + CASE WHEN (ra >= rb AND n - a - 2 * b >= 2) OR (ra < rb AND n - a - 2 * b >= 1) THEN 1 ELSE 0 END AS b FROM q)
SELECT family, digest, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'development' ELSE 'test' END AS split
FROM (SELECT family, digest, row_number() OVER (ORDER BY digest, family) AS r FROM d), w""",
    "split_leakage": f"""SELECT {_tidy('event_family_id')} AS family, count(DISTINCT {_tidy('proposed_split')}) AS n_splits, count(*) AS n_rows
FROM selection WHERE {_tidy('event_family_id')} IS NOT NULL GROUP BY 1 HAVING n_splits > 1""",
    "first_per_event": f"""SELECT event_id, source_id, family FROM (
  SELECT event_id, {_tidy('source_id')} AS source_id, {_tidy('event_family_id')} AS family FROM selection WHERE event_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY source_id NULLS LAST, family NULLS FIRST) = 1""",
    "replacement_events": f"""WITH o AS (SELECT event_id, {_tidy('proposed_split')} AS split FROM selection),
r AS (SELECT split, min(event_id) AS event_id FROM o WHERE split IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT event_id FROM o WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM r))
SELECT r.split, arg_min(c.event_id, sha256('7' || chr(0) || 'replacement' || chr(0) || r.split || chr(0) || c.event_id)) AS event_id FROM r CROSS JOIN c GROUP BY 1""",
    "event_features": f"""WITH o AS (SELECT event_id, any_value(metadata) AS metadata, any_value(occurred_on) AS d FROM selection GROUP BY 1)
SELECT unnest(['year:' || coalesce(CAST(year(d) AS VARCHAR), 'unknown'), {', '.join(f"'{c}:' || " + _FEATURE(c) for c in ('severity', 'event_type', 'weather', 'report_type'))}]) AS feature, count(*) AS n_records FROM o GROUP BY 1""",
    "discovery_windows": """WITH s AS (SELECT split, CAST(min(published_at) AS DATE) AS a, CAST(max(published_at) AS DATE) AS b FROM sources WHERE published_at IS NOT NULL AND split IS NOT NULL GROUP BY 1),
n AS (SELECT *, b - a + 1 AS days, least(12, b - a + 1) AS c FROM s),
w AS (SELECT split, a, b, c, days, unnest(range(0, c)) AS number FROM n)
SELECT split, CAST(number AS INT) AS number, a + CAST(CASE WHEN c = 1 THEN 0 ELSE number * (days - 1) // (c - 1) END AS INT) AS begins,
  least(b, a + CAST(CASE WHEN c = 1 THEN 0 ELSE number * (days - 1) // (c - 1) END AS INT) + 30) AS ends FROM w""",
    "repeated_chunks": "SELECT chunk_id, count(*) AS n_rows FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING n_rows > 1",
    "equal_documents": "SELECT sha256(text) AS sha256, count(*) AS n_documents, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING n_documents > 1",
    "orphan_documents": "SELECT document_id, count(*) AS n_rows FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT 'doc-' || sha256 FROM sources WHERE sha256 IS NOT NULL AND published_at IS NOT NULL AND deleted_at IS NULL) GROUP BY 1",
    "family_coverage": f"""WITH l AS (SELECT DISTINCT {_tidy('event_family_id')} AS family FROM selection), r AS (SELECT DISTINCT {_tidy('event_family_id')} AS family FROM sources)
SELECT coalesce(l.family, r.family) AS family, CASE WHEN r.family IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (FROM l WHERE family IS NOT NULL) l FULL JOIN (FROM r WHERE family IS NOT NULL) r ON l.family = r.family WHERE l.family IS NULL OR r.family IS NULL""",
    "pending_events": "SELECT DISTINCT event_id FROM selection s WHERE NOT EXISTS (SELECT 1 FROM sources o WHERE o.event_id = s.event_id)",
    "span_violations": """SELECT DISTINCT chunk_id, unnest(list_filter([CASE WHEN start_offset < 0 THEN 'negative_start' END, CASE WHEN e <= start_offset THEN 'empty_span' END,
  CASE WHEN length(text) <> e - start_offset THEN 'length_differs' END, CASE WHEN kind = 'ocr' AND page_start < page_end OR kind IS DISTINCT FROM 'ocr' AND page_end < page_start THEN 'pages_reversed' END,
  CASE WHEN (kind = 'ocr' AND page_end < 1) OR (kind IS DISTINCT FROM 'ocr' AND page_start < 1) THEN 'page_below_one' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT *, CASE WHEN kind = 'table' THEN end_offset + 1 WHEN kind IS NOT NULL THEN end_offset END AS e FROM chunks) WHERE chunk_id IS NOT NULL""",
    "uncovered_pages": """WITH o AS (SELECT document_id, page_start AS a, page_end AS b FROM chunks WHERE document_id IS NOT NULL AND page_end >= page_start AND kind = 'text'),
have AS (SELECT DISTINCT document_id, unnest(range(a, b + 1)) AS page FROM o), due AS (SELECT document_id, unnest(range(min(a), max(b) + 1)) AS page FROM o GROUP BY 1)
SELECT document_id, CAST(page AS INT) AS page FROM due EXCEPT SELECT document_id, CAST(page AS INT) FROM have""",
    "evidence_violations": """WITH d AS (SELECT example_id, any_value(evidence) AS evidence, any_value(provenance) AS provenance FROM retrieval_dev WHERE example_id IS NOT NULL GROUP BY 1),
c AS (SELECT example_id, provenance.source_document_ids AS declared, e.chunk_id AS chunk_id, e.quote AS quote FROM (SELECT example_id, provenance, unnest(evidence) AS e FROM d)),
ch AS (SELECT chunk_id, max(text) AS text, max(document_id) AS document_id FROM chunks GROUP BY 1),
so AS (SELECT source_document_id, max('doc-' || sha256) AS document_id FROM sources GROUP BY 1),
j AS (SELECT DISTINCT c.example_id, c.chunk_id, CASE WHEN ch.text IS NULL THEN 'unknown_chunk' WHEN so.source_document_id IS NULL THEN 'unknown_source'
  WHEN NOT list_contains(declared, so.source_document_id) THEN 'undeclared_source' WHEN NOT contains(ch.text, quote) THEN 'quote_not_found' END AS problem
  FROM c LEFT JOIN ch ON ch.chunk_id = c.chunk_id LEFT JOIN so ON so.document_id = ch.document_id)
SELECT example_id, chunk_id, problem FROM j WHERE problem IS NOT NULL""",
    "scope_violations": """WITH d AS (SELECT DISTINCT example_id, report_id, event_id, event_family_id, split FROM retrieval_dev WHERE example_id IS NOT NULL),
s AS (SELECT source_document_id, any_value(event_id) AS e, any_value(event_family_id) AS f, any_value(split) AS p FROM sources GROUP BY 1)
SELECT DISTINCT example_id, unnest(list_filter([CASE WHEN e IS NULL THEN 'unknown_report' END, CASE WHEN event_id <> e THEN 'event_differs' END,
  CASE WHEN event_family_id <> f THEN 'family_differs' END, CASE WHEN split <> p THEN 'split_differs' END], lambda x: x IS NOT NULL)) AS problem
FROM d LEFT JOIN s ON d.report_id = s.source_document_id""",
    "chunk_lengths": """WITH l AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS c FROM chunks WHERE text IS NOT NULL)
SELECT min(CASE WHEN i = 0 THEN n END) AS least, min(CASE WHEN i = round_even((c - 1) * 0.5, 0) THEN n END) AS median, min(CASE WHEN i = round_even((c - 1) * 0.95, 0) THEN n END) AS p95, max(n) AS most FROM l""",
    "chunk_kinds": "WITH ch AS (SELECT chunk_id, max(kind) AS kind, max(document_id) AS document_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT kind, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ch GROUP BY 1",
    "token_f1": f"""WITH {_ANSWERED},
t AS (SELECT record_id, answer, quote, {_words('answer')} AS a, {_words('quote')} AS b FROM an),
c AS (SELECT *, CAST(coalesce(list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in list_distinct(list_intersect(a, b))]), 0) AS DOUBLE) AS k FROM t)
SELECT record_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * k / (len(a) + len(b)) END, 6) AS f1, {_PLAIN('answer')} = {_PLAIN('quote')} AS exact FROM c""",
    "citation_scores": """WITH d AS (SELECT example_id, any_value(evidence) AS evidence FROM retrieval_dev WHERE example_id IS NOT NULL GROUP BY 1),
u AS (SELECT DISTINCT example_id, e.chunk_id AS c, e.quote AS q FROM (SELECT example_id, unnest(evidence) AS e FROM d)),
k AS (SELECT example_id, count(*) AS g, count(*) FILTER (WHERE c IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)) AS p FROM u GROUP BY 1)
SELECT example_id, CAST(round(coalesce(p, 0) / (coalesce(p, 0) + 1), 6) AS DOUBLE) AS precision, CASE WHEN coalesce(g, 0) > 0 THEN round(p / g, 6) ELSE 0.0 END AS recall
FROM d LEFT JOIN k USING (example_id)""",
    "processed_answers": f"WITH {_PROCESSED} SELECT record_id, answer, CAST(n_citations AS BIGINT) AS n_citations, abstained, abstention_reason, warnings FROM pr",
    "failure_classes": rf"""WITH {_PROCESSED},
f AS (SELECT *, trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t, len(list_filter(regexp_split_to_array(coalesce(raw, ''), '\s+'), lambda w: w <> '')) AS n FROM pr)
SELECT CASE WHEN warnings = '' THEN CASE WHEN abstained AND abstention_reason = 'insufficient evidence' THEN 'unexpected_abstention' ELSE 'none' END
  WHEN starts_with(t, '{{') AND len(string_split(t, '{{')) > len(string_split(t, '}}')) THEN CASE WHEN n >= {COMPLETION_WORDS} THEN 'generation_truncation' ELSE 'incomplete_json' END
  WHEN contains(warnings, 'invalid_json') THEN 'non_json_output' WHEN contains(warnings, 'malformed_output') THEN 'schema_violation' WHEN contains(warnings, 'invalid_citation') THEN 'incorrect_citation'
  WHEN contains(warnings, 'insufficient_evidence') THEN 'missing_citation' ELSE 'other_contract_failure' END AS failure, count(*) AS n_records FROM f GROUP BY 1""",
    "contract_outcomes": f"""WITH {_PROCESSED},
f AS (SELECT *, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'empty' WHEN starts_with(trim(raw), '```') THEN 'fenced' WHEN starts_with(trim(raw), '{{') THEN 'object' ELSE 'plain' END AS form FROM pr)
SELECT form, count(*) AS count, round(avg((answer IS NOT NULL)::INT), 6) AS task_accuracy_after_fail_closed, round(avg((warnings = '')::INT), 6) AS valid_grounded_output_rate, round(avg((warnings <> '')::INT), 6) AS format_failure_rate,
  round(avg(abstained::INT), 6) AS abstention_rate, round(avg((epoch_us(ingested_at) - epoch_us(created_at)) / 1000.0), 1) AS mean_latency_ms FROM f GROUP BY 1""",
    "sentence_quality": f"""WITH ch AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), s AS (SELECT unnest({_SENT}) AS s FROM ch)
SELECT coalesce({_REASON}, 'accepted') AS reason, count(*) AS n_sentences FROM s WHERE s <> '' GROUP BY 1""",
    "best_sentences": f"""WITH ch AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), s AS (SELECT chunk_id, unnest({_SENT}) AS s FROM ch),
g AS (SELECT chunk_id, s, len(list_filter(['engine', 'runway', 'pilot', 'weather', 'landing', 'inspection'], lambda t: contains(lower(s), t))) AS relevance FROM s WHERE {_REASON} IS NULL AND length(regexp_replace(s, '\\P{{L}}', '', 'g')) >= 0.65 * length(s))
SELECT chunk_id, s AS sentence, relevance FROM g WHERE relevance > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY relevance DESC, length(s) DESC, s DESC) = 1""",
    "token_budget": rf"WITH {_SF} SELECT record_id, CAST(coalesce(list_sum([len(list_filter(regexp_split_to_array(coalesce(m.content, ''), '\s+'), lambda w: w <> '')) + 4 for m in messages]), 0) AS BIGINT) AS n_tokens FROM sf",
    "chat_rendering": f"WITH {_SF} SELECT record_id, sha256(array_to_string([ '[' || upper(trim(coalesce(m.role, ''))) || ']' || chr(10) || coalesce(m.content, '') for m in messages], chr(10) || chr(10))) AS rendered_sha256 FROM sf",
    "public_manifest": "SELECT example_id, any_value(event_family_id) AS event_family_id, any_value(report_id) AS report_id, any_value(split) AS split FROM retrieval_test WHERE example_id IS NOT NULL GROUP BY 1",
    "family_token_sums": f"""SELECT source, lang, count(*) AS n_documents, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n) AS BIGINT) AS n_terms
FROM (SELECT coalesce({_tidy('source')}, '?') AS source, coalesce(lang, '?') AS lang, n_tokens, len({_tok('text')}) AS n FROM documents) GROUP BY ROLLUP (source, lang)""",
}
