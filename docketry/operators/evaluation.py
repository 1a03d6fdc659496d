"""Scores of answers and generations against reviewed examples, one row per example, and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import compatible_words, normalized_answer
from docketry.operators.metrics import all_mentioned, citation_scores, exact_match, numeric_match, token_f1

SPANS = "array<struct<chunk_id:string,quote:string>>"
# Words for small numbers, months, and phrases by which a generated text declines.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
REFUSALS = ("do not know", "does not specify", "not specified", "insufficient")


def key_differences(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, problem) where given doesn't have each expected key exactly once: missing, extra or repeated.

    Both sides are counted per key before the full outer join, so a key given very often meets it as one row. A repeated
    key that isn't expected is extra. Null keys count on neither side.
    """
    a = expected.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_a", F.lit(True))
    b = given.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def answer_scores(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of one prediction per example.

    examples: example_id, answerable, reference_answer, evidence ARRAY<STRUCT<chunk_id, quote>>. predictions: example_id,
    answer, citations (as evidence), abstained, chunks MAP<chunk_id, text>, what the prediction was given to read.
    Null arrays and maps count as empty, a null answerable or abstained as false. Examples without a prediction drop out
    (see key_differences). Columns: example_id, answer_correct, citation_precision, citation_recall, span_validity,
    abstention_correct, predicted_abstention, expected_abstention, failures (sorted).
    """
    said = predictions.select("example_id", "answer", F.coalesce("citations", F.array().cast(SPANS)).alias("cited"), F.coalesce("abstained", F.lit(False)).alias("predicted_abstention"), "chunks")
    due = examples.select("example_id", (~F.coalesce("answerable", F.lit(False))).alias("expected_abstention"), "reference_answer", F.coalesce("evidence", F.array().cast(SPANS)).alias("gold"))
    both = due.join(said, "example_id")
    same = F.coalesce((F.length("answer") > 0) & (F.length("reference_answer") > 0) & exact_match(F.col("answer"), F.col("reference_answer")), F.lit(False))
    precision, recall = citation_scores(F.col("cited"), F.col("gold"))
    held = lambda c: F.coalesce(F.contains(F.try_element_at("chunks", c["chunk_id"]), c["quote"]), F.lit(False))
    validity = F.when(F.size("cited") == 0, 1.0).otherwise(F.size(F.filter("cited", held)) / F.size("cited"))
    out = both.withColumn("answer_correct", F.when(F.col("predicted_abstention"), F.col("expected_abstention")).otherwise(same))
    out = out.withColumn("citation_precision", precision).withColumn("citation_recall", recall).withColumn("span_validity", validity)
    given, wanted, cites = ~F.col("predicted_abstention"), ~F.col("expected_abstention"), F.size("cited") > 0
    labels = {
        "answer_mismatch": given & wanted & ~F.col("answer_correct"),
        "incorrect_citation": cites & (F.col("citation_precision") < 1),
        "invalid_citation_span": F.col("span_validity") < 1,
        "missed_abstention": given & ~wanted,
        "missing_citation": given & ~cites,
        "missing_gold_citation": (F.size("gold") > 0) & (F.col("citation_recall") < 1),
        "unexpected_abstention": ~given & wanted,
    }
    failures = F.array_compact(F.array(*[F.when(rule, name) for name, rule in labels.items()]))
    return out.select(
        "example_id", "answer_correct", "citation_precision", "citation_recall", "span_validity",
        (F.col("predicted_abstention") == F.col("expected_abstention")).alias("abstention_correct"), "predicted_abstention", "expected_abstention", failures.alias("failures"),
    )


def _share(part: Column, whole: Column) -> Column:
    """Share of the rows of whole that are in part; 1 where whole has none."""
    n = F.count_if(whole)
    return F.when(n == 0, 1.0).otherwise(F.count_if(part & whole) / n)


def answer_summary(scores: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Means of answer_scores (with the columns that slices need), overall and per value of each slice.

    Abstention precision is over predicted, recall over expected abstentions; without any it is 1.
    """
    names = [F.lit("overall"), *[F.concat(F.lit(name + ":"), F.coalesce(c.cast("string"), F.lit("none"))) for name, c in slices.items()]]
    predicted, expected = F.col("predicted_abstention"), F.col("expected_abstention")
    mean = lambda c: F.avg(F.col(c).cast("double")).alias({"answer_correct": "answer_accuracy", "abstention_correct": "abstention_accuracy"}.get(c, c))
    values = [mean(c) for c in ("answer_correct", "citation_precision", "citation_recall", "span_validity", "abstention_correct")]
    spread = scores.withColumn("slice", F.explode(F.array(*names)))
    return spread.groupBy("slice").agg(F.count("*").alias("n"), *values, _share(expected, predicted).alias("abstention_precision"), _share(predicted, expected).alias("abstention_recall"))


def generation_scores(generations: DataFrame, examples: DataFrame) -> DataFrame:
    """Scores of generated texts (example_id, variant, text, retrieved_chunk_ids, context_chunk_ids, and prompt_tokens,
    completion_tokens, latency_ms if there are any) on examples.

    exact_match and token_f1 are null without a reference answer; gold_coverage is null but for the variant rag with
    evidence. Citations are numbers in brackets, valid from 1 to the size of the context: citation_precision is 0 where
    there is a context and no citation, null where there is neither; citation_recall says whether any is valid, null
    without a context; both are null for questions without an answer, which have refusal_correct instead.
    """
    extra = {c: F.col(c) if c in generations.columns else F.lit(None).cast("double") for c in ("prompt_tokens", "completion_tokens", "latency_ms")}
    given = generations.select("example_id", "variant", "text", "retrieved_chunk_ids", "context_chunk_ids", *[v.alias(c) for c, v in extra.items()])
    due = examples.select("example_id", "answerable", "reference_answer", "evidence")
    # Words are taken after the join: they are found in Arrow batches, after which rows of a key aren't known to be together.
    own = given.join(due, "example_id").withColumn("_said", compatible_words("text")).withColumn("_due", compatible_words("reference_answer"))
    text, size = F.coalesce("text", F.lit("")), F.size(F.coalesce("context_chunk_ids", F.array().cast("array<string>")))
    gold = F.array_distinct(F.coalesce(F.col("evidence")["chunk_id"], F.array().cast("array<string>")))
    cited = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    valid = F.size(F.filter(cited, lambda x: (x >= 1) & (x <= size)))
    answerable, referenced = F.coalesce("answerable", F.lit(False)), F.col("reference_answer").isNotNull()
    plain = F.array_join("_said", " ")
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | plain.contains(phrase)
    found = F.size(F.array_intersect(gold, F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>"))))
    return own.select(
        "example_id", "variant",
        F.when(referenced, (F.col("_said") == F.col("_due")).cast("double")).alias("exact_match"),
        F.when(referenced, token_f1(F.col("_said"), F.col("_due"))).alias("token_f1"),
        F.when((F.size(gold) > 0) & (F.col("variant") == "rag"), found / F.size(gold)).alias("gold_coverage"),
        F.when(answerable & (F.size(cited) > 0), valid / F.size(cited)).when(answerable & (size > 0), 0.0).alias("citation_precision"),
        F.when(answerable & (size > 0), (valid > 0).cast("double")).alias("citation_recall"),
        F.when(~answerable, refused.cast("double")).alias("refusal_correct"), *extra,
    )


def generation_summary(scores: DataFrame) -> DataFrame:
    """Examples, means (nulls left out) of scores and latency, and sums of tokens, per variant."""
    values = ("exact_match", "token_f1", "gold_coverage", "citation_precision", "citation_recall", "refusal_correct")
    return scores.groupBy("variant").agg(F.count("*").alias("examples"), *[F.avg(c).alias(c) for c in values], F.avg("latency_ms").alias("mean_latency_ms"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def number_mentioned(answer: Column, target: Column, tolerance: Column) -> Column:
    """Whether a number of answer, in digits or as a word up to ten, is within tolerance of target."""
    words = F.split(normalized_answer(F.coalesce(answer, F.lit(""))), " ")
    spelled = F.transform(words, lambda w: F.array_position(F.array(*[F.lit(x) for x in NUMBER_WORDS]), w) - 1)
    return numeric_match(answer, target, tolerance) | F.exists(spelled, lambda n: (n >= 0) & (F.abs(n - target) <= tolerance))


def time_mentioned(answer: Column, day: Column, clock: Column) -> Column:
    """Whether answer gives a DATE (2015-11-10 or november 10 2015) and a time of day HH:MM (as 1453, or 903 for 09:03).

    The answer is compared without punctuation, so a time with a colon is found by its digits.
    """
    said = normalized_answer(answer)
    months = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    written = F.concat_ws(" ", months, F.day(day).cast("string"), F.year(day).cast("string"))
    digits = F.replace(clock, F.lit(":"), F.lit(""))
    short = F.regexp_replace(digits, r"^0(?=\d{3})", "")
    return (said.contains(F.date_format(day, "yyyyMMdd")) | said.contains(written)) & (said.contains(digits) | said.contains(short))


def task_correct(strategy: Column, answer: Column, target: Column, facts: Column) -> Column:
    """Whether answer satisfies the target of its task; which columns count depends on the strategy.

    target is STRUCT<value DOUBLE, tolerance DOUBLE, day DATE, clock STRING, required ARRAY<STRING>, label STRING>.
    A blank or null answer is right for abstention_v1 and wrong for all others. An unknown strategy or a target without
    the fields of its strategy gives null, so that a faulty annotation shows (see task_problems) and doesn't count.
    """
    blank = F.coalesce(F.trim(F.regexp_replace(answer, r"(?U)\s+", " ")) == "", F.lit(True))
    rules = {
        "numeric_exact_or_tolerance_v1": number_mentioned(answer, target["value"], target["tolerance"]),
        "normalized_datetime_v1": time_mentioned(answer, target["day"], target["clock"]),
        "normalized_entity_set_v1": all_mentioned(answer, target["required"]),
        "categorical_exact_v1": exact_match(answer, target["label"]),
        "required_key_facts_v1": all_mentioned(answer, facts),
    }
    out = F.when(task_problem(strategy, target, facts).isNotNull(), F.lit(None).cast("boolean")).when(strategy == "abstention_v1", blank).when(blank, False)
    for name, rule in rules.items():
        out = out.when(strategy == name, rule)
    return out


def task_problem(strategy: Column, target: Column, facts: Column) -> Column:
    """Why a task can't be scored: unknown_strategy, or incomplete_target; null if it can."""
    filled = lambda xs: F.coalesce((F.size(xs) > 0) & F.forall(xs, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))
    whole = {
        "numeric_exact_or_tolerance_v1": target["value"].isNotNull() & F.coalesce(target["tolerance"] >= 0, F.lit(False)),
        "normalized_datetime_v1": target["day"].isNotNull() & F.coalesce(target["clock"].rlike(r"^\d{2}:\d{2}$"), F.lit(False)),
        "normalized_entity_set_v1": filled(target["required"]),
        "categorical_exact_v1": F.coalesce(F.trim(target["label"]) != "", F.lit(False)),
        "required_key_facts_v1": filled(facts),
        "abstention_v1": F.lit(True),
    }
    known = F.coalesce(strategy.isin(*whole), F.lit(False))
    out = F.when(~known, "unknown_strategy")
    for name, rule in whole.items():
        out = out.when((strategy == name) & ~rule, "incomplete_target")
    return out


def task_summary(scores: DataFrame, task: str, correct: str) -> DataFrame:
    """(task, n, accuracy) per task and overall (null), from one rollup; tasks that can't be scored are left out."""
    own = scores.where(F.col(correct).isNotNull()).select(F.coalesce(task, F.lit("none")).alias(task), F.col(correct).cast("double").alias("_c"))
    return own.rollup(task).agg(F.count("*").alias("n"), F.avg("_c").alias("accuracy"))


def quote_spans(citations: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("example_id", "chunk_id", "quote")) -> DataFrame:
    """citations (keys with chunk_id and quote) with span, the words of the chunk that are the quote but for white space.

    The first such place counts. span is null where the chunk is unknown, the quote blank or nowhere in its text. The
    pattern of a quote has its characters literally with optional white space between, so a place is found in one pass.
    """
    letters = F.regexp_extract_all(F.regexp_replace("quote", r"(?U)\s+", ""), F.lit(r"(?s)."), F.lit(0))
    pattern = F.concat(F.lit("(?U)"), F.array_join(F.transform(letters, lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), r"\s*"))
    own = citations.select(*keys).distinct().join(chunks.select("chunk_id", "text"), "chunk_id", "left").withColumn("_p", F.when(F.size(letters) > 0, pattern))
    return own.withColumn("span", F.regexp_substr("text", F.col("_p"))).select(*keys, "span")


def evidence_prompt(question: Column, evidence: Column) -> Column:
    """A question with its evidence as chunks: quotes of a chunk on lines of their own, chunks in the order of their first
    quote; a question without evidence says so."""
    ids = F.array_distinct(F.transform(evidence, lambda e: e["chunk_id"]))
    quotes = lambda i: F.array_join(F.transform(F.filter(evidence, lambda e: e["chunk_id"].eqNullSafe(i)), lambda e: F.coalesce(e["quote"], F.lit(""))), "\n")
    blocks = F.transform(ids, lambda i: F.concat(F.lit('<chunk id="'), F.coalesce(i, F.lit("")), F.lit('">\n'), quotes(i), F.lit("\n</chunk>")))
    return F.concat_ws("\n\n", question, F.when(F.size(evidence) > 0, F.array_join(blocks, "\n\n")).otherwise("<no_evidence />"))
