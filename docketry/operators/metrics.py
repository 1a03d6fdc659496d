"""Deterministic scores of rankings, answers, generations and tasks, with slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normalized_answer

IDENTIFIER = r"(?<![A-Z0-9-])(?=[A-Z0-9-]*[A-Z])(?=[A-Z0-9-]*\d)[A-Z0-9-]{5,}(?![A-Z0-9-])"


def retrieval_scores(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: recall, reciprocal_rank, ndcg and n_gold. hits (query_id, chunk_id, rank), gold (query_id, chunk_id).

    Without gold all scores are null. The ideal gain is over min(gold, hits) ranks; without hits ndcg is null.
    """
    wanted = gold.select("query_id", "chunk_id").distinct()
    found = wanted.join(hits.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_gold"), F.count("rank").alias("n_found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain")
    )
    held = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    own = queries.select("query_id").distinct().join(found, "query_id", "left").join(held, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", "n_hits").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    scored = F.col("n_gold") > 0
    return own.select(
        "query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.when(scored, F.col("n_found") / F.col("n_gold")).alias("recall"),
        F.when(scored, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), F.when(scored & (F.col("n_hits") > 0), F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def sliced(scores: DataFrame, slices: dict[str, Column], values: list[str], several: dict[str, Column] | None = None) -> DataFrame:
    """Mean of values (nulls left out), examples and scored examples, overall and per value of each slice.

    A row is in one slice of each name, in the slice none where its value is null, and once in overall. several has
    arrays: a row is in a slice of each different value, in none where there is no value.
    """
    names = [F.lit("overall"), *[F.concat(F.lit(name + ":"), F.coalesce(c.cast("string"), F.lit("none"))) for name, c in slices.items()]]
    held = F.array(*names)
    for name, c in (several or {}).items():
        own = F.array_distinct(F.array_compact(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))))
        held = F.concat(held, F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("none"))), lambda v: F.concat(F.lit(name + ":"), v)))  # noqa: B023
    spread = scores.withColumn("slice", F.explode(held))
    return spread.groupBy("slice").agg(F.count("*").alias("examples"), F.count(values[0]).alias("scored"), *[F.avg(v).alias(v) for v in values])


def query_kind(c: Column | str) -> Column:
    """identifier where a question names one (capitals, digits and hyphens, five characters or more), else natural."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(IDENTIFIER), "identifier").otherwise("natural-language")


def half_even_percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share the value at 0-based place round-half-even((n - 1) x share) of the sorted values.

    For lengths and counts: values are counted first, the counts summed per thousand values, and only those sums are
    accumulated over all; within a thousand they run on by themselves. Null values are left out; no rows give nulls.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")).withColumn("_b", F.floor(F.col(value) / 1000))
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("_b").agg(F.sum("_c").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    upto = counts.join(bases, "_b").withColumn("_to", F.col("_s0") + F.sum("_c").over(Window.partitionBy("_b").orderBy(value)))
    return upto.agg(*[F.min(F.when(F.col("_to") > F.bround(F.lit((total - 1) * share)), F.col(value))).alias(name) for name, share in shares.items()])


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two multisets of words (arrays, see compatible_words); 1 if both are empty, 0 if one is."""
    both = F.array_distinct(F.array_intersect(a, b))
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(both, F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))
    score = 2.0 * common / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(score)


def exact_match(predicted: Column, expected: Column) -> Column:
    return normalized_answer(predicted) == normalized_answer(expected)


def citation_scores(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """(precision, recall) of sets of (chunk_id, quote): empty against empty is 1, empty against some 0."""
    p, g = F.array_distinct(F.coalesce(predicted, F.array())), F.array_distinct(F.coalesce(gold, F.array()))
    common = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) > 0, common / F.size(p)).otherwise(F.when(F.size(g) == 0, 1.0).otherwise(0.0))
    recall = F.when(F.size(g) > 0, common / F.size(g)).otherwise(F.when(F.size(p) == 0, 1.0).otherwise(0.0))
    return precision, recall


def numeric_match(answer: Column, target: Column, tolerance: Column | float = 0.0) -> Column:
    """Whether any number of answer, commas left out, is within tolerance of target; null answers don't match.

    A number is a run of digits and commas that starts with a digit, with a minus before it and a fraction after it if
    there are any; it doesn't begin within a word or another number.
    """
    within = r"[\w.]"
    numbers = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"(?<!{within})-?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.exists(numbers, lambda x: F.abs(F.translate(x, ",", "").cast("double") - target) <= tolerance)


def all_mentioned(answer: Column, facts: Column) -> Column:
    """Whether every fact, normalized, is part of the normalized answer; a blank answer mentions none."""
    said = normalized_answer(answer)
    return F.coalesce(F.length(said) > 0, F.lit(False)) & F.forall(facts, lambda f: F.contains(said, normalized_answer(f)))
