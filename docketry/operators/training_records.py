"""Supervised records: sentence quality, rendering, token budgets, rounds over families, neighbouring contexts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import answer_digest, sentences
from docketry.operators.ranking import running, seeded_key
from docketry.session import cut_lineage

# Reasons to leave a sentence out, in the order in which they are tried, with the patterns of each. Lists of
# an author's own wording (titles of agencies, openings, words seen to be merged or split) aren't among them.
GATE = {
    "length_or_termination": (r"^.{0,79}$", r"^.{321,}$", r"[^.!?]$"),
    "sentence_fragment": (r"^[^\p{Lu}\p{Nd}]",),
    "footnote_fragment": (r"^\d+\s+[A-Z]", r"\b\d+\s+(?:A|An|The)\s+[a-z]"),
    "list_or_page_fragment": (r"•", r"\b\d\s+\d\b"),
    "document_boilerplate": (r"(?i)^(?:exemplar|figure|table) ",),
    "reference_or_heading": (r"^[A-Z]-\d",),
    "section_cross_reference": (r"(?i)\bsection\s+\d",),
    "transcript_fragment": (r"^\d{1,2}:\d{2}:\d{2}\b",),
    "fused_sentences": (r"[.!?][”\"]?\s+(?:A|According|An|As|At|He|In|It|On|She|That|The|They|This|We)\s",),
    "isolated_operational_instruction": (r"(?i)^(?:If .+?,\s+)?(?:continue|do|ensure|maintain)\b",),
    "heading_or_url": (r"(?i)http", r"\b\d+(?:\.\d+){1,3}\s+[A-Z][A-Za-z]"),
    "split_word": (r"\b[b-z]\s+[a-z]{2,}\b", r"(?i)\ba\s+re\b"),
    "broken_punctuation": (r"\s+[.,;)]", r"[,.)][A-Za-z]"),
    "merged_word": (),
    "unbalanced_quote": (r"^[^\"]*\"(?:[^\"]*\"[^\"]*\")*[^\"]*$",),
    "ocr_fragment": (
        r"\b[A-Za-z0-9]{2,}\s+-\s*[A-Za-z0-9]", r"\b[A-Za-z0-9]{2,}-\s+[A-Za-z0-9]", r"\b[a-z]{2,}[A-Z]{2,}\b", r"\d{2,}[a-z]{3,}\b", r"\b[A-Z][A-Za-z]{3,}\d{4}\b",
        r"\b[A-Z]\s+[A-Z][A-Za-z]?\b", r"\b(?:[A-Z]-){2,}\s*[A-Z]\b",
    ),
}
#: Letters among the characters of a best sentence, at least.
LETTER_SHARE = 0.65


def gate_reason(c: Column, wording: dict[str, Sequence[str]] | None = None) -> Column:
    """The first reason of GATE that holds for a sentence, null for a good one; null sentences have the wrong length.

    wording adds to a reason phrases of a corpus that are enough for it wherever they stand, whatever their case.
    """
    marks = lambda m: F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))
    out = F.when(c.isNull(), "length_or_termination")
    for reason, patterns in GATE.items():
        holds = F.lit(False)
        for p in patterns:
            holds = holds | c.rlike("(?sU)" + p)  # (?U): classes are Unicode
        for phrase in (wording or {}).get(reason, ()):
            holds = holds | F.contains(F.lower(c), F.lit(phrase.lower()))
        out = out.when(holds | (marks("“") != marks("”")) if reason == "unbalanced_quote" else holds, reason)
    return out


def quality_report(rows: DataFrame, text: str) -> DataFrame:
    """(reason, sentences) over the sentences of all rows; accepted where there is no reason."""
    own = rows.select(F.explode(sentences(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))).alias("s")).where("s != ''")
    return own.groupBy(F.coalesce(gate_reason(F.col("s")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_sentences"))


def best_sentence(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, sentence, relevance): per row the good sentence of enough letters with most terms, then the longest, then the last by text."""
    own = rows.select(key, F.explode(sentences(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))).alias("sentence"))
    relevance = F.lit(0)
    for t in terms:
        relevance = relevance + F.contains(F.lower("sentence"), F.lit(t)).cast("int")
    letters = F.length(F.regexp_replace("sentence", r"\P{L}", "")) >= LETTER_SHARE * F.length("sentence")
    good = own.where(gate_reason(F.col("sentence")).isNull() & letters).withColumn("relevance", relevance).where("relevance > 0")
    best = good.groupBy(key).agg(F.max(F.struct("relevance", F.length("sentence").alias("n"), "sentence")).alias("b"))
    return best.select(key, "b.sentence", "b.relevance")


def token_estimate(messages: Column) -> Column:
    """Words by white space plus 4 for each message; null contents count as empty."""
    words = lambda m: F.size(F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"\s+"), lambda w: w != ""))
    return F.aggregate(F.coalesce(messages, F.array()), F.lit(0), lambda s, m: s + words(m) + 4)


def rendered_chat(messages: Column) -> Column:
    """[ROLE] and content of each message on lines of their own, messages a blank line apart."""
    role = lambda m: F.upper(F.trim(F.coalesce(m["role"], F.lit(""))))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), role(m), F.lit("]\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")


def round_robin(candidates: DataFrame, family: str, key: str, answer: str, target: int, most_per_family: int, exact: bool = False) -> DataFrame:
    """(family, key, round): answers dealt in rounds over the sorted families, none twice. With exact, fewer than target
    raise.

    In a round each family gives its next candidate by key whose normalized answer hasn't been dealt yet, at most
    most_per_family in all; target ends the last round. Each choice depends on all before it, so it is made in one task,
    over those candidates that can be dealt at all: at most target answers are dealt, so a family gives only of its first
    target different answers and an answer is given only by its first target families (in the first round each of these
    gives something, or the answer has been dealt); and a family that is the first with some answer gives in the first
    round, so no family comes after the target-th of these. The task is bounded by target, not by the candidates.
    """
    own = candidates.where(F.col(answer).isNotNull() & F.col(family).isNotNull()).withColumn("_d", answer_digest(F.col(answer)))
    once = own.groupBy(family, "_d").agg(F.min(key).alias(key))
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(key, "_d"))).where(F.col("_n") <= target).drop("_n")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy(family))).where(F.col("_n") <= target)
    last = first.where("_n = 1").select(family).distinct().orderBy(family).limit(target).agg(F.max(family).alias("_last"))
    kept = first.crossJoin(F.broadcast(last)).where(F.col(family) <= F.col("_last")).select(family, key, "_d")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        waiting = {name: iter(part[[key, "_d"]].itertuples(index=False, name=None)) for name, part in rows.sort_values([family, key, "_d"]).groupby(family)}
        dealt: set[str] = set()
        out = []
        for number in range(1, most_per_family + 1):
            for name in list(waiting):
                if len(out) == target:
                    break
                taken = next(((k, d) for k, d in waiting[name] if d not in dealt), None)
                if taken is None:
                    del waiting[name]
                    continue
                dealt.add(taken[1])
                out.append((name, taken[0], number))
        return pd.DataFrame(out, columns=[family, key, "round"])

    dealt = kept.groupBy().applyInPandas(deal, f"`{family}` {kinds[family]}, `{key}` {kinds[key]}, round int")
    if exact:
        dealt = cut_lineage(dealt)
        if (found := dealt.count()) < target:
            raise ValueError(f"{found} answers for a target of {target}")
    return dealt.orderBy("round", family)


def record_id(event: Column, chunk: Column, sentence: Column) -> Column:
    """Identity of a supervised record: 16 hexadecimal digits of the SHA-256 of its event, chunk and sentence."""
    return F.substring(F.sha2(F.concat_ws("\0", event, chunk, sentence), 256), 1, 16)


def grounded_record(prefix: str, event: Column, question: Column, chunk: Column, text: Column, sentence: Column, system: str) -> Column:
    """STRUCT<record_id, messages>: a question on the text of a chunk, answered by a sentence that cites itself."""
    evidence = F.concat(question, F.lit('\n\n<chunk id="'), chunk, F.lit('">\n'), text, F.lit("\n</chunk>"))
    cited = F.array(F.struct(chunk.alias("chunk_id"), sentence.alias("quote")))
    answer = F.to_json(F.struct(sentence.alias("answer"), cited.alias("citations"), F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("abstention_reason")), {"ignoreNullFields": "false"})
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(F.concat(F.lit(prefix), record_id(event, chunk, sentence)).alias("record_id"), F.array(said("system", F.lit(system)), said("user", evidence), said("assistant", answer)).alias("messages"))


def neighbours(records: DataFrame, key: str, offsets: tuple[int, ...] = (1, 2), seed: int = 0) -> DataFrame:
    """(key, neighbour, step): for each record those that come 1, 2, ... after it, around the end, in a seeded order.

    Places in the order are exact ranks from slices; the join is on the place, so each record meets as many rows as there
    are offsets.
    """
    placed = running(records.select(key).withColumn("_k", seeded_key(seed, key)), [], "_k", key).select(key, (F.col("rank") - 1).alias("at"))
    n = records.count()
    asked = placed.withColumn("step", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("to", (F.col("at") + F.col("step")) % max(n, 1))
    other = placed.select(F.col(key).alias("neighbour"), F.col("at").alias("to"))
    return asked.join(other, "to").where(F.col(key) != F.col("neighbour")).select(key, "neighbour", "step")
