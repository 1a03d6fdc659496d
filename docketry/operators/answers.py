"""Model output taken only as far as it holds: strict JSON, citations word for word, else an abstention with a warning."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the contract: fields of an answer and of a citation, the longest output, what an abstention says.
FIELDS = {"answer", "citations", "abstained", "abstention_reason"}
CITED = {"chunk_id", "quote"}
LONGEST = 16_384
UNSUPPORTED = "insufficient evidence"

CITATION = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("quote", T.StringType())])
PROCESSED = T.StructType([T.StructField("answer", T.StringType()), T.StructField("citations", T.ArrayType(CITATION)), T.StructField("abstained", T.BooleanType()), T.StructField("abstention_reason", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])


class _Malformed(Exception):
    pass


def plain_space(text: str) -> str:
    """NFC, line feeds only, single blanks within lines, nothing at the ends."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(" ".join(x.split()) for x in text.split("\n")).strip()


def _row(answer: str | None, citations: list, reason: str | None, warnings: Iterable[str]) -> dict:
    return {"answer": answer, "citations": citations, "abstained": answer is None, "abstention_reason": reason, "warnings": list(dict.fromkeys(warnings))}


def _unfenced(text: str) -> str:
    if len(text) < 6 or not (text.startswith("```") and text.endswith("```")):
        return text
    inside = text[3:-3]
    return (inside[4:] if inside[:4].lower() == "json" else inside).strip()


def _typed(value: object, kind: type, none: bool = False) -> object:
    if not (isinstance(value, kind) or (none and value is None)):
        raise _Malformed
    return value


def _kept(cited: list, evidence: dict[str, str], warnings: list[str]) -> list[dict]:
    """The citations that stand in the evidence, each once; the others are warned of."""
    kept: dict[tuple[str, str], None] = {}
    for c in cited:
        if not isinstance(c, dict) or set(c) != CITED:
            raise _Malformed
        chunk, quote = (plain_space(_typed(c[k], str)) for k in ("chunk_id", "quote"))
        if chunk and quote and quote in evidence.get(chunk, ""):
            kept[chunk, quote] = None
        else:
            warnings.append("invalid_citation")
    return [{"chunk_id": chunk, "quote": quote} for chunk, quote in kept]


def processed(raw: str | None, evidence: dict[str, str], longest: int = LONGEST) -> dict:
    """The answer that raw gives on evidence (chunk_id to text), or an abstention with a warning that says why not.

    Null raw counts as empty. An abstention of the output itself has no answer and no citations, keeps its reason and
    has no warning; every other one has the reason UNSUPPORTED.
    """
    if not (raw or "").strip():
        return _row(None, [], UNSUPPORTED, ["empty_output"])
    if len(raw) > longest:
        return _row(None, [], UNSUPPORTED, ["output_too_long"])
    try:
        value = json.loads(_unfenced(plain_space(raw)))
    except (ValueError, RecursionError):
        return _row(None, [], UNSUPPORTED, ["invalid_json"])
    warnings: list[str] = []
    try:
        if not isinstance(value, dict) or set(value) != FIELDS:
            raise _Malformed
        abstained, answer, reason = _typed(value["abstained"], bool), _typed(value["answer"], str, True), _typed(value["abstention_reason"], str, True)
        cited = _typed(value["citations"], list)
        if abstained:
            if answer is not None or cited:
                raise _Malformed
            return _row(None, [], plain_space(reason or "") or UNSUPPORTED, [])
        kept = _kept(cited, {k: plain_space(v or "") for k, v in evidence.items()}, warnings)
    except _Malformed:
        return _row(None, [], UNSUPPORTED, ["malformed_output"])
    answer = plain_space(answer or "")
    if not answer or not kept:
        return _row(None, [], UNSUPPORTED, [*warnings, "insufficient_evidence"])
    return _row(answer, kept, None, warnings)


def postprocess(raw: Column, chunk_ids: Column, texts: Column) -> Column:
    """STRUCT<answer, citations, abstained, abstention_reason, warnings> of raw output on the evidence of two arrays.

    Evidence that names a chunk twice, or arrays of different length, can't ground anything: the row abstains with the
    warning duplicate_evidence.
    """

    @F.pandas_udf(PROCESSED)
    def run(raw: pd.Series, ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for r, i, t in zip(raw, ids, texts, strict=True):
            i, t = ([] if x is None else list(x) for x in (i, t))
            sound = len(i) == len(t) == len(set(i))
            out.append(processed(r, dict(zip(i, t, strict=True))) if sound else _row(None, [], UNSUPPORTED, ["duplicate_evidence"]))
        return pd.DataFrame(out, columns=[f.name for f in PROCESSED])

    return run(raw, chunk_ids, texts)


def failure_class(raw: Column, warnings: Column, abstained: Column, correct: Column, completion_tokens: Column, most_tokens: Column) -> Column:
    """The primary failure of a processed output, null for none.

    Output without warnings fails only by an abstention where one wasn't right. Else an object that isn't closed was cut
    off (generation_truncation if all tokens were used, incomplete_json if not), and what is left goes by its warnings.
    """
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", ""))
    count = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    warned = lambda w: F.array_contains(warnings, w)
    unclosed = F.startswith(text, F.lit("{")) & (count("{") > count("}"))
    used_up = F.coalesce(completion_tokens, F.lit(0)) >= most_tokens
    return (
        F.when(F.coalesce(F.size(warnings), F.lit(0)) <= 0, F.when(F.coalesce(abstained, F.lit(False)) & ~F.coalesce(correct, F.lit(False)), "unexpected_abstention"))
        .when(unclosed & used_up, "generation_truncation").when(unclosed, "incomplete_json").when(warned("invalid_json"), "non_json_output")
        .when(warned("malformed_output"), "schema_violation").when(warned("invalid_citation"), "incorrect_citation")
        .when(warned("insufficient_evidence"), "missing_citation").otherwise("other_contract_failure")
    )


def contract_summary(rows: DataFrame, by: str) -> DataFrame:
    """Per value of by: count and the shares of correct, valid_grounded_output, format failures (any warning) and
    abstentions, and the mean latency; nulls of correct and abstained count as false, null latencies are left out.

    rows: by, correct, answer, warnings, abstained, latency_ms. Output is valid and grounded if it has no warning.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    warned = F.coalesce(F.size("warnings"), F.lit(0)) > 0
    return rows.groupBy(by).agg(
        F.count("*").alias("count"), share(F.col("correct")).alias("task_accuracy_after_fail_closed"), share(~warned).alias("valid_grounded_output_rate"),
        share(warned).alias("format_failure_rate"), share(F.col("abstained")).alias("abstention_rate"), F.avg("latency_ms").alias("mean_latency_ms"),
    )
