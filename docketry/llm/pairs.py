"""Defects of question and answer pairs: ordered rules over the last answer of a record's messages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources.tables import tidy

# Names of roles in circulation.
ASKS, ANSWERS = ("user", "human", "prompter", "question"), ("assistant", "bot", "gpt", "model", "ai", "answer")
# Frequent short words by language, for telling languages apart.
FUNCTION_WORDS = {
    "en": "the and of was were is are that this with from had has have what which who how did does been by for at on it its not when where about into after before during near said to in",
    "de": "der die das und ist war wurde mit von den dem des ein eine einen nicht auf bei nach für im zu sich als über um alle hatte ohne dass keine es am vor welche was ergab gab er sie in an",
    "fr": "le la les des du et est était avait une un à au aux dans pour par sur que qui de ne pas selon près avec été déjà l d n qu en sous il elle ce a",
    "es": "el la los las de del y en un una que por con para al no se según ya qué había sin fue tras cada lo su es a",
    "it": "il lo la gli le di del della e è era un una che per con non si nel alla dal sono in",
    "pt": "o os as de do da dos das e é um uma que por com para não se no na ao foi em",
    "nl": "de het een en van is was dat met voor niet op bij naar aan er zijn werd in te",
}
# Words after which no sentence ends, in the languages above.
OPEN_ENDINGS = (
    "the a an of and or to with for from by at in on because that which who whose than but as into between about under over while if when during near its their his her was were is are be been had has have "
    "der die das dem den des ein eine einer eines und oder mit von zu im am zum zur bei nach für weil dass als auf aus "
    "le la les du des un une et ou de à au aux avec pour par dans sur que qui dont sous selon "
    "el los las del una y o con para por en al que se según su"
)
# Forms of verbs that show a sentence where there are few words.
VERBS = r"\b(was|were|is|are|had|has|have|did|does|\w{2,}ed|found|held|lost|said|told|came|ran|struck|war|wurde|hatte|hat|lag|gab|est|était|avait|a|fue|había|es|está|quedó)\b"
# A refusal in its first sentence; each needs the speaker and the declining.
SPEAKERS = {
    "en": (r"\b(i|i['’](m|d|ll|ve)|me|my|this request|your request)\b", r"\b(cannot|can['’]?t|can not|won['’]t|will not|wouldn['’]t|unable|not able|not (be )?(permitted|allowed|appropriate|comfortable|authori[sz]ed)|declin\w*|refus\w*|rather not|prefer not|don['’]t feel comfortable|do not feel comfortable|outside what|against (my|our)|no comment|no answer|not willing|must pass|will pass)\b"),
    "de": (r"\b(ich|mir|mich|meine[nrm]?)\b", r"\b(kann|darf|möchte|werde|bin|muss|lehne)\b.*\b(nicht|keine?[nr]?|leider|ablehnen|ab)\b|tut mir leid|bedau[e]?re"),
    "fr": (r"\b(je|j['’]|me|mes|désolée?s?)", r"\bne (peux|puis|suis|souhaite|veux|serai)\b|\bn['’](ai|y)\b|désolée?s?|regrette|refuse|préfère ne"),
    "es": (r"\b(puedo|siento|lamento|prefiero|debo|estoy|mi|mis|me|disculp\w*)\b", r"\bno (puedo|me|estoy|debo|podré)\b|lo siento|lamento|disculp\w*|prefiero no|negarme|rechazar"),
}
# What may stand before a question that is said again.
LEAD_INS = r"^(question|you asked|the question (is|was)|your question|q|frage|sie fragten|pregunta|usted preguntó|vous avez demandé|la question)\b"

READ = T.StructType([T.StructField("state", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("quotes", T.ArrayType(T.StringType()))])
_FENCE = re.compile(r"^```[\w-]*[ \t]*\r?\n?(.*?)\s*(```)?$", re.S)
_UNSEEN = re.compile("[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]")


def _read(content: str | None) -> tuple[str, str | None, list[str]]:
    """(state, answer, quotes): state is none, blank, abstained, object, cut (an object that stops) or plain."""
    if content is None:
        return "none", None, []
    text = _UNSEEN.sub("", content).strip()
    fence = _FENCE.match(text)
    body = fence[1].strip() if fence else text
    if not re.search(r"\w", body):
        return "object" if body == "{}" else "blank", None, []
    if body[0] not in "{[":
        return "plain", body, []
    try:
        value = json.loads(body, strict=False)
    except (ValueError, RecursionError):
        text = re.sub(r'"(\\.|[^"\\])*"', "", body)  # what is left outside of closed strings
        if text.count("{") + text.count("[") > text.count("}") + text.count("]") or '"' in text:
            return "cut", body, []
        return "plain", body, []
    if not isinstance(value, dict):
        return "plain", body, []
    if value.get("abstained") is True:
        return "abstained", None, []
    cited = value.get("citations")
    quotes = [str(c["quote"]) for c in cited if isinstance(c, dict) and c.get("quote")] if isinstance(cited, list) else []
    answer = value.get("answer")
    return "object", None if answer is None else answer if isinstance(answer, str) else json.dumps(answer), quotes


@F.pandas_udf(READ)
def _reading(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x) for x in content], columns=["state", "answer", "quotes"])


def _first(messages: Column, roles: tuple[str, ...], last: bool = False) -> Column:
    own = F.filter(F.coalesce(messages, F.array()), lambda m: m.isNotNull() & tidy(m["role"]).isin(*roles))
    content = F.transform(own, lambda m: m["content"])
    return F.try_element_at(content, F.lit(-1 if last else 1))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _language(words: Column) -> Column:
    """STRUCT<best, name, second>: how many words speak for the likeliest language, and for the next one."""
    def speaking(text: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*text.split())))

    counts = [F.struct(speaking(text).alias("n"), F.lit(name).alias("name")) for name, text in FUNCTION_WORDS.items()]
    return F.sort_array(F.array(*counts), asc=False)


def _share(text: Column, script: str) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.length(F.regexp_replace(text, rf"[^\p{{{script}}}]", "")) / F.greatest(letters, F.lit(1))


def pair_defects(records: DataFrame, key: str = "record_id", messages: str = "messages") -> DataFrame:
    """(key, defects ARRAY<STRING>): every defect that the pair of a record triggers, in the order of the rules.

    The question is the first message of an asking role up to the first chunk of context, the answer the last message of
    an answering role; roles are compared without blanks and case. Keys are taken to be unique; records without defect
    have an empty array. Null or empty messages are empty. Rules in order: empty (nothing readable and no declared
    abstention); cut objects (unclosed delimiters) as truncated; refusal; copied_question (the question, once or more, and
    nothing besides a lead-in); truncated (an abrupt end: no final mark after six words or a sentence of five, a word that leads on, an
    open bracket or quote, an ellipsis, a last word that is the beginning of a longer one in the cited quote);
    other_language (another script or, by function words, another language than the question's). An object that declares
    abstention triggers none.
    """
    own = records.select(key, _first(F.col(messages), ASKS).alias("asked"), _first(F.col(messages), ANSWERS, True).alias("content"))
    own = own.withColumn("read", _reading("content")).select(key, "asked", "read.*")
    own = own.withColumn("question", F.trim(F.regexp_extract("asked", r"(?s)^(.*?)(?:<chunk\b|\n\s*\n|$)", 1)))
    own = own.withColumn("answer", F.regexp_replace("answer", r"(?U)^\s+|\s+$", ""))
    own = own.withColumn("qw", _words(F.col("question"))).withColumn("aw", _words(F.col("answer")))
    own = own.withColumn("ql", _language(F.col("qw"))).withColumn("al", _language(F.col("aw")))

    has = F.size("aw") > 0
    empty = (F.col("state") != "abstained") & (F.col("state") != "cut") & ~has
    cut = F.col("state") == "cut"
    said = F.col("state").isin("object", "plain") & has

    unquoted = F.regexp_replace("answer", "[\"“„«][^\"”“»]*([\"”“»]|$)", " ")
    opening = F.lower(F.regexp_extract(unquoted, r"(?s)^(.*?[.!?](?:\s|$)|.*$)", 1))
    refusal = F.lit(False)
    for who, declines in SPEAKERS.values():
        refusal = refusal | (opening.rlike(who) & opening.rlike(declines))
    refusal = refusal | opening.rlike(r"^\W*(as an? (ai|assistant|language model|ai assistant|model)\b.*\bnot\b|no comment\b.*\bby me\b|.*\bwhat i am allowed to talk about)")

    q, a = F.array_join("qw", " "), F.array_join("aw", " ")
    body = F.regexp_replace(a, LEAD_INS, "")
    copied = (F.size("qw") > 0) & F.contains(a, q) & (F.trim(F.replace(body, q, F.lit(""))) == "")

    end = F.regexp_replace("answer", r"(?U)[\s\"“”»«'’*_`)\]]+$", "")
    last = F.element_at(F.concat(F.array(F.lit("")), F.col("aw")), -1)
    quoted = F.flatten(F.transform("quotes", _words))
    half = F.exists(quoted, lambda w: F.startswith(w, last) & (w != last)) & ~F.array_contains(quoted, last) & (F.length(last) > 0) & ~last.rlike(r"^\d+$")
    closed = end.rlike(r"[.!?。！？]$") & ~end.rlike(r"\.\.\.$|…$")
    opened = F.length(F.regexp_replace("answer", r"[^(]", "")) > F.length(F.regexp_replace("answer", r"[^)]", ""))
    opened = opened | (F.length(F.regexp_replace("answer", '[^"]', "")) % 2 == 1) | F.rtrim("answer").rlike(r"[,;:(\-–—]$|…$|\.\.\.$")
    leads_on = last.isin(*OPEN_ENDINGS.split()) & ~F.col("answer").rlike(r"\p{N}")
    tokens = F.size(F.split(F.trim("answer"), r"(?U)\s+"))
    sentence = (tokens >= 6) | ((tokens == 5) & F.lower("answer").rlike(VERBS))
    abrupt = opened | (~closed & (sentence | half | leads_on | last.isin(*OPEN_ENDINGS.split())))

    best, own_language = F.col("al")[0], F.col("ql")[0]
    in_own = F.element_at(F.transform(F.filter("al", lambda x: x["name"] == own_language["name"]), lambda x: x["n"]), 1)
    language = (own_language["n"] > 0) & (best["name"] != own_language["name"]) & (best["n"] >= 2) & (best["n"] >= 2 * in_own + 1)
    scripts = F.lit(False)
    for script in ("IsLatin", "IsCyrillic", "IsGreek", "IsArabic", "IsHan", "IsHebrew"):
        scripts = scripts | ((_share(F.col("question"), script) > 0.7) & (_share(F.col("answer"), script) < 0.3) & (F.size("aw") > 1) & F.col("answer").rlike(r"\p{L}{2}"))

    rules = [(empty, "empty"), (cut, "truncated"), (said & refusal, "refusal"), (said & copied, "copied_question"), (said & abrupt, "truncated"), (said & (language | scripts), "other_language")]
    return own.select(key, F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]))).alias("defects"))
