"""Text as it is compared: folding, tokens, normalized answers, sentences, digests. All but one are JVM expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+(?:[-./][\p{L}\p{N}_]+)*"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Words that say little about what a question asks for.
STOP_WORDS = ("the", "and", "for", "was", "were", "what", "when", "where", "which", "who", "how", "did", "does", "with", "that", "this", "from", "had", "has", "have", "are", "its")


def fold(c: Column | str) -> Column:
    """Lower case, and ss for the one letter of the corpus languages whose fold isn't its lower case."""
    return F.regexp_replace(F.lower(c), "ß", "ss")


def tokens(c: Column | str) -> Column:
    """Words with inner hyphens, points and slashes, folded. Null gives no tokens."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalized_answer(c: Column | str) -> Column:
    """Folded, without ASCII punctuation and English articles, single blanks between words."""
    bare = F.translate(fold(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


_COMPATIBLE_WORD = re.compile(r"[\w-]+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compatible_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _COMPATIBLE_WORD.findall(unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")


def compatible_words(c: Column | str) -> Column:
    """Words of the compatibility form (NFKC) without case: runs of letters, digits, underscores and hyphens. Null gives
    no words. Spark has no Unicode normalization, so this is the one step in Arrow batches; what follows is JVM-side."""
    return F.coalesce(_compatible_words(c), F.array().cast("array<string>"))


def sentences(c: Column | str) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def answer_digest(c: Column | str) -> Column:
    """SHA-256 of the text in lower case with single blanks."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), 256)


def seeded_digest(seed: str, c: Column | str) -> Column:
    """The order key of seeded selections: SHA-256 of seed, a zero byte and the value, in hexadecimal."""
    return F.sha2(F.concat(F.lit(seed + "\0"), c), 256)
