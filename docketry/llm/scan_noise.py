"""Noise of scanned pages: running headers, page labels, divided and misread words; and the text without it.

Two passes read the texts. The first finds, chunk by chunk, page labels, lines that could be headers and words divided
at line ends, and counts words. From these the corpus tells which lines are headers, which divided words belong
together and which rare words are misread forms of frequent ones. The second pass marks the misread words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.operators.joins import weighted_join
from docketry.session import cut_lineage

#: Misread forms up to this number are sent to all tasks (about 100 bytes each); beyond it words and forms meet in a shuffle.
SENT_FORMS = 200_000
#: Bits of the map by which tokens are taken for possible forms beyond that number; 16 MB in each task.
FORM_BITS = 24
#: Parts that the forms of one key are dealt to.
KEY_PARTS = 16
#: A form of letters only is misread if the right word is this many times as frequent.
RATIO = 10

# What scanning makes of letters; each right form before what is read.
CONFUSIONS = (
    "i:1 i:l i:| i:! l:1 l:i l:| o:0 0:o s:5 5:s t:7 e:c c:e a:@ g:9 q:9 b:6 b:8 h:b f:t t:f z:2 "
    "n:ri u:ii d:cl m:rn w:vv li:h ti:u in:m rn:m cl:d ri:n vv:w ii:u"
)
# A key that is equal for a word and what scanning makes of it, as a rewriting of each character.
KEY_OF = {"l": "i", "1": "i", "|": "i", "!": "i", "t": "i", "7": "i", "f": "i", "r": "i", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "m": "iii", "d": "ci", "e": "c", "0": "o", "5": "s", "@": "a", "9": "g", "q": "g", "w": "vv", "2": "z"}

_FORM_LABEL = re.compile(r"^(page\s+\d+(\s+of\s+\d+)?|p\.\s*\d+|-\s*\d+\s*-|\[\s*\d+\s*\]|\d+\s*/\s*\d+|m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3}))$", re.I)
_HEADING = re.compile(r"^\d+(\.\d+)+\.?\s+\S")
_ENDS_DIVIDED = re.compile(r"[^\W\d_]([-­¬‐‑])[ \t]*$")
_DIVIDED = re.compile("[-­¬‐‑][ \t]*\r?\n")
_NUMBERED = re.compile(r"^\d+\s{2,}|\s{2,}\d+$")
_EDGES = " \t\r\n.,;:!?\"()[]{}“”„‘’'«»*_…–—-­¬"


def scan_key(text: str) -> str:
    """Equal for a text and its misread forms; compares letters and digits only, whatever their case and spacing."""
    return "".join(KEY_OF.get(c, c) for c in text.lower() if c.isalnum() or c in "@|!")


def _titled(line: str) -> bool:
    """Whether a line could be a header: a few words, those of substance with a capital, and no end of a sentence."""
    if len(line) > 100 or line.count("|") > 1 or line[-1] in ".,;:\"”!?" or _HEADING.match(line):
        return False
    words = re.findall(r"[^\W_][\w@|!'’-]*", line)
    long = [w for w in words if len(w) > 3 and not w.isdigit()]
    if len([w for w in words if re.search(r"[^\W\d_]", w)]) < 2 or not long or (line[0].islower() and line[0] != "l"):
        return False
    return sum(w[0].isupper() or w[0].isdigit() or w[0] in "l@" for w in long) >= 0.7 * len(long)


class _Page:
    """The lines of a text with the kind of each: blank, label, cell (a number that may be a label), row, heading, title, text."""

    def __init__(self, text: str, section: str | None) -> None:
        self.lines = [x.strip() for x in text.splitlines()]
        rows = [x.count("|") for x in self.lines]
        kinds, section = [], (section or "").strip().lower()
        for i, x in enumerate(self.lines):
            if not x:
                kind = "blank"
            elif x.isdigit():
                kind = "number"
            elif _FORM_LABEL.match(x):
                kind = "label"
            elif rows[i] > 1:
                kind = "row"
            elif _HEADING.match(x) or x.lower() == section:
                kind = "heading"
            elif _titled(x):
                kind = "title"
            else:
                kind = "text"
            kinds.append(kind)
        for i, kind in enumerate(kinds):
            if kind == "number":
                a = b = i
                while a and kinds[a - 1] != "blank":
                    a -= 1
                while b + 1 < len(kinds) and kinds[b + 1] != "blank":
                    b += 1
                kinds[i] = "cell" if "row" in kinds[a : b + 1] else "label"
        self.kinds = kinds

    def at_edge(self, i: int) -> bool:
        """Whether only labels, titles and blanks lie between line i and an end of the text, a label or both blanks."""
        kinds = self.kinds
        for step in (-1, 1):
            j = i + step
            if 0 <= j < len(kinds) and kinds[j] == "blank" and 0 <= i - step < len(kinds) and kinds[i - step] == "blank":
                return True
            while 0 <= j < len(kinds) and kinds[j] in ("blank", "title"):
                j += step
            if not 0 <= j < len(kinds) or kinds[j] == "label":
                return True
        return False

    def divided(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(line, line of the rest, left part, sign, right part) of words that go on in the next line of running text."""
        for i, x in enumerate(self.lines):
            if self.kinds[i] not in ("text", "title") or not (m := _ENDS_DIVIDED.search(x)):
                continue
            j = i + 1
            while j < len(self.lines) and self.kinds[j] in ("blank", "label", "title", "cell"):
                j += 1
            if j == len(self.lines):
                continue
            left = x[: m.start(1)].rsplit(None, 1)[-1].lstrip(_EDGES)
            right = self.lines[j].split(None, 1)[0].rstrip(_EDGES)
            if right[:1].isalpha() and left:
                yield i, j, left, m[1], right


def _header_parts(line: str) -> tuple[str, str]:
    """(key of the whole line without page number, key of what headers of other reports may share with it)."""
    body = _NUMBERED.sub("", _NUMBERED.sub("", line))
    head = re.split(r"\s*[,|–—]\s*|\s+-\s+", body)[0]
    head = re.sub(r"\s+(?=\S*\d\S*\d\S*\d)[A-Z0-9]+$", "", head)  # the report's number
    return scan_key(body), scan_key(head)


FIRST = "kind string, chunk_id string, document_id string, line string, key string, head string, edge boolean, n bigint, m bigint"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    for batch in batches:
        ids, documents, sections, starts, ends, texts = (c.to_pylist() for c in batch.columns)
        rows: list[tuple] = []
        for chunk, document, section, start, end, text in zip(ids, documents, sections, starts, ends, texts, strict=True):
            words.update(text.split())
            page = _Page(text, section)
            for i, kind in enumerate(page.kinds):
                line = page.lines[i]
                if kind == "label":
                    rows.append(("label", chunk, document, line, None, None, None, None, None))
                    if line.isdigit() and start is not None and len(line) < 9:
                        rows.append(("offset", chunk, document, None, None, None, None, int(line) - start, int(line) - (start if end is None else end)))
                elif kind == "cell" and start is not None and len(line) < 9:
                    rows.append(("cell", chunk, document, line, None, None, i in (0, len(page.kinds) - 1), int(line) - start, int(line) - (start if end is None else end)))
                elif kind == "title":
                    key, head = _header_parts(line)
                    if len(key) > 5:
                        rows.append(("title", chunk, document, line, key, head, page.at_edge(i), None, None))
            if _DIVIDED.search(text):
                for i, j, left, sign, right in page.divided():
                    rows.append(("divided", chunk, document, sign, left.lower(), right.lower(), None, None, None))
                    words[page.lines[i].split()[-1]] -= 1
                    words[page.lines[j].split(None, 1)[0]] -= 1
        yield _rows(rows)
        if len(words) > 200_000:
            yield from _word_rows(words)
            words.clear()
    yield from _word_rows(words)


_FIRST_SCHEMA = pa.schema([("kind", pa.string()), ("chunk_id", pa.string()), ("document_id", pa.string()), ("line", pa.string()), ("key", pa.string()), ("head", pa.string()), ("edge", pa.bool_()), ("n", pa.int64()), ("m", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIRST_SCHEMA, strict=True)], schema=_FIRST_SCHEMA)


def _word_rows(raw: Counter[str]) -> Iterator[pa.RecordBatch]:
    """Words with a small letter, in lower case and without marks at their ends, with their key and number."""
    words: Counter[str] = Counter()
    for token, n in raw.items():
        if n > 0 and (w := token.strip(_EDGES)) and not w.isupper() and not w.isdigit() and any(c.islower() for c in w):
            words[w.lower()] += n
    items = iter(words.items())
    while part := list(islice(items, 20_000)):
        yield _rows([("word", None, None, w, scan_key(w), None, None, n, None) for w, n in part])


_STEPS = [tuple(x.split(":")) for x in CONFUSIONS.split()]


def misreading(right: str, read: str) -> int | None:
    """The least number of confusions that turn right into read; None if none do."""
    best: list[dict[int, int]] = [{} for _ in range(len(right) + 1)]
    best[0][0] = 0
    for i in range(len(right) + 1):
        for j, cost in sorted(best[i].items()):
            if i < len(right) and j < len(read) and right[i] == read[j]:
                best[i + 1][j + 1] = min(cost, best[i + 1].get(j + 1, cost))
            for a, b in _STEPS:
                if right.startswith(a, i) and read.startswith(b, j):
                    to, at = best[i + len(a)], j + len(b)
                    to[at] = min(cost + 1, to.get(at, cost + 1))
    return best[len(right)].get(len(read))


@F.pandas_udf(T.IntegerType())
def _misreadings(right: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([misreading(a, b) for a, b in zip(right, read, strict=True)], dtype="Int32")


def misread_forms(words: DataFrame, others: DataFrame) -> DataFrame:
    """(read, right): forms in words (word, key, n) or others (word, key) that are misread, with the right word.

    The right word has the same key, letters only, and can be turned into the form by few confusions. A form with
    digits or signs in it needs a right word that is as frequent, one of letters only a right word RATIO times as
    frequent; of several the one of least confusions is taken, then the most frequent.
    """
    letters = r"^\p{L}+(['’-]\p{L}+)*$"
    forms = words.select(F.col("word").alias("read"), "key", F.col("n").alias("read_n")).unionByName(others.select(F.col("word").alias("read"), "key", F.lit(0).cast("bigint").alias("read_n")))
    forms = forms.groupBy("read", "key").agg(F.max("read_n").alias("read_n"))
    rights = words.where(F.col("word").rlike(letters) & (F.length("word") > 1) & (F.col("n") > 1)).select(F.col("word").alias("right"), "key", "n")
    enough = F.when(F.col("read").rlike(letters), F.col("n") >= RATIO * F.greatest("read_n", F.lit(1))).otherwise(F.col("n") >= F.col("read_n"))
    # Short keys gather much of a large vocabulary's noise, so their forms are dealt to parts and the right words repeated.
    dealt = forms.where(F.length("read") > 2).withColumn("part", F.pmod(F.xxhash64("read"), F.lit(KEY_PARTS)).cast("int"))
    repeated = rights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1))))
    pairs = dealt.join(repeated, ["key", "part"]).where((F.col("read") != F.col("right")) & enough)
    costed = cut_lineage(pairs.withColumn("cost", _misreadings("right", "read")).where(F.col("cost") <= 1 + F.floor(F.length("right") / 3)))
    costed = costed.join(costed.select(F.col("read").alias("right")).distinct(), "right", "left_anti")  # itself a misread form
    return costed.groupBy("read").agg(F.min(F.struct("cost", (-F.col("n")).alias("n"), "right"))["right"].alias("right"))


def _tokens(text: str, section: str | None, wrong: dict[str, str]) -> list[tuple[str, str, str]]:
    """(token, right word, line) of misread words of running text; parts of divided words don't count as words."""
    page, out = _Page(text, section), []
    parts = [(i, j) for i, j, *_ in page.divided()]
    lasts, firsts = {i for i, _ in parts}, {j for _, j in parts}
    for i, line in enumerate(page.lines):
        if page.kinds[i] in ("text", "title"):
            tokens = line.split()
            for token in tokens[i in firsts : len(tokens) - (i in lasts)]:
                if (right := wrong.get(token.strip(_EDGES).lower())) and any(c.islower() for c in token):
                    out.append((token.strip(_EDGES), right, line))
    return out


_MARKED = "chunk_id string, piece string, right string, line string"


def _marked(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(chunk_id, piece, right, line): misread words in texts with the line they stand in."""
    known = forms.limit(SENT_FORMS + 1).collect()
    if len(known) > SENT_FORMS:
        return _marked_by_shuffle(texts, forms)
    sent = texts.sparkSession.sparkContext.broadcast({r["read"]: r["right"] for r in known})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, seen = sent.value, {}
        for batch in batches:
            ids, sections, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chunk_id", "section", "text"))
            out: list[tuple] = []
            for chunk, section, text in zip(ids, sections, texts, strict=True):
                hit = False
                for token in set(text.split()):
                    known = seen.get(token)
                    if known is None:
                        known = seen[token] = token.strip(_EDGES).lower() in wrong
                    hit = hit or known
                if len(seen) > 500_000:
                    seen.clear()
                if hit:
                    out += [(chunk, *x) for x in _tokens(text, section, wrong)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["chunk_id", "piece", "right", "line"])

    return texts.mapInArrow(mark, _MARKED)


def _form_map(forms: DataFrame) -> np.ndarray:
    """Whether a form has the place of its CRC-32 among 2**FORM_BITS; its size doesn't depend on their number."""
    at = F.pmod(F.crc32("read"), F.lit(1 << FORM_BITS)) + 1
    maps = forms.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << FORM_BITS, bool)
    for r in maps:
        out[(r["n"] - 1) * 32768 : r["n"] * 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def _marked_by_shuffle(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """The same for forms too many to send: tokens that may be forms by a map that all tasks get meet them by word.

    What the map lets pass are the misread words and one word in 2**FORM_BITS / forms of the others. Forms that very
    many texts have are joined without a shuffle.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_form_map(forms))

    @F.pandas_udf("array<struct<piece:string,word:string,line:string>>")
    def tokens(text: pd.Series, section: pd.Series) -> pd.Series:
        known = sent.value

        class Possible(dict):
            get = staticmethod(lambda w: w if known[zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << FORM_BITS) - 1)] else None)

        return pd.Series([[{"piece": p, "word": w, "line": x} for p, w, x in sorted(set(_tokens(t, s, Possible())))] for t, s in zip(text, section, strict=True)])

    own = cut_lineage(texts.select("chunk_id", F.explode(tokens("text", "section")).alias("t")).select("chunk_id", "t.*"))
    times = own.groupBy("word").agg(F.count("*").alias("n")).join(forms.withColumnRenamed("read", "word"), "word")
    return weighted_join(own, times, "word", "n").select("chunk_id", "piece", "right", "line")


def scan_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise, found_value, piece) of chunks (chunk_id, document_id, text, page_start, page_end, section).

    noise is running_header or page_number (found_value and piece: the line), hyphenation (the whole word; piece: its two
    parts with the sign between) or misread (the right word; piece: the word as read). Rows with the same chunk_id are
    taken to be the same text and reported once; null ids and null or empty texts give no row. Texts are read whole.

    Headers: lines like titles at an edge of a page that recur, misread or not, in two chunks of a report; and lines whose
    first part, without place, number and subtitle, is confirmed so in a report and stands at page edges in three. Page
    numbers: labels on a line of their own; a bare number within a table is one only where the report's other labels
    make that number due on the page. Divided words: rejoined where the corpus has the whole word at least as often as
    the compound, or knows neither the compound nor both parts. Misread words: see misread_forms.
    """
    own = chunks.where("chunk_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    texts = own.select("chunk_id", "document_id", "section", "page_start", "page_end", "text")
    first = cut_lineage(texts.mapInArrow(_first_pass, FIRST))

    labels = first.where("kind = 'label'").select("chunk_id", F.lit("page_number").alias("noise"), F.col("line").alias("found_value"), F.col("line").alias("piece"))
    offsets = first.where("kind = 'offset'").select("document_id", F.explode(F.array_distinct(F.array("n", "m"))).alias("off"))
    offsets = offsets.groupBy("document_id", "off").agg(F.count("*").alias("c")).groupBy("document_id").agg(F.max(F.struct("c", "off"))["off"].alias("off"))
    cells = first.where("kind = 'cell'")
    held = cells.groupBy("document_id").agg(F.count("*").alias("c")).join(offsets, "document_id", "left")
    due = weighted_join(cells.where("document_id IS NOT NULL"), held, "document_id", "c").unionByName(cells.where("document_id IS NULL").withColumn("off", F.lit(None).cast("bigint")))
    due = due.where(((F.col("off") >= F.col("m")) & (F.col("off") <= F.col("n"))) | (F.col("off").isNull() & F.col("edge") & ((F.col("n") == 0) | (F.col("m") == 0))))
    numbers = due.select("chunk_id", F.lit("page_number").alias("noise"), F.col("line").alias("found_value"), F.col("line").alias("piece"))

    titles = first.where("kind = 'title'").select("chunk_id", "document_id", "line", "key", "head", "edge")
    by_key = titles.where("edge").groupBy("document_id", "key", "head").agg(F.countDistinct("chunk_id").alias("c"))
    repeated = by_key.where("c > 1").groupBy("document_id", "key").agg(F.lit(1).alias("x")).select("document_id", "key")
    heads = by_key.groupBy("head").agg(F.countDistinct("document_id").alias("d"), F.max("c").alias("c")).where("c > 1 AND d > 2 AND length(head) > 5").select("head")
    # A report or a head may have any share of the titles, so both are joined by how many there are.
    of_key = titles.groupBy("document_id", "key").agg(F.count("*").alias("w")).join(repeated, ["document_id", "key"])
    of_head = titles.groupBy("head").agg(F.count("*").alias("w")).join(heads, "head")
    headers = weighted_join(titles, of_key, ["document_id", "key"], "w").select("chunk_id", "line").union(weighted_join(titles, of_head, "head", "w").select("chunk_id", "line")).distinct()
    headers = cut_lineage(headers)
    running = headers.select("chunk_id", F.lit("running_header").alias("noise"), F.col("line").alias("found_value"), F.col("line").alias("piece"))

    words = first.where("kind = 'word'").groupBy(F.col("line").alias("word"), "key").agg(F.sum("n").alias("n"))
    divided = first.where("kind = 'divided'").select("chunk_id", F.col("line").alias("sign"), F.col("key").alias("left"), F.col("head").alias("right_part"))
    divided = divided.withColumn("word", F.concat("left", "right_part"))
    others = divided.select("word").distinct().withColumn("key", _scan_keys("word"))
    forms = cut_lineage(misread_forms(words, others))

    whole = _counted(divided.groupBy("left", "sign", "right_part", "word").agg(F.count("*").alias("times")), words)
    joined = whole.join(forms, whole["word"] == forms["read"], "left").drop("read")
    known, both = F.col("whole_n") > 0, (F.col("left_n") > 0) & (F.col("part_n") > 0)
    soft = F.col("sign").isin("­", "¬")
    rejoin = soft | (known & (F.col("whole_n") >= F.col("compound_n"))) | (~known & (F.col("compound_n") == 0) & (F.col("right").isNotNull() | ~both))
    joined = joined.where(rejoin).select("left", "sign", "right_part", F.coalesce("right", "word").alias("whole"), F.col("right").isNotNull().alias("wrong"), "times")
    parts = weighted_join(divided, joined, ["left", "sign", "right_part"], "times")
    piece = F.concat("left", "sign", "right_part")
    hyphens = parts.select("chunk_id", F.lit("hyphenation").alias("noise"), F.col("whole").alias("found_value"), piece.alias("piece"))
    wrong_wholes = parts.where("wrong").select("chunk_id", F.lit("misread").alias("noise"), F.col("whole").alias("found_value"), piece.alias("piece"))

    marked = _marked(texts, forms).join(headers, ["chunk_id", "line"], "left_anti")
    misread = marked.select("chunk_id", F.lit("misread").alias("noise"), F.col("right").alias("found_value"), "piece")
    return labels.unionByName(numbers).unionByName(running).unionByName(hyphens).unionByName(wrong_wholes).unionByName(misread).distinct()


@F.pandas_udf(T.StringType())
def _scan_keys(words: pd.Series) -> pd.Series:
    return words.map(scan_key, na_action="ignore")


def _counted(divided: DataFrame, words: DataFrame) -> DataFrame:
    """divided with how often the corpus has the whole word, the compound, and each part (its outer word, if compound)."""

    def numbers(name: str, of: Column) -> DataFrame:
        nonlocal divided
        counts = words.select(F.col("word").alias("_w"), F.col("n").alias(name))
        divided = divided.withColumn("_of", of).join(counts, F.col("_of") == F.col("_w"), "left").drop("_of", "_w").withColumn(name, F.coalesce(name, F.lit(0)))
        return divided

    numbers("whole_n", F.col("word"))
    numbers("compound_n", F.concat("left", F.lit("-"), "right_part"))
    numbers("left_n", F.element_at(F.split("left", "-"), -1))
    return numbers("part_n", F.element_at(F.split("right_part", "-"), 1))


def repaired(text: str, section: str | None, found: list[dict]) -> str:
    """The text in continuous paragraphs: noise lines gone, divided words rejoined, misread words put right."""
    page = _Page(text, section)
    gone = {x["piece"] for x in found if x["noise"] in ("running_header", "page_number")}
    wholes = {x["piece"]: x["found_value"] for x in found if x["noise"] == "hyphenation"}
    wrong = {x["piece"]: x["found_value"] for x in found if x["noise"] == "misread"}
    join = {i: (j, wholes.get((left + sign + right).lower()), left, right) for i, j, left, sign, right in page.divided()}

    def put_right(token: str) -> str:
        core = token.strip(_EDGES)
        right = wrong.get(core)
        if not right:
            return token
        return token.replace(core, right.upper() if core.isupper() else right[:1].upper() + right[1:] if core[:1].isupper() else right, 1)

    paragraphs: list[tuple[bool, str]] = []  # whether it is a line of a table
    current: list[str] = []
    carried = ""  # the left part of a divided word, for the line in which it ends
    carried_to, through_break = -1, False

    def close() -> None:
        if current:
            paragraphs.append((False, " ".join(current)))
            current.clear()

    for i, line in enumerate(page.lines):
        kind = page.kinds[i]
        if kind in ("label", "cell", "title") and line in gone:
            through_break = True
            continue
        if kind == "blank":
            before = next((x for x in reversed(page.lines[:i]) if x), "")
            if carried_to <= i and not (through_break and before in gone) and not (i + 1 < len(page.lines) and page.lines[i + 1] in gone and current and not current[-1].endswith((".", '"', "!", "?"))):
                close()
            continue
        through_break = False
        if kind in ("row", "heading", "cell"):
            close()
            paragraphs.append((kind != "heading", line))
            continue
        tokens = line.split()
        if carried and i == carried_to:
            tokens[0] = carried + tokens[0]
            carried, carried_to = "", -1
        if i in join:
            j, whole, left, right = join[i]
            tail = tokens[-1].rstrip("-­¬‐‑")
            if whole and tail.lower().endswith(left.lower()) and whole != (left + right).lower():
                keep = whole[: len(left)]  # the word is misread too: its letters are dealt to both parts again
                tail = tail[: len(tail) - len(left)] + keep
                page.lines[j] = page.lines[j].replace(right, whole[len(left) :], 1)
            carried, carried_to = (tail if whole else tail + "-"), j
            tokens = tokens[:-1]
        current += [put_right(x) for x in tokens]
    if carried:
        current.append(carried)
    close()
    out, before = "", False
    for row, text in paragraphs:  # lines of a table stay together, all else is a paragraph of its own
        out += ("\n" if row and before else "\n\n" if out else "") + text
        before = row
    return out


def repaired_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text) once per chunk with a text: see repaired. Null and empty texts stay as they are."""
    noise = scan_noise(chunks).groupBy("chunk_id").agg(F.collect_list(F.struct("noise", "found_value", "piece")).alias("found"))
    once = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("text", "section")).alias("_t")).select("chunk_id", "_t.text", "_t.section")

    @F.pandas_udf(T.StringType())
    def repair(text: pd.Series, section: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if not t or f is None else repaired(t, s, list(f)) for t, s, f in zip(text, section, found, strict=True)])

    held = once.join(noise, "chunk_id", "left")
    return held.select("chunk_id", repair("text", "section", F.coalesce("found", F.array().cast("array<struct<noise:string,found_value:string,piece:string>>"))).alias("text"))
