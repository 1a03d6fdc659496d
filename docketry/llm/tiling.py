"""Evaluation passages inside training texts, by greedy string tiling over running Karp-Rabin hashes.

Words are maximal runs of letters and digits of the one form of a text (see codepoints) in lower case. Each word is a
64-bit hash; a window of words is a polynomial in its word hashes modulo 2**64, taken for every position of a block of
texts at once from prefix sums.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.codepoints import Block, blocks, canonical
from docketry.operators.joins import weighted_join
from docketry.session import cut_lineage

U = np.uint64
LETTER_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)  # odd, so that powers have inverses
#: Passage windows up to this number are sent to all tasks (8 bytes each); beyond it texts and windows meet in a shuffle.
SENT_WINDOWS = 1_000_000


@cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point where that is one code point, and whether it is part of a word."""
    lower, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    word[0x3400:0xA000] = word[0xAC00:0xD7A4] = word[0x20000:0x323B0] = True
    for cp in (*range(0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA1E)):
        ch = chr(cp)
        word[cp] = unicodedata.category(ch)[0] in "LMN"
        if ch.isupper() and len(ch.lower()) == 1:
            lower[cp] = ord(ch.lower())
    return lower, word


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        ones = np.ones(n, U)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = U(base), U(pow(base, -1, 1 << 64))
        return np.cumprod(up), np.cumprod(down)


def _powers_for(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(int(base), size)


def _windows(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[first:last] for each pair, whatever its place."""
    up, down = _powers_for(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(values * up[: len(values)], dtype=U)))
    return (sums[last] - sums[first]) * down[first]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Parts(NamedTuple):
    """Words of a block of texts. At a divided line end the parts are words of their own; span i says that the parts from
    first[i] to last[i] also read as one word, whose hash is whole[i]. Spans are sorted by their first part."""

    hashes: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    last: np.ndarray
    whole: np.ndarray
    letters: np.ndarray


def word_parts(block: Block, longest: int = 1 << 30) -> Parts:
    """The words of a block of texts with MARK at divided line ends; spans of more than longest letters are left out."""
    points, offsets = canonical(block)
    lower, word = _folding()
    points = lower[points]
    inside = word[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True  # a word ends with its row
    begins = inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1])
    ends = inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    none = np.zeros(0, np.int64)
    if not len(first):
        return Parts(np.zeros(0, U), np.zeros(len(offsets), np.int64), none, none, np.zeros(0, U), none)
    rows = np.searchsorted(first, offsets)
    mark = points == ord(MARK)
    tied = none
    if mark.any():
        after = np.append(mark, False)[last[:-1]] & (first[1:] == last[:-1] + 1)
        tied = np.flatnonzero(after)
        gone = np.concatenate(([0], np.cumsum(mark)))
        points, first, last = points[~mark], first - gone[first], last - gone[last]
    letters = points.astype(U) + U(1)
    hashed = lambda a, b: _mixed(_windows(letters, a, b, LETTER_BASE) + (b - a).astype(U))
    spans, p, q = [], tied, tied + 1
    goes_on = np.zeros(len(first) + 1, bool)
    goes_on[tied] = True
    while len(p):
        fits = last[q] - first[p] <= longest
        p, q = p[fits], q[fits]
        spans.append((p, q))
        p, q = p[goes_on[q]], q[goes_on[q]] + 1
    p, q = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (none, none)
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    return Parts(hashed(first, last), rows, p, q, hashed(first[p], last[q]) if len(p) else np.zeros(0, U), last - first)


def running_windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of size words; entry i starts at word i. Shorter arrays have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return _mixed(_windows(words, at, at + size, WORD_BASE))


def tiles(text: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash arrays: (place in text, place in passage, words), longest match first.

    The search length starts at the whole passage and is halved when nothing of it is left to mark; a match found at a
    length is extended to both sides as far as unmarked words agree, and matches are marked from the longest to the
    shortest, ties by their place in the passage, then in the text; of a match that overlaps a tile the unmarked rests
    are matches of their own. No word of either side is in two tiles.
    """
    found: list[tuple[int, int, int]] = []
    free_t, free_p = np.ones(len(text), bool), np.ones(len(passage), bool)
    size = max(least, min(len(passage), len(text)))
    while size >= least:
        of_text, of_passage = running_windows(text, size), running_windows(passage, size)
        open_t = np.flatnonzero(np.convolve(free_t, np.ones(size, int), "valid") == size) if len(of_text) else []
        open_p = np.flatnonzero(np.convolve(free_p, np.ones(size, int), "valid") == size) if len(of_passage) else []
        matches = []
        if len(open_t) and len(open_p):
            places: dict[int, list[int]] = {}
            for p in open_p:
                places.setdefault(int(of_passage[p]), []).append(int(p))
            for t in open_t[np.isin(of_text[open_t], of_passage[open_p])]:
                for p in places.get(int(of_text[t]), ()):
                    a, b = int(t), p
                    while a and b and free_t[a - 1] and free_p[b - 1] and text[a - 1] == passage[b - 1]:
                        a, b = a - 1, b - 1
                    c, d = int(t) + size, p + size
                    while c < len(text) and d < len(passage) and free_t[c] and free_p[d] and text[c] == passage[d]:
                        c, d = c + 1, d + 1
                    matches.append((c - a, b, a))
        queue = sorted({(-n, p, t) for n, p, t in matches})
        while queue:
            n, p, t = heappop(queue)
            free = free_t[t : t - n] & free_p[p : p - n]
            if free.all():
                if (text[t : t - n] == passage[p : p - n]).all():
                    free_t[t : t - n] = free_p[p : p - n] = False
                    found.append((t, p, -n))
            else:  # its unmarked rests take their turn by their own length
                edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
                for i, j in edges.reshape(-1, 2).tolist():
                    if j - i >= size:
                        heappush(queue, (i - j, p + i, t + i))
        if size == least:
            break
        size = max(least, size // 2)
    return found


def unmarked(text: Column) -> Column:
    """text without tags, with line ends that JSON writes as two characters, and with words divided by signs rejoined."""
    out = F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", " ")
    out = F.when(out.contains("\\"), F.regexp_replace(F.regexp_replace(out, r"\\[nrt]", "\n"), r'\\"', '"')).otherwise(out)
    return F.regexp_replace(out, "[\u00ac\u00ad][ \\t]*\\r?\\n\\s*", "")


DIVIDED = r"(?<=\p{L})[-‐‑][ \t]*\r?\n\s*(?=\p{L})"
#: Stands for a line end that may divide a word; a code point that no text has, as Unicode keeps it for such use.
MARK = "\ufdd0"


def marked(text: Column) -> Column:
    """text without markup, with MARK where a line ends in a hyphen between letters."""
    return F.regexp_replace(F.translate(unmarked(text), MARK, " "), DIVIDED, MARK)


def _whole_words(words: np.ndarray, spans: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """words with the parts of each span, which don't overlap, as the one word of it."""
    out, at = [], 0
    for p, q, whole in sorted(spans):
        out += [words[at:p], np.array([whole], U)]
        at = q + 1
    return np.concatenate([*out, words[at:]])


def divided_windows(words: np.ndarray, spans: Sequence[tuple[int, int, int]], least: int, known: np.ndarray) -> list[tuple[int, int, int, tuple]]:
    """(hash, first part, part after the last, spans) of the windows of least words that read some span as one word.

    Every divided line end may be read either way on its own, so each window is a path through the parts. known says
    which words any passage has; a path ends at a word that isn't, and spans are of words that are.
    """
    ahead: dict[int, list[tuple[int, int, tuple]]] = {}
    behind: dict[int, list[int]] = {}
    for p, q, whole in spans:
        ahead.setdefault(p, []).append((q + 1, whole, (p, q, whole)))
        behind.setdefault(q + 1, []).append(p)
    starts = edge = {p for p, _, _ in spans}
    for _ in range(least - 1):
        edge = {y for x in edge for y in [*([x - 1] if x and known[x - 1] else []), *behind.get(x, ())]} - starts
        starts = starts | edge
    powers = [pow(int(WORD_BASE), n, 1 << 64) for n in range(least)]
    found = []
    for start in sorted(starts):
        waiting = [(start, 0, 0, ())]
        while waiting:
            x, n, value, used = waiting.pop()
            if n == least:
                if used:
                    found.append((value % (1 << 64), start, x, used))
                continue
            if x < len(words) and known[x]:
                waiting.append((x + 1, n + 1, value + int(words[x]) * powers[n], used))
            for to, whole, span in ahead.get(x, ()):
                waiting.append((to, n + 1, value + whole * powers[n], (*used, span)))
    mixed = _mixed(np.array([x[0] for x in found], U))
    return [(int(h), *x[1:]) for h, x in zip(mixed, found, strict=True)]


def passage_readings(words: np.ndarray, spans: Sequence[tuple[int, int, int]], passage: np.ndarray, seeds: np.ndarray, least: int) -> list[np.ndarray]:
    """The words of a text as they read for a passage, so that each window of the text that is one of the passage's is in
    one of the readings.

    Windows that read a line end differently come in different readings, nearly always one is enough. A line end in no
    such window is read as a whole word where the passage has that word.
    """
    spans = [x for x in spans if x[2] in set(passage.tolist())]
    if not spans:
        return [words]
    held = np.isin(words, passage)
    crossing = [x[1:] for x in divided_windows(words, spans, least, held) if x[0] in set(seeds.tolist())]
    near = sorted({s for p, q, _ in spans for s in range(max(0, p - least + 1), min(q + 1, len(words) - least + 1))})
    if near:
        grams = running_windows(words, least)[near]
        crossing += [(s, s + least, ()) for s, hit in zip(near, np.isin(grams, seeds), strict=True) if hit]
    readings: list[tuple[list, set]] = []
    meets = lambda span, a, b: span[0] < b and span[1] >= a
    for a, b, used in sorted(crossing, key=lambda x: (x[0], x[1])):
        for windows, chosen in readings:
            if all(x in used or not meets(x, a, b) for x in chosen) and all(x in u or not meets(x, c, d) for x in used for c, d, u in windows):
                break
        else:
            windows, chosen = [], set()
            readings.append((windows, chosen))
        windows.append((a, b, used))
        chosen |= set(used)
    for windows, chosen in readings or [([], set())]:
        for span in spans:
            if not any(meets(span, c, d) for c, d, _ in windows) and not any(meets(span, x[0], x[1] + 1) for x in chosen):
                chosen.add(span)
        if not readings:
            readings = [(windows, chosen)]
    return [_whole_words(words, chosen) for _, chosen in readings]


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _plain(column: pa.Array) -> pa.Array:
    """Texts in which JSON wrote characters as \\uXXXX, with those characters; others as they are."""
    import pyarrow.compute as pc

    has = pc.fill_null(pc.match_substring(column, "\\u"), False)
    if not pc.any(has).as_py():
        return column
    decode = lambda x: _ESCAPE.sub(lambda m: chr(int(m[1], 16)), x).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return pa.array([decode(x) if h else x for x, h in zip(column.to_pylist(), has.to_pylist(), strict=True)], pa.string())


def passages(items: DataFrame, least: int) -> DataFrame:
    """(passage BINARY, words ARRAY<BIGINT>, letters INT of the longest word, item_ids ARRAY<STRING>) from rows (item_id
    STRING, passage STRING).

    Passages of the same words count once, with all items that hold them; those of under least words are in no row. A
    passage with divided line ends is in as many rows as it takes to hold each window of least words in all its
    readings: two to the power of the line ends that such a window can meet, one or two in ordinary lines.
    """
    own = items.where(F.col("item_id").isNotNull()).select("item_id", marked(F.col("passage")).alias("text"))

    def read(words: np.ndarray, letters: np.ndarray, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[np.ndarray, int]]:
        ties = sorted({p for p, q, *_ in spans if q == p + 1})
        widest = 0
        for i, t in enumerate(ties):  # line ends from t on that least words can meet
            reach, n = i, 0
            while reach < len(ties) and ties[reach] - t - n < least:
                reach, n = reach + 1, n + 1
            widest = max(widest, n)
        wholes = {(p, q): (p, q, whole, size) for p, q, whole, size in spans}
        for r in range(1 << widest):
            chosen, i = [], 0
            while i < len(ties):
                if not r >> (i % widest) & 1:
                    i += 1
                    continue
                p = q = ties[i]
                while i < len(ties) and ties[i] == q and r >> (i % widest) & 1:
                    q, i = q + 1, i + 1
                chosen.append(wholes[p, q])
            yield _whole_words(words, [x[:3] for x in chosen]), max([*letters.tolist(), *[x[3] for x in chosen]], default=0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, block in blocks(_plain(batch.column(1))):
                with np.errstate(over="ignore"):
                    parts = word_parts(block)
                sums = np.concatenate(([0], np.cumsum(parts.letters)))
                for r, (x, y) in enumerate(zip(parts.offsets[:-1].tolist(), parts.offsets[1:].tolist(), strict=True)):
                    own = slice(*np.searchsorted(parts.first, (x, y)))
                    spans = [(int(p) - x, int(q) - x, int(h), int(sums[q + 1] - sums[p])) for p, q, h in zip(parts.first[own], parts.last[own], parts.whole[own], strict=True)]
                    for words, longest in read(parts.hashes[x:y], parts.letters[x:y], spans):
                        if len(words) >= least:
                            yield pa.RecordBatch.from_arrays([ids.slice(a + r, 1), pa.array([words.view(np.int64)], pa.list_(pa.int64())), pa.array([longest], pa.int32())], names=["item_id", "words", "letters"])

    found = own.mapInArrow(hashed, "item_id string, words array<bigint>, letters int")
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("words").cast("array<string>")), 256))
    return found.groupBy(key.alias("passage")).agg(F.first("words").alias("words"), F.max("letters").alias("letters"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


#: Bits by which a word is looked up among the words of all passages; a false hit costs time only.
WORD_BITS = 22


def _known_words(known: DataFrame) -> np.ndarray:
    """Whether any passage has a word whose last WORD_BITS bits are the place."""
    at = F.pmod(F.col("w"), F.lit(1 << WORD_BITS)) + 1
    maps = known.select(F.explode("words").alias("w")).groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((1 << WORD_BITS) // 32768 * 32768, bool)
    for r in maps:
        out[(r["n"] - 1) * 32768 : r["n"] * 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def _is_known(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[(words & U((1 << WORD_BITS) - 1)).astype(np.int64)]


def _spans_of(parts: Parts, row: int) -> list[tuple[int, int, int]]:
    x, y = parts.offsets[row], parts.offsets[row + 1]
    own = slice(*np.searchsorted(parts.first, (x, y)))
    return [(int(p - x), int(q - x), int(h)) for p, q, h in zip(parts.first[own], parts.last[own], parts.whole[own], strict=True)]


TILED = "found_in string, record_key string, part int, passage binary, passage_words int, longest int, covered int, tiles array<struct<text_word:int,passage_word:int,words:int>>"


def _tiled(key: tuple, text: np.ndarray, spans: list[tuple[int, int, int]], passage: bytes, words: np.ndarray, seeds: np.ndarray, least: int, coverage: float) -> Iterator[dict]:
    for reading in passage_readings(text, spans, words, seeds, least):
        found = tiles(reading, words, least)
        covered = sum(n for _, _, n in found)
        if found and covered >= coverage * len(words):
            yield {
                "found_in": key[0], "record_key": key[1], "part": key[2], "passage": passage, "passage_words": len(words), "longest": max(n for _, _, n in found),
                "covered": covered, "tiles": [{"text_word": t, "passage_word": p, "words": n} for t, p, n in sorted(found)],
            }


def _out(rows: list[dict]) -> pa.RecordBatch:
    tile = pa.struct([("text_word", pa.int32()), ("passage_word", pa.int32()), ("words", pa.int32())])
    fields = [("found_in", pa.string()), ("record_key", pa.string()), ("part", pa.int32()), ("passage", pa.binary()), ("passage_words", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("tiles", pa.list_(tile))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def tile_texts(texts: DataFrame, known: DataFrame, least: int = 8, coverage: float = 0.0, sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """Tilings of texts (found_in, record_key, part, text) with passages (see passages): one row per text and passage that
    share a tile of at least least words.

    Columns: found_in, record_key, part, passage, passage_words, longest (words of the longest tile), covered (words of
    the passage in tiles), tiles. Every divided line end is read on its own as one word or as two, whatever the others
    are read as, and a text in which a passage's windows read one line end both ways gives a row for each reading. Null
    and empty texts and those of fewer words give none. Texts and passages of any length are searched whole. With
    coverage, only tilings that cover that share of their passage are given: tiles consist of shared seeds, so where a
    passage's shared seeds don't cover as much, the pair is left out before it is tiled.

    Seeds are the windows of least words. While the passages have at most sent_windows of them, all tasks get them and
    the texts are read once without a shuffle. A larger set meets the texts' windows in a shuffle by window instead.
    """
    texts = texts.where(F.col("text").isNotNull()).select("found_in", "record_key", F.col("part").cast("int"), marked(F.col("text")).alias("text"))
    windows, longest = known.agg(F.coalesce(F.sum(F.size("words") - (least - 1)), F.lit(0)), F.coalesce(F.max("letters"), F.lit(0))).first()
    if windows > sent_windows:
        return _tiled_by_shuffle(texts, known, least, coverage, longest)
    held = known.select("passage", "words").toPandas()
    arrays = [np.asarray(x, np.int64).view(U) for x in held["words"]]
    names = [bytes(x) for x in held["passage"]]
    with np.errstate(over="ignore"):
        grams = [running_windows(x, least) for x in arrays]
    seeds = np.concatenate(grams) if grams else np.zeros(0, U)
    owner = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
    order = np.argsort(seeds, kind="stable")
    words_held = np.zeros(1 << WORD_BITS, bool)
    for x in arrays:
        words_held[(x & U((1 << WORD_BITS) - 1)).astype(np.int64)] = True
    sent = texts.sparkSession.sparkContext.broadcast((seeds[order], owner[order], arrays, names, grams, words_held))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owner, arrays, names, seeds_of, words_held = sent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                column = _plain(batch.column(3))
                for a, _, block in blocks(column):
                    rows = []
                    parts = word_parts(block, longest)
                    words, offsets = parts.hashes, parts.offsets
                    grams = running_windows(words, least)
                    if not len(seeds) or not len(words):
                        continue
                    place = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
                    hits = np.flatnonzero(seeds[place] == grams)
                    row = np.searchsorted(offsets, hits, "right") - 1
                    inside = hits + least <= offsets[row + 1]  # windows don't run over into the next text
                    values = {int(r): grams[hits[inside & (row == r)]] for r in np.unique(row[inside])}
                    parts = _known_spans(parts, words_held)
                    for r in np.unique(np.searchsorted(offsets, parts.first, "right") - 1).tolist():
                        own = slice(offsets[r], offsets[r + 1])
                        crossing = np.array([x[0] for x in divided_windows(words[own], _spans_of(parts, r), least, _is_known(words[own], words_held))], U)
                        crossing = crossing[np.isin(crossing, seeds)]
                        if len(crossing):
                            values[r] = np.concatenate((values.get(r, np.zeros(0, U)), crossing))
                    for r in sorted(values):
                        shared = np.unique(values[r])
                        lo, hi = np.searchsorted(seeds, shared, "left"), np.searchsorted(seeds, shared, "right")
                        text, spans = words[offsets[r] : offsets[r + 1]], _spans_of(parts, r)
                        key = tuple(batch.column(i)[a + r].as_py() for i in range(3))
                        for p in sorted({int(x) for i, j in zip(lo, hi, strict=True) for x in owner[i:j]}):
                            if (np.convolve(np.isin(seeds_of[p], shared), np.ones(least, int)) > 0).sum() >= coverage * len(arrays[p]):
                                rows += _tiled(key, text, spans, names[p], arrays[p], seeds_of[p], least, coverage)
                    if rows:
                        yield _out(rows)

    return texts.mapInArrow(search, TILED)


def _known_spans(parts: Parts, words_held: np.ndarray) -> Parts:
    """parts with those spans only that read as a word of some passage."""
    keep = _is_known(parts.whole, words_held)
    return parts._replace(first=parts.first[keep], last=parts.last[keep], whole=parts.whole[keep])


SPANS = "array<struct<first:int,last:int,whole:bigint>>"


def _tiled_by_shuffle(texts: DataFrame, known: DataFrame, least: int, coverage: float, longest: int) -> DataFrame:
    """tile_texts for passages too many to send: windows are joined by hash, then texts and passages by their keys.

    Windows that many texts or passages that many texts share are joined without a shuffle (see weighted_join), so no
    key gathers in one task. Of the passages' words all tasks get a map of 2**WORD_BITS bits.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_known_words(known))
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("whole", pa.int64())]))
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_held = sent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, block in blocks(_plain(batch.column(3))):
                    parts = _known_spans(word_parts(block, longest), words_held)
                    spans, windows = [], []
                    for r in range(b - a):
                        words = parts.hashes[parts.offsets[r] : parts.offsets[r + 1]]
                        own = _spans_of(parts, r)
                        crossing = [x[0] for x in divided_windows(words, own, least, _is_known(words, words_held))] if own else []
                        spans.append([{"first": p, "last": q, "whole": signed(h)} for p, q, h in own])
                        windows.append(np.unique(np.concatenate((running_windows(words, least), np.array(crossing, U)))).view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(parts.offsets, pa.int32()), pa.array(parts.hashes.view(np.int64)))
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], lists, pa.array(spans, span), pa.array(windows, pa.list_(pa.int64()))], names=["found_in", "record_key", "part", "words", "spans", "windows"])

    read = texts.mapInArrow(hashed, f"found_in string, record_key string, part int, words array<bigint>, spans {SPANS}, windows array<bigint>").where(F.size("windows") > 0)
    key = ["found_in", "record_key", "part", "reading"]
    read = cut_lineage(read.withColumn("reading", F.xxhash64("words", "spans")).dropDuplicates(key))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def window_list(lists):  # noqa: ANN001, ANN202
        with np.errstate(over="ignore"):
            return lists.map(lambda x: np.unique(running_windows(np.asarray(x, np.int64).view(U), least)).view(np.int64))

    of_text = read.select(*key, F.explode("windows").alias("window"))
    of_passage = cut_lineage(known.select("passage", F.size("words").alias("n_words"), F.explode(window_list("words")).alias("window")))
    shared = of_text.join(of_passage.select("window").distinct(), "window", "left_semi").groupBy("window").agg(F.count("*").alias("n"))
    holders = of_passage.groupBy("window").agg(F.collect_list(F.struct("passage", "n_words")).alias("in"))  # as many as a window has passages
    hits = weighted_join(of_text, shared.join(holders, "window"), "window", "n").select(*key, F.explode("in").alias("p"))
    pairs = hits.groupBy(*key, F.col("p.passage").alias("passage")).agg(F.count("*").alias("seeds"), F.first("p.n_words").alias("n_words"))
    pairs = cut_lineage(pairs.where(F.col("seeds") * least >= coverage * F.col("n_words")).select(*key, "passage"))
    with_text = pairs.join(read.select(*key, "words", "spans"), key)
    times = pairs.groupBy("passage").agg(F.count("*").alias("n"))
    both = weighted_join(with_text, times.join(known.select("passage", F.col("words").alias("passage_hashes")), "passage"), "passage", "n")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for x in batch.to_pylist():
                    passage = np.asarray(x["passage_hashes"], np.int64).view(U)
                    spans = [(y["first"], y["last"], y["whole"] % (1 << 64)) for y in x["spans"]]
                    text = np.asarray(x["words"], np.int64).view(U)
                    rows += _tiled((x["found_in"], x["record_key"], x["part"]), text, spans, x["passage"], passage, running_windows(passage, least), least, coverage)
                if rows:
                    yield _out(rows)

    return both.select("found_in", "record_key", "part", "passage", "words", "spans", "passage_hashes").mapInArrow(tile, TILED)


def leaked_items(tiled: DataFrame, known: DataFrame, coverage: float = 0.0) -> DataFrame:
    """(found_in, record_key, example_id, longest, coverage): per record and item the best of its texts and passages.

    coverage is the share of a passage's words that tiles cover, wherever in the text and in whatever order they stand;
    records below the threshold for every passage of an item drop out. A passage that several items hold gives each; one
    that a large share of the records hold is joined without a shuffle.
    """
    best = tiled.groupBy("found_in", "record_key", "passage").agg(F.max("longest").alias("longest"), F.max(F.col("covered") / F.col("passage_words")).alias("coverage"))
    best = cut_lineage(best.where(F.col("coverage") >= coverage))
    times = best.groupBy("passage").agg(F.count("*").alias("n"))
    spread = weighted_join(best, times.join(known.select("passage", "item_ids"), "passage"), "passage", "n").withColumn("example_id", F.explode("item_ids"))
    return spread.groupBy("found_in", "record_key", "example_id").agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
