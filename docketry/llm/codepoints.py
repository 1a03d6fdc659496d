"""Arrow text columns as numpy code-point arrays, with lookup tables built by rule from the Unicode database.

A block of texts is one uint32 array of code points and one array of row offsets. All work is done on whole blocks:
gathers from tables, expansion by offsets, vector composition of marks. No Python code runs per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; bounds a task's memory whatever the number and length of rows in an Arrow batch.
BLOCK_BYTES = 1 << 21
LIMIT = 0x110000

# Letters of other scripts and code points that are drawn like a Latin letter, each before its Latin form.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY ӀI "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC οo ϲc ϳj "
    "օo ոn սu հh ցg զq ՕO ՍU ՏS ԼL "
    "ɡg ɑa ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "‐- ‑- ﹣- ⁃-"
)
# Format characters that print something.
PRINTING_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Letters and fillers that print nothing although they aren't format characters.
SILENT = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
# The long s and its dotted form differ visibly from s.
VISIBLE_COMPATIBILITY = {0x17F, 0x1E9B}


class Block(NamedTuple):
    points: np.ndarray
    offsets: np.ndarray


def _mapped(cp: int, alike: dict[int, int]) -> tuple[int, ...]:
    """The code points that stand for cp in the one form: decomposed, plain width, Latin where drawn alike."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in (0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029):
        return (0x0A,)
    if kind == "Zs" or cp == 0x09:
        return (0x20,)
    if cp == 0x0A:
        return (cp,)
    if kind == "Cc" or (kind == "Cf" and cp not in PRINTING_FORMATS) or cp in SILENT:
        return ()
    if 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ()
    if 0xAC00 <= cp <= 0xD7A3:
        return (cp,)
    if cp in alike:
        return (alike[cp],)
    parts = unicodedata.decomposition(ch)
    if not parts:
        return (cp,)
    tag, _, rest = parts.rpartition("> ")
    plain = not tag or tag in ("<wide", "<narrow", "<noBreak")
    letter = tag == "<compat" and (kind[0] == "L" or kind == "Nl") and cp not in VISIBLE_COMPATIBILITY
    if not (plain or letter):
        return (cp,)
    return tuple(y for x in rest.split() for y in _mapped(int(x, 16), alike))


class Tables(NamedTuple):
    single: np.ndarray  # the one code point of a code point that maps to one, else the first
    length: np.ndarray  # to how many it maps
    start: np.ndarray  # where the sequence begins in sequences, for those that map to several
    sequences: np.ndarray
    combining: np.ndarray  # canonical combining class
    pair_keys: np.ndarray  # base << 32 | mark, sorted
    pair_values: np.ndarray


@cache
def tables() -> Tables:
    alike = {ord(x[0]): ord(x[1]) for x in LOOKALIKES.split()}
    single, length = np.arange(LIMIT, dtype=np.uint32), np.ones(LIMIT, np.uint8)
    start, combining, sequences, pairs = np.zeros(LIMIT, np.int32), np.zeros(LIMIT, np.uint8), [], {}
    # Ideographs, syllables, surrogates, private code points and the historic scripts between stand for themselves.
    for cp in (*range(0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0x12000), *range(0x1BC9F, 0x1BCA4), *range(0x1D000, 0x20000), *range(0x2F800, 0x2FA1E), *range(0xE0000, 0xE0200)):
        combining[cp] = unicodedata.combining(chr(cp))
        to = _mapped(cp, alike)
        if to != (cp,):
            length[cp] = len(to)
            if to:
                single[cp] = to[0]
            if len(to) > 1:
                start[cp] = len(sequences)
                sequences += to
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            a, b = (int(x, 16) for x in parts)
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(cp) and unicodedata.combining(chr(b)):
                pairs[alike.get(a, a) << 32 | b] = min(cp, pairs.get(alike.get(a, a) << 32 | b, cp))
    keys = np.array(sorted(pairs), np.uint64)
    return Tables(single, length, start, np.array(sequences or [0], np.uint32), combining, keys, np.array([pairs[int(k)] for k in keys], np.uint32))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, code points) of slices of at most size bytes, or of one row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        raw = b"" if data is None else data.slice(offsets[a], offsets[b] - offsets[a]).to_pybytes()
        yield a, b, _decoded(raw, offsets[a : b + 1] - offsets[a])
        a = b


def _decoded(raw: bytes, offsets: np.ndarray) -> Block:
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # bytes that aren't UTF-8 become U+FFFD, row by row so that rows stay apart
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ends = np.cumsum([0, *map(len, rows)])
        return Block(np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), ends.astype(np.int64))
    if len(points) == len(raw):
        return Block(points, offsets)
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return Block(points, np.concatenate(([0], np.cumsum(first)))[offsets])


def encoded(block: Block, null: np.ndarray | None = None) -> pa.Array:
    """The block as an Arrow string array; rows where null is true are null."""
    points, offsets = block
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    if len(raw) != len(points):
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate(([0], np.cumsum(width)))[offsets]
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out) if null is not None and null.any() else out


def canonical(block: Block) -> Block:
    """Every text in the one form: equal for texts that look the same on the page."""
    t = tables()
    points, offsets = block
    if not len(points):
        return block
    feed = (points[:-1] == 0x0D) & (points[1:] == 0x0A)
    length = t.length[points]
    if feed.any():  # of a carriage return and a line feed in one row, the first prints nothing
        at = np.flatnonzero(feed)
        length = length.copy()
        length[at[~np.isin(at + 1, offsets)]] = 0
    if (length == 1).all():
        points = t.single[points]
    else:
        ends = np.cumsum(length, dtype=np.int64)
        wide = np.repeat(points, length)
        out = t.single[wide]
        if (length > 1).any():
            several = np.repeat(length > 1, length)
            within = np.arange(len(wide)) - np.repeat(ends - length, length)
            out[several] = t.sequences[t.start[wide[several]] + within[several]]
        points, offsets = out, np.concatenate(([0], ends))[offsets]
    if not len(points) or points.max() < 0x300:
        return Block(points, offsets)
    return _composed(*_syllables(points, offsets))


def _syllables(points: np.ndarray, offsets: np.ndarray) -> Block:
    """Conjoining Korean letters joined to syllables by arithmetic."""
    lead = (points >= 0x1100) & (points <= 0x1112)
    if not lead.any() and not ((points >= 0x11A8) & (points <= 0x11C2)).any():
        return Block(points, offsets)
    points, keep = points.astype(np.int64), np.ones(len(points), bool)
    begins = np.zeros(len(points) + 2, bool)
    begins[offsets] = True
    after = np.append(points[1:], 0)
    at = np.flatnonzero(lead & (after >= 0x1161) & (after <= 0x1175) & ~begins[1 : len(points) + 1])
    points[at] = 0xAC00 + ((points[at] - 0x1100) * 21 + after[at] - 0x1161) * 28
    keep[at + 1] = False
    points, offsets = points[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    keep, begins = np.ones(len(points), bool), np.zeros(len(points) + 2, bool)
    begins[offsets] = True
    after = np.append(points[1:], 0)
    open_syllable = (points >= 0xAC00) & (points <= 0xD7A3) & ((points - 0xAC00) % 28 == 0)
    at = np.flatnonzero(open_syllable & (after >= 0x11A8) & (after <= 0x11C2) & ~begins[1 : len(points) + 1])
    points[at] += after[at] - 0x11A7
    keep[at + 1] = False
    return Block(points[keep].astype(np.uint32), np.concatenate(([0], np.cumsum(keep)))[offsets])


def _composed(points: np.ndarray, offsets: np.ndarray) -> Block:
    """Marks sorted by combining class within their run, then joined to their letter, the k-th mark of all runs at a time."""
    t = tables()
    rank_class = t.combining[points]
    marks = np.flatnonzero(rank_class)
    if not len(marks):
        return Block(points, offsets)
    points = points.copy()
    row_start = np.zeros(len(points) + 1, bool)
    row_start[offsets] = True
    fresh = np.ones(len(marks), bool)  # a run ends at a letter and at the end of a row
    fresh[1:] = (np.diff(marks) > 1) | row_start[marks[1:]]
    run = np.cumsum(fresh) - 1
    order = np.lexsort((rank_class[marks], run))
    points[marks] = points[marks[order]]
    classes = rank_class[marks[order]]
    first = marks[fresh]
    letter = first - 1  # of each run; none at the start of a row
    has_letter = (first > 0) & ~row_start[first]
    nth = np.arange(len(marks)) - np.flatnonzero(fresh)[run]
    keep = np.ones(len(points), bool)
    last_class = np.zeros(len(first), np.int64)
    by_rank = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by_rank], np.arange(nth.max() + 2))
    for k in range(nth.max() + 1):
        at = by_rank[bounds[k] : bounds[k + 1]]
        at = at[has_letter[run[at]]]
        r = run[at]
        key = points[letter[r]].astype(np.uint64) << np.uint64(32) | points[marks[at]]
        where = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        joined = (t.pair_keys[where] == key) & (last_class[r] != classes[at])
        points[letter[r[joined]]] = t.pair_values[where[joined]]
        keep[marks[at[joined]]] = False
        last_class[r[~joined]] = classes[at[~joined]]
    return Block(points[keep], np.concatenate(([0], np.cumsum(keep)))[offsets])


#: Scripts whose letters are brought back in their own words, by their blocks. The order settles nothing but speed.
SCRIPTS = {"Cyrillic": (0x400, 0x530), "Greek": (0x370, 0x400), "Armenian": (0x530, 0x590)}


@cache
def _own_letters() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Whether a code point is a letter or a mark, whether it is a Latin letter, and per script the letter of the script
    that is drawn like it (0 where there is none)."""
    word, latin = np.zeros(LIMIT, bool), np.zeros(LIMIT, bool)
    for cp in (*range(0x250), *range(0x300, 0x590), *range(0x1E00, 0x2000)):
        ch = chr(cp)
        word[cp] = unicodedata.category(ch)[0] in "LM"
        latin[cp] = "LATIN" in unicodedata.name(ch, "")
    backs = []
    for a, b in SCRIPTS.values():
        back: dict[int, int] = {}
        for x in LOOKALIKES.split():
            if a <= ord(x[0]) < b and x[1].isalpha():
                back.setdefault(ord(x[1]), ord(x[0]))
        for cp in np.flatnonzero(latin):  # accented letters, by their letter
            parts = unicodedata.normalize("NFD", chr(cp))
            if len(parts) > 1 and ord(parts[0]) in back:
                whole = unicodedata.normalize("NFC", chr(back[ord(parts[0])]) + parts[1:])
                if len(whole) == 1:
                    back.setdefault(int(cp), ord(whole))
        to = np.zeros(LIMIT, np.uint32)
        to[list(back)] = list(back.values())
        backs.append(to)
    return word, latin, backs


def scripted(block: Block) -> Block:
    """A block in the one form of canonical, with each word in one script: letters drawn like Latin ones are those of
    another script in words that have more letters that only this script has than letters that only Latin has, and in
    words without either where more words of the text are of that script. The result depends on the one form alone, so
    texts that look the same stay equal.
    """
    word, latin, backs = _own_letters()
    points, offsets = block
    if not len(points) or points.max() < 0x370:
        return block
    inside = word[points]
    begins = inside & ~np.concatenate(([False], inside[:-1]))
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[row_starts] |= inside[row_starts]
    number = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    if not len(first):
        return block
    row = np.searchsorted(offsets, first, "right") - 1
    rows, out = len(offsets) - 1, points.copy()
    count = lambda flags: np.bincount(number[flags & inside], minlength=len(first))
    is_latin = latin[points]
    undecided, best = [], np.zeros(rows, np.int64)
    choice = np.full(rows, -1)
    for i, ((a, b), back) in enumerate(zip(SCRIPTS.values(), backs, strict=True)):
        theirs, only_latin = count((points >= a) & (points < b)), count(is_latin & (back[points] == 0))
        chosen = theirs > only_latin
        at = inside & chosen[number] & (back[points] > 0)
        out[at] = back[points[at]]
        undecided.append((theirs == 0) & (only_latin == 0))
        votes = np.bincount(row[chosen], minlength=rows) - np.bincount(row[(only_latin > 0) & ~chosen], minlength=rows)
        choice[votes > best], best = i, np.maximum(best, votes)
    for i, back in enumerate(backs):
        drawn_alike = count(back[points] == 0) == 0  # every letter has a form of the script
        at = inside & (undecided[i] & drawn_alike & (choice[row] == i))[number] & (back[points] > 0)
        out[at] = back[points[at]]
    return Block(out, offsets)
