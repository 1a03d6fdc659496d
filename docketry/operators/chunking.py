"""Pages cut into overlapping chunks at paragraph and sentence ends, with exact offsets in their document."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between the pages of a document's text.
PAGE_BREAK = "\n\n"
#: How far from the start of a chunk a page header may end.
HEADER_REACH = 32
# The characters of a heading.
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
OF_HEADINGS = CAPITALS | frozenset("0123456789 /(),&'-")


@dataclass(frozen=True)
class ChunkSizes:
    """Characters: aimed at, shared by neighbours, least, and how far from the aim a paragraph end is looked for."""

    # The sizes of the reference corpus.
    target: int = 1600
    overlap: int = 256
    least: int = 320
    reach: int = 400

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.target or not 0 < self.least <= self.target or self.reach < 0:
            raise ValueError("overlap must be below target, least at most target, reach not negative")

    @property
    def fingerprint(self) -> str:
        """Identity of the sizes, for the record of a build."""
        return "sha256:" + hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


_WHITE = re.compile(r"\s{2,}")


class _Page:
    """A page with the places where it can be cut, and its headings."""

    def __init__(self, text: str) -> None:
        self.text = text
        # Line feeds of each run of white space that has two or more, with the number of their run.
        self.feeds: list[int] = []
        self.run: list[int] = []
        for n, run in enumerate(_WHITE.finditer(text)):
            held = [i for i in range(*run.span()) if text[i] == "\n"]
            if len(held) > 1:
                self.feeds += held
                self.run += [n] * len(held)
        self.lines = [0, *(i + 1 for i in range(len(text)) if text[i] == "\n")] if "\n" in text else [0]
        self.titles = list(self._headings())

    def breaks(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(begin, end) of the paragraph breaks of which both line feeds lie in text[low:high]; an end is the place after
        the last line feed of its run in that range."""
        i, j = bisect_left(self.feeds, low), bisect_left(self.feeds, high)
        while i < j:
            last = bisect_right(self.run, self.run[i], i, j) - 1
            if last > i:
                yield self.feeds[i], self.feeds[last] + 1
            i = last + 1

    def _headings(self) -> Iterator[tuple[int, int, str]]:
        """(begin, end, heading) of the lines that are headings."""
        skipped = -1
        for begin, after in zip(self.lines, [*self.lines[1:], len(self.text) + 1], strict=True):
            if begin <= skipped:
                continue
            line = self.text[begin : after - 1]
            if not line or not (line[0] in CAPITALS or line[0].isdecimal()):
                continue
            body, stop = begin + _after_number(line), after - 1
            while begin < body < len(self.text) and self.text[body].isspace():  # a number may stand on a line of its own
                body += 1
            if body > stop:
                following = self.text.find("\n", body)
                stop = len(self.text) if following < 0 else following
            if _is_heading(self.text[body:stop]):
                skipped = stop
                yield begin, stop, self.text[begin:stop].strip()

    def section(self, a: int, b: int) -> str | None:
        """The last heading of text[:b] that begins at or before a, else its first, else null; b may cut a line short."""
        at = bisect_right(self.titles, a, key=lambda t: t[0])
        if at:
            return self.titles[at - 1][2]
        if at < len(self.titles) and self.titles[at][1] <= b:
            return self.titles[at][2]
        cut = self.text[self.lines[bisect_left(self.lines, b) - 1] : b]
        number = _after_number(cut)
        return cut.strip() if _is_heading(cut[number:].lstrip() if number else cut) else None


def _after_number(line: str) -> int:
    """Where the white space after a section number begins; 0 where a line doesn't begin with one."""
    at = 0
    while at < len(line) and (line[at].isdecimal() or (line[at] == "." and 0 < at < len(line) - 1 and line[at - 1].isdecimal() and line[at + 1].isdecimal())):
        at += 1
    return at if at == len(line) or line[at].isspace() else 0


def _is_heading(line: str) -> bool:
    return 5 <= len(line) <= 81 and line[0] in CAPITALS and OF_HEADINGS.issuperset(line)


def spans(page: _Page | str, sizes: ChunkSizes, header: str | None = None) -> Iterator[tuple[int, int]]:
    """Half-open spans of a page without blanks at their ends; each begins before the last ended, by at most the overlap,
    and least characters after the last began.

    A chunk ends with the page where what is left fits, else with the paragraph nearest to the aim, else with the last
    sentence in reach before it, else at the aim. Where the page begins with nothing but header, whatever its case, up to
    a paragraph break, that is skipped; so is a chunk of nothing else.
    """
    page = _Page(page) if isinstance(page, str) else page
    text, whole = page.text, len(page.text)
    is_header = (lambda a, b: text[a:b].strip().casefold() == header.casefold()) if header else lambda a, b: False
    at = 0
    while True:
        while at < whole and text[at].isspace():
            at += 1
        if at >= whole:
            return
        top = next(page.breaks(at, min(at + HEADER_REACH, whole)), None) if header else None
        if top and is_header(at, top[0]):
            at = top[1]
            continue
        stop = _end(page, at, sizes)
        while text[stop - 1].isspace():
            stop -= 1
        if is_header(at, stop):
            at = stop
            continue
        yield at, stop
        if stop >= whole:
            return
        at = max(min(stop, at + sizes.least), stop - sizes.overlap)
        at = next((b for _, b in page.breaks(at, stop)), at)


def _end(page: _Page, begin: int, sizes: ChunkSizes) -> int:
    whole = len(page.text)
    aim = begin + sizes.target
    if aim >= whole:
        return whole
    low = max(begin + sizes.least, aim - sizes.reach)
    paragraphs = [b for _, b in page.breaks(low, min(whole, aim + sizes.reach))]
    if paragraphs:
        return min(paragraphs, key=lambda b: (abs(b - aim), b))
    full = max(page.text.rfind(mark, low, aim) for mark in (". ", ".\n"))
    return full + 1 if full >= 0 else aim


def content_kind(text: str) -> str:
    """table if two in five lines with text have two blanks in a row or a bar, else text."""
    marked = lines = 0
    for line in text.splitlines():
        if line.strip():
            lines += 1
            marked += line.find("|") >= 0 or line.find(" " * 2) >= 0
    return "table" if marked and 5 * marked >= 2 * lines else "text"


def chunk_id(document_id: str, text: str, start: int, end: int, kind: str) -> str:
    """Identity by content: chk_ and the SHA-256 of the fields as JSON with sorted keys and no blanks."""
    fields = {"document_id": document_id, "text": text, "start": start, "end": end, "kind": kind}
    return "chk_" + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


#: Pages whose offsets are summed in one window; longer documents are summed block by block first.
BLOCK_PAGES = 1000


def page_spans(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text) with start_offset and end_offset in the text of all pages of a document in
    order, PAGE_BREAK between them. Null texts count as empty; rows without document or page number are left out.

    Lengths are summed per block of pages first, so a document of any number of pages is spread over many tasks.
    """
    block = F.floor(F.col("page_number") / BLOCK_PAGES)
    own = pages.where("document_id IS NOT NULL AND page_number IS NOT NULL").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_b", block)
    own = own.withColumn("_n", F.length("text").cast("bigint") + len(PAGE_BREAK))
    earlier = Window.partitionBy("document_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("document_id", "_b").agg(F.sum("_n").alias("_s")).select("document_id", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("document_id", "_b").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(blocks, ["document_id", "_b"]).withColumn("start_offset", F.col("_from") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.withColumn("end_offset", F.col("start_offset") + F.length("text")).drop("_b", "_n", "_from")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(document_id, text): the pages of a document in order with PAGE_BREAK between. For documents that fit a row."""
    held = pages.where("document_id IS NOT NULL AND page_number IS NOT NULL").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return held.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), PAGE_BREAK).alias("text"))


CHUNKS = "chunk_id string, document_id string, text string, start_offset bigint, end_offset bigint, page_start int, page_end int, section string, kind string"


def chunked_pages(pages: DataFrame, sizes: ChunkSizes | None = None, header: str | None = None) -> DataFrame:
    """Chunks (see CHUNKS) of pages (document_id STRING, page_number INT, text); none crosses a page.

    start_offset and end_offset are code points in the text of the document's pages (see page_spans). section is the last
    heading of the page that begins at or before the chunk, else the first within it, else null. Blank pages give no
    chunk; documents without any are given by empty_documents.
    """
    sizes = sizes or ChunkSizes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for document, number, text, offset in zip(batch["document_id"], batch["page_number"], batch["text"], batch["start_offset"], strict=True):
                page = _Page(text)
                for a, b in spans(page, sizes, header):
                    section = page.section(a, b)
                    piece = text[a:b]
                    kind = content_kind(piece)
                    out.append((chunk_id(document, piece, offset + a, offset + b, kind), document, piece, offset + a, offset + b, number, number, section, kind))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNKS.split(", ")])

    return page_spans(pages).select("document_id", "page_number", "text", "start_offset").mapInPandas(cut, CHUNKS)


def chunked(documents: DataFrame, sizes: ChunkSizes | None = None) -> DataFrame:
    """chunked_pages of documents (document_id STRING, text) of one page each."""
    return chunked_pages(documents.select("document_id", F.lit(1).alias("page_number"), "text"), sizes)


def empty_documents(pages: DataFrame) -> DataFrame:
    """(document_id) of documents without any text on their pages."""
    return pages.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max(F.coalesce(F.length(F.regexp_replace("text", r"(?U)\s+", "")), F.lit(0))).alias("n")).where("n = 0").select("document_id")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)))


def chunk_problems(chunks: DataFrame, pages: DataFrame, least: int = 1, width: int = 8192) -> DataFrame:
    """(document_id, chunk_id, page, problem) of chunks (as CHUNKS) and pages (document_id, page_number, text) that don't
    fit together:

    unknown_document; text_differs, where the document's text from start to end isn't the chunk's; page_range, where its
    pages aren't the first and last that it overlaps (or it overlaps none); tiny_chunk of less than least characters
    without blanks at the ends; uncovered_page, a page with text that no chunk overlaps (chunk_id null). Chunks meet the
    pages they overlap by bins of width characters, so no document gathers in one task.
    """
    own = page_spans(pages).select("document_id", "page_number", F.col("text").alias("_page"), F.col("start_offset").alias("_from"), F.col("end_offset").alias("_to"))
    cut = chunks.where("chunk_id IS NOT NULL").select("chunk_id", "document_id", "text", F.col("start_offset").cast("bigint").alias("a"), F.col("end_offset").cast("bigint").alias("b"), "page_start", "page_end")
    binned = own.where("_to > _from").withColumn("_bin", _bins(F.col("_from"), F.col("_to"), width))
    spread = cut.where("a >= 0 AND b > a").select("chunk_id", "document_id", "a", "b").withColumn("_bin", _bins(F.col("a"), F.col("b"), width))
    met = spread.join(binned, ["document_id", "_bin"]).where("_from < b AND _to > a")
    # A pair meets in every bin that both reach; it is kept in the first.
    met = met.where(F.col("_bin") == F.floor(F.greatest("a", "_from") / width))
    part = F.expr("substring(_page, cast(greatest(a - _from, 0) + 1 AS int), cast(least(b, _to) - greatest(a, _from) AS int))")
    piece = F.struct("page_number", F.greatest("a", "_from").alias("x"), F.least("b", "_to").alias("y"), part.alias("t"))
    pieces = met.groupBy("chunk_id", "document_id", "a", "b").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    gap = lambda n: F.repeat(F.lit("\n"), n.cast("int"))
    said = F.concat(gap(F.col("p")[0]["x"] - F.col("a")), F.array_join(F.transform("p", lambda x: x["t"]), PAGE_BREAK), gap(F.col("b") - F.element_at("p", -1)["y"]))
    held = pieces.select("chunk_id", "document_id", "a", "b", said.alias("said"), F.col("p")[0]["page_number"].alias("first"), F.element_at("p", -1)["page_number"].alias("last"))
    known = own.select("document_id").distinct().withColumn("_known", F.lit(True))
    both = cut.join(held, ["chunk_id", "document_id", "a", "b"], "left").join(known, "document_id", "left")
    rules = {
        "unknown_document": F.col("_known").isNull(),
        "text_differs": F.col("_known") & ~F.coalesce(F.col("said") == F.col("text"), F.lit(False)),
        "page_range": F.col("_known") & ~F.coalesce((F.col("first") == F.col("page_start")) & (F.col("last") == F.col("page_end")), F.lit(False)),
        "tiny_chunk": F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) < least,
    }
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    of_chunks = both.select("document_id", "chunk_id", F.lit(None).cast("int").alias("page"), F.explode(broken).alias("problem"))
    with_text = own.where(F.length(F.regexp_replace("_page", r"(?U)\s+", "")) > 0).select("document_id", F.col("page_number").alias("page"))
    covered = met.select("document_id", F.col("page_number").alias("page")).distinct()
    of_pages = with_text.join(covered, ["document_id", "page"], "left_anti").select("document_id", F.lit(None).cast("string").alias("chunk_id"), "page", F.lit("uncovered_page").alias("problem"))
    return of_chunks.unionByName(of_pages).distinct()


__all__: Sequence[str] = ("ChunkSizes", "spans", "content_kind", "chunk_id", "page_spans", "joined_pages", "chunked_pages", "chunked", "empty_documents", "chunk_problems")
