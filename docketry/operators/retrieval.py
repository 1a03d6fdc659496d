"""Retrieval for sets of questions: BM25, exact cosine, rank fusion, reranking, scopes and context budgets.

A question set is searched against all rows at once. While it is small (its size is checked), every task gets it as a
matrix, scores its own rows for all questions and keeps the best k of each; only those are shuffled and merged. A larger
set meets the postings in a shuffle by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docketry.functions.text import STOP_WORDS, fold, sentences, tokens
from docketry.session import cut_lineage
from docketry.sources.tables import ROW_BITS, set_bits

K1, B = 1.2, 0.75
#: Questions times their different terms (or dimensions) that are sent to all tasks, 8 bytes each.
SENT_CELLS = 4_000_000
#: Candidates that a task holds before they are cut to the best, if that is more than 4 k per query.
HELD_ROWS = 400_000


def ranked(scores: DataFrame, k: int, by: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The best k rows per query with rank; order by score rounded to 9 places, then item. Rows must be unique."""
    order = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(block: np.ndarray, ids: np.ndarray, names: list, k: int, item: str) -> pd.DataFrame:
    """The best k of each column of scores (rows: items in ids, columns: queries in names)."""
    k, rounded = min(k, len(ids)), np.round(block, 9)
    order = np.argsort(ids, kind="stable")
    rows = order[np.argsort(-rounded[order], axis=0, kind="stable")[:k]]
    picked = np.take_along_axis(block, rows, axis=0)
    return pd.DataFrame({"query_id": np.tile(names, len(rows)), item: ids[rows.ravel()], "score": picked.ravel()})


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def _statistics(own: DataFrame, terms: list[str]) -> tuple[int, float, dict[str, int]]:
    """(chunks, mean length of at least 1, chunks per term) of own (terms ARRAY<STRING>), in one pass over the texts."""
    sent = own.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, n, length = sent.value, np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            row, term, sizes = _places(batch.column(0), known)
            found += np.bincount(np.unique(row * max(len(known), 1) + term) % max(len(known), 1), minlength=len(known)) if len(row) else 0
            n, length = n + len(sizes), length + int(sizes.sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1, -2], pa.int32()), pa.array([*found[at], n, length], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in own.select("terms").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = sums.pop(-1, 0)
    return n, max(1.0, sums.pop(-2, 0) / max(n, 1)), {terms[i]: v for i, v in sums.items()}


def _places(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in known) of the items of a list column that are in known, and the length of each list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = pc.index_in(lists.flatten(), value_set=known)
    hit = place.is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)[hit], place.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """(query_id, chunk_id, rank, score): the best k of chunks (chunk_id, text) for each of queries (query_id, text).

    Terms of a question count once; k1 is 1.2 and b 0.75; document numbers, frequencies and mean length are over all
    chunks, the mean at least 1. Chunks without any term have score 0 and fill the ranks by id, so each query has
    min(k, chunks) rows. Ids are taken to be unique; null texts are empty.
    """
    own, wanted = chunks.select("chunk_id", tokens("text").alias("terms")), _asked(queries)
    count, different = queries.count(), wanted.select("term").distinct().count()
    if count * max(different, 1) > sent_cells:
        return _filled(ranked(_bm25_scores(own, wanted), k), own, queries, k)
    terms = [r[0] for r in wanted.select("term").distinct().orderBy("term").collect()]
    n, mean, df = _statistics(own, terms)
    idf = {t: float(np.log(1 + (n - v + 0.5) / (v + 0.5))) for t, v in df.items()}

    def weigh(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        return counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))

    return _sent_topk(own, queries, wanted, idf, weigh, k)


def overlap_topk(chunks: DataFrame, queries: DataFrame, k: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """(query_id, chunk_id, rank, score): the best k of all chunks (chunk_id, text) by the share of a question's
    different terms that they have; see overlap. Chunks without any term fill the ranks by id, as in bm25_topk.
    """
    own, wanted = chunks.select("chunk_id", F.array_distinct(tokens("text")).alias("terms")), _asked(queries)
    count, different = queries.count(), wanted.select("term").distinct().count()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("_size"))
    if count * max(different, 1) > sent_cells:
        hits = own.select("chunk_id", F.explode("terms").alias("term")).join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("_hits"))
        scores = hits.join(sizes, "query_id").select("query_id", "chunk_id", (F.col("_hits") / F.col("_size")).alias("score"))
        return _filled(ranked(scores, k), own, queries, k)
    asked = {r[0]: 1.0 for r in wanted.select("term").distinct().collect()}
    counted = _sent_topk(own, queries, wanted, asked, lambda counts, length: counts, k).join(sizes, "query_id", "left")
    return counted.withColumn("score", F.coalesce(F.col("score") / F.col("_size"), F.lit(0.0))).select("query_id", "chunk_id", "rank", "score")


def _sent_topk(own: DataFrame, queries: DataFrame, wanted: DataFrame, values: dict[str, float], weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """The best k of own (chunk_id, terms) by the sum over a question's terms of their values times weigh(counts of the
    terms in a chunk, its length); the questions are sent to all tasks."""
    names = [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]
    terms = sorted(values)
    place = {t: i for i, t in enumerate(terms)}
    column = {q: i for i, q in enumerate(names)}
    asked = np.zeros((len(place), len(names)))
    for r in wanted.collect():
        if r["term"] in place:
            asked[place[r["term"]], column[r["query_id"]]] = values[r["term"]]
    sent = own.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), asked, names))
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *own.schema)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, names = sent.value
        best: pd.DataFrame | None = None
        for batch in batches if len(names) else ():
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                row, term, sizes = _places(part.column(1), known)
                weights = np.bincount(row * max(len(known), 1) + term, minlength=len(sizes) * len(known)).reshape(len(sizes), len(known)).astype(float)
                ids = np.array(part.column(0).to_pylist(), object)
                found = _best(weigh(weights, sizes[:, None]) @ asked, ids, names, k, "chunk_id")
                best = found if best is None else pd.concat([best, found])
                if len(best) > max(4 * k * len(names), HELD_ROWS):
                    best = _kept(best, k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(_kept(best, k), preserve_index=False)

    near = own.mapInArrow(score, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
    return ranked(near, k).select("query_id", "chunk_id", "rank", "score")


def _kept(best: pd.DataFrame, k: int) -> pd.DataFrame:
    item = best.columns[1]
    ordered = best.assign(_s=-best["score"].round(9)).sort_values(["query_id", "_s", item], kind="stable")
    kept = ordered.groupby("query_id", sort=False).head(k).drop(columns="_s")
    return kept.astype({c: object for c in kept.columns[:2]})  # ids as plain objects: joined string columns come in pieces


#: Parts that the postings of a term are cut into where they meet many questions, so that no frequent term is one task.
TERM_PARTS = 16


def _bm25_scores(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term (and a scope, where both sides have one).

    Postings are cut to the questions' terms first. A term's postings are dealt to TERM_PARTS parts by chunk and the
    questions repeated for each, so a term or scope with a third of all rows is spread.
    """
    scope = ["scope"] if "scope" in wanted.columns else []
    n, mean = own.agg(F.count("*"), F.greatest(F.coalesce(F.avg(F.size("terms")), F.lit(0.0)), F.lit(1.0))).first()
    known = wanted.select("term").distinct()
    every = own.select("chunk_id", *scope, F.size("terms").alias("len"), F.explode("terms").alias("term"))
    postings = every.groupBy("chunk_id", *scope, "len", "term").agg(F.count("*").alias("tf"))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df")).join(known, "term", "left_semi")
    weighted = wanted.join(frequencies, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    parts = postings.withColumn("w", weight).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_PARTS)).cast("int"))
    repeated = weighted.select("query_id", *scope, "term", "idf", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))).alias("part"))
    return parts.join(repeated, [*scope, "term", "part"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("idf")).alias("score"))


def _filled(positive: DataFrame, own: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k with score above 0, and score 0 by id where a query has fewer."""
    held = positive.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = queries.join(held, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < k).select("query_id")
    # Only the first 2 k ids can fill ranks: at most k of them are taken already.
    first = [F.lit(r[0]) for r in own.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]
    ids = F.array(*first) if first else F.array().cast("array<string>")
    fill = short.withColumn("chunk_id", F.explode(ids)).withColumn("score", F.lit(0.0))
    zeros = fill.join(positive.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return ranked(positive.select("query_id", "chunk_id", "score").unionByName(zeros), k).select("query_id", "chunk_id", "rank", "score")


def scoped_bm25(chunks: DataFrame, queries: DataFrame, k: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """bm25 within a scope: chunks (chunk_id, scope, text), queries (query_id, scope, text), rows of equal scope only.

    Frequencies, number and mean length stay those of all chunks; the scope cuts candidates after that and before ranks.
    A question has min(k, chunks of its scope) rows, those without shared terms with score 0. A scope without chunks or
    a null scope gives none; empty_scopes names those questions, so that a caller can refuse them.
    """
    wanted = _asked_in_scopes(queries)
    if wanted.select("term").distinct().count() > sent_cells:
        return _scoped_topk(_bm25_scores(chunks.select("chunk_id", "scope", tokens("text").alias("terms")), wanted), chunks, queries, k)
    near, names = _scope_ranks(chunks, queries, wanted, ("bm25",), k)
    return _for_each(ranked(near, k), names)


def _asked_in_scopes(queries: DataFrame) -> DataFrame:
    return queries.where("scope IS NOT NULL").select("query_id", "scope", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def scoped_overlap(chunks: DataFrame, queries: DataFrame, k: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """As scoped_bm25, by the share of a question's different terms that a chunk has."""
    wanted = _asked_in_scopes(queries)
    if wanted.select("term").distinct().count() > sent_cells:
        sizes = wanted.groupBy("query_id").agg(F.count("*").alias("size"))
        repeated = wanted.join(sizes, "query_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))))
        own = chunks.select("chunk_id", "scope", F.explode(F.array_distinct(tokens("text"))).alias("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_PARTS)).cast("int").alias("part"))
        scores = own.join(repeated, ["scope", "term", "part"]).groupBy("query_id", "chunk_id", "size").agg(F.count("*").alias("_h"))
        return _scoped_topk(scores.select("query_id", "chunk_id", (F.col("_h") / F.col("size")).alias("score")), chunks, queries, k)
    near, names = _scope_ranks(chunks, queries, wanted, ("overlap",), k)
    return _for_each(ranked(near, k), names)


def scoped_fused(chunks: DataFrame, queries: DataFrame, k: int, held: int, weight: float = 0.5, constant: int = 60, sent_cells: int = SENT_CELLS) -> DataFrame:
    """fused over the best held of scoped_bm25 and of scoped_overlap, both from one pass over the chunks."""
    wanted = _asked_in_scopes(queries)
    if wanted.select("term").distinct().count() > sent_cells:
        return fused(scoped_bm25(chunks, queries, held, sent_cells), scoped_overlap(chunks, queries, held, sent_cells), k, weight, constant)
    near, names = _scope_ranks(chunks, queries, wanted, ("bm25", "overlap"), held, (k, weight, constant))
    order = Window.partitionBy("query_id", "side").orderBy(F.round("score", 9).desc(), "chunk_id")
    own = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= held)
    part = F.when(F.col("side") == 0, F.lit(weight) / (constant + F.col("rank"))).when(F.col("side") == 1, F.lit(1 - weight) / (constant + F.col("rank"))).otherwise(F.col("score"))
    return _for_each(ranked(own.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")), k), names)


def _for_each(ranks: DataFrame, names: DataFrame) -> DataFrame:
    """ranks (query_id, chunk_id, rank, score) of the questions that stand for others, for each question of names."""
    return names.join(ranks.withColumnRenamed("query_id", "_of"), "_of").select("query_id", "chunk_id", "rank", "score")


#: Chunks, and different questions, of a scope that meet in one task; a scope of more is cut into parts. Both sides of a
#: scope are repeated for the other's parts.
SCOPE_CHUNKS, SCOPE_ASKED = 32_000, 20_000
#: Cells of a block that a task scores at once, and rows of a scope that it gathers for that.
BLOCK_CELLS, BLOCK_ROWS = 1_000_000, 2_000


def _packed(row: np.ndarray, term: np.ndarray, n: int, kind: str) -> pa.Array:
    """The terms of each of n rows as bytes of kind; row is in order."""
    ends = np.searchsorted(row, np.arange(n + 1)) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(term.astype(kind).tobytes())])


def _squeezed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _bit_places(scope: np.ndarray, term: np.ndarray, bits: int) -> np.ndarray:
    """A place below bits, a power of two, for each pair of a scope's hash and a term's number; -1 stands for the scope itself."""
    mixed = scope.view(np.uint64) ^ (np.asarray(term, np.int64) + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ mixed >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _has_bits(bits: np.ndarray, scope: np.ndarray, term: np.ndarray) -> np.ndarray:
    place = _bit_places(scope, term, 8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _pair_bits(numbered: DataFrame, byte: str) -> np.ndarray:
    """Bytes with a bit set for each scope of numbered (h1, terms) and each pair of it with a term: for one in MARK_SHARE or
    so of all other pairs too, more where that takes more than MOST_BITS."""
    width = np.dtype(byte).itemsize
    count = numbered.agg(F.coalesce(F.sum(F.octet_length("terms") / width + 1), F.lit(0)).cast("bigint")).first()[0]
    bits = set_bits(count)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scope, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in lists], np.int64) // width
            place = np.concatenate([_bit_places(scope, np.int64(-1), bits), _bit_places(np.repeat(scope, sizes), np.frombuffer(b"".join(lists), byte).astype(np.int64), bits)])
            place = np.unique(place)
            yield pa.RecordBatch.from_arrays([pa.array(place // ROW_BITS, pa.int32()), pa.array(place % ROW_BITS, pa.int64())], names=["row", "place"])

    out = np.zeros(bits // 8, np.uint8)
    # The pairs themselves are shuffled: they are fewer bytes than the bits of many tasks.
    for r in numbered.select("h1", "terms").mapInArrow(pairs, "row int, place bigint").repartition("row").groupBy("row").agg(F.bitmap_construct_agg("place").alias("bits")).toLocalIterator():
        first = r["row"] * (ROW_BITS // 8)
        out[first : first + ROW_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _scope_ranks(chunks: DataFrame, queries: DataFrame, wanted: DataFrame, sides: tuple[str, ...], k: int, fusion: tuple[int, float, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, side, score) with the best k of each side and part of a scope, and names (_of, query_id).

    Questions of a scope with the same terms are one, named by the least query_id; names has all that it stands for.
    Texts are read once: a chunk goes on as its numbered terms that a question of its scope has (and a few others, see
    _pair_bits), squeezed in a checkpoint, and meets the questions of its scope in a task that keeps the best k, so no
    pair of question and chunk is ever written but these. Chunks of scopes without a question don't go on.
    side is the place in sides. With fusion, a scope of one part gives its fused best as side 2, all others both sides.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *chunks.schema)}
    context = chunks.sparkSession.sparkContext
    known = wanted.select("term").distinct().orderBy("term").toArrow().column(0).combine_chunks()
    sent = context.broadcast(known)
    byte = "<u2" if len(known) <= 1 << 16 else "<u4"
    # Two hashes of 64 bits stand for a scope.
    keys = [F.when(F.col("scope").isNotNull(), F.xxhash64("scope")).alias("h1"), F.xxhash64(F.lit("scope"), "scope").alias("h2")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, sizes = _places(batch.column(3), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(row, term, len(sizes), byte)], names=["query_id", "h1", "h2", "terms"])

    asked = queries.where("scope IS NOT NULL").select("query_id", *keys, F.array_sort(F.array_distinct(tokens("text"))).alias("terms"))
    numbered = asked.mapInArrow(number, f"query_id {kinds['query_id']}, h1 bigint, h2 bigint, terms binary")
    different = numbered.groupBy("h1", "h2", "terms").agg(F.min("query_id").alias("_of"))
    names = numbered.join(different, ["h1", "h2", "terms"]).select("_of", "query_id")
    sent_bits = context.broadcast(_pair_bits(numbered, byte))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, found, n, length = sent.value, sent_bits.value, np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            row, term, sizes = _places(batch.column(3), known)
            found += np.bincount(np.unique(row * max(len(known), 1) + term) % max(len(known), 1), minlength=len(known)) if len(row) else 0
            n, length = n + len(sizes), length + int(sizes.sum())
            scope = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
            kept = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & _has_bits(bits, scope, np.int64(-1))
            hit = kept[row] & _has_bits(bits, scope[row], term)
            own = [*(batch.column(i).filter(pa.array(kept)) for i in range(3)), pa.array(sizes[kept]), _packed((np.cumsum(kept) - 1)[row[hit]], term[hit], int(kept.sum()), byte)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([_squeezed(pa.RecordBatch.from_arrays(own, names=names_held))], pa.binary())], names=["term", "n", "rows"])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1, -2], pa.int32()), pa.array([*found[at], n, length], pa.int64()), pa.nulls(len(at) + 2, pa.binary())], names=["term", "n", "rows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                yield from pa.ipc.open_stream(rows.as_buffer())

    names_held = ["chunk_id", "h1", "h2", "size", "terms"]
    own = chunks.select("chunk_id", *keys, tokens("text").alias("terms"))
    every = cut_lineage(own.mapInArrow(code, "term int, n bigint, rows binary"))
    sums = {r["term"]: r["n"] for r in every.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = sums.pop(-1, 0)
    mean, idf = max(1.0, sums.pop(-2, 0) / max(n, 1)), np.zeros(len(known))
    for i, v in sums.items():
        idf[i] = np.log(1 + (n - v + 0.5) / (v + 0.5))

    held = every.where("term IS NULL").select("rows").mapInArrow(unpack, f"chunk_id {kinds['chunk_id']}, h1 bigint, h2 bigint, size bigint, terms binary")
    large = [
        df.groupBy("h1", "h2").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
        for df, most, name in ((held, SCOPE_CHUNKS, "_parts"), (different, SCOPE_ASKED, "_slices"))
    ]
    # A scope is in one of these per SCOPE_CHUNKS chunks or SCOPE_ASKED questions at most.
    cuts = F.broadcast(cut_lineage(large[0].join(large[1], ["h1", "h2"], "full").select("h1", "h2", F.coalesce("_parts", F.lit(1)).alias("_parts"), F.coalesce("_slices", F.lit(1)).alias("_slices"))))
    parts, slices = F.coalesce("_parts", F.lit(1)), F.coalesce("_slices", F.lit(1))
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = different.join(cuts, ["h1", "h2"], "left").withColumn("part", upto(parts)).select("h1", "h2", "part", F.pmod(F.xxhash64("_of"), slices).cast("int").alias("slice"), "_of", F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), parts.cast("bigint").alias("size"), "terms")
    right = held.join(cuts, ["h1", "h2"], "left").withColumn("slice", upto(slices)).select("h1", "h2", F.pmod(F.xxhash64("chunk_id"), parts).cast("int").alias("part"), "slice", F.lit(None).cast(kinds["query_id"]).alias("_of"), "chunk_id", "size", "terms")
    # Chunks without an id aren't expected, so a row is a question where it has one.
    both = left.unionByName(right).repartition("h1", "h2", "part", "slice").sortWithinPartitions("h1", "h2", "part", "slice", F.col("_of").isNull(), "chunk_id")
    sent_idf, cells, lines = chunks.sparkSession.sparkContext.broadcast(idf), BLOCK_CELLS, BLOCK_ROWS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, ready = None, None, []
        for batch in batches:
            keys = [batch.column(i) for i in range(4)]
            change = np.zeros(batch.num_rows, bool)
            for c in keys:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if (key := tuple(c[a].as_py() for c in keys)) != last:
                    if group:
                        ready += group.best()
                    group, last = _Scope(sides, k, fusion, sent_idf.value, mean, byte, cells, lines), key
                group.add(batch.slice(a, b - a))
            if sum(map(len, ready)) > lines:
                yield from ready
                ready = []
        yield from [*ready, *(group.best() if group else [])]

    near = both.mapInArrow(search, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, side int, score double")
    return near, names


class _Scope:
    """The best k chunks per side for each question of a part of a scope: first its questions come, then its chunks in order of their ids."""

    def __init__(self, sides: tuple[str, ...], k: int, fusion: tuple[int, float, int] | None, idf: np.ndarray, mean: float, byte: str, cells: int, lines: int) -> None:
        self.sides, self.k, self.fusion, self.idf, self.mean, self.byte, self.cells, self.lines = sides, k, fusion, idf, mean, byte, cells, lines
        self.asked, self.ids, self.waiting, self.held, self.whole = [], [], [], 0, False
        self.blocks: list | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows - batch.column(4).null_count
        if n:
            self.asked.append(batch.slice(0, n))
        if n < batch.num_rows and self.asked:
            self.waiting.append(batch.slice(n))
            self.held += batch.num_rows - n
            if self.held >= self.lines:
                self._score()

    def _terms(self, batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """(terms of all rows one after the other, number of each row's)."""
        lists = [x.to_numpy(zero_copy_only=False) for x in (b.column(7) for b in batches)]
        lists = [x for part in lists for x in part]
        return np.frombuffer(b"".join(lists), self.byte).astype(np.int64), np.array([len(x) for x in lists], np.int64) // np.dtype(self.byte).itemsize

    def _cut(self) -> None:
        """Questions in blocks of at most so many cells of their terms times themselves."""
        terms, sizes = self._terms(self.asked)
        self.whole = self.asked[0].column(6)[0].as_py() == 1
        self.blocks, first, ends = [], 0, np.concatenate([[0], np.cumsum(sizes)])
        while first < len(sizes):
            cells = (ends[first + 1 :] - ends[first]) * np.arange(1, len(sizes) - first + 1)
            until = first + max(1, int(np.searchsorted(cells, self.cells, "right")))
            own, place = np.unique(terms[ends[first] : ends[until]], return_inverse=True)
            column = np.repeat(np.arange(until - first), sizes[first:until])
            state = {s: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(until - first, -np.inf)) for s in self.sides}
            self.blocks.append((own, place, column, sizes[first:until], state))
            first = until

    def _score(self) -> None:
        if self.blocks is None:
            self._cut()
        offset = sum(map(len, self.ids))
        self.ids += [b.column(5) for b in self.waiting]
        terms, sizes = self._terms(self.waiting)
        length = np.concatenate([b.column(6).to_numpy() for b in self.waiting])[:, None]
        row, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        self.waiting, self.held = [], 0
        for own, place, column, asked, state in self.blocks:
            t, a = max(len(own), 1), len(asked)
            at = np.minimum(np.searchsorted(own, terms), t - 1)
            hit = own[at] == terms if len(own) else np.zeros(len(terms), bool)
            in_row, in_own = row[hit], at[hit]
            values = np.zeros((t, a))
            step = max(1, self.cells // max(t, a))
            ends = np.searchsorted(in_row, np.arange(0, n + step, step))
            for i in range(0, n, step):
                upto = min(step, n - i)
                mine = slice(ends[i // step], ends[i // step + 1])
                counts = np.bincount((in_row[mine] - i) * t + in_own[mine], minlength=upto * t).reshape(upto, t).astype(float)
                for side in self.sides:
                    if side == "bm25":
                        values[place, column] = self.idf[own[place]] if len(place) else 0
                        scores = counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[i : i + upto] / self.mean)) @ values
                    else:
                        values[place, column] = 1
                        scores = np.minimum(counts, 1) @ values / np.maximum(asked, 1)
                    state[side] = self._kept(scores, offset + i, *state[side])

    def _kept(self, scores: np.ndarray, offset: int, column: np.ndarray, row: np.ndarray, score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state with rows of scores, which come after all others, so a row as good as the kth is too late."""
        n, near = scores.shape[0], 2e-9
        bound = np.partition(scores, n - self.k, axis=0)[n - self.k] if n > self.k and not len(column) else least
        r, c = np.nonzero(scores >= bound - near)
        found = scores[r, c]
        new = np.round(found, 9) > np.round(least, 9)[c]
        r, c, found = r[new], c[new], found[new]
        if not len(r):
            return column, row, score, least
        column, row, score = np.concatenate([column, c]), np.concatenate([row, r + offset]), np.concatenate([score, found])
        column, row, score, place = self._first(column, row, score, self.k)
        last = place == self.k - 1
        least = least.copy()
        least[column[last]] = score[last]
        return column, row, score, least

    @staticmethod
    def _first(column: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each column, in order, with their places from 0."""
        order = np.lexsort((row, -np.round(score, 9), column))
        column, row, score = column[order], row[order], score[order]
        place = np.arange(len(column)) - np.searchsorted(column, column)
        kept = place < k
        return column[kept], row[kept], score[kept], place[kept]

    def best(self) -> list[pa.RecordBatch]:
        if self.waiting:
            self._score()
        if not self.blocks:
            return []
        asked, ids = pa.concat_arrays([b.column(4) for b in self.asked]), pa.concat_arrays(self.ids)
        out, first = [], 0
        for *_, sizes, state in self.blocks:
            found = [(i, *state[s][:3]) for i, s in enumerate(self.sides)]
            if self.fusion and self.whole:
                found = [(len(self.sides), *self._fused([x[1:] for x in found]))]
            for side, column, row, score in found:
                out.append(pa.RecordBatch.from_arrays([asked.take(pa.array(column + first)), ids.take(pa.array(row)), pa.array(np.full(len(row), side), pa.int32()), pa.array(score)], names=["query_id", "chunk_id", "side", "score"]))
            first += len(sizes)
        return out

    def _fused(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, weight, constant = self.fusion
        width = sum(map(len, self.ids))
        pairs, parts = [], []
        for (column, row, _), w in zip(found, (weight, 1 - weight)):
            pairs.append(column * width + row)
            parts.append(w / (constant + np.arange(1, len(column) + 1) - np.searchsorted(column, column)))
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        sums = np.bincount(at, np.concatenate(parts), len(pair))
        return self._first(pair // width, pair % width, sums, k)[:3]


def _scoped_topk(scores: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of scores, filled up with score 0 by id from the question's scope.

    At most k of a scope's first 2 k ids can be taken already, so these are all that can fill. They are found per part of
    a scope first, so that a scope of any size is cut before it is ranked.
    """
    best = ranked(scores, k).select("query_id", "chunk_id", "score")
    by_part = Window.partitionBy("scope", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy("chunk_id")
    sought = queries.where("scope IS NOT NULL").select("scope").distinct()
    near = chunks.join(sought, "scope", "left_semi").select("scope", "chunk_id").withColumn("_n", F.row_number().over(by_part)).where(F.col("_n") <= 2 * k)
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("chunk_id"))).where(F.col("_n") <= 2 * k).drop("_n")
    held = best.groupBy("query_id").agg(F.count("*").alias("_h"))
    short = queries.select("query_id", "scope").join(held, "query_id", "left").where(F.coalesce("_h", F.lit(0)) < k)
    fill = short.join(first, "scope").select("query_id", "chunk_id", F.lit(0.0).alias("score")).join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return ranked(best.unionByName(fill), k).select("query_id", "chunk_id", "rank", "score")


def empty_scopes(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, scope) of questions whose scope is null or has no chunk."""
    return queries.select("query_id", "scope").join(chunks.select("scope").distinct(), "scope", "left_anti").select("query_id", "scope")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, sent_cells: int = SENT_CELLS) -> DataFrame:
    """(query_id, vec_id, rank, score): exact cosine of vectors (vec_id, embedding) and queries (query_id, embedding).

    Order by score, then id; scores below 0 keep their rank and show 0. Null vectors and vectors of norm 0 or of another
    length than the queries' are in no row. Queries of more than sent_cells values are searched in blocks by a hash of
    their ids, so that the driver and each task hold one block at a time.
    """
    asked = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", "embedding")
    cells, least, width = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != width:
        raise ValueError("queries of several lengths")
    if cells <= sent_cells:
        return _dense_block(vectors, asked, k, width or 0)
    count = -(-2 * cells // max(sent_cells, 1))  # blocks are half full on average: hashes don't fill them alike
    block = F.pmod(F.xxhash64("query_id"), F.lit(count))
    return reduce(DataFrame.unionByName, [_dense_block(vectors, asked.where(block == i), k, width) for i in range(count)])


def _dense_block(vectors: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    rows = queries.collect()
    names = [r[0] for r in rows]
    asked = np.array([r[1] for r in rows], float).reshape(len(rows), width)
    norms = np.linalg.norm(asked, axis=1, keepdims=True) if len(rows) else np.ones((0, 1))
    sent = vectors.sparkSession.sparkContext.broadcast((asked / np.where(norms == 0, 1, norms), names))
    q_kind, v_kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, names = sent.value
        best: pd.DataFrame | None = None
        step = max(1, SENT_CELLS // max(len(names), 1))  # so many rows are scored at once
        for batch in batches:
            if not len(batch) or not names:
                continue
            for part in (batch[i : i + step] for i in range(0, len(batch), step)):
                block = np.stack(part["embedding"].to_numpy()).astype(float)
                norm = np.linalg.norm(block, axis=1)
                block, ids = block[norm > 0] / norm[norm > 0, None], part["vec_id"].to_numpy()[norm > 0]
                if len(ids):
                    found = _best(block @ asked.T, ids, names, k, "vec_id")
                    best = _kept(found if best is None else pd.concat([best, found]), k)
        if best is not None:
            yield best

    own = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == width)).select("vec_id", "embedding")
    near = own.mapInPandas(score, f"query_id {q_kind}, vec_id {v_kind}, score double")
    return ranked(near, k, item="vec_id").select("query_id", "vec_id", "rank", F.greatest("score", F.lit(0.0)).alias("score"))


def fused(lexical: DataFrame, dense: DataFrame, k: int, weight: float = 0.5, constant: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of two rankings (query_id, chunk_id, rank): weight / (constant + rank), missing sides 0."""
    parts = lexical.select("query_id", "chunk_id", (F.lit(weight) / (constant + F.col("rank"))).alias("part")).unionByName(
        dense.select("query_id", "chunk_id", (F.lit(1 - weight) / (constant + F.col("rank"))).alias("part"))
    )
    return ranked(parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), k).select("query_id", "chunk_id", "rank", "score")


def reranked(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The best k of candidates (query_id, chunk_id, rank, ...) by score, then candidate rank, then id.

    The score given out is relative to the least of the rows kept, so the last is 0.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("_s").desc(), "rank", "chunk_id")
    kept = candidates.withColumn("_s", score).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    least = F.min("_s").over(Window.partitionBy("query_id"))
    return kept.select("query_id", "chunk_id", F.col("_r").alias("rank"), (F.col("_s") - least).alias("score"))


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's different terms that text has; 0 for a question without terms."""
    asked = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def bounded_context(passages: DataFrame, limit: int) -> DataFrame:
    """Passages (query_id, rank, text) in rank order up to limit characters; the last is cut, blank ones are left out."""
    own = passages.where(F.length(F.trim("text")) > 0)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_b", before).where(F.col("_b") < limit).withColumn("text", F.expr(f"substring(text, 1, cast({limit} - _b as int))")).drop("_b")


def nearest_sentence(question: Column, text: Column, most: int = 420) -> Column:
    """The sentence of text with most different terms of question, the earliest if several, cut to most characters.

    Terms have three characters at least and aren't stop words. The sentence is given as it stands in text, blanks before
    the first one included, so that it can be cited. Null where text is null or blank.
    """
    asked = F.array_distinct(F.filter(tokens(question), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))
    said = F.transform(sentences(text), lambda s, i: F.when(F.length(F.trim(s)) > 0, F.struct(F.size(F.array_intersect(asked, tokens(s))).alias("hits"), (-i).alias("first"), s.alias("sentence"))))
    return F.substring(F.array_max(said)["sentence"], 1, most)


def context_passage(pairs: DataFrame, most: int = 420) -> DataFrame:
    """(query_id, passage) of pairs (query_id, question, text), one per query; see nearest_sentence. Blank texts give no
    row."""
    return pairs.select("query_id", nearest_sentence(F.col("question"), F.col("text"), most).alias("passage")).where("passage IS NOT NULL")


def term_spread(chunks: DataFrame) -> DataFrame:
    """(term, df, cf): in how many chunks each term is and how often; combined before the shuffle."""
    each = chunks.select("chunk_id", F.explode(tokens("text")).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


__all__ = ["bm25_topk", "overlap_topk", "scoped_bm25", "scoped_overlap", "scoped_fused", "empty_scopes", "dense_topk", "fused", "reranked", "overlap", "bounded_context", "nearest_sentence", "context_passage", "term_spread", "ranked", "fold"]
