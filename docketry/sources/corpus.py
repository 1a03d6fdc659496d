"""A corpus as one plan: pages and sources to validated chunks, written once with a record of how it was made; frozen
datasets, manifests and vector indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.chunking import ChunkSizes, chunk_problems, chunked_pages, page_spans
from docketry.operators.integrity import repeated_keys, unequal_sides
from docketry.session import cut_lineage

RECORD = "build.json"


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of df, whatever their order and partitions: the sum of 120 bits of a SHA-256 per row, with
    the number of rows. Columns count by name; rows are aggregated before anything is sent."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)"))
    n, x, y = df.agg(F.count("*"), F.coalesce(part(1), F.lit(0)), F.coalesce(part(16), F.lit(0))).first()
    return f"{n}-{int(x):x}-{int(y):x}"


def corpus_problems(pages: DataFrame, chunks: DataFrame, sources: DataFrame, splits: DataFrame, least: int) -> DataFrame:
    """(problem, subject) of a corpus that may not be written, and of tiny chunks, which only warn.

    sources: document_id, sha256, event_family_id; splits: event_family_id, split, one per family. Problems are those of
    chunk_problems, duplicate_source (several documents of one content), unknown_source (a document without a source),
    chunk_id_repeated, and family_left_only or family_right_only where the splits don't name exactly the families.
    """
    of_chunks = chunk_problems(chunks, pages, least).select("problem", F.coalesce("chunk_id", F.concat_ws(" page ", "document_id", F.col("page").cast("string"))).alias("subject"))
    same = sources.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.countDistinct("document_id").alias("n")).where("n > 1").select(F.lit("duplicate_source").alias("problem"), F.col("sha256").alias("subject"))
    documents = pages.where("document_id IS NOT NULL").select("document_id").distinct()
    unknown = documents.join(sources.select("document_id"), "document_id", "left_anti").select(F.lit("unknown_source").alias("problem"), F.col("document_id").alias("subject"))
    twice = repeated_keys(chunks, ["chunk_id"]).select(F.lit("chunk_id_repeated").alias("problem"), F.col("chunk_id").alias("subject"))
    sides = unequal_sides(sources, splits, "event_family_id").select(F.concat(F.lit("family_"), "side").alias("problem"), F.col("event_family_id").alias("subject"))
    return of_chunks.unionByName(same).unionByName(unknown).unionByName(twice).unionByName(sides)


def build_corpus(pages: DataFrame, sources: DataFrame, splits: DataFrame, folder: str, sizes: ChunkSizes | None = None, header: str | None = None) -> dict:
    """Cuts pages into chunks, checks the corpus (see corpus_problems) and writes pages, chunks and sources with their split
    to folder, with a record of the build, which is returned.

    Any problem but tiny chunks raises before anything is written; the message names ten of them. The same build in the
    same folder writes nothing; another content in a folder that has a corpus raises. Null documents are left out.
    """
    sizes = sizes or ChunkSizes()
    chunks = cut_lineage(chunked_pages(pages, sizes, header))
    problems = cut_lineage(corpus_problems(pages, chunks, sources, splits, sizes.least))
    errors = problems.where("problem != 'tiny_chunk'")
    if examples := errors.orderBy("problem", "subject").limit(10).collect():
        raise ValueError(f"{errors.count()} problems, among them {[tuple(r) for r in examples]}")
    tables = {"pages": page_spans(pages), "chunks": chunks, "sources": sources.join(splits, "event_family_id")}
    record = {
        "fingerprint": sizes.fingerprint, "sizes": {k: getattr(sizes, k) for k in ("target", "overlap", "least", "reach")}, "warnings": problems.count(),
        "tables": {name: content_digest(df) for name, df in tables.items()},
    }
    return write_once(tables, folder, record)


def _file(spark: SparkSession, path: str) -> tuple:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str | None:
    name, files = _file(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if files.exists(name) else None


def write_once(tables: dict[str, DataFrame], folder: str, record: dict) -> dict:
    """Writes tables below folder and then record as JSON with sorted keys, as the mark of a whole build.

    Where the record is there already, an equal one means that nothing is to be done, and another raises: what was
    frozen is never replaced. Tables of an earlier build that didn't end are replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    said = json.dumps(record, sort_keys=True, indent=2, ensure_ascii=False)
    before = _text(spark, f"{folder}/{RECORD}")
    if before is not None:
        if json.loads(before) != json.loads(said):
            raise FileExistsError(f"{folder} holds another build")
        return record
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    name, files = _file(spark, f"{folder}/{RECORD}")
    out = files.create(name, True)
    try:
        out.write(bytearray((said + "\n").encode()))
    finally:
        out.close()
    return record


def freeze(rows: DataFrame, folder: str) -> str:
    """Writes rows to folder once, with their digest, which is returned; writing other rows there raises."""
    digest = content_digest(rows)
    write_once({"rows": rows}, folder, {"digest": digest})
    return digest


def broken_freeze(spark: SparkSession, folder: str) -> bool:
    """Whether the rows of a frozen folder are no longer those of its digest, or there is no whole one."""
    record = _text(spark, f"{folder}/{RECORD}")
    return record is None or json.loads(record)["digest"] != content_digest(spark.read.parquet(f"{folder}/rows"))


def write_manifest(rows: DataFrame, folder: str, key: str) -> None:
    """rows as JSON lines in the order of key over all files; a range sort, so no task holds them all."""
    rows.orderBy(key).write.mode("errorifexists").json(folder)


def write_index(vectors: DataFrame, folder: str) -> dict:
    """vectors (vec_id, embedding) as 32-bit floats, with their number, length and digest. Vectors of several lengths, null
    ones and null or repeated ids raise."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    count, ids, least, width, nulls = own.agg(F.count("*"), F.count_distinct("vec_id"), F.min(F.size("embedding")), F.max(F.size("embedding")), F.count_if(F.col("embedding").isNull())).first()
    if nulls or ids != count or least != width:
        raise ValueError("vectors need different ids and one length")
    return write_once({"vectors": own}, folder, {"count": count, "width": width, "digest": content_digest(own)})


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of write_index; raises where their number or length isn't what its record says."""
    record = json.loads(_text(spark, f"{folder}/{RECORD}") or "{}")
    own = spark.read.parquet(f"{folder}/vectors")
    count, least, width = own.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if count != record.get("count") or (count and not least == width == record.get("width")):
        raise ValueError("the index isn't whole")
    return own
