import hashlib
import json

import pytest
from docketry.operators.chunking import ChunkSizes
from docketry.sources import corpus
from pyspark.sql import functions as F

SIZES = ChunkSizes(100, 10, 3, 20)


def parts(spark):
    pages = spark.createDataFrame([("d1", 1, "One page. " * 30), ("d1", 2, "Two. "), ("d2", 1, "Other text here.")], "document_id string, page_number int, text string")
    sources = spark.createDataFrame([("d1", "s1", "F1", "u"), ("d2", "s2", "F2", "u")], "document_id string, sha256 string, event_family_id string, url string")
    splits = spark.createDataFrame([("F1", "train"), ("F2", "test")], "event_family_id string, split string")
    return pages, sources, splits


def test_build_once(spark, tmp_path):
    pages, sources, splits = parts(spark)
    folder = str(tmp_path / "corpus")
    first = corpus.build_corpus(pages, sources, splits, folder, SIZES)
    assert first == corpus.build_corpus(pages.repartition(5), sources, splits, folder, SIZES) and first["fingerprint"] == SIZES.fingerprint
    assert {r["split"] for r in spark.read.parquet(folder + "/sources").collect()} == {"train", "test"}
    assert json.loads((tmp_path / "corpus" / "build.json").read_text())["tables"] == first["tables"]
    with pytest.raises(FileExistsError):
        corpus.build_corpus(pages.where("document_id = 'd2'"), sources, splits, folder, SIZES)


def test_problems_stop_a_build(spark, tmp_path):
    pages, sources, splits = parts(spark)
    cases = [
        (pages, sources.where("document_id = 'd1'"), splits.where("event_family_id = 'F1'"), "unknown_source"), (pages, sources, splits.where("event_family_id = 'F1'"), "family_left_only"),
        (pages, sources.withColumn("sha256", F.lit("s")), splits, "duplicate_source"),
    ]
    for n, (p, s, f, problem) in enumerate(cases):
        with pytest.raises(ValueError, match=problem):
            corpus.build_corpus(p, s, f, str(tmp_path / str(n)), SIZES)
        assert not (tmp_path / str(n)).exists()
    tiny = corpus.build_corpus(pages, sources, splits, str(tmp_path / "tiny"), ChunkSizes(100, 10, 50, 20))
    assert tiny["warnings"] > 0


def test_freeze_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5]), (2, None, [1.5])], "k int, v string, w array<double>")
    assert corpus.content_digest(df) == corpus.content_digest(df.repartition(3).select("w", "k", "v")) != corpus.content_digest(df.distinct())
    folder = str(tmp_path / "frozen")
    assert corpus.broken_freeze(spark, folder)
    digest = corpus.freeze(df, folder)
    assert corpus.freeze(df, folder) == digest and not corpus.broken_freeze(spark, folder)
    with pytest.raises(FileExistsError):
        corpus.freeze(df.limit(1), folder)
    df.limit(1).write.mode("append").parquet(folder + "/rows")
    assert corpus.broken_freeze(spark, folder)
    assert corpus.content_digest(df.limit(0)).startswith("0-")


def test_index_and_manifest(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    folder = str(tmp_path / "index")
    assert corpus.write_index(vectors, folder)["width"] == 2
    assert {r["vec_id"]: r["embedding"] for r in corpus.read_index(spark, folder).collect()} == {1: [1.0, 0.0], 2: [0.5, 0.5]}
    spark.read.parquet(folder + "/vectors").limit(1).write.mode("append").parquet(folder + "/vectors")
    with pytest.raises(ValueError):
        corpus.read_index(spark, folder)
    for rows in ([(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        with pytest.raises(ValueError):
            corpus.write_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), str(tmp_path / "bad"))
    corpus.write_manifest(vectors.repartition(3), str(tmp_path / "manifest"), "vec_id")
    lines = [x for f in sorted((tmp_path / "manifest").glob("part-*")) for x in f.read_text().splitlines()]
    assert [json.loads(x)["vec_id"] for x in lines] == [1, 2]


def test_digest_of_many_rows(spark, tmp_path):
    from docketry.plans.corpus_queries import document_digest

    own = spark.range(150_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").when(F.col("id") % 50 == 1, "de").alias("lang"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    own.write.parquet(f"{tmp_path}/documents.parquet")
    sums = {}
    for r in own.toLocalIterator():
        row = "\1".join((str(r["doc_id"]), r["lang"] or "?", "\2" if r["text"] is None else r["text"]))
        sums[r["lang"] or "?"] = sums.get(r["lang"] or "?", 0) + int(hashlib.sha256(row.encode()).hexdigest()[:12], 16)
    assert 2**63 < sums["en"] < 2**64 and sums["de"] < 2**63  # at 64 bits the largest sum turns negative
    want = {k: v - 2**64 if v >= 2**63 else v for k, v in sums.items()}
    assert {r["lang"]: r["digest"] for r in document_digest(spark, str(tmp_path)).collect()} == want
