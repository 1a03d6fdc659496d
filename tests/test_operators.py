import hashlib
import json
import math
import re
from collections import Counter

import pytest
from docketry.functions.text import compatible_words
from docketry.operators import answers, chunking, integrity, metrics, ranking, retrieval, selection, training_records
from docketry.sources.tables import one_per_key, tidy
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_tidy_and_one_per_key(spark):
    df = spark.createDataFrame([("\tA ", 1), ("a", 2), ("", 3), (" ", 4), (None, 5)], "k string, ingested_at int")
    assert [r[0] for r in df.orderBy("ingested_at").select(tidy("k")).collect()] == ["a", "a", None, None, None]
    got = one_per_key(df.withColumn("k", tidy("k")).withColumn("v", F.col("ingested_at")), "k", ["v"]).collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 2)]


def test_running_ranks_and_totals(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("cold", 1, 2), (None, 1, None), (None, 2, 3)]
    df = spark.createDataFrame(rows, "g string, id int, w int").withColumn("k", ranking.seeded_key(3, "id"))
    got = ranking.running(df, ["g"], "k", "id", F.col("w"), bits=4).collect()
    assert len(got) == len(rows)
    for g in ("hot", "cold", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r["before"] for r in own] == [sum(x["w"] or 0 for x in own[:i]) for i in range(len(own))]
    cut = ranking.running(df.withColumn("q", F.lit(17)), ["g"], "k", "id", upto="q").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in cut} == {"hot": 17, "cold": 1, None: 2}
    assert ranking.running(df.limit(0), ["g"], "k", "id").count() == 0


def brute_bm25(chunks, question, k):
    import re

    tok = lambda x: re.findall(r"[^\W]+(?:[-./]\w+)*", (x or "").lower())
    docs = {c: tok(t) for c, t in chunks}
    mean = max(sum(map(len, docs.values())) / len(docs), 1)
    scores = []
    for c, t in docs.items():
        tf, s = Counter(t), 0.0
        for w in set(tok(question)):
            df = sum(w in x for x in docs.values())
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        scores.append((-round(s, 9), c))
    return [(c, round(-s, 6)) for s, c in sorted(scores)[:k]]


def test_bm25_both_ways(spark):
    chunks = [("c1", "case CEN24LA001 on rwy-27"), ("c2", "a calm day"), ("c3", None), ("c4", "case case closed"), ("c5", "")]
    questions = [("q1", "Case CEN24LA001?"), ("q2", "nothing shared"), ("q3", None), ("q4", "calm case calm")]
    c = spark.createDataFrame(chunks, "chunk_id string, text string").withColumn("query_id", F.lit("clash"))
    q = spark.createDataFrame(questions, "query_id string, text string")
    for sent in (10**6, 0):
        got = retrieval.bm25_topk(c, q, 3, sent).orderBy("query_id", "rank").collect()
        for name, text in questions:
            assert [(r["chunk_id"], round(r["score"], 6)) for r in got if r["query_id"] == name] == brute_bm25(chunks, text, 3)
    assert retrieval.bm25_topk(c.limit(0), q, 3).count() == 0
    assert retrieval.bm25_topk(c, q.limit(0), 3).count() == 0


def test_fusion_searches_all_chunks_on_both_sides(spark, tmp_path):
    from docketry.plans import reference_queries

    # 120 short chunks of one rare word are ahead in BM25; the chunk with most of the question's terms is long.
    texts = {f"c{i:03d}": "zulu" for i in range(120)} | {"whole": "zulu alpha bravo charlie " + "filler " * 3000} | {f"d{i:03d}": "alpha bravo charlie filler" for i in range(400)}
    question = "zulu alpha bravo charlie"
    when = "timestamp'2024-01-01 00:00:00' AS ingested_at"
    spark.createDataFrame([(c, "d", t, "text") for c, t in texts.items()], "chunk_id string, document_id string, text string, kind string").selectExpr("*", when).write.parquet(f"{tmp_path}/chunks.parquet")
    test = spark.createDataFrame([("q", question, None, True, "", "test")], "example_id string, question string, evidence array<struct<chunk_id:string,quote:string>>, answerable boolean, reference_answer string, split string")
    test.selectExpr("*", when).write.parquet(f"{tmp_path}/retrieval_test.parquet")
    share = sorted((-len(set(question.split()) & set(t.split())) / 4, c) for c, t in texts.items())[:100]
    sums = Counter()
    for weight, side in ((0.25, [c for c, _ in brute_bm25(list(texts.items()), question, 100)]), (0.75, [c for _, c in share])):
        for rank, c in enumerate(side, 1):
            sums[c] += weight / (60 + rank)
    want = [c for _, c in sorted((-round(s, 9), c) for c, s in sums.items())[:10]]
    got = [r["chunk_id"] for r in reference_queries.hybrid_rrf(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == want and "whole" in got


def test_overlap_both_ways(spark):
    chunks = [("c1", "a b"), ("c2", "b b b"), ("c3", None), ("c4", "x c a b")]
    c = spark.createDataFrame(chunks, "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "a b c"), ("q2", "b"), ("q3", None), ("q4", "none")], "query_id string, text string")
    want = {"q1": ["c4", "c1", "c2"], "q2": ["c1", "c2", "c4"], "q3": ["c1", "c2", "c3"], "q4": ["c1", "c2", "c3"]}
    for sent in (10**6, 0):
        got = retrieval.overlap_topk(c, q, 3, sent).orderBy("query_id", "rank").collect()
        assert {n: [r["chunk_id"] for r in got if r["query_id"] == n] for n in want} == want
        assert [round(r["score"], 6) for r in got if r["query_id"] == "q1"] == [1.0, 0.666667, 0.333333]


def test_dense_order_and_clamp(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id int, embedding array<double>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r["vec_id"], r["rank"], r["score"]) for r in retrieval.dense_topk(v, q, 9).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (6, 2, 1.0), (2, 3, 0.0), (3, 4, 0.0)]
    assert retrieval.dense_topk(v, q.limit(0), 3).count() == 0


def test_dense_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 1, 1.0]) for i in range(40)], "vec_id int, embedding array<double>")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, retrieval.dense_topk(v, q, 3).collect()))
    assert len(whole) == 30 and sorted(map(tuple, retrieval.dense_topk(v, q, 3, sent_cells=12).collect())) == whole


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([("q", "shared", 1), ("q", "lex", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "dense", 1), ("q", "shared", 2)], "query_id string, chunk_id string, rank int")
    assert [r["chunk_id"] for r in retrieval.fused(a, b, 3, constant=1).orderBy("rank").collect()][0] == "shared"
    c = spark.createDataFrame([("q", "low", 1, -2.0), ("q", "high", 2, 10.0)], "query_id string, chunk_id string, rank int, s double")
    assert [(r["chunk_id"], r["score"]) for r in retrieval.reranked(c, F.col("s"), 2).orderBy("rank").collect()] == [("high", 12.0), ("low", 0.0)]


def test_context_budget_cuts_the_last(spark):
    p = spark.createDataFrame([("q", 1, "abcd"), ("q", 2, " "), ("q", 3, "efgh"), ("q", 4, "x")], "query_id string, rank int, text string")
    assert [(r["rank"], r["text"]) for r in retrieval.bounded_context(p, 6).orderBy("rank").collect()] == [(1, "abcd"), (3, "ef")]


def test_retrieval_scores(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1)], "query_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q1", "b")], "query_id string, chunk_id string")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    got = {r["query_id"]: r for r in metrics.retrieval_scores(hits, gold, queries).collect()}
    assert (got["q1"]["recall"], got["q1"]["reciprocal_rank"]) == (0.5, 0.5)
    assert got["q1"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["q2"]["recall"] is None and got["q3"]["ndcg"] is None


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("x", "", 0.0), ("a a b", "a b b", 2 * 2 / 6), (None, None, 1.0), ("Straße", "strasse", 1.0), ("ﬁve ½-inch", "FIVE 1⁄2-inch", 1.0), ("the well-known", "well known", 0.0)])
def test_token_f1(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(compatible_words("a").alias("a"), compatible_words("b").alias("b"))
    assert df.select(metrics.token_f1(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_numeric_and_facts(spark):
    df = spark.createDataFrame([("about 1,200 feet", 1200.0, ["the feet"]), ("N123AB", 123.0, ["x"]), (None, 1.0, ["x"]), ("", 1.0, [])], "a string, t double, f array<string>")
    got = df.select(metrics.numeric_match(F.col("a"), F.col("t")), metrics.all_mentioned(F.col("a"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, False)]


def test_percentiles_round_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 20, 30, None)], "n int")
    assert tuple(metrics.half_even_percentiles(df, "n", {"a": 0.0, "m": 0.5, "z": 1.0}).first()) == (10, 20, 30)
    assert tuple(metrics.half_even_percentiles(df.limit(0), "n", {"a": 0.5}).first()) == (None,)


def test_twenty_families(spark):
    fractions = (("train", 0.8), ("development", 0.1), ("test", 0.1))
    assert selection.largest_remainder(20, fractions) == {"train": 16, "development": 2, "test": 2}
    df = spark.createDataFrame([(f"event-{i:02d}",) for i in range(20)] * 2 + [(None,)], "f string")
    assert Counter(r["split"] for r in selection.family_splits(df, "f", fractions, "1").collect()) == {"train": 16, "development": 2, "test": 2}


def test_scoped_both_ways(spark):
    words = "engine runway pilot weather landing gear the of flap rudder".split()
    rows = [(f"c{i:02d}", f"s{i % 3}" if i % 7 else None, " ".join(words[(i * j) % 10] for j in range(1, 2 + i % 6)) if i % 11 else None) for i in range(40)]
    chunks = spark.createDataFrame([(*r, 1.0) for r in rows], "chunk_id string, scope string, text string, score double")
    queries = spark.createDataFrame([("q1", "s0", "engine of the pilot"), ("q2", "s1", "zebra"), ("q3", "none", "engine"), ("q4", None, "engine"), ("q5", "s0", None), ("q6", "s2", "flap flap rudder")], "query_id string, scope string, text string")
    for search in (retrieval.scoped_bm25, retrieval.scoped_overlap):
        near = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in search(chunks, queries, 7).collect())
        far = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in search(chunks, queries, 7, sent_cells=0).collect())
        assert near == far and {r[0] for r in near} == {"q1", "q2", "q5", "q6"} and sum(r[0] == "q2" for r in near) == 7
        assert search(chunks.limit(0), queries, 7).count() == 0 and search(chunks, queries.limit(0), 7).count() == 0
    assert {r["query_id"] for r in retrieval.empty_scopes(chunks, queries).collect()} == {"q3", "q4"}

def test_scopes_in_parts_and_repeated_questions(spark, monkeypatch):
    words = "engine runway pilot weather landing gear the of flap rudder".split()
    rows = [(f"c{i:03d}", f"s{i % 3}" if i % 4 else "hot", " ".join(words[(i * j) % 10] for j in range(1, 2 + i % 6)) if i % 11 else None) for i in range(160)]
    chunks = spark.createDataFrame(rows, "chunk_id string, scope string, text string")
    texts = ["engine of the pilot", "the pilot of engine", "zebra", None, "flap flap rudder", "weather landing"]
    asked = [(f"q{i:02d}", "hot" if i % 3 else f"s{i % 5}", texts[i % 6]) for i in range(40)]
    queries = spark.createDataFrame(asked, "query_id string, scope string, text string")
    plain = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    # Scores of all pairs that share a term, each written out: what a scope with many chunks and many questions can't afford.
    want = [plain(search(chunks, queries, 7, sent_cells=0)) for search in (retrieval.scoped_bm25, retrieval.scoped_overlap)]
    both = plain(retrieval.scoped_fused(chunks, queries, 3, 7, weight=0.25, sent_cells=0))
    for chunks_at_once, asked_at_once, cells, lines in ((32_000, 20_000, 10**6, 2000), (15, 3, 12, 4)):
        for name, value in (("SCOPE_CHUNKS", chunks_at_once), ("SCOPE_ASKED", asked_at_once), ("BLOCK_CELLS", cells), ("BLOCK_ROWS", lines)):
            monkeypatch.setattr(retrieval, name, value)
        # 20 cells are fewer than the questions of a scope times their terms, but more than the terms.
        assert [plain(search(chunks, queries, 7, sent_cells=20)) for search in (retrieval.scoped_bm25, retrieval.scoped_overlap)] == want
        assert plain(retrieval.scoped_fused(chunks, queries, 3, 7, weight=0.25, sent_cells=20)) == both
    plan = retrieval.scoped_bm25(chunks, queries, 7, sent_cells=20)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*\bterm#", plan)

@pytest.fixture(scope="module")
def one_report(spark, tmp_path_factory):
    """Tables of one report whose 2,100 questions with a term each make more than SENT_CELLS cells."""
    folder = str(tmp_path_factory.mktemp("report"))
    when = "timestamp'2024-01-01 00:00:00' AS ingested_at"
    chunks = [(f"c{i}", "doc-h", f"Word{i} was common. Nothing else was said.", "text") for i in range(4)]
    spark.createDataFrame(chunks, "chunk_id string, document_id string, text string, kind string").selectExpr("*", when).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([("E:report", "h", "E")], "source_document_id string, sha256 string, event_id string").selectExpr("*", when).write.parquet(f"{folder}/sources.parquet")
    asked = spark.range(2100).selectExpr(
        "concat('q', id) AS example_id", "concat('common word', id) AS question", "'E:report' AS report_id", "'E' AS event_id", "'test' AS split", "true AS answerable",
        "concat('Word', id, ' was common.') AS reference_answer", "cast(array() AS array<struct<chunk_id:string,quote:string>>) AS evidence", "'' AS provenance", "timestamp'2023-12-31 00:00:00' AS created_at", when,
    )
    asked.write.parquet(f"{folder}/retrieval_dev.parquet")
    return folder


@pytest.mark.parametrize("name", ["extracted_answers", "hybrid_scoped", "generation_summary", "task_accuracy", "extracted_summary"])
def test_no_pairs_of_question_and_chunk_are_written(spark, one_report, name):
    from docketry.plans import reference_queries

    out = reference_queries.QUERIES[name](spark, one_report)
    assert not re.search(r"Join .*\bterm#", out._jdf.queryExecution().optimizedPlan().toString())
    if name == "extracted_answers":
        right = {r["example_id"] for r in out.where("answer_correct").collect()}
        assert right == {"q0", "q1", "q2", "q3"}


def shuffled_bytes(spark, run):
    """Bytes that all jobs of run write to shuffles."""
    context = spark.sparkContext
    java, scala = context._jvm, context._jsc.sc()

    def stages():
        scala.listenerBus().waitUntilEmpty(30_000)
        held = scala.statusStore().stageList(None, False, False, context._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return {held.apply(i).stageId(): held.apply(i).shuffleWriteBytes() for i in range(held.size())}

    last = max(stages(), default=-1)
    run()
    return sum(n for i, n in stages().items() if i > last)


@pytest.fixture(scope="module")
def wide_report(spark, tmp_path_factory):
    """Tables of one report with 300 chunks of 6,500 letters each that hardly compress, one of them delivered twice, and three questions."""
    folder = str(tmp_path_factory.mktemp("wide"))
    text = "concat('Word', id, ' was common. ', array_join(transform(sequence(1, 100), x -> sha2(concat(id, '-', x), 256)), ' '))"
    chunks = spark.range(300).selectExpr("concat('c', id) AS chunk_id", "'doc-h' AS document_id", f"{text} AS text", "'text' AS kind", "timestamp'2024-01-01 00:00:00' AS ingested_at")
    older = chunks.where("chunk_id = 'c7'").withColumn("text", F.lit("Nothing.")).withColumn("ingested_at", F.expr("timestamp'2023-01-01 00:00:00'"))
    chunks.unionByName(older).write.parquet(f"{folder}/chunks.parquet")
    when = "timestamp'2024-01-01 00:00:00' AS ingested_at"
    spark.createDataFrame([("E:report", "h", "E")], "source_document_id string, sha256 string, event_id string").selectExpr("*", when).write.parquet(f"{folder}/sources.parquet")
    asked = spark.range(6, 9).selectExpr(
        "concat('q', id) AS example_id", "concat('common word', id) AS question", "'E:report' AS report_id", "'E' AS event_id", "'test' AS split", "true AS answerable",
        "concat('Word', id, ' was common.') AS reference_answer", "cast(array() AS array<struct<chunk_id:string,quote:string>>) AS evidence", "'' AS provenance", "timestamp'2023-12-31 00:00:00' AS created_at", when,
    )
    asked.write.parquet(f"{folder}/retrieval_dev.parquet")
    return folder


@pytest.mark.parametrize("name", ["extracted_answers", "generation_summary", "task_accuracy", "extracted_summary"])
def test_only_texts_that_are_asked_for_are_shuffled(spark, wide_report, name):
    from docketry.plans import reference_queries

    rows = []
    written = shuffled_bytes(spark, lambda: rows.extend(reference_queries.QUERIES[name](spark, wide_report).collect()))
    assert written < 300 * 6500 / 4
    if name == "extracted_answers":
        assert {r["example_id"]: r["answer_correct"] for r in rows} == {"q6": True, "q7": True, "q8": True}


@pytest.fixture(scope="module")
def many_reports(spark, tmp_path_factory):
    """Tables of 20 reports with 100 chunks, all of the same 200 words in an order of their own; the question of each report asks for ten of them."""
    folder = str(tmp_path_factory.mktemp("many"))
    when = "timestamp'2024-01-01 00:00:00' AS ingested_at"
    text = "concat(array_join(transform(array_sort(transform(sequence(0, 199), x -> struct(xxhash64(id, x) AS h, x AS x))), y -> concat('w', y.x)), ' '), '.')"
    spark.range(2000).selectExpr("concat('c', id) AS chunk_id", "concat('doc-h', id % 20) AS document_id", f"{text} AS text", "'text' AS kind", when).write.parquet(f"{folder}/chunks.parquet")
    spark.range(20).selectExpr("concat('E', id, ':report') AS source_document_id", "concat('h', id) AS sha256", "concat('E', id) AS event_id", when).write.parquet(f"{folder}/sources.parquet")
    asked = spark.range(20).selectExpr(
        "concat('q', id) AS example_id", "array_join(transform(sequence(0, 9), x -> concat('w', 10 * id + x)), ' ') AS question", "concat('E', id, ':report') AS report_id", "concat('E', id) AS event_id", "'test' AS split", "true AS answerable",
        "'Word.' AS reference_answer", "cast(array() AS array<struct<chunk_id:string,quote:string>>) AS evidence", "'' AS provenance", "timestamp'2023-12-31 00:00:00' AS created_at", when,
    )
    asked.write.parquet(f"{folder}/retrieval_dev.parquet")
    return folder


@pytest.mark.parametrize("name", ["generation_summary", "task_accuracy", "extracted_summary"])
def test_only_terms_that_a_scope_asks_for_are_shuffled(spark, many_reports, name):
    from docketry.plans import reference_queries

    rows = []
    written = shuffled_bytes(spark, lambda: rows.extend(reference_queries.QUERIES[name](spark, many_reports).collect()))
    assert written < 2000 * 200  # a byte for each word of a chunk
    if name == "generation_summary":
        assert {(r["variant"], r["examples"]) for r in rows} == {("rag", 20), ("passage", 20)}


@pytest.fixture(scope="module")
def asked_texts(spark, tmp_path_factory):
    """Tables of one report with 300 chunks of 6,500 letters each that hardly compress, each the best of a question and with such a sentence for it."""
    folder = str(tmp_path_factory.mktemp("asked"))
    text = "concat('Word', id, ' was common. ', array_join(transform(sequence(1, 100), x -> sha2(concat(id, '-', x), 256)), ' '))"
    when = "timestamp'2024-01-01 00:00:00' AS ingested_at"
    spark.range(300).selectExpr("concat('c', id) AS chunk_id", "'doc-h' AS document_id", f"{text} AS text", "'text' AS kind", when).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([("E:report", "h", "E")], "source_document_id string, sha256 string, event_id string").selectExpr("*", when).write.parquet(f"{folder}/sources.parquet")
    asked = spark.range(300).selectExpr(
        "concat('q', id) AS example_id", "concat('common word', id) AS question", "'E:report' AS report_id", "'E' AS event_id", "'test' AS split", "true AS answerable",
        "concat('Word', id, ' was common.') AS reference_answer", "cast(array() AS array<struct<chunk_id:string,quote:string>>) AS evidence", "'' AS provenance", "timestamp'2023-12-31 00:00:00' AS created_at", when,
    )
    asked.write.parquet(f"{folder}/retrieval_dev.parquet")
    return folder


@pytest.mark.parametrize("name", ["generation_summary", "task_accuracy", "extracted_summary"])
def test_texts_are_shuffled_once(spark, asked_texts, name):
    from docketry.plans import reference_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = []
        written = shuffled_bytes(spark, lambda: rows.extend(reference_queries.QUERIES[name](spark, asked_texts).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written < 1.5 * 300 * 6500
    if name == "generation_summary":
        assert {(r["variant"], r["examples"], r["token_f1"]) for r in rows if r["variant"] == "passage"} == {("passage", 300, 1.0)}


def test_selected_candidates(spark):
    rows = [(f"s{i}", f"e{i}", f"f{i % 5}", "u" if i % 4 else " ", [f"a:{i % 3}", f"b:{i % 2}"]) for i in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source_id string, event_id string, family string, url string, features array<string>, place int")
    used = spark.createDataFrame([("f1",), (None,)], "family string")
    got = selection.selected_candidates(df, used, [("test", 2), ("development", 1), ("train", 3)], "7").orderBy("place").collect()
    assert [r["split"] for r in got] == ["test", "test", "development", "train", "train", "train"] and len({r["event_id"] for r in got}) == 6
    assert all(int(r["source_id"][1:]) % 5 != 1 and int(r["source_id"][1:]) % 4 for r in got)
    with pytest.raises(ValueError, match="eligible"):
        selection.selected_candidates(df, used, [("test", 20)], "7")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=3), min_size=0, max_size=12), st.integers(0, 6))
def test_diverse_like_one_by_one(spark, sets, target):
    df = spark.createDataFrame([(f"s{i}", f) for i, f in enumerate(sets)], "source_id string, features array<string>")
    left = sorted((hashlib.sha256(f"x\0s{i}".encode()).hexdigest(), f"s{i}", f) for i, f in enumerate(sets))
    seen, want = set(), []
    while left and len(want) < target:
        best = max(range(len(left)), key=lambda i: (len(set(left[i][2]) - seen), -i))
        seen |= set(left[best][2])
        want.append(left.pop(best)[1])
    assert [r["source_id"] for r in selection.diverse(df, target, "x").orderBy("place").collect()] == want


def test_diverse_prefers_what_is_new(spark):
    df = spark.createDataFrame([("a", ["y:1", "s:x"]), ("b", ["y:1", "s:x"]), ("c", ["y:2", "s:z"])], "source_id string, features array<string>")
    got = [r["source_id"] for r in selection.diverse(df, 2, "s").orderBy("place").collect()]
    assert "c" in got and len(got) == 2


def test_integrity(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert [(r["k"], r["n_rows"]) for r in integrity.repeated_keys(a, ["k"]).collect()] == [("x", 2)]
    assert [(r["k"], r["n_rows"]) for r in integrity.missing_parents(a, "k", b, "k").collect()] == [("x", 2)]
    assert sorted((r["k"], r["side"]) for r in integrity.unequal_sides(a, b, "k").collect()) == [("x", "left_only"), ("z", "right_only")]
    assert integrity.pending(a.limit(0), b, ["k"]).count() == 0


def test_uncovered_pages(spark):
    c = spark.createDataFrame([("d", 1, 2), ("d", 5, 5), ("e", None, None)], "document_id string, page_start int, page_end int")
    assert sorted((r["document_id"], r["page"]) for r in integrity.uncovered_pages(c).collect()) == [("d", 3), ("d", 4)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ab.\n😀é", max_size=400))
def test_chunk_spans(text):
    sizes = chunking.ChunkSizes(40, 10, 8, 10)
    got = list(chunking.spans(text, sizes))
    covered = set()
    for a, b in got:
        assert 0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() and b - a <= sizes.target + sizes.reach
        covered |= set(range(a, b))
    assert all(text[i].isspace() or i in covered for i in range(len(text)))
    assert all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_chunked_documents(spark):
    long = "1.1 FINDINGS\n\n" + "A sentence of some words. " * 200
    df = spark.createDataFrame([("d", long), ("e", None), ("f", "  \n"), ("g", "a | b\nc | d")], "document_id string, text string")
    got = chunking.chunked(df).collect()
    assert all(long[r["start_offset"] : r["end_offset"]] == r["text"] for r in got if r["document_id"] == "d")
    assert {r["section"] for r in got if r["document_id"] == "d"} == {"1.1 FINDINGS"}
    assert {(r["document_id"], r["kind"]) for r in got} == {("d", "text"), ("g", "table")}
    assert chunking.chunked(df.limit(0)).count() == 0


def paged(spark, *texts):
    return spark.createDataFrame([("d", i, t, "clash") for i, t in enumerate(texts, 1)], "document_id string, page_number int, text string, chunk_id string")


def test_chunks_stay_within_pages(spark):
    pages = paged(spark, "First page sentence. " * 50, "Second page sentence. " * 50, None, "")
    whole = chunking.joined_pages(pages).first()["text"]
    got = chunking.chunked_pages(pages, chunking.ChunkSizes(240, 40, 80, 50)).collect()
    assert {r["page_start"] for r in got} == {1, 2} and all(r["page_start"] == r["page_end"] and whole[r["start_offset"] : r["end_offset"]] == r["text"] for r in got)
    assert all("First" not in r["text"] or "Second" not in r["text"] for r in got)
    assert chunking.empty_documents(pages).count() == 0 and chunking.empty_documents(paged(spark, "", " \n")).count() == 1


def test_worked_chunks(spark):
    one = chunking.chunked_pages(paged(spark, "", "Column A    Column B\nValue 1     Value 2\nValue 3     Value 4"), chunking.ChunkSizes(200, 20, 40, 40)).collect()
    assert [(r["page_start"], r["kind"]) for r in one] == [(2, "table")]
    titled = chunking.chunked_pages(paged(spark, "PROBABLE CAUSE\n\nThe probable cause was loss of control. " * 10), chunking.ChunkSizes(220, 30, 80, 40)).collect()
    assert all(r["section"] == "PROBABLE CAUSE" for r in titled)
    bare = chunking.chunked_pages(paged(spark, "Useful report content.", "Agency\n\nSubstantive transcript content.", "AGENCY"), header="agency").orderBy("start_offset").collect()
    assert [r["text"] for r in bare] == ["Useful report content.", "Substantive transcript content."]
    dotted = "A useful sentence. " * 90 + "Probable Cause" + "." * 120 + " 42\n" + "Next section. " * 90
    starts = [a for a, _ in chunking.spans(dotted, chunking.ChunkSizes())]
    assert all(b - a >= 320 for a, b in zip(starts, starts[1:], strict=False))
    overlapping = list(chunking.spans("Sentence one. Sentence two. Sentence three. " * 20, chunking.ChunkSizes(180, 40, 80, 40)))
    assert len(overlapping) > 2 and all(x[0] < y[0] < x[1] for x, y in zip(overlapping, overlapping[1:], strict=False))
    with pytest.raises(ValueError, match="overlap"):
        chunking.ChunkSizes(target=100, overlap=100)
    assert chunking.ChunkSizes().fingerprint != chunking.ChunkSizes(reach=1).fingerprint


def test_places_of_cuts_and_headings():
    sizes = chunking.ChunkSizes(40, 0, 10, 15)
    assert [b for _, b in chunking.spans("a" * 30 + "\n \n  " + "b" * 60, sizes)][0] == 30  # the paragraph end near the aim
    assert [b for _, b in chunking.spans("a" * 20 + ". " + "b" * 5 + ". " + "c" * 60, sizes)][0] == 28  # the last sentence in reach
    assert [b for _, b in chunking.spans("a. " + "b" * 90, sizes)][0] == 40  # a sentence out of reach doesn't count
    page = chunking._Page("intro\n1.2 FINDINGS (A)\ntext\n2\n\nCAUSE OF IT\nNot one\n3 Also not\nTOO\nLAST-LINE")
    assert [t for *_, t in page.titles] == ["1.2 FINDINGS (A)", "2\n\nCAUSE OF IT", "LAST-LINE"]
    assert page.section(0, 12) is None and page.section(0, 30) == "1.2 FINDINGS (A)" and page.section(40, 60) == "2\n\nCAUSE OF IT"
    assert page.section(0, 15) == "1.2 FINDI"  # a line cut by the end of the chunk counts as it is


def test_chunk_problems(spark):
    pages = paged(spark, "First page. " * 30, "Second page. " * 30, "   ", "Fourth")
    chunks = chunking.chunked_pages(pages, chunking.ChunkSizes(100, 10, 30, 20))
    assert chunking.chunk_problems(chunks, pages, 3, 64).count() == 0
    rows = [
        ("a", "d", "First", 0, 5, 1, 1), ("b", "d", "Xirst", 0, 5, 1, 1), ("c", "d", "page. \n\nSecond", 354, 368, 1, 2), ("e", "d", "page. \n\nSecond", 354, 368, 1, 1), ("f", "z", "x", 0, 1, 1, 1), ("g", "d", "\nSecond", 361, 368, 2, 2),
        ("h", "d", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "chunk_id string, document_id string, text string, start_offset int, end_offset int, page_start int, page_end int, said string")
    got = {(r["chunk_id"], r["page"], r["problem"]) for r in chunking.chunk_problems(df, pages, 2, 64).collect()}
    assert got == {("b", None, "text_differs"), ("e", None, "page_range"), ("f", None, "unknown_document"), ("f", None, "tiny_chunk"), ("h", None, "text_differs"), ("h", None, "page_range"), (None, 4, "uncovered_page")}
    assert chunking.chunk_problems(df.limit(0), pages.limit(0)).count() == 0


def output(**changed):
    return json.dumps({"answer": "It landed safely.", "citations": [{"chunk_id": "c", "quote": "landed safely"}], "abstained": False, "abstention_reason": None} | changed)


WORKED = [
    (output(answer="It\u00a0 \tlanded safely."), "It landed safely.", 1, None, []),
    ("```json\n" + output() + "\n```", "It landed safely.", 1, None, []),
    ("``` " + output() + "```", "It landed safely.", 1, None, []),
    (None, None, 0, "insufficient evidence", ["empty_output"]),
    (" \n", None, 0, "insufficient evidence", ["empty_output"]),
    ("plain answer", None, 0, "insufficient evidence", ["invalid_json"]),
    (output() + " x", None, 0, "insufficient evidence", ["invalid_json"]),
    ("{" + " " * 16_384, None, 0, "insufficient evidence", ["output_too_long"]),
    ('{"answer": "unsupported"}', None, 0, "insufficient evidence", ["malformed_output"]),
    ("[]", None, 0, "insufficient evidence", ["malformed_output"]),
    (output(abstained=1), None, 0, "insufficient evidence", ["malformed_output"]),
    (output(citations=[{"chunk_id": "c"}]), None, 0, "insufficient evidence", ["malformed_output"]),
    (output(citations=[{"chunk_id": "c", "quote": None}]), None, 0, "insufficient evidence", ["malformed_output"]),
    (output(citations=[{"chunk_id": "z", "quote": "landed safely"}]), None, 0, "insufficient evidence", ["invalid_citation", "insufficient_evidence"]),
    (output(citations=[{"chunk_id": "z", "quote": "no"}, {"chunk_id": " c ", "quote": "landed\n safely"}, {"chunk_id": "c", "quote": "The aircraft  landed"}, {"chunk_id": "c", "quote": "The aircraft landed"}]), "It landed safely.", 1, None, ["invalid_citation"]),
    (output(citations=[]), None, 0, "insufficient evidence", ["insufficient_evidence"]),
    (output(answer=" "), None, 0, "insufficient evidence", ["insufficient_evidence"]),
    (output(answer=None, citations=[], abstained=True, abstention_reason="Not\u00a0enough"), None, 0, "Not enough", []),
    (output(answer=None, citations=[], abstained=True), None, 0, "insufficient evidence", []),
    (output(citations=[], abstained=True), None, 0, "insufficient evidence", ["malformed_output"]),
    (output(answer=None, abstained=True), None, 0, "insufficient evidence", ["malformed_output"]),
]


def test_answers_by_contract(spark):
    df = spark.createDataFrame([(i, r[0], ["c", "d"], ["The aircraft\u00a0landed safely.", None]) for i, r in enumerate(WORKED)], "n int, raw string, i array<string>, t array<string>")
    got = {r["n"]: r["o"] for r in df.select("n", answers.postprocess(F.col("raw"), F.col("i"), F.col("t")).alias("o")).collect()}
    for n, (_, answer, citations, reason, warnings) in enumerate(WORKED):
        assert (got[n]["answer"], len(got[n]["citations"]), got[n]["abstention_reason"], got[n]["warnings"], got[n]["abstained"]) == (answer, citations, reason, warnings, answer is None), WORKED[n]
    twice = spark.createDataFrame([(output(), ["c", "c"], ["a", "b"])], "raw string, i array<string>, t array<string>")
    assert twice.select(answers.postprocess(F.col("raw"), F.col("i"), F.col("t")).alias("o")).first()["o"]["warnings"] == ["duplicate_evidence"]
    assert answers.plain_space(" A\u00a0 B\r\n\tC ") == "A B\nC"


def test_failure_classes(spark):
    rows = [
        ('{"a":', ["invalid_json"], False, 9, "incomplete_json"), ('{"a":', ["invalid_json"], False, 10, "generation_truncation"), ("plain", ["invalid_json"], False, 1, "non_json_output"),
        ("{}", ["malformed_output"], False, 1, "schema_violation"), ("{}", ["invalid_citation", "insufficient_evidence"], False, 1, "incorrect_citation"), ("{}", ["insufficient_evidence"], False, 1, "missing_citation"),
        (None, ["empty_output"], False, None, "other_contract_failure"), ("{}", [], False, 1, "unexpected_abstention"), ("{}", [], True, 1, None), (None, None, None, None, "unexpected_abstention"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, raw string, w array<string>, correct boolean, used int, want string")
    got = df.select("n", "want", answers.failure_class(F.col("raw"), F.col("w"), F.lit(True), F.col("correct"), F.col("used"), F.lit(10)).alias("f")).collect()
    assert all(r["f"] == r["want"] for r in got), got


def test_contract_summary(spark):
    df = spark.createDataFrame([("a", True, ["x"], False, 10.0), ("a", None, [], None, None), ("b", True, None, True, 4.0)], "v string, correct boolean, warnings array<string>, abstained boolean, latency_ms double")
    got = {r["v"]: tuple(r)[1:] for r in answers.contract_summary(df, "v").collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5, 0.0, 10.0), "b": (1, 1.0, 1.0, 0.0, 1.0, 4.0)}
    assert answers.contract_summary(df.limit(0), "v").count() == 0


def test_records(spark):
    df = spark.createDataFrame([("f1", "k1", "Same answer."), ("f1", "k2", "Other."), ("f2", "k3", "same  answer."), ("f2", "k4", "Third."), (None, "k5", "x")], "fam string, key string, ans string")
    got = [(r["fam"], r["key"]) for r in training_records.round_robin(df, "fam", "key", "ans", 3, 4).collect()]
    assert got == [("f1", "k1"), ("f2", "k4"), ("f1", "k2")]
    near = training_records.neighbours(df, "key").collect()
    assert len(near) == 10 and all(r["key"] != r["neighbour"] for r in near)


def test_rounds_drop_only_what_has_been_dealt(spark):
    rows = [("a", f"k{i}", f"answer {i}") for i in range(6)] + [("b", f"m{i}", f"answer {i}") for i in range(6)] + [("c", "n0", "answer 0"), ("d", "o0", "answer 1"), ("d", "o1", "answer 9")]
    df = spark.createDataFrame(rows, "fam string, key string, ans string")
    for target in (1, 3, 5, 7, 20):
        waiting, dealt, want = {f: [(k, x) for g, k, x in rows if g == f] for f in "abcd"}, set(), []
        for number in (1, 2, 3, 4):
            for f in "abcd":
                left = [(k, x) for k, x in waiting[f] if x not in dealt]
                if left and len(want) < target:
                    dealt.add(left[0][1])
                    want.append((f, left[0][0], number))
        got = [tuple(r) for r in training_records.round_robin(df, "fam", "key", "ans", target, 4).collect()]
        assert got == want
    assert {x for x in want if x[0] == "b"} and training_records.round_robin(df.limit(0), "fam", "key", "ans", 5, 4).count() == 0


def test_grounded_records(spark):
    df = spark.createDataFrame([("e", "What?", "c1", 'It "stopped".', 'It "stopped".'), ("e", "What?", "c2", "x", None)], "event string, q string, chunk string, text string, s string")
    got = [r["r"] for r in df.select(training_records.grounded_record("sft-", F.col("event"), F.col("q"), F.col("chunk"), F.col("text"), F.col("s"), "Be exact.").alias("r")).collect()]
    assert got[0]["record_id"] == "sft-" + hashlib.sha256(b'e\0c1\0It "stopped".').hexdigest()[:16]
    assert [m["role"] for m in got[0]["messages"]] == ["system", "user", "assistant"]
    assert answers.processed(got[0]["messages"][2]["content"], {"c1": 'It "stopped".'})["answer"] == 'It "stopped".'


def test_whole_gate_and_letter_share(spark):
    good = "The operator had removed the valve from forty airplanes before the engine was tested again."
    rows = [
        (good, None), (good[:70] + ".", "length_or_termination"), (good[:-1], "length_or_termination"), (good * 4, "length_or_termination"), ("é" + good, "sentence_fragment"), ("12 " + good, "footnote_fragment"), (good.replace("forty", "4 0"), "list_or_page_fragment"), ("Table " + good, "document_boilerplate"),
        (good.replace("forty", "the section 4"), "section_cross_reference"), ("10:20:30 " + good.lower(), "transcript_fragment"), (good.replace("valve from", "valve.” The"), "fused_sentences"), ("Ensure that " + good, "isolated_operational_instruction"),
        (good.replace("forty", "1.2 Forty"), "heading_or_url"), ("See HTTP " + good, "heading_or_url"), ("A-1 on " + good, "reference_or_heading"), (good.replace("forty", "f orty"), "split_word"), (good.replace("forty", "(forty )"), "broken_punctuation"), (good.replace("forty", "“forty"), "unbalanced_quote"),
        (good.replace("forty", '"x-ray" "Beta'), "unbalanced_quote"), (good.replace("forty", "12forty"), "ocr_fragment"), (good.replace("forty", "forty- five"), "ocr_fragment"), (good.replace("forty", "Château- Lorne"), None), ("“" + good + "”.", "sentence_fragment"), (None, "length_or_termination"),
    ]
    df = spark.createDataFrame(rows, "s string, r string")
    assert [r[0] for r in df.select(training_records.gate_reason(F.col("s"))).collect()] == [r for _, r in rows]
    added = df.limit(1).select(training_records.gate_reason(F.col("s"), {"merged_word": ["Forty Air"]}).alias("r"))
    assert [r[0] for r in added.collect()] == ["merged_word"]
    digits = "The engine 1234567890 1234567890 1234567890 1234567890 had stopped 1234567890 1234567890."
    texts = spark.createDataFrame([("a", " " + good + " The engine had stopped by then."), ("b", digits)], "k string, t string")
    assert [tuple(r) for r in training_records.best_sentence(texts, "k", "t", ["engine"]).collect()] == [("a", good, 1)]
