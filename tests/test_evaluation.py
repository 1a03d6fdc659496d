import datetime

from docketry.operators import evaluation, integrity
from pyspark.sql import functions as F

SPAN = "array<struct<chunk_id:string,quote:string>>"
TARGET = "struct<value:double,tolerance:double,day:date,clock:string,required:array<string>,label:string>"


def test_key_differences(spark):
    a = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "k string")
    b = spark.createDataFrame([("a", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 2), (None, 3)], "k string, _n int")
    assert {tuple(r) for r in evaluation.key_differences(a, b, "k").collect()} == {("b", "missing"), ("c", "repeated"), ("d", "extra")}
    assert evaluation.key_differences(a.limit(0), b.limit(0), "k").count() == 0


EXAMPLES = [
    ("right", True, "The Rudder.", [("c1", "q1"), ("c1", "q1"), ("c2", "q2")], "clash"), ("wrong", True, "rudder", [("c1", "q1")], None), ("kept", False, None, [], None),
    ("told", False, None, None, None), ("shy", True, "rudder", [("c1", "q1")], None), ("nulls", None, None, None, None), ("left out", True, "x", [], None),
]
PREDICTIONS = [
    ("right", "a rudder", [("c1", "q1"), ("c2", "q2")], False, {"c1": "has q1", "c2": "has q2"}), ("wrong", "wing", [("c1", "q1"), ("c1", "q9")], False, {"c1": "has q1"}), ("kept", None, [], True, {}),
    ("told", "wing", None, False, None), ("shy", None, None, True, None), ("nulls", None, None, None, None),
]


def scored(spark):
    e = spark.createDataFrame(EXAMPLES, f"example_id string, answerable boolean, reference_answer string, evidence {SPAN}, chunks string")
    p = spark.createDataFrame(PREDICTIONS, f"example_id string, answer string, citations {SPAN}, abstained boolean, chunks map<string,string>")
    return evaluation.answer_scores(e, p), e, p


def test_answer_scores(spark):
    scores, e, p = scored(spark)
    got = {r["example_id"]: r for r in scores.collect()}
    assert set(got) == {"right", "wrong", "kept", "told", "shy", "nulls"}
    assert (got["right"]["answer_correct"], got["right"]["citation_precision"], got["right"]["citation_recall"], got["right"]["span_validity"], got["right"]["failures"]) == (True, 1, 1, 1, [])
    assert got["wrong"]["failures"] == ["answer_mismatch", "incorrect_citation", "invalid_citation_span"] and got["wrong"]["span_validity"] == 0.5
    assert got["kept"]["answer_correct"] and got["kept"]["failures"] == []
    assert got["told"]["failures"] == ["missed_abstention", "missing_citation"] and not got["told"]["answer_correct"]
    assert got["shy"]["failures"] == ["missing_gold_citation", "unexpected_abstention"] and got["shy"]["citation_precision"] == 0
    assert got["nulls"]["failures"] == ["missed_abstention", "missing_citation"]
    assert evaluation.answer_scores(e.limit(0), p).count() == 0 and evaluation.answer_scores(e, p.limit(0)).count() == 0


def test_answer_summary(spark):
    scores, _, _ = scored(spark)
    out = {r["slice"]: r for r in evaluation.answer_summary(scores, {"expected": F.col("expected_abstention")}).collect()}
    assert set(out) == {"overall", "expected:true", "expected:false"}
    assert (out["overall"]["n"], out["overall"]["answer_accuracy"], out["overall"]["abstention_precision"]) == (6, 2 / 6, 0.5)
    assert (out["expected:true"]["abstention_recall"], out["expected:false"]["abstention_recall"], out["expected:false"]["abstention_precision"]) == (1 / 3, 1.0, 0.0)
    assert evaluation.answer_summary(scores.limit(0), {}).count() == 0


def test_generation_scores(spark):
    rows = [
        ("a", "rag", "The rudder jammed [1] [3] [1].", ["c1", "c9"], ["c1", "c2"]), ("a", "base", "rudder", ["c1"], None), ("b", "rag", "I do NOT know; nothing.", [], []), ("b", "base", None, None, None), ("z", "rag", "no example", [], []),
    ]
    g = spark.createDataFrame(rows, "example_id string, variant string, text string, retrieved_chunk_ids array<string>, context_chunk_ids array<string>")
    e = spark.createDataFrame([("a", True, "rudder", [("c1", "q"), ("c2", "q")]), ("b", False, None, None)], f"example_id string, answerable boolean, reference_answer string, evidence {SPAN}")
    got = {(r["example_id"], r["variant"]): r for r in evaluation.generation_scores(g, e).collect()}
    assert set(got) == {("a", "rag"), ("a", "base"), ("b", "rag"), ("b", "base")}
    assert tuple(got["a", "rag"])[2:8] == (0.0, 2 / 7, 0.5, 0.5, 1.0, None)
    assert tuple(got["a", "base"])[2:8] == (1.0, 1.0, None, None, None, None)
    assert tuple(got["b", "rag"])[2:8] == (None, None, None, None, None, 1.0) and got["b", "base"]["refusal_correct"] == 0.0
    out = {r["variant"]: r for r in evaluation.generation_summary(evaluation.generation_scores(g, e)).collect()}
    assert (out["rag"]["examples"], out["rag"]["exact_match"], out["base"]["refusal_correct"]) == (2, 0.0, 0.0)


def test_task_strategies(spark):
    day = datetime.date(2015, 11, 10)
    none = (None,) * 6
    number, moment, two, label = (1500.0, 5.0, None, None, None, None), (None, None, day, "14:53", None, None), (None, None, None, None, ["The Pilot", "co-pilot"], None), (None,) * 5 + ("Loss of control",)
    rows = [
        ("numeric_exact_or_tolerance_v1", "about 1,497 feet", number, None, True), ("numeric_exact_or_tolerance_v1", "1400", number, None, False), ("numeric_exact_or_tolerance_v1", "Seven seats", (7.0, 0.0, *none[2:]), None, True),
        ("numeric_exact_or_tolerance_v1", " ", number, None, False), ("numeric_exact_or_tolerance_v1", "1500", none, None, None), ("numeric_exact_or_tolerance_v1", "1500", None, None, None),
        ("normalized_datetime_v1", "On November 10, 2015 at 14:53", moment, None, True), ("normalized_datetime_v1", "2015-11-10, 1453", moment, None, True), ("normalized_datetime_v1", "2015-11-11, 1453", moment, None, False),
        ("normalized_datetime_v1", "2015-11-10 at 9:03", (None, None, day, "09:03", None, None), None, True), ("normalized_entity_set_v1", "the copilot and pilot", two, None, True), ("normalized_entity_set_v1", "the pilot", two, None, False),
        ("categorical_exact_v1", "Loss of control.", label, None, True), ("categorical_exact_v1", "A loss", label, None, False), ("required_key_facts_v1", "Fuel ran out, engine stopped", none, ["fuel", "the engine"], True),
        ("required_key_facts_v1", "fuel", none, ["fuel", " "], None), ("required_key_facts_v1", "fuel", none, None, None), ("abstention_v1", None, none, None, True), ("abstention_v1", "no", none, None, False), ("other", "x", none, None, None), (None, "x", none, None, None),
    ]
    df = spark.createDataFrame(rows, f"strategy string, answer string, target {TARGET}, facts array<string>, expected boolean")
    df = df.withColumn("got", evaluation.task_correct(F.col("strategy"), F.col("answer"), F.col("target"), F.col("facts")))
    assert [tuple(r) for r in df.where("NOT (got <=> expected)").collect()] == []
    out = {r["strategy"]: (r["n"], r["accuracy"]) for r in evaluation.task_summary(df, "strategy", "got").collect()}
    assert out["abstention_v1"] == (2, 0.5) and out[None][0] == sum(r[-1] is not None for r in rows)


def test_quote_spans(spark):
    cited = [("e", "c1", "gear was\nfolded"), ("e", "c1", "a.b (c)"), ("e", "c1", "absent"), ("e", "c1", " "), ("e", "c1", None), ("e", "gone", "x"), ("e", None, "x"), ("e", "c1", "x\\Ey"), ("e", "c1", "gear was\nfolded")]
    c = spark.createDataFrame(cited, "example_id string, chunk_id string, quote string")
    chunks = spark.createDataFrame([("c1", "The gear  was fol\nded. a.b ( c ) axb x\\Ey gear was folded", 1)], "chunk_id string, text string, quote int")
    got = {(r["chunk_id"], r["quote"]): r["span"] for r in evaluation.quote_spans(c, chunks).collect()}
    assert len(got) == 8
    assert got["c1", "gear was\nfolded"] == "gear  was fol\nded" and got["c1", "a.b (c)"] == "a.b ( c )" and got["c1", "x\\Ey"] == "x\\Ey"
    assert {v for k, v in got.items() if k[1] in ("absent", " ", None, "x")} == {None}


def test_evidence_prompt(spark):
    df = spark.createDataFrame([("Why?", [("c2", "x"), ("c1", "y"), ("c2", "z")]), ("Why?", []), ("Why?", None)], f"q string, e {SPAN}")
    got = [r[0] for r in df.select(evaluation.evidence_prompt(F.col("q"), F.col("e"))).collect()]
    assert got == ['Why?\n\n<chunk id="c2">\nx\nz\n</chunk>\n\n<chunk id="c1">\ny\n</chunk>', "Why?\n\n<no_evidence />", "Why?\n\n<no_evidence />"]


def test_example_and_record_problems(spark):
    prov = "struct<author:string,reviewers:array<string>,source_document_ids:array<string>,is_synthetic:boolean>"
    rows = [
        ("ok", "q", "test", True, "a", [("c", "q")], ("x", ["y"], ["s"], False)), ("bare", " ", "dev", True, None, None, None), ("odd", "q", "Test ", False, "a", [("c", "q")], ("x", ["x"], [], True)), (None, None, None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, f"example_id string, question string, split string, answerable boolean, reference_answer string, evidence {SPAN}, provenance {prov}")
    got = {tuple(r) for r in integrity.example_problems(e.union(e)).collect()}
    assert got == {("bare", p) for p in ("no_question", "no_answer", "no_evidence", "no_source")} | {("odd", p) for p in ("answer_unexpected", "evidence_unexpected", "own_reviewer", "no_source", "synthetic_test")}
    say = lambda *citations: '{"answer":"a","citations":[' + ",".join(f'{{"chunk_id":"{c}","quote":"{q}"}}' for c, q in citations) + "]}"
    turn = lambda last: [("system", "s"), ("User ", "u"), ("assistant", last)]
    records = [("r1", turn(say(("C1", "two words")))), ("r2", turn(say(("c1", "other"), ("c9", "x")))), ("r3", turn("plain")), ("r4", [("user", "u")]), ("r5", None), ("r6", []), (None, turn("plain"))]
    r = spark.createDataFrame(records, "record_id string, messages array<struct<role:string,content:string>>")
    chunks = spark.createDataFrame([("c1 ", "has two\n words"), (None, "x")], "chunk_id string, text string")
    got = {tuple(x) for x in integrity.record_problems(r, chunks).collect()}
    assert got == {("r2", "quote_not_found"), ("r2", "unknown_chunk"), ("r3", "not_json")} | {(k, p) for k in ("r4", "r5", "r6") for p in ("roles", "not_json")}


def test_nearest_sentence(spark):
    from docketry.operators import retrieval

    long = "The rudder jammed " + "x" * 500 + "."
    rows = [("1", "Did the rudder jam or jammed?", "It was calm. The rudder jammed! A rudder jammed."), ("2", "of it", "First one. Second."), ("3", None, " \n Only."), ("4", "q", " "), ("5", "q", None), ("6", "rudder", "No. " + long)]
    df = spark.createDataFrame(rows, "query_id string, question string, text string").withColumn("passage", F.lit("clash"))
    got = {r["query_id"]: r["passage"] for r in retrieval.context_passage(df).collect()}
    assert got == {"1": "The rudder jammed!", "2": "First one.", "3": " \n Only.", "6": long[:420]}
    assert retrieval.context_passage(df.limit(0)).count() == 0
