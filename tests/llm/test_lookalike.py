import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from docketry.llm.codepoints import blocks, canonical, encoded
from docketry.llm.lookalike import lookalike_classes, lookalike_pairs, with_canonical
from hypothesis import given, settings
from hypothesis import strategies as st


def form(texts, size=50):
    out = []
    for _, _, block in blocks(pa.array(texts, pa.string()), size):
        out += encoded(canonical(block)).to_pylist()
    return out


def test_worked_forms():
    given_ = ["Ｎ７６", "áb", "ё", "Hộ", "Hộ", "́x", "th‌e\r\nX\r", "ﬁ x² Ⅳ", "한", "Å", "µ Ω", "a　b c d", "ﬀ", "ſ", "한"]
    want = ["N76", "áb", "ë", "Hộ", "Hộ", "́x", "the\nX\n", "fi x² IV", "한", "Å", "μ Ω", "a b c d", "ff", "ſ", "한"]
    assert form(given_) == want


def test_visible_differences_stay():
    for a, b in (("x2", "x²"), ("a", "A"), ("e", "é"), (".", ";"), ("1", "l"), ("-", "–")):
        assert len(set(form([a, b]))) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeoса̧̣́̈​ éộñ  \r\nＡ각"), max_size=30), max_size=8))
def test_forms_against_rows(texts):
    whole = form(texts, 1 << 20)
    assert whole == [form([t])[0] for t in texts]  # rows don't touch each other
    assert form(whole) == whole  # the form of a form is itself
    for t, f in zip(texts, whole, strict=True):
        assert form([unicodedata.normalize("NFD", t)])[0] == f
        assert form([unicodedata.normalize("NFC", t)])[0] == f


def test_invalid_bytes_keep_rows_apart():
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 2, 3], np.int32)), pa.py_buffer(b"\xffab")])
    assert [encoded(canonical(b)).to_pylist() for _, _, b in blocks(bad)] == [["�a", "b"]]


ROWS = [(1, "wing"), (2, "wіng"), (3, "wing"), (4, "wi​ng"), (5, "Wing"), (6, None), (7, ""), (8, "​"), (9, "wіng"), (10, "x" * 300_000), (11, "x" * 300_000 + "­")]


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id bigint, text string, look string")
    look = {i: form([t])[0] for i, t in ROWS if t}
    want = {(a, b) for (a, s), (b, t) in combinations(ROWS, 2) if s and t and s != t and look[a] == look[b] != ""}
    got = lookalike_pairs(df.select("doc_id", "text", "look"))
    assert got.columns == ["doc_id_a", "doc_id_b"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert lookalike_pairs(df.limit(0)).count() == 0


def test_classes_and_nulls(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["variants"]) for r in lookalike_classes(df).collect()}
    assert got[9] == (1, 3) and got[5] == (5, 1) and not {6, 7, 8} & set(got)
    held = {r["doc_id"]: r["canonical"] for r in with_canonical(df.withColumnRenamed("text", "canonical"), "canonical", "form").withColumnRenamed("form", "f").select("doc_id", "f").withColumnRenamed("f", "canonical").collect()}
    assert held[6] is None and held[7] == "" and held[2] == "wing"


def test_one_script_per_word(spark):
    texts = {
        1: "Самолёт совершил посадку", 2: "Cамолёт coвершил пocaдку", 3: "The copy сору was есо", 4: "The copy copy was eco", 5: "ｐｌａｉｎ о\u0301", 6: "Он и с ней", 7: None, 8: "",
        9: "ΑΘΗΝΑ οδός", 10: "AΘHNA oδός", 11: "Её ёлка в cеле",
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id bigint, text string, canonical string")
    got = {r["doc_id"]: r["canonical"] for r in with_canonical(df, scripts=True).collect()}
    assert got[1] == got[2] == texts[1] and got[3] == got[4] == texts[4] and got[5] == "plain ó" and got[6] == texts[6] and got[7] is None and got[8] == ""
    assert got[9] == got[10] == texts[9] and got[11] == "Её ёлка в селе"
    plain = {r["doc_id"]: r["canonical"] for r in with_canonical(df).collect()}
    assert len({plain[1], plain[2]}) == 1 and len({plain[i] for i in plain}) == len({got[i] for i in got})
