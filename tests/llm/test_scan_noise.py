from docketry.llm import scan_noise
from docketry.llm.scan_noise import misreading, repaired_texts, scan_key
from docketry.llm.scan_noise import scan_noise as noise

PLAIN = "The captain reported that the hydraulic reservoir was empty during the approach. Investigators examined the quick-reference card and the weight-and-balance sheet."
SCHEMA = "chunk_id string, document_id string, section string, page_start int, page_end int, text string, noise string"


def table(spark, extra=()):
    rows = [(f"p{i}", f"d{i}", None, 1, 1, PLAIN, "x") for i in range(30)]
    for i in range(2):
        rows.append((f"h{i}", "doc", None, i + 1, i + 1, f"Docket  Exhibit, Tolvik     {i + 1}\n\n{PLAIN}\n\n- {i + 1} -", "x"))
    rows += [
        ("m", "doc", None, 3, 4, "The capta1n reported that the hydraullc reserv-\n\nPage 3\nD0cket Exhibit, Tolvik\noir was ernpty during the appro¬\nach.", "x"),
        ("q", "doc", "1.1 FINDINGS", 4, 4, "1.1 FINDINGS\n\nInvestigators examined the quick-\nreference card.\n\nPhase | Finding | Count\nclimb | wear | 12\n401\nhover | wear | 7", "x"),
        ("n", "doc", None, None, None, None, "x"), ("e", "doc", None, 1, 1, "", "x"), (None, "doc", None, 1, 1, "Page 1", "x"), ("p0", "d0", None, 1, 1, PLAIN, "x"),
    ]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


WANT = {
    ("h0", "running_header", "Docket  Exhibit, Tolvik     1"), ("h1", "running_header", "Docket  Exhibit, Tolvik     2"), ("h0", "page_number", "- 1 -"), ("h1", "page_number", "- 2 -"),
    ("m", "running_header", "D0cket Exhibit, Tolvik"), ("m", "page_number", "Page 3"), ("m", "hyphenation", "reservoir"), ("m", "hyphenation", "approach"),
    ("m", "misread", "captain"), ("m", "misread", "hydraulic"), ("m", "misread", "empty"),
}


def test_noise_in_a_small_corpus(spark):
    got = {(r["chunk_id"], r["noise"], r["found_value"]) for r in noise(table(spark)).collect()}
    assert got == WANT
    assert noise(table(spark).limit(0)).count() == 0


def test_forms_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "SENT_FORMS", 0)
    assert {(r["chunk_id"], r["noise"], r["found_value"]) for r in noise(table(spark)).collect()} == WANT


def test_repaired(spark):
    got = {r["chunk_id"]: r["text"] for r in repaired_texts(table(spark)).collect()}
    assert got["m"] == "The captain reported that the hydraulic reservoir was empty during the approach."
    assert got["h0"] == PLAIN and got["n"] is None and got["e"] == ""
    assert got["q"] == "1.1 FINDINGS\n\nInvestigators examined the quick-reference card.\n\nPhase | Finding | Count\nclimb | wear | 12\n401\nhover | wear | 7"


def test_keys_cover_every_confusion():
    for right, read in (x.split(":") for x in scan_noise.CONFUSIONS.split()):
        word, form = "xy" + right + "k", "xy" + read + "k"
        assert misreading(word, form) is not None and scan_key(word) == scan_key(form), (right, read)


def test_misreading_counts():
    assert misreading("flight", "fli9h7") == 2 and misreading("flight", "fhght") == 1 and misreading("runway", "runway") == 0 and misreading("runway", "taxi") is None
