import numpy as np
from docketry.llm import tiling
from docketry.llm.tiling import leaked_items, passages, tile_texts, tiles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

U = np.uint64
QUOTE = "one two three four five six seven eight nine ten"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=25), st.integers(1, 4))
def test_tiles_are_greedy_and_disjoint(a, b, least):
    with np.errstate(over="ignore"):
        got = tiles(np.array(a, U), np.array(b, U), least)
    marked_a, marked_b = set(), set()
    for t, p, n in got:
        assert n >= least and a[t : t + n] == b[p : p + n]
        assert not marked_a & set(range(t, t + n)) and not marked_b & set(range(p, p + n))
        marked_a |= set(range(t, t + n))
        marked_b |= set(range(p, p + n))
    common = max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)
    assert (max((n for *_, n in got), default=0) if common >= least else 0) == (common if common >= least else 0)


def brute_tiles(a, b, least):
    """Greedy tiling by its definition: again and again the longest common run of unmarked words, first by passage, then text."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for p in range(len(b)):
            for t in range(len(a)):
                n = 0
                while t + n < len(a) and p + n < len(b) and free_a[t + n] and free_b[p + n] and a[t + n] == b[p + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            return out
        n, p, t = best
        free_a[t : t + n], free_b[p : p + n] = [False] * n, [False] * n
        out.append((t, p, n))


def test_rest_of_an_occluded_match_is_marked():
    text = [*range(7), *range(100, 113), *range(6, 13)]
    with np.errstate(over="ignore"):
        got = tiles(np.array(text, U), np.arange(20, dtype=U), 5)
    assert sum(n for *_, n in got) == sum(n for *_, n in brute_tiles(text, list(range(20)), 5)) == 13


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=25), st.integers(1, 4))
def test_tiles_are_those_of_brute_force(a, b, least):
    with np.errstate(over="ignore"):
        got = tiles(np.array(a, U), np.array(b, U), least)
    assert got == brute_tiles(a, b, least)


def found(spark, texts, items, least=8, **how):
    t = spark.createDataFrame([("documents", str(i), 0, x, "clash") for i, x in enumerate(texts)], "found_in string, record_key string, part int, text string, words string")
    known = passages(spark.createDataFrame(items, "item_id string, passage string"), least)
    return {(int(r["record_key"]), r["example_id"]): r for r in leaked_items(tile_texts(t, known, least, **how), known, how.pop("coverage", 0.0) if "coverage" in how else 0.0).collect()}


def test_readings_both_ways(spark):
    texts = [
        QUOTE, "ONE, two; <b>three</b> four **five** six\n\nseven eight", "one two three four five six seven", None, "", "оne two threе four five six seven eight",
        "zero one two three fo-\nur five six seven eight nine", "one two three four five six sev¬\n  en eight", "{\"q\":\"one two three\\nfour five six \\u0073even eight\"}",
        "one two three four five six seven seven eight nine ten", QUOTE + " " + QUOTE, "x " * 200_000 + QUOTE,
    ]
    items = [("i1", QUOTE), ("i2", "Zero " + QUOTE), ("i2", None), ("i3", "short one"), ("i1", QUOTE), (None, QUOTE), ("i4", QUOTE.replace(" ", "\n"))]
    sent = found(spark, texts, items)
    want = {(i, e) for i in (0, 1, 5, 6, 7, 8, 10, 11) for e in ("i1", "i2", "i4")}
    assert set(sent) == want
    assert set(found(spark, texts, items, sent_windows=0)) == want


def test_compound_at_line_end(spark):
    items = [("i", "the right-hand gear was found folded after the event")]
    assert set(found(spark, ["the right-\nhand gear was found folded after the event"], items)) == {(0, "i")}


def test_each_line_end_reads_by_itself(spark):
    items = [("i", "the right-hand gear was found folded after the event")]
    texts = ["the right-\nhand gear was fo-\nund folded after the event", "a-\nb c-\nd the right-hand ge-\nar was fo-\r\n  und folded after the event", "the right-\nhand gear was found-\nfolded aft-\ner the event", "the right-\nhand gear"]
    for sent in (10**6, 0):
        assert set(found(spark, texts, items, sent_windows=sent)) == {(0, "i"), (1, "i"), (2, "i")}


def test_dense_line_ends_in_any_mix(spark):
    items = [("i", "the runway surface aircraft landed engine left-hand side was damaged"), ("j", "alpha runway beta sur face gamma air-craft delta run way surface landed here")]
    texts = [
        "run-\nway sur-\nface air-\ncraft landed engine left-\nhand side was",
        "al-\npha run-\nway be-\nta sur-\nface gam-\nma air-\ncraft del-\nta run-\nway sur-\nface land-\ned here",
        "run-\nway sur-\nface air-\ncraft landed engine left-\nhander side was",
        " ".join(f"w{i}a-\nb" for i in range(3000)) + " the run-\nway sur-\nface air-\ncraft land-\ned en-\ngine left-\nhand",
        "a-\n" * 3000 + "b",
    ]
    for sent in (10**6, 0):
        assert set(found(spark, texts, items, sent_windows=sent)) == {(0, "i"), (1, "j"), (3, "i")}
        assert set(found(spark, [x.replace("-\n", "") for x, _ in zip(texts, range(1), strict=False)], [("d", texts[1])], sent_windows=sent)) == set()
    for mix in range(0, 1024, 37):
        text = " ".join(f"p{i}" + ("-\n" if mix >> i & 1 else "") + f"q{i}" if i % 2 else f"p{i}-\nq{i}" for i in range(10))
        item = " ".join(f"p{i}q{i}" if mix >> i & 1 else f"p{i} q{i}" if not i % 2 else f"p{i}q{i}" for i in range(10))
        with np.errstate(over="ignore"):
            known = set(tiling.running_windows(parts_of(item).hashes, 8).tolist())
            parts = parts_of(text.replace("-\n", tiling.MARK))
            spans = [(int(p), int(q), int(h)) for p, q, h in zip(parts.first, parts.last, parts.whole, strict=True)]
            windows = {x[0] for x in tiling.divided_windows(parts.hashes, spans, 8, np.ones(len(parts.hashes), bool))} | set(tiling.running_windows(parts.hashes, 8).tolist())
        assert known <= windows


def parts_of(text):
    return tiling.word_parts(tiling.Block(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)])))


def test_divided_passages(spark):
    items = [("i", "the run-\nway sur-\nface of air-\ncraft land-\ned here"), ("j", "no eight words in here")]
    for sent in (10**6, 0):
        assert set(found(spark, ["the runway surface of aircraft landed here today", "the run way surface of air craft landed here", "THE RUN WAY SUR FACE OF AIR CRAFT LAND ED"], items, 7, sent_windows=sent)) == {(0, "i"), (1, "i"), (2, "i")}


def test_reordered_passage_by_coverage(spark):
    words = [f"w{i}" for i in range(20)]
    text = " ".join(words[10:] + words[:10])
    t = spark.createDataFrame([("d", "1", 0, text), ("d", "2", 0, " ".join(words[:6]))], "found_in string, record_key string, part int, text string")
    known = passages(spark.createDataFrame([("i", " ".join(words))], "item_id string, passage string"), 5)
    got = leaked_items(tile_texts(t, known, 5), known, 0.5).collect()
    assert [(r["record_key"], r["coverage"]) for r in got] == [("1", 1.0)]
    for sent in (10**6, 0):
        assert [r["record_key"] for r in tile_texts(t, known, 5, 0.5, sent).collect()] == ["1"]


def test_empty_tables(spark):
    assert found(spark, [], [("i", QUOTE)]) == {}
    assert found(spark, [QUOTE], []) == {}
    empty = spark.createDataFrame([], "item_id string, passage string")
    assert passages(empty, 8).count() == 0 and passages(empty.withColumn("text", F.lit(1)), 8).count() == 0
    assert tiling.SENT_WINDOWS > 0
