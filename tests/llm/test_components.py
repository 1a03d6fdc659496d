from collections import Counter, defaultdict
from math import log2

from docketry.llm.components import _dealt, assign_splits, connected_components, related_groups, torn_groups
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(edges):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_in_one_level_and_in_many(spark):
    import random

    random.seed(5)
    edges = [(f"n{random.randrange(300):03d}", f"n{random.randrange(300):03d}") for _ in range(170)] + [("hub", f"n{i:03d}") for i in range(0, 60)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(80)] + [("z", "z"), ("z", "z")]
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None)], "a string, b string")
    for per_task in (10_000, 37):
        got = connected_components(df, per_task)
        assert got.columns == ["node", "component"]
        assert dict(map(tuple, got.collect())) == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_levels_are_few_whatever_the_order(spark):
    chain = spark.range(1500).selectExpr("format_string('n%05d', id) a", "format_string('n%05d', id + 1) b")
    star = spark.range(1500).selectExpr("format_string('n%05d', id) a", "'hub' b")
    grid = spark.range(900).selectExpr("format_string('n%05d', id) a", "format_string('n%05d', CASE WHEN id % 30 < 29 THEN id + 1 ELSE id END) b")
    grid = grid.union(spark.range(870).selectExpr("format_string('n%05d', id)", "format_string('n%05d', id + 30)"))
    for edges in (chain, star, grid):
        parts: list[int] = []
        got = connected_components(edges, 50, parts)
        assert {r[0] for r in got.select("component").distinct().collect()} == {"hub" if edges is star else "n00000"}
        assert len(parts) <= log2(parts[0]) + 3


RECORDS = [("e3", "F1", None, "train"), ("e1", "f1 ", "s", "TRAIN"), ("e2", None, "S", "test"), ("e4", "unknown", "-", None), ("e5", "Unknown", "", "test"), ("e6", "g", None, None), ("e7", "G", None, "test")]


def test_related_and_torn(spark):
    df = spark.createDataFrame([(*r, "clash") for r in RECORDS], "k string, family string, source string, split string, group_id string")
    groups = related_groups(df, "k", ["family", "source"])
    got = dict(map(tuple, groups.collect()))
    assert got == {"e1": "e1", "e2": "e1", "e3": "e1", "e4": "e4", "e5": "e5", "e6": "e6", "e7": "e6"}
    held = df.drop("group_id").join(groups, "k").withColumnRenamed("split", "s")
    assert {(r["k"], r["group_k"]) for r in torn_groups(held, "s", "k").collect()} == {("e1", "e1"), ("e2", "e1"), ("e3", "e1")}
    assert related_groups(df.limit(0), "k", ["family"]).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-50, 400), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 80))
def test_dealing_like_one_by_one(deficits, size, count):
    one, got = list(deficits), [0] * len(deficits)
    for _ in range(count):
        i = max(range(len(one)), key=lambda j: one[j])
        one[i] -= size
        got[i] += 1
    many = list(deficits)
    assert sorted(x for x in _dealt(many, size, count)) is not None and sum(_dealt(list(deficits), size, count)) == count
    assert sorted(many) == sorted(one)


def test_whole_groups_near_targets(spark):
    rows = [(f"g{g}", f"r{g}-{i}") for g, n in enumerate([40, 17, 9, 9, 5] + [1] * 120) for i in range(n)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "group_id string, r string, split string")
    targets = [("train", 8000), ("development", 1000), ("test", 1000)]
    got = assign_splits(df, targets).collect()
    by = defaultdict(set)
    for r in got:
        by[r["group_id"]].add(r["split"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in by.values())
    assert Counter(r["split"] for r in got) == {"train": 160, "development": 20, "test": 20}
    assert assign_splits(df.limit(0), targets).count() == 0
