"""Groups of related records by distributed union-find, and whole groups dealt to splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.joins import weighted_join
from docketry.operators.ranking import running, seeded_key
from docketry.session import cut_lineage
from docketry.sources.tables import tidy

#: Edges in one local forest; bounds a task's memory (about 100 bytes an edge).
FOREST_EDGES = 250_000
# What stands for an unknown value in a field that relates records.
PLACEHOLDERS = ("-", "--", "?", "n/a", "na", "n.a.", "nil", "none", "null", "not available", "not known", "tba", "tbd", "undefined", "unknown", "unspecified", "not stated", "not specified", "anonymous")


def _local_forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Union-find over each most edges of a partition: (node, smallest node of its tree)."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def trees() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["node", "root"])

    held = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held == most:  # the rest of a partition that is larger than its share is a forest of its own
                yield from trees()
                parent, held = {}, 0
            held += 1
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield from trees()


def _gathered(level: DataFrame, number: int, parts: int) -> DataFrame:
    """The edges of a level dealt to parts so that those around the same node lie together.

    Each node has a random rank, new in every level. An edge goes to the part of the node of least rank in the closed
    neighbourhood of its first end. So a forest joins whole neighbourhoods of such nodes, of which there are half as
    many as nodes along a chain and fewer wherever nodes have more neighbours.
    """
    rank = lambda c: F.xxhash64(F.lit(number), c)
    ends = level.select("a", "b").union(level.select("b", "a")).union(level.select("a", "a"))
    centre = ends.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("centre"))).alias("m")).select("a", "m.centre")
    return level.join(centre, "a").repartition(parts, "centre").select("a", "b")


def connected_components(edges: DataFrame, per_task: int = FOREST_EDGES, count_levels: list[int] | None = None) -> DataFrame:
    """(node, component) of all nodes of edges (a STRING, b STRING); component is the smallest node that a path reaches.

    Each level cuts the edges into parts of about per_task, builds forests of at most per_task edges in each part by
    union-find, and labels each node with the smallest root that it has anywhere. What is left to merge are edges between
    the roots of nodes that occur in several forests; they are the next level's edges. From the second level on the
    edges of a neighbourhood are gathered in one part (see _gathered), so at most half of the trees are left by the
    next level and there are about log2(parts) levels, whatever the order of the nodes. The last level has one part.
    Labels are then composed from the last level to the first. The first level is cut by a hash of a, so the edges of a
    node of any degree on the other side are spread; after that a node has at most one edge per forest. Edges with a
    null end are dropped; repeated edges and loops change nothing. count_levels receives the parts of each level.
    """
    level = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    left, labels = level.count(), []
    while left:
        parts = ceil(left / per_task)
        if count_levels is not None:
            count_levels.append(parts)
        dealt = level.repartition(parts, "a") if not labels or parts == 1 else _gathered(level, len(labels), parts)
        forest = dealt.mapInArrow(lambda batches: _local_forests(batches, per_task), "node string, root string")
        # A node has at most one root per forest, so the set is bounded by the number of forests.
        named = cut_lineage(forest.groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots")))
        labels.append(named.select("node", "label"))
        if parts == 1:
            break
        level = cut_lineage(named.select(F.explode("roots").alias("a"), F.col("label").alias("b")).where("a != b").distinct())
        left = level.count()
    if not labels:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = labels.pop()
    while labels:
        below = labels.pop()
        higher = out.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        out = below.join(higher, "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
    return out.withColumnRenamed("label", "component")


def related_groups(records: DataFrame, key: str, fields: Sequence[str], placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """(key, group_id) for each row of records, whose keys are taken to be unique and not null.

    Records are related if they share a value of one of the fields, directly or through other records. Values are
    compared without blanks at their ends and in lower case; nulls, blanks and placeholders relate nothing, so a record
    without values is a group of its own. group_id is the smallest key of the group.
    """
    own = F.concat(F.lit("0"), F.col(key).cast("string"))
    ends = [F.when(~tidy(f).isin(*placeholders), F.concat(F.lit(f"{i}:"), tidy(f))) for i, f in enumerate(fields, 1)]
    edges = records.select(own.alias("a"), F.explode(F.array_compact(F.array(own, *ends))).alias("b"))
    nodes = connected_components(edges).where(F.col("node").startswith("0"))
    return nodes.select(F.substring("node", 2, 1 << 30).alias(key), F.substring("component", 2, 1 << 30).alias("group_id"))


def torn_groups(grouped: DataFrame, split: str, name: str) -> DataFrame:
    """The rows of grouped (with group_id) whose group has more than one split, with group_<name>, the least value of
    the column name in the group; null splits don't count. A group may hold any share of the rows."""
    sums = grouped.groupBy("group_id").agg(F.min(split).alias("_a"), F.max(split).alias("_b"), F.min(name).alias(f"group_{name}"), F.count("*").alias("_n"))
    return weighted_join(grouped, sums.where("_a < _b").drop("_a", "_b"), "group_id", "_n")


def _dealt(deficits: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of equal size each split gets when each goes to the split furthest below its target.

    deficits is lowered in place. The groups that surely fall to a split, those taken while it is a full group above the
    level that the deficits sink to, are counted at once; the few that are left are dealt one by one.
    """
    got = [0] * len(deficits)
    low, high = min(deficits) - size * (count + 1), max(deficits)
    while low < high:  # the lowest level at which no more than count groups fit in above it
        middle = (low + high) // 2
        if sum(max(0, (d - middle) // size) for d in deficits) <= count:
            high = middle
        else:
            low = middle + 1
    for i, d in enumerate(list(deficits)):
        got[i] = max(0, (d - low) // size)
        deficits[i] -= got[i] * size
    for _ in range(count - sum(got)):
        i = max(range(len(deficits)), key=lambda j: deficits[j])
        got[i] += 1
        deficits[i] -= size
    return got


def assign_splits(grouped: DataFrame, targets: Sequence[tuple[str, int]], seed: int = 0) -> DataFrame:
    """grouped (one row per record, with group_id) with a column split; all records of a group get the same.

    Groups are dealt from the largest to the smallest, each to the split that is then furthest below its target share
    (targets: name and share in 1/10000; ties go to the first named). Groups of one size are interchangeable, so the
    driver deals a histogram of sizes, of at most sqrt(2 x records) rows, and a seeded order of the groups of each size,
    ranked without sorting a size in one task, says which group is in which part of it. No records give no rows.
    """
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("_size"))
    sizes = cut_lineage(sizes)
    histogram = sorted(((r["_size"], r["n"]) for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).collect()), reverse=True)
    total = sum(s * n for s, n in histogram)
    deficits, plan = [bp * total for _, bp in targets], []
    for size, n in histogram:
        start = 0
        for (name, _), got in zip(targets, _dealt(deficits, 10_000 * size, n), strict=True):
            if got:
                plan.append((size, start, start + got, name))
                start += got
    parts = F.broadcast(grouped.sparkSession.createDataFrame(plan, "_size bigint, _from bigint, _to bigint, split string"))  # rows: splits x different sizes
    ranked = running(sizes.withColumn("_key", seeded_key(seed, "group_id")), ["_size"], "_key", "group_id").drop("before", "_key")
    chosen = ranked.join(parts, [ranked["_size"] == parts["_size"], F.col("rank") > F.col("_from"), F.col("rank") <= F.col("_to")]).select("group_id", "split", ranked["_size"])
    return weighted_join(grouped.drop("split"), chosen, "group_id", "_size")
