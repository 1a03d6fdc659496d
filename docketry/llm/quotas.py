"""Samples that match target shares per category: controlled rounding by maximum flow, exact quotas by random keys."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.flows import cheapest_flow
from docketry.operators.ranking import running, seeded_key

#: Categories in a target table; the flow is solved on the driver over a few arcs per category.
MOST_CATEGORIES = 20_000
#: What a row beyond the margin of a split or of another category costs, against 1 to 4 for one beyond its own cell.
MARGIN_COST = 1000


def _steps(low: int, high: int, share: Fraction) -> list[tuple[int, int]]:
    """(rows, cost of each) from low to high: free between share rounded down and up, dearer the further from it."""
    down, up = min(max(floor(share), low), high), min(max(ceil(share), low), high)
    edges = sorted({low, high, down, up, *[min(max(ceil(share * n / 4), low), high) for n in (1, 2, 3, 5, 6, 8)]})
    cost = lambda a, b: 0 if down <= a and b <= up else -min(4, ceil((share - a) * 4 / max(share, 1))) if b <= down else min(4, ceil((b - share) * 4 / max(share, 1)))
    return [(b - a, cost(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def controlled_rounding(table: dict[tuple[object, object], Fraction], total: int, bounds: dict[tuple[object, object], tuple[int, int]] | None = None) -> dict[tuple[object, object], int]:
    """Whole numbers for the cells of a two-way table that sum to total, with row and column sums rounded down or up.

    Without bounds every cell is rounded down or up as well; such a table exists whenever total is the sum rounded down
    or up, because the fractions themselves are a flow. bounds gives the least and the most of a cell, which always hold;
    total is moved between their sums if it isn't there. Where the bounds leave no such table, cells move away from
    their fraction before a margin does, and as little as can be: the table is a largest flow from rows to columns of
    least cost.
    """
    bounds = bounds or {k: (floor(v), ceil(v)) for k, v in table.items()}
    least = sum(a for a, _ in bounds.values())
    total = min(max(total, least), sum(b for _, b in bounds.values()))
    arcs: list[tuple[object, object, int, int]] = [("S", "s", total - least, 0)]
    for side, make in ((0, lambda i, n, c: ("s", ("r", i), n, c)), (1, lambda j, n, c: (("c", j), "T", n, c))):
        sums: dict[object, Fraction] = defaultdict(Fraction)
        lows: dict[object, int] = defaultdict(int)
        for k, v in table.items():
            sums[k[side]] += v
            lows[k[side]] += bounds[k][0]
        for i, v in sorted(sums.items(), key=lambda x: str(x[0])):
            first, free = max(0, floor(v) - lows[i]), max(0, ceil(v) - max(floor(v), lows[i]))
            arcs += [make(i, first, -MARGIN_COST), make(i, free, 0), make(i, total, MARGIN_COST)]
    cells: list[tuple[int, tuple[object, object]]] = []
    for k, v in sorted(table.items(), key=lambda x: str(x[0])):
        for rows, cost in _steps(*bounds[k], v):
            cells.append((len(arcs), k))
            arcs.append((("r", k[0]), ("c", k[1]), rows, cost))
    flows = cheapest_flow(arcs, "S", "T")
    out = {k: a for k, (a, _) in bounds.items()}
    for i, k in cells:
        out[k] += flows[i]
    return out


def quota_table(targets: Sequence[tuple[str, object, int, int]], size: int, available: dict[tuple[str, object], int]) -> dict[tuple[str, object], int]:
    """Rows to take per (row category, column category) for targets (row, column, share in 1/10000, least).

    A sample of size rows in which no category has more rows than are available, none less than it needs (its least
    number, or its share rounded down if that is more) as far as available, and all shares are rounded under control.
    Where the needs are more than size the sample has as many rows as they ask for; where fewer are available, those.
    """
    table = {t[:2]: Fraction(size * t[2], 10_000) for t in targets}
    bounds = {}
    for t in targets:
        have = available.get(t[:2], 0)
        bounds[t[:2]] = (min(have, max(t[3], size * t[2] // 10_000)), have)
    return controlled_rounding(table, size, bounds)


def sample_plan(records: DataFrame, targets: DataFrame, row: str, columns: Sequence[str], share: int = 4) -> DataFrame:
    """Per category of targets: target_bp, min_rows, available, need, target (exact rows of its share) and quota.

    records has one row per key with the category columns as in targets, null where a record is in no category of that
    field. The sample is a share-th of the records. need is greatest(min_rows, sample x target_bp div 10000); see
    quota_table for quota. Null shares and least numbers count as 0; targets are taken to name each category once.
    """
    fields = [row, *columns]
    rows = targets.limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    size = records.count() // share
    name = lambda r: (r[row], tuple(r[c] for c in columns))
    wanted = F.broadcast(targets.select(*fields).distinct())
    counts = {name(r): r["n"] for r in records.join(wanted, fields, "left_semi").groupBy(*fields).agg(F.count("*").alias("n")).collect()}
    asked = {name(r): (r["target_bp"] or 0, r["min_rows"] or 0) for r in rows}
    quotas = quota_table([(*k, *v) for k, v in asked.items()], size, counts)
    plan = [(k[0], *k[1], bp, least, counts.get(k, 0), max(least, size * bp // 10_000), size * bp / 10_000, quotas[k]) for k, (bp, least) in asked.items()]
    names = ", ".join(f"{f} string" for f in fields)
    return records.sparkSession.createDataFrame(plan, f"{names}, target_bp int, min_rows int, available bigint, need bigint, target double, quota bigint")


def quota_sample(records: DataFrame, plan: DataFrame, fields: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """The rows of records that are in the sample: in each category the quota of rows with the smallest random keys.

    The random key is a seeded hash of key, so the sample is the same in every run. A category that holds a third of
    all rows is ranked in slices; slices beyond its quota are dropped before any sort.
    """
    quotas = plan.select(*fields, F.col("quota").alias("_quota")).where("_quota > 0")
    wanted = records.join(F.broadcast(quotas), list(fields)).withColumn("_key", seeded_key(seed, key))
    return running(wanted, fields, "_key", key, upto="_quota").drop("rank", "before", "_key", "_quota")


def sample_report(records: DataFrame, targets: DataFrame, row: str, columns: Sequence[str], key: str, share: int = 4, seed: int = 0) -> DataFrame:
    """sample_plan with taken (rows of the drawn sample), shortfall (need less taken, at least 0) and met, per category."""
    fields = [row, *columns]
    plan = sample_plan(records, targets, row, columns, share)
    drawn = quota_sample(records.select(*fields, key), plan, fields, key, seed).groupBy(*fields).agg(F.count("*").alias("taken"))
    out = plan.join(drawn, fields, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.withColumn("shortfall", F.greatest(F.col("need") - F.col("taken"), F.lit(0))).withColumn("met", F.col("taken") >= F.col("need"))


def margin_report(report: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(side, category, target, taken, kept) of both margins of a sample_report; kept says that taken is the target
    rounded down or up, so where it is false the least numbers or the records there are left no such sample."""
    sides = F.array(F.struct(F.lit("rows").alias("side"), F.col(row).alias("category")), F.struct(F.lit("columns").alias("side"), F.concat_ws(" / ", *columns).alias("category")))
    sums = report.withColumn("_s", F.explode(sides)).groupBy("_s.side", "_s.category").agg(F.round(F.sum("target"), 4).alias("target"), F.sum("taken").alias("taken"))
    return sums.withColumn("kept", (F.col("taken") >= F.floor("target")) & (F.col("taken") <= F.ceil("target")))
