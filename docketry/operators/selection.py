"""Seeded splits, quotas and selections of families and candidates."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import seeded_digest
from docketry.operators.ranking import running
from docketry.session import cut_lineage


def largest_remainder(total: int, fractions: Sequence[tuple[str, float]]) -> dict[str, int]:
    """Whole quotas that sum to total; what rounding down leaves goes to the largest remainders, ties to the first named."""
    if abs(sum(f for _, f in fractions) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    quotas = {name: floor(total * f) for name, f in fractions}
    order = sorted(range(len(fractions)), key=lambda i: (-(total * fractions[i][1] - quotas[fractions[i][0]]), i))
    for i in order[: total - sum(quotas.values())]:
        quotas[fractions[i][0]] += 1
    return quotas


def family_splits(families: DataFrame, family: str, fractions: Sequence[tuple[str, float]], seed: str) -> DataFrame:
    """(family, digest, split): different families in the order of their seeded digest, dealt to the splits by quota.

    The first named split gets the first families. Ranks are exact without sorting all families in one task: the digest
    is cut by its upper bits. Null families are left out.
    """
    own = families.where(F.col(family).isNotNull()).select(family).distinct().withColumn("digest", seeded_digest(seed, F.col(family)))
    quotas = largest_remainder(own.count(), fractions)
    order = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")  # 60 bits, so the hash is not negative
    placed = running(own.withColumn("_h", F.shiftleft(order, 3)), [], "_h", "digest").drop("_h", "before")
    split, upto = None, 0
    for name, quota in quotas.items():
        upto += quota
        split = F.when(F.col("rank") <= upto, name) if split is None else split.when(F.col("rank") <= upto, name)
    return placed.withColumn("split", split).select(family, "digest", "split")


def leaking_families(rows: DataFrame, family: str, split: str) -> DataFrame:
    """(family, n_splits, n_rows) of families in more than one split; null splits don't count."""
    return rows.where(F.col(family).isNotNull()).groupBy(family).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def first_per_key(rows: DataFrame, key: str, order: str, keep: Sequence[str]) -> DataFrame:
    """Per key the row of smallest order (nulls last), ties by the kept columns."""
    null_last = F.struct(F.col(order).isNull().alias("_n"), F.col(order).alias("_o"), *[F.col(c).alias(c) for c in keep])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(null_last).alias("_r")).select(key, F.col("_r._o").alias(order), *[F.col(f"_r.{c}").alias(c) for c in keep])


def replacements(candidates: DataFrame, rejected: DataFrame, seed: str) -> DataFrame:
    """(split, event_id): for each rejected event (split, event_id) the candidate with the smallest seeded digest.

    A candidate isn't among the rejected. The digest is over the split and the event, so splits draw independently;
    min_by is combined before the shuffle.
    """
    free = candidates.join(rejected.select("event_id"), "event_id", "left_anti").select("event_id").distinct()
    splits = [r[0] for r in rejected.select("split").distinct().collect()]
    keyed = [F.min(F.struct(seeded_digest(seed, F.concat(F.lit(f"replacement\0{s}\0"), F.col("event_id"))).alias("d"), F.col("event_id").alias("event_id"))).alias(f"s{i}") for i, s in enumerate(splits)]
    if not keyed:
        return rejected.select("split", "event_id").limit(0)
    best = free.agg(*keyed)
    return best.select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"s{i}.event_id").alias("event_id")) for i, s in enumerate(splits)])).alias("x")).select("x.split", "x.event_id")


def features(occurred_on: Column, fields: dict[str, Column]) -> Column:
    """year:..., then name:value of each field in lower case; unknown where missing."""
    known = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    return F.array(F.concat(F.lit("year:"), F.coalesce(F.year(occurred_on).cast("string"), F.lit("unknown"))), *[F.concat(F.lit(f"{n}:"), known(c)) for n, c in fields.items()])


def discovery_windows(spans: DataFrame, requests: int, days: int) -> DataFrame:
    """spans (first DATE, last DATE) spread into at most requests evenly spaced windows (number, begins, ends) of days."""
    length = F.datediff("last", "first") + 1
    count = F.least(F.lit(requests), length)
    spread = spans.withColumn("_n", count).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begins = F.expr("date_add(first, cast(CASE WHEN _n = 1 THEN 0 ELSE number * (datediff(last, first)) div (_n - 1) END AS int))")
    return spread.withColumn("begins", begins).withColumn("ends", F.least("last", F.date_add("begins", days - 1))).drop("_n")


#: Candidates that a diverse selection has at most; each is a pass over the different sets of features.
MOST_TARGET = 1000


def diverse(candidates: DataFrame, target: int, seed: str) -> DataFrame:
    """(place, source_id): target candidates (source_id, features ARRAY<STRING>), each with most features not seen yet.

    Ties go to the smallest seeded digest, then id. Null ids are left out, null features count as none. Of the candidates
    with one set of features only the first by digest can win while the set has features not seen yet; each place is one
    distributed minimum over those. As soon as nothing new is left, the digest alone decides, and the remaining places
    are the first ones by digest. The driver holds the chosen ones, which the caller bounds.
    """
    if not 0 <= target <= MOST_TARGET:
        raise ValueError(f"a target is between 0 and {MOST_TARGET}")
    own = candidates.where(F.col("source_id").isNotNull()).select("source_id", seeded_digest(seed, F.col("source_id").cast("string")).alias("d"), F.array_sort(F.array_distinct(F.coalesce("features", F.array().cast("array<string>")))).alias("f"))
    firsts = cut_lineage(own.groupBy("f").agg(F.min(F.struct("d", "source_id")).alias("m")).select("f", "m.d", "m.source_id"))
    seen: list[str] = []
    chosen: list = []
    while len(chosen) < target:
        fresh = F.size(F.array_except("f", F.array(*[F.lit(x) for x in seen]).cast("array<string>")))
        best = firsts.agg(F.min(F.struct((-fresh).alias("gain"), "d", "source_id", "f")).alias("b")).first()["b"]
        if best is None or best["gain"] == 0:
            break
        chosen.append(best["source_id"])
        seen += sorted(set(best["f"]) - set(seen))
    if len(chosen) < target:
        taken = candidates.sparkSession.createDataFrame([(c,) for c in chosen], own.select("source_id").schema)
        rest = own.join(F.broadcast(taken), "source_id", "left_anti").orderBy("d", "source_id").limit(target - len(chosen)).collect()
        chosen += [r["source_id"] for r in rest]
    kind = own.schema["source_id"].dataType.simpleString()
    return candidates.sparkSession.createDataFrame(list(enumerate(chosen, 1)), f"place int, source_id {kind}")


def selected_candidates(candidates: DataFrame, used: DataFrame, quotas: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """(place, split, source_id, event_id): as many candidates (source_id, event_id, family, url, features) as the quotas
    sum to, diverse, none of a family in used (family) and none without a url.

    The chosen are ordered by the seeded digest of their event and dealt to the splits in the order of quotas. Fewer
    eligible candidates than that raise.
    """
    total = sum(n for _, n in quotas)
    free = candidates.where("url IS NOT NULL AND trim(url) != '' AND event_id IS NOT NULL").join(used.where("family IS NOT NULL").select("family").distinct(), "family", "left_anti")
    chosen = diverse(free, total, seed)
    if (found := chosen.count()) < total:
        raise ValueError(f"{found} eligible candidates for {total} places")
    named = chosen.join(free.select("source_id", "event_id"), "source_id").select("source_id", "event_id").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(seeded_digest(seed, F.col("event_id").cast("string")), "source_id")  # as many rows as places
    placed = named.withColumn("place", F.row_number().over(order))
    split, upto = F.lit(None).cast("string"), 0
    for name, n in quotas:
        split = F.when((F.col("place") > upto) & (F.col("place") <= upto + n), name).otherwise(split)
        upto += n
    return placed.select("place", split.alias("split"), "source_id", "event_id")
