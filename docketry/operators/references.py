"""References to records that aren't there, from signed counts of what exists and what is referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def existence_deltas(rows: DataFrame, key: Column, came: str = "ingested_at", went: str = "deleted_at") -> DataFrame:
    """(key, at, alive, seen): +1 alive and +1 seen when a row of the key arrives, -1 alive when it is withdrawn.

    Rows withdrawn before or as they arrive never exist; their arrival counts as seen only. Rows that never arrive have
    no deltas but a row of null time, so that their key is known. Deltas of a key at one time are summed, so a key that
    is delivered very often at one time is one row.
    """
    own = rows.select(key.alias("key"), F.col(came).alias("came"), F.col(went).alias("went")).where("key IS NOT NULL")
    lives = F.col("went").isNull() | (F.col("went") > F.col("came"))
    arrive = F.struct(F.col("came").alias("at"), F.when(lives & F.col("came").isNotNull(), 1).otherwise(0).alias("alive"), F.when(F.col("came").isNotNull(), 1).otherwise(0).alias("seen"))
    leave = F.when(lives & F.col("went").isNotNull() & F.col("came").isNotNull(), F.struct(F.col("went").alias("at"), F.lit(-1).alias("alive"), F.lit(0).alias("seen")))
    deltas = own.select("key", F.explode(F.array_compact(F.array(arrive, leave))).alias("d"))
    return deltas.groupBy("key", F.col("d.at").alias("at")).agg(F.sum("d.alive").alias("alive"), F.sum("d.seen").alias("seen"))


def reference_deltas(references: DataFrame, came: str = "created_at", went: str | None = None) -> DataFrame:
    """(key, at, refs): +1 at the time a reference (ref_key) was made, -1 when it was taken back, summed per key and time.

    Null times count as before all others. Without a column went, references stay. Null keys are left out.
    """
    made = references.where("ref_key IS NOT NULL").select(F.col("ref_key").alias("key"), F.col(came).alias("at"), F.lit(1).alias("refs"))
    if went:
        made = made.union(references.where(F.col("ref_key").isNotNull() & F.col(went).isNotNull()).select("ref_key", went, F.lit(-1)))
    return made.groupBy("key", "at").agg(F.sum("refs").alias("refs"))


def orphan_times(referred: DataFrame, deltas: DataFrame, period: str = "day") -> DataFrame:
    """(key, at, refs, alive, seen, known, reason) at each time of referred (see reference_deltas) at which a key has more
    references than were taken back: the running counts, and why its references are orphans: missing if no row has the
    key, deleted if one was seen by then but none is alive, late if none was seen yet, null if they are sound.

    Deltas of that moment count. A null time is before all arrivals. References and existence (see existence_deltas) of
    a key are lined up by time and their signed counts run along, over periods first and within a period after that, so
    a window never holds more than one period of one key, and all references of a key at one moment are one row.
    """
    unit = lambda c: F.date_trunc(period, c)
    lined = deltas.select("key", "at", unit("at").alias("unit"), F.lit(0).cast("bigint").alias("refs"), "alive", "seen", F.lit(1).alias("rows")).unionByName(
        referred.select("key", "at", unit("at").alias("unit"), "refs", F.lit(0).cast("bigint").alias("alive"), F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("rows"))
    )
    counts = ("refs", "alive", "seen")
    units = lined.groupBy("key", "unit").agg(*[F.sum(c).alias(c) for c in counts], F.sum("rows").alias("rows"), F.max(F.col("rows") == 0).alias("asked"))
    before = Window.partitionBy("key").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    bases = units.select(
        "key", "unit", "asked", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in counts], F.sum("rows").over(Window.partitionBy("key")).alias("known")
    ).where("asked").drop("asked")
    same = [lined["key"] == bases["key"], lined["unit"].eqNullSafe(bases["unit"])]
    within = lined.join(bases, same).drop(bases["key"]).drop(bases["unit"])
    upto = Window.partitionBy("key", "unit").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ran = within.select("key", "at", "known", "rows", *[(F.col(f"{c}0") + F.sum(c).over(upto)).alias(c) for c in counts]).where("rows = 0 AND refs > 0")
    some = F.col("at").isNotNull()
    reason = F.when(F.col("known") == 0, "missing").when(some & (F.col("alive") > 0), F.lit(None)).when(some & (F.col("seen") > 0), "deleted").otherwise("late")
    return ran.select("key", "at", *counts, "known", reason.alias("reason"))


def judged_references(references: DataFrame, deltas: DataFrame, period: str = "day") -> DataFrame:
    """references (with ref_key and created_at, one row per reference) with reason: null where sound, else missing,
    deleted or late at the time they were made; see orphan_times. Null keys drop out.
    """
    verdicts = orphan_times(reference_deltas(references), deltas, period).select("key", "at", "reason")
    matched = [references["ref_key"] == verdicts["key"], references["created_at"].eqNullSafe(verdicts["at"])]
    return references.join(verdicts, matched).drop("key", "at")


def orphan_report(referred: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, refs, alive, ever) of keys with, at the end of all deltas, positive references and no existence, each once.

    The current state of the signed counts of reference_deltas and existence_deltas: one aggregate over both.
    """
    both = referred.select("key", "refs", F.lit(0).cast("bigint").alias("alive"), F.lit(0).cast("bigint").alias("seen")).union(deltas.select("key", F.lit(0).cast("bigint"), "alive", "seen"))
    state = both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("alive").alias("alive"), F.sum("seen").alias("ever"))
    return state.where("refs > 0 AND alive <= 0")
