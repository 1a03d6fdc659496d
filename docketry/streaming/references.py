"""The orphan report kept up to date from a stream of change deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta_stream(references: DataFrame, existence: DataFrame) -> DataFrame:
    """One stream of changes (key, refs, alive) for running_orphans, from a stream of reference changes (key, refs) and one
    of existence changes (key, alive), +1 and -1 as in reference_deltas and existence_deltas."""
    return references.select("key", F.col("refs").cast("int").alias("refs"), F.lit(0).alias("alive")).unionByName(existence.select("key", F.lit(0).alias("refs"), F.col("alive").cast("int").alias("alive")))


def running_orphans(deltas: DataFrame) -> DataFrame:
    """(key, refs, alive) of the keys with references and without existence, from a stream (key, refs INT, alive INT).

    Each delta adds to or takes from the references to a key or its existence; both sums per key are the query's state,
    combined before the shuffle. Written in complete mode it gives the current report after every batch; in update mode,
    keys that become sound again appear when the filter is left to the sink. Null keys are dropped.
    """
    state = deltas.where("key IS NOT NULL").groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("alive").alias("alive"))
    return state.where("refs > 0 AND alive <= 0")
