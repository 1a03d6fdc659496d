"""Joins with keys that hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut_lineage

#: Rows of a key from which on it is joined without a shuffle. So the side that is sent has at most one row for each so
#: many rows of the other side.
HEAVY_ROWS = 100_000


def weighted_join(rows: DataFrame, keyed: DataFrame, key: str | Sequence[str], weight: str, heavy: int = HEAVY_ROWS) -> DataFrame:
    """rows joined with keyed, which has one row per key (one or more columns) and in weight the number of rows of that key; weight is dropped.

    Rows of keys of heavy rows or more stay where they are and get their partner by broadcast, of which there are at most
    count(rows) / heavy; all others meet in a shuffle, in which no key has as many. Rows without a partner and null keys
    drop out. keyed is computed once into a checkpoint; while no key is heavy the join is a plain one, else rows is read
    twice, so it is best a checkpoint or a table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keyed = cut_lineage(keyed)
    big, light = keyed.where(F.col(weight) >= heavy).drop(weight), keyed.where(F.col(weight) < heavy).drop(weight)
    if not big.take(1):
        return rows.join(light, keys)
    cold = rows.join(F.broadcast(big), keys, "left_anti").join(light, keys)
    return rows.join(F.broadcast(big), keys).unionByName(cold)


def salts(weight: str, heavy: int = HEAVY_ROWS):  # noqa: ANN201
    """How many parts a key of weight rows is cut into so that none has more than about heavy rows; 1 at least."""
    return F.greatest(F.ceil(F.col(weight) / heavy), F.lit(1)).cast("int")
