"""Parquet tables of a data folder, and one row per key where rows are delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_per_key(df: DataFrame, key: str, keep: Sequence[str], order: str = "ingested_at") -> DataFrame:
    """One row per key with the columns in keep, taken from the row that arrived last.

    Written as an aggregate (max_by is combined before the shuffle), so a key that is delivered very often meets in
    one task only as one partial row per input partition. Rows with a null key are dropped; ties in order give the
    largest struct, so the result doesn't depend on row order.
    """
    packed = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in keep if c != key])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in keep if c != key])


#: Bits of the set of keys that marked sends to all tasks: MARK_SHARE for each key, MOST_BITS (32 MB) at most. A denser set
#: marks more of the other keys, all in the end.
MARK_SHARE, MOST_BITS = 16, 1 << 28
#: Bits of a row of that set; bitmap_construct_agg has no more.
ROW_BITS = 1 << 15


def set_bits(count: int) -> int:
    """Bits of a set of count hashes, a power of two."""
    return min(MOST_BITS, max(ROW_BITS, 1 << (MARK_SHARE * max(count, 1) - 1).bit_length()))


def marked(df: DataFrame, key: str, hashes: DataFrame, count: int) -> DataFrame:
    """df with marked: true for all rows of a key whose 64-bit hash (xxhash64) is in hashes (hash), and for one in
    MARK_SHARE or so of the other keys; count is the number of hashes, or more.

    The set goes to all tasks as one bit per hash, so df is filtered before it is shuffled. Null keys aren't expected.
    """
    bits = set_bits(count)
    cut = lambda c: F.pmod(c, F.lit(bits))
    row, place = lambda c: F.shiftright(cut(c), 15), lambda c: cut(c).bitwiseAND(F.lit(ROW_BITS - 1))
    held = hashes.groupBy(row(F.col("hash")).alias("_row")).agg(F.bitmap_construct_agg(place(F.col("hash"))).alias("_bits"))
    own = df.withColumn("_row", row(F.xxhash64(key))).withColumn("_place", place(F.xxhash64(key)))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_place", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("_place").bitwiseAND(F.lit(7)).cast("int")) == 1
    return own.join(F.broadcast(held), "_row", "left").withColumn("marked", F.coalesce(bit, F.lit(False))).drop("_row", "_place", "_bits")


def one_per_key_in_place(df: DataFrame, key: str, keep: Sequence[str], order: str = "ingested_at") -> DataFrame:
    """As one_per_key, but rows whose key no other row has stay where they are.

    For wide rows of which few are repeated: only hashes of all keys are shuffled, and the rows of repeated keys (and
    of the few others that are marked with them). df is read twice, and once more for its keys, so it is best a table.
    """
    own = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, order, *keep]))
    repeated = own.select(F.xxhash64(key).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    both = marked(own, key, repeated, df.count() // 2)
    single = both.where("NOT marked").select(key, *[c for c in keep if c != key])
    return single.unionByName(one_per_key(both.where("marked"), key, keep, order))


def tidy(c: Column | str) -> Column:
    """An id, source name, split or category as it is compared: without blanks at its ends, in lower case, never empty."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")))
    return F.when(t != "", t)
