"""Texts that look the same but differ in their characters: one form for all, classes of equal look, pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.codepoints import blocks, canonical, encoded, scripted
from docketry.operators.joins import salts, weighted_join
from docketry.session import cut_lineage


def with_canonical(df: DataFrame, text: str = "text", to: str = "canonical", scripts: bool = False) -> DataFrame:
    """df with a column in which text is in the one form; null stays null, empty stays empty.

    Full-width forms become plain, accents composed, every blank a blank, every line end a line feed; invisible
    characters go, letters of other scripts drawn like Latin ones become those. Case, digits, accents, punctuation and
    superscripts stay. With scripts each word is then in one script, so that Russian stays Russian; equal forms stay
    equal. A column of the name in to is replaced; all others pass unchanged.
    """
    form = (lambda block: scripted(canonical(block))) if scripts else canonical
    df = df.drop(to) if to in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])
    at = df.columns.index(text)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for a, b, block in blocks(column):
                rows = batch.slice(a, b - a)
                null = column.slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*rows.columns, encoded(form(block), null)], names=[*batch.schema.names, to])

    return df.mapInArrow(convert, schema)


def lookalike_members(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_column, look BINARY, exact BINARY) of each row with a text: SHA-256 of the one form and of the characters.

    Null and empty texts, and texts of invisible characters only, have no look and give no row. Ids are taken to be
    unique.
    """
    own = df.select(F.col(id_column), F.unhex(F.sha2(F.col(text), 256)).alias("exact"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    form = with_canonical(own, "_text", "_form").where(F.length("_form") > 0)
    return form.select(id_column, F.unhex(F.sha2("_form", 256)).alias("look"), "exact")


def lookalike_classes(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df with a text: (id_column, class_id, variants).

    class_id is the smallest id among texts of the same look, variants the number of different character sequences in
    the class. A class of any size is aggregated before the shuffle and meets its rows as one row (see weighted_join).
    """
    members = cut_lineage(lookalike_members(df, id_column, text))
    by_text = members.groupBy("look", "exact").agg(F.min(id_column).alias("_first"), F.count("*").alias("_n"))
    classes = by_text.groupBy("look").agg(F.min("_first").alias("class_id"), F.count("*").alias("variants"), F.sum("_n").alias("_n"))
    return weighted_join(members, classes, "look", "_n").select(id_column, "class_id", "variants")


def lookalike_pairs(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows whose texts look the same and differ in their characters.

    First the different character sequences of a look are paired with each other, then each pair is spread to its
    rows. Copies of one sequence are never paired among themselves, however many there are, so the joins produce the
    rows of the result and no others. Looks with one sequence, nearly all, drop out before any join. Rows of a sequence
    with many copies are cut into parts by their id, and its pairs repeated for each part, so no key is met in one task.
    """
    members = cut_lineage(lookalike_members(df, id_column, text))  # read more than once below; the texts only once
    variants = members.groupBy("look", "exact").agg(F.count("*").alias("copies"))
    shared = variants.groupBy("look").agg(F.count("*").alias("n")).where("n > 1")
    sequences = cut_lineage(weighted_join(variants, shared, "look", "n").withColumn("parts", salts("copies")))
    own = weighted_join(members.select(id_column, "exact"), sequences.select("exact", "copies", "parts"), "exact", "copies")
    own = own.withColumn("part", F.pmod(F.xxhash64(id_column), F.col("parts")).cast("int"))
    a, b = ([F.col("look"), *[F.col(c).alias(f"{c}_{x}") for c in ("exact", "parts")]] for x in "ab")
    pairs = sequences.select(*a).join(sequences.select(*b), "look").where("exact_a < exact_b")
    split = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    left, right = ([F.col("exact").alias(f"exact_{x}"), F.col("part").alias(f"part_{x}"), F.col(id_column).alias(f"_{x}")] for x in "ab")
    both = split.join(own.select(*left), ["exact_a", "part_a"]).join(own.select(*right), ["exact_b", "part_b"])
    return both.select(F.least("_a", "_b").alias(f"{id_column}_a"), F.greatest("_a", "_b").alias(f"{id_column}_b"))
