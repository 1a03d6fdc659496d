"""Registered queries of the subpackage; SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import components, lookalike, mixing, packing, pairs, quotas, scan_noise, tiling
from docketry.session import cut_lineage
from docketry.sources.tables import one_per_key, table, tidy


def _training_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.lit("documents").alias("found_in"), F.col("doc_id").cast("string").alias("record_key"), F.lit(0).alias("part"), "text")
    sft = table(spark, folder, "sft").where("record_id IS NOT NULL").select("record_id", F.posexplode("messages").alias("part", "message"))
    return documents.union(sft.select(F.lit("sft"), "record_id", "part", "message.content"))


def _test_passages(spark: SparkSession, folder: str, least: int) -> DataFrame:
    test = one_per_key(table(spark, folder, "retrieval_test"), "example_id", ["question", "evidence"])
    quotes = F.transform(F.coalesce("evidence", F.array()), lambda e: e["quote"])
    return tiling.passages(test.select(F.col("example_id").alias("item_id"), F.explode(F.concat(F.array("question"), quotes)).alias("passage")), least)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    known = _test_passages(spark, folder, 8).persist()
    tiled = tiling.tile_texts(_training_texts(spark, folder), known, 8)
    return tiling.leaked_items(tiled, known).select("found_in", "record_key", "example_id")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which tiles of five words or more cover half a passage, in whatever order."""
    known = _test_passages(spark, folder, 5).persist()
    tiled = tiling.tile_texts(_training_texts(spark, folder), known, 5, coverage=0.5)
    leaked = tiling.leaked_items(tiled, known, coverage=0.5)
    return leaked.select("found_in", "record_key", "example_id", "longest", F.round("coverage", 4).alias("coverage"))


#: Other spellings of a split.
SPLIT_NAMES = {"dev": "development"}


def _selection(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event; ids trimmed, the categories as text that can be compared."""
    s = table(spark, folder, "selection").withColumn("event_key", tidy("event_id"))
    s = s.select("event_key", F.trim("event_id").alias("event_id"), "event_family_id", "source_id", "author", "proposed_split", "metadata.event_type", "metadata.severity", "ingested_at")
    one = one_per_key(s, "event_key", [c for c in s.columns if c != "ingested_at"])
    split = tidy("proposed_split")
    for short, name in SPLIT_NAMES.items():
        split = F.when(split == short, name).otherwise(split)
    return one.withColumn("proposed_split", F.when(~split.isin(*components.PLACEHOLDERS), split))


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    records = _selection(spark, folder)
    groups = components.related_groups(records, "event_key", ["event_family_id", "source_id", "author"])
    return cut_lineage(records.join(groups, "event_key").select("event_id", "group_id", "proposed_split"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.torn_groups(_grouped(spark, folder), "proposed_split", "event_id").select("group_event_id", "event_id")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    targets = [(r["proposed_split"], r["target_bp"]) for r in table(spark, folder, "split_targets").collect()]
    return components.assign_splits(_grouped(spark, folder).select("event_id", "group_id"), targets).select("event_id", "group_id", "split")


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect that a record triggers."""
    records = one_per_key(table(spark, folder, "sft"), "record_id", ["messages"])
    return pairs.pair_defects(records).select("record_id", F.explode("defects").alias("defect"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first defect of a record in the order of the rules."""
    records = one_per_key(table(spark, folder, "sft"), "record_id", ["messages"])
    return pairs.pair_defects(records).where(F.size("defects") > 0).select("record_id", F.col("defects")[0].alias("defect"))


CATEGORIES = ["proposed_split", "event_type", "severity"]


def _categorized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "sample_targets")
    records = _selection(spark, folder).select("event_key", "event_id", *CATEGORIES)
    for c in CATEGORIES:  # spelled as in the targets; the table is small and fixed
        spelled = {r[c].strip().lower(): r[c] for r in targets.select(c).where(F.col(c).isNotNull()).distinct().collect()}
        known = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair]) if spelled else None
        value = tidy(c)
        records = records.withColumn(c, F.coalesce(known[value], value) if spelled else value)
    return records, targets


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    records, targets = _categorized(spark, folder)
    return quotas.sample_report(records, targets, CATEGORIES[0], CATEGORIES[1:], "event_key")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The categories of which the drawn sample has fewer rows than they need."""
    return p4_report(spark, folder).where("taken < need").select(*CATEGORIES)


def p4_margins(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.margin_report(p4_report(spark, folder), CATEGORIES[0], CATEGORIES[1:])


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    records, targets = _categorized(spark, folder)
    plan = quotas.sample_plan(records, targets, CATEGORIES[0], CATEGORIES[1:])
    return quotas.quota_sample(records, plan, CATEGORIES, "event_key").select("event_id", *CATEGORIES)


def p4_available(spark: SparkSession, folder: str) -> DataFrame:
    """What the categories have and need, without the quotas."""
    return p4_report(spark, folder).select(*CATEGORIES, "target_bp", "min_rows", "available", "need", "target", "shortfall")


CHUNK = ["chunk_id", "document_id", "section", "page_start", "page_end", "text"]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.scan_noise(table(spark, folder, "chunks").select(*CHUNK)).select("chunk_id", "noise", "found_value").distinct()


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repaired_texts(table(spark, folder, "chunks").select(*CHUNK))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    capacities = [r[0] for r in table(spark, folder, "pack_bins").select("capacity_tokens").where("capacity_tokens IS NOT NULL").collect()]
    return packing.pack(table(spark, folder, "documents").select("doc_id", "n_tokens"), capacities)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.divided_items(_packed(spark, folder))


def p7_placement(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p7_held(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: documents, their pieces, tokens placed, containers that hold too much, documents placed in part."""
    placed = _packed(spark, folder)
    over = placed.groupBy("capacity_tokens", "block", "container").agg(F.sum("tokens").alias("t")).groupBy("capacity_tokens").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    parts = placed.groupBy("capacity_tokens", "doc_id").agg(F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.sum("tokens").alias("t"))
    whole = parts.groupBy("capacity_tokens").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.count_if(F.col("n") != F.col("pieces")).alias("n_partial"))
    return whole.join(over, "capacity_tokens")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(_packed(spark, folder))


def _mixable(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("doc_id", "n_tokens", F.array(tidy("source")).alias("members"))
    return documents, table(spark, folder, "mix_targets")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(*_mixable(spark, folder), "members")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(p8_report(spark, folder))


def p8_routed(spark: SparkSession, folder: str) -> DataFrame:
    """What the flow routes to each source."""
    return p8_report(spark, folder).select("source", "own_tokens", F.round("quota", 2).alias("quota"), F.round("routed", 2).alias("routed"), "reachable")


def _shared(spark: SparkSession, folder: str) -> DataFrame:
    """One document per text, the first that has it, with all sources that hold the text as its members."""
    own = table(spark, folder, "documents").where("text IS NOT NULL AND text != ''").select(F.sha2("text", 256).alias("digest"), "doc_id", "n_tokens", tidy("source").alias("s"))
    return own.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.collect_set("s").alias("members"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a mix without copies, in which a text that several sources hold may count for any of them."""
    return mixing.mix_report(_shared(spark, folder), table(spark, folder, "mix_targets"), "members")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(*_mixable(spark, folder), "members")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "documents").select("doc_id", "text"))


def p9_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in the one form, each word in one script."""
    return lookalike.with_canonical(table(spark, folder, "documents").select("doc_id", "text"), scripts=True).select("doc_id", F.col("canonical").alias("text"))


def p9_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Of the texts of plain characters, which are in the one form already, length and digest of their form."""
    own = lookalike.with_canonical(table(spark, folder, "documents").select("doc_id", "text"), scripts=True).where(F.col("text").rlike(r"^[ -~\n]*$"))
    return own.select("doc_id", F.length("canonical").cast("bigint").alias("n"), F.md5("canonical").alias("digest"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_coverage, p2_found, p2_splits, p3_found, p3_defects, p4_found, p4_report, p4_available, p4_margins, p4_sample, p5_found, p5_text, p7_found, p7_placement, p7_held, p7_report, p8_found, p8_report, p8_routed, p8_mix, p8_shared, p9_found, p9_text, p9_plain, p9_classes)
}

_EVENTS = """
events AS (
  SELECT lower(trim(event_id)) AS event_key, any_value(lower(trim(proposed_split))) AS split,
    any_value(lower(trim(metadata.event_type))) AS event_type, any_value(lower(trim(metadata.severity))) AS severity
  FROM selection GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p4_found": f"""
WITH {_EVENTS},
counted AS (
  SELECT CASE split WHEN 'dev' THEN 'development' ELSE split END AS split, event_type, severity, count(*) AS have
  FROM events GROUP BY 1, 2, 3)
SELECT t.proposed_split, t.event_type, t.severity FROM sample_targets t
LEFT JOIN counted c ON c.split = lower(t.proposed_split) AND c.event_type = lower(t.event_type) AND c.severity = lower(t.severity)
WHERE coalesce(c.have, 0) < greatest(t.min_rows, ((SELECT count(*) FROM events) // 4) * t.target_bp // 10000)""",
    "p4_available": f"""
WITH {_EVENTS},
counted AS (
  SELECT CASE split WHEN 'dev' THEN 'development' ELSE split END AS split, event_type, severity, count(*) AS have
  FROM events GROUP BY 1, 2, 3),
size AS (SELECT count(*) // 4 AS n FROM events),
needed AS (
  SELECT t.proposed_split, t.event_type, t.severity, t.target_bp, t.min_rows, coalesce(c.have, 0) AS available,
    greatest(t.min_rows, size.n * t.target_bp // 10000) AS need, CAST(size.n * t.target_bp AS DOUBLE) / 10000 AS target
  FROM sample_targets t CROSS JOIN size
  LEFT JOIN counted c ON c.split = lower(t.proposed_split) AND c.event_type = lower(t.event_type) AND c.severity = lower(t.severity))
SELECT *, greatest(need - available, 0) AS shortfall FROM needed""",
    "p7_held": """
SELECT CAST(c AS BIGINT) AS capacity_tokens, count(*) AS n_documents, CAST(sum(greatest(1, (t + c - 1) // c)) AS BIGINT) AS n_pieces,
  CAST(sum(t) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_partial, CAST(0 AS BIGINT) AS n_overfull
FROM (SELECT DISTINCT capacity_tokens AS c FROM pack_bins) CROSS JOIN (SELECT coalesce(n_tokens, 0) AS t FROM documents) GROUP BY c""",
    "p8_routed": """
WITH own AS (SELECT lower(trim(source)) AS s, sum(n_tokens) AS t FROM documents GROUP BY 1),
size AS (SELECT sum(n_tokens) * 3 // 5 AS n FROM documents)
SELECT m.source, CAST(coalesce(own.t, 0) AS BIGINT) AS own_tokens, CAST(round(size.n * m.target_bp / 10000.0, 2) AS DOUBLE) AS quota,
  CAST(round(least(size.n * m.target_bp / 10000.0, m.max_repeats * coalesce(own.t, 0)), 2) AS DOUBLE) AS routed,
  m.max_repeats * coalesce(own.t, 0) * 10000 >= m.target_bp * size.n AS reachable
FROM mix_targets m CROSS JOIN size LEFT JOIN own ON own.s = lower(trim(m.source))""",
    "p7_found": """
SELECT CAST(b.capacity_tokens AS BIGINT) AS capacity_tokens, d.doc_id
FROM documents d JOIN (SELECT DISTINCT capacity_tokens FROM pack_bins) b ON d.n_tokens > b.capacity_tokens""",
    "p8_found": """
WITH own AS (SELECT lower(trim(source)) AS s, sum(n_tokens) AS t FROM documents GROUP BY 1),
size AS (SELECT sum(n_tokens) * 3 // 5 AS n FROM documents)
SELECT m.source FROM mix_targets m LEFT JOIN own ON own.s = lower(trim(m.source)), size
WHERE m.max_repeats * coalesce(own.t, 0) * 10000 < m.target_bp * size.n""",
    "p9_plain": """
SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE regexp_full_match(text, '[ -~\n]*')""",
    "p2_found": """
WITH RECURSIVE
one AS (
  SELECT lower(trim(event_id)) AS e, any_value(trim(event_id)) AS event_id, any_value(lower(trim(proposed_split))) AS split,
    any_value(lower(trim(event_family_id))) AS f, any_value(lower(trim(source_id))) AS s, any_value(lower(trim(author))) AS a
  FROM selection GROUP BY 1),
tied AS (
  SELECT e, 'f' || f AS k FROM one WHERE f NOT IN ('', '-', 'unknown', 'n/a', 'tbd')
  UNION SELECT e, 's' || s FROM one WHERE s NOT IN ('', '-', 'unknown', 'n/a', 'tbd')
  UNION SELECT e, 'a' || a FROM one WHERE a NOT IN ('', '-', 'unknown', 'n/a', 'tbd')),
steps AS (SELECT DISTINCT x.e AS e, y.e AS e2 FROM tied x JOIN tied y ON x.k = y.k),
reach AS (SELECT e, e AS r FROM one UNION SELECT reach.e, steps.e2 FROM reach JOIN steps ON steps.e = reach.r),
grp AS (SELECT e, min(r) AS g FROM reach GROUP BY 1),
torn AS (
  SELECT g FROM grp JOIN one USING (e) GROUP BY g
  HAVING count(DISTINCT CASE split WHEN 'dev' THEN 'development' WHEN '' THEN NULL ELSE split END) > 1)
SELECT first.event_id AS group_event_id, one.event_id FROM torn
JOIN grp ON grp.g = torn.g JOIN one ON one.e = grp.e JOIN one first ON first.e = torn.g""",
}
