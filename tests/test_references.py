from datetime import datetime, timedelta

from docketry.operators.references import existence_deltas, judged_references, orphan_report, orphan_times, reference_deltas
from docketry.streaming.references import delta_stream, running_orphans
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
day = lambda n: T0 + timedelta(days=n)
ROWS = "key string, ingested_at timestamp, deleted_at timestamp, ref_key string"
REFS = "record string, ref_key string, created_at timestamp, key string"


def judged(spark, rows, refs):
    r = spark.createDataFrame([(*x, "clash") for x in rows], ROWS)
    q = spark.createDataFrame([(*x, "clash") for x in refs], REFS).drop("key")
    out = judged_references(q, existence_deltas(r, F.col("key")))
    return sorted(((x["record"], x["ref_key"], x["reason"]) for x in out.collect()), key=str)


def test_reasons_against_brute_force(spark):
    rows = [("a", day(1), None), ("b", day(1), day(5)), ("c", day(9), None), ("d", day(3), day(2)), ("e", day(1), day(4)), ("e", day(6), None), ("a", day(1), None), ("f", None, None), (None, day(1), None), ("g", day(2), day(2))]
    refs = [(f"{k}{t}", k, day(t)) for k in "abcdefgz" for t in (0, 1, 2, 3, 4, 5, 6, 9, 12)] + [("n", "a", None)]

    def reason(key, at):
        own = [x for x in rows if x[0] == key]
        if not own:
            return "missing"
        seen = [x for x in own if at is not None and x[1] is not None and x[1] <= at]
        if any(x[2] is None or x[2] > at for x in seen):
            return None
        return "deleted" if seen else "late"

    assert judged(spark, rows, refs) == sorted(((r, k, reason(k, t)) for r, k, t in refs), key=str)


def test_within_one_day(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    got = spark.createDataFrame([(str(n), "a", hour(n)) for n in (4, 5, 6, 7)], "record string, ref_key string, created_at timestamp")
    out = judged_references(got, existence_deltas(spark.createDataFrame([("a", hour(5), hour(7), "")], ROWS), F.col("key")))
    assert {r["record"]: r["reason"] for r in out.collect()} == {"4": "late", "5": None, "6": None, "7": "deleted"}


def test_empty_tables(spark):
    assert judged(spark, [], []) == []
    assert judged(spark, [], [("r", "a", day(1))]) == [("r", "a", "missing")]
    assert judged(spark, [("a", day(1), None)], []) == []


def test_current_orphans(spark):
    rows = spark.createDataFrame([("a", day(1), None, ""), ("b", day(1), day(2), ""), ("c", day(1), None, "")], ROWS)
    refs = [("r", "b", day(3), None), ("r", "a", day(3), None), ("s", "b", day(3), None), ("s", "z", None, None), ("t", "y", day(1), day(2)), ("u", "b", day(4), day(5)), ("v", None, day(1), None)]
    made = reference_deltas(spark.createDataFrame(refs, "record string, ref_key string, created_at timestamp, dropped_at timestamp"), went="dropped_at")
    existence = existence_deltas(rows, F.col("key"))
    got = {r["key"]: (r["refs"], r["alive"], r["ever"]) for r in orphan_report(made, existence).collect()}
    assert got == {"b": (2, 0, 1), "z": (1, 0, 0)}
    times = {(r["key"], r["at"]): (r["refs"], r["reason"]) for r in orphan_times(made, existence).collect()}
    assert times[("b", day(4))] == (3, "deleted") and times[("b", day(5))] == (2, "deleted") and times[("y", day(1))] == (1, "missing") and ("y", day(2)) not in times
    assert orphan_report(made.limit(0), existence).count() == 0


def test_streaming_report(spark, tmp_path):
    schema = "key string, refs int, alive int"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 0, 1), (None, 1, 0)], schema).write.parquet(source)
    out = running_orphans(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("orphans").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        out.processAllAvailable()
        assert [(r["key"], r["refs"]) for r in spark.table("orphans").collect()] == [("a", 1)]
        spark.createDataFrame([("a", 0, 1), ("b", 0, -1)], schema).write.mode("append").parquet(source)
        out.processAllAvailable()
        assert [(r["key"], r["refs"]) for r in spark.table("orphans").collect()] == [("b", 1)]
    finally:
        out.stop()


def test_stream_gives_the_batch_report(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 7}", day(i), day(i + 3) if i % 2 else None, "") for i in range(20)] + [("k9", day(1), day(2), "")], ROWS)
    refs = spark.createDataFrame([(str(i), f"k{i % 11}", day(i)) for i in range(40)], "record string, ref_key string, created_at timestamp")
    made, existence = reference_deltas(refs), existence_deltas(rows, F.col("key"))
    made.write.parquet(str(tmp_path / "refs"))
    existence.write.parquet(str(tmp_path / "rows"))
    streams = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)) for df, name in ((made, "refs"), (existence, "rows"))]
    out = running_orphans(delta_stream(*streams)).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        out.processAllAvailable()
        got = sorted((r["key"], r["refs"], r["alive"]) for r in spark.table("running").collect())
    finally:
        out.stop()
    assert got == sorted((r["key"], r["refs"], r["alive"]) for r in orphan_report(made, existence).collect()) != []
