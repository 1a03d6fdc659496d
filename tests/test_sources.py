from datetime import date

import pytest
from docketry.sources import reports, snapshots, tables
from pyspark.sql import functions as F


def test_snapshots_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "body string")
    assert snapshots.write_snapshots(df, folder).count() == 2
    assert snapshots.write_snapshots(df.union(spark.createDataFrame([("c",)], "body string")), folder).count() == 1
    held = spark.read.parquet(folder)
    assert held.count() == 3 and snapshots.broken_snapshots(spark, folder).count() == 0
    assert all(r["sha256"].startswith(r["prefix"]) for r in held.withColumn("prefix", F.col("prefix").cast("string")).collect() if not r["prefix"].isdigit())


def test_cases_in_every_envelope(spark):
    one = '{"eventId":" E1 ","CASENUMBER":"ABC24LA001","eventDate":"2024-02-03T00:00:00Z","secret":"x"}'
    rows = [one, f"[{one}]", f'{{"cases":[{one}]}}', f'{{"results":[{one},{{"note":"no id"}}]}}', "not json", None, "{}", '{"data":[{"AccidentNumber":"N2","eventDate":"soon"}]}']
    got = snapshots.case_records(spark.createDataFrame([(r,) for r in rows], "payload string")).collect()
    assert [(r["event_id"], r["occurred_on"]) for r in got] == [("E1", date(2024, 2, 3))] * 4 + [("N2", None)]
    assert "secret" not in got[0].asDict()


@pytest.mark.parametrize("url, want", [(None, "missing"), ("https://ok.example/a.pdf", None), ("https://ok.example:443/a", None), ("http://ok.example/a", "not_https"), ("https://u:p@ok.example/a", "credentials"), ("https://ok.example:8443/a", "port"), ("https://bad.example/a", "host"), ("nonsense", "malformed")])
def test_where_reports_may_come_from(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(snapshots.url_problem(F.col("u"), ["ok.example"])).first()[0] == want


def test_discovery_limits(spark):
    rows = [(date(2024, 1, 1), date(2024, 1, 31), "Aviation", None), (date(2024, 1, 1), date(2024, 2, 1), "Aviation", None), (date(2024, 1, 2), date(2024, 1, 1), "Aviation", "m"), (date(2024, 1, 1), date(2024, 1, 1), "Aviation", "m")]
    got = [r["source_id"] for r in snapshots.discovery_ids(spark.createDataFrame(rows, "first date, last date, mode string, marker string")).collect()]
    assert got[0] == "aviation-2024-01-01-2024-01-31" and len(got) == 2 and "-marker-" in got[1]


def test_reports(spark):
    df = spark.createDataFrame([("b|c", 0.5, None), ("a", None, 2)], "k string, v double, n int")
    assert reports.markdown(df, "T") == "# T\n\n| k | v | n |\n|---|---|---|\n| a | – | 2 |\n| b\\|c | 0.5000 | – |\n"
    assert reports.pretty_json(df.limit(0)) == "[]\n"


@pytest.mark.parametrize("bits", [1 << 15, 1 << 28])
def test_rows_of_single_keys_stay_in_place(spark, monkeypatch, bits):
    monkeypatch.setattr(tables, "MOST_BITS", bits)
    # Keys of one, two and three rows: the last to arrive counts, of equal times the largest, null times come first.
    df = spark.range(40_000).selectExpr("CASE WHEN id % 97 = 0 THEN NULL WHEN id < 9000 THEN concat('k', id % 4000) ELSE concat('k', id) END AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 3 END AS ingested_at", "id % 11 AS v", "concat('t', id % 7) AS w")
    got, want = tables.one_per_key_in_place(df, "k", ["w", "v"]), tables.one_per_key(df, "k", ["w", "v"])
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    for hashes, least in ((df.where("k = 'k5'"), 1), (df.limit(0), 0)):
        found = {r["k"] for r in tables.marked(df.where("k IS NOT NULL"), "k", hashes.select(F.xxhash64("k").alias("hash")), least).where("marked").select("k").distinct().collect()}
        assert ("k5" in found) == bool(least) and len(found) < 100
