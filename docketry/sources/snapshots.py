"""Content-addressed snapshots of source bodies, case payloads, and checks of where reports may be fetched from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import cut_lineage

#: Largest body that is taken, in bytes.
LARGEST_BODY = 25 * 1024 * 1024


def with_digest(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with sha256 (of body, lower-case hexadecimal) and prefix, its first two digits. Null bodies have neither."""
    return bodies.withColumn("sha256", F.sha2(F.col(body), 256)).withColumn("prefix", F.substring("sha256", 1, 2))


def write_snapshots(bodies: DataFrame, folder: str, body: str = "body") -> DataFrame:
    """Adds to folder the bodies that it doesn't hold yet, each once, partitioned by prefix; returns what was added.

    The name of a body is its digest, so writing again adds nothing and no body is ever replaced. Digests that are there
    are read without their bodies. Null bodies and those above LARGEST_BODY are left out.
    """
    spark = bodies.sparkSession
    own = with_digest(bodies, body).where(F.col("sha256").isNotNull() & (F.octet_length(body) <= LARGEST_BODY))
    own = own.dropDuplicates(["sha256"])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        own = own.join(spark.read.parquet(folder).select("sha256"), "sha256", "left_anti")
    own = cut_lineage(own)  # what is new is settled before the folder changes
    own.write.mode("append").partitionBy("prefix").parquet(folder)
    return own.select("sha256")


def broken_snapshots(spark: SparkSession, folder: str, body: str = "body") -> DataFrame:
    """(sha256, problem) of snapshots whose body isn't what their name says."""
    return spark.read.parquet(folder).where(F.sha2(F.col(body), 256) != F.col("sha256")).select("sha256", F.lit("digest_differs").alias("problem"))


def field(values: Column, *names: str) -> Column:
    """The first of names that a map has with a value that isn't blank, whatever the case of its keys; without blanks."""
    # Keys that differ only in case would clash as map keys, so entries are searched instead.
    entries = F.map_entries(values)
    found = [_entries_of(entries, n) for n in names]
    return F.coalesce(*[F.trim(F.try_element_at(x, F.lit(1))["value"]) for x in found])


def _entries_of(entries: Column, name: str) -> Column:
    return F.filter(entries, lambda e: (F.lower(e["key"]) == name.lower()) & (F.trim(e["value"]) != ""))


def case_records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(event_id, source_id, report_url, occurred_on, published_on, event_type) per case of JSON payloads.

    A payload is an object with a list named cases, data, results or value, a list, or one case. Field names are read in
    either spelling and any case; dates that can't be read are null, cases without an event or source id are left out,
    and unknown fields don't come along. Payloads that aren't JSON give no rows.
    """
    kind = "array<map<string,string>>"
    text = F.col(payload)
    lists = [F.from_json(F.get_json_object(text, f"$.{n}"), kind) for n in ("cases", "data", "results", "value")]
    whole = F.when(F.trim(text).startswith("["), F.from_json(text, kind)).when(F.trim(text).startswith("{"), F.array(F.from_json(text, "map<string,string>")))
    cases = payloads.select(F.explode(F.coalesce(*lists, whole)).alias("c")).where("c IS NOT NULL")
    date = lambda *names: F.to_date(F.try_to_timestamp(F.substring(field(F.col("c"), *names), 1, 10), F.lit("yyyy-MM-dd")))
    number = field(F.col("c"), "caseNumber", "AccidentNumber")
    out = cases.select(
        F.coalesce(field(F.col("c"), "eventId"), number).alias("event_id"), number.alias("source_id"), field(F.col("c"), "reportUrl").alias("report_url"),
        date("eventDate", "occurredOn").alias("occurred_on"), date("publishedDate").alias("published_on"), field(F.col("c"), "eventType", "InvestigationType").alias("event_type"),
    )
    return out.where("event_id IS NOT NULL")


def url_problem(url: Column, hosts: Sequence[str]) -> Column:
    """Why a report may not be fetched from url: missing, malformed, not_https, credentials, port, host; null if it may."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    port = F.regexp_extract(url, r"^[a-z]+://[^/]*:(\d+)(?:/|$)", 1)
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "missing").when(part("HOST").isNull(), "malformed").when(F.lower(part("PROTOCOL")) != "https", "not_https")
        .when(part("USERINFO").isNotNull(), "credentials").when(~port.isin("", "443"), "port").when(~F.lower(part("HOST")).isin(*hosts), "host")
    )


def discovery_ids(requests: DataFrame) -> DataFrame:
    """requests (first DATE, last DATE, mode, marker) that may be made, 1 to 31 days each, with their source_id.

    A page marker is hashed into the id, so that pages of one window are different sources.
    """
    days = F.datediff("last", "first") + 1
    page = F.when(F.col("marker").isNotNull(), F.concat(F.lit("-marker-"), F.substring(F.sha2("marker", 256), 1, 12))).otherwise("")
    return requests.where(days.between(1, 31)).withColumn("source_id", F.concat(F.lower("mode"), F.lit("-"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), page))
