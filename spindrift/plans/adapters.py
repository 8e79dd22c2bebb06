"""Views of the test tables in the shapes that the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sorted_set
from ..schema import depth_rank

#: The clock and the subscriber of the registered queries.
NOW, SUBSCRIBER = "2024-01-31 00:00:00", 8


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a sealed event log."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"-?[0-9]+", 0).try_cast("int")
    kind = F.when(F.col("event_type").isin("error", "signup"), "announcement").when(F.col("event_type") == "purchase", "longform").otherwise("message")
    cve = F.when((F.col("event_type") == "error") & (k < 5), F.concat(F.lit("cve:CVE-2024-"), F.lpad((k + 1000).cast("string"), 4, "0")))
    private = F.col("user_id") % 4 == 0
    return e.select(
        "event_id",
        F.col("event_id").cast("string").alias("stable_id"),
        F.col("event_type").alias("source"),
        F.when(private, "private").otherwise("public").alias("scope_kind"),
        F.when(private, F.col("user_id")).alias("owner"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("event_id") % 7)).alias("ingest_time"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("body"),
        F.array().cast("array<string>").alias("links"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("group_key"),
        sorted_set(F.array(cve, F.concat(F.lit("repo:k"), k.cast("string")), F.concat(F.lit("user:u"), F.col("user_id").cast("string")))).alias("entities"),
        kind.alias("content_kind"),
        depth_rank(kind).alias("depth_rank"),
        F.when(F.col("event_type") == "error", F.least(F.lit(3), F.floor(F.col("value") / 100).cast("int"))).alias("severity"),
        F.when(k % 10 != 0, k % 10).cast("long").alias("connection_id"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is subscribed to three of the ten connections."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("subscriber")).distinct()
    return users.withColumn("connection_id", F.explode(F.transform(F.array(F.lit(0), F.lit(2), F.lit(5)), lambda d: (F.col("subscriber") + d) % 9 + 1)))


#: event_log and subscriptions for the oracle.
EVENT_LOG_SQL = """
SELECT *, list_sort(list_filter([cve, 'repo:k' || k, 'user:u' || user_id], lambda x: x IS NOT NULL)) AS entities,
  CASE content_kind WHEN 'longform' THEN 2 WHEN 'announcement' THEN 1 ELSE 0 END AS depth_rank,
  CASE WHEN k % 10 <> 0 THEN k % 10 END AS connection_id
FROM (
  SELECT event_id, user_id, CAST(event_id AS VARCHAR) AS stable_id, event_type AS source,
    CASE WHEN user_id % 4 = 0 THEN 'private' ELSE 'public' END AS scope_kind,
    CASE WHEN user_id % 4 = 0 THEN user_id END AS owner,
    ts AS event_time, ts + to_minutes(event_id % 7) AS ingest_time,
    event_type || ' by user ' || user_id AS title, 'u' || user_id AS group_key, k,
    CASE WHEN event_type = 'error' AND k < 5 THEN 'cve:CVE-2024-' || lpad(CAST(1000 + k AS VARCHAR), 4, '0') END AS cve,
    CASE WHEN event_type IN ('error', 'signup') THEN 'announcement' WHEN event_type = 'purchase' THEN 'longform' ELSE 'message' END AS content_kind,
    CASE WHEN event_type = 'error' THEN least(3, CAST(floor(value / 100) AS INTEGER)) END AS severity
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k FROM events)
)
"""
SUBSCRIPTION_SQL = "SELECT DISTINCT user_id AS subscriber, (user_id + unnest([0, 2, 5])) % 9 + 1 AS connection_id FROM events"
