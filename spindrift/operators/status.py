"""Counts of what is there and what is due, in one scan of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_stats(events: DataFrame, now: Column) -> DataFrame:
    day = now - F.expr("interval 1 day")
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("scope_kind") == "public").alias("public_events"), F.count_if(F.col("scope_kind") == "private").alias("private_events"),
        F.count_if(F.col("ingest_time") >= day).alias("events_24h"), F.count_if(F.size("entities") > 0).alias("with_entities"), F.count_if(F.col("severity").isNotNull()).alias("with_severity"),
    )


def by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _measures(block: str, df: DataFrame) -> DataFrame:
    """One row of measures as rows (block, measure, value); times are seconds since the epoch, to the nearest."""
    number = lambda f: F.rint(F.unix_micros(F.col(f.name).cast("timestamp")) / F.lit(1e6)).cast("long") if f.dataType.typeName().startswith("timestamp") else F.col(f.name).cast("long")
    pairs = F.array(*[F.struct(F.lit(f.name).alias("measure"), number(f).alias("value")) for f in df.schema.fields])
    return df.select(F.lit(block).alias("block"), F.explode(pairs).alias("x")).select("block", "x.measure", "x.value")


def connection_stats(connections: DataFrame, now: Column) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    due = (F.col("status") == "active") & (F.col("next_poll_at") <= now)
    return connections.agg(F.count(F.lit(1)).alias("total"), of("active"), of("paused"), of("errored"), F.count_if(due).alias("due_now"))


def event_backlog(events: DataFrame, through: Column, fetchable: list[str], attempts: int) -> DataFrame:
    """How many events there are, public ones that aren't built yet, and ones whose article is still to be
    fetched; and when the last came in."""
    public = F.col("scope_kind") == "public"
    fetch = public & F.col("full_text").isNull() & (F.col("full_text_attempts") < attempts) & F.col("source").isin(*fetchable) & (F.size("links") > 0)
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(public & (F.col("ingest_time") > through)).alias("unbuilt"), F.count_if(fetch).alias("fetch_pending"), F.max("ingest_time").alias("latest_ingest"))


def build_status(watermark: DataFrame, now: Column) -> DataFrame:
    """How far builds have come, and how far that is behind."""
    at = F.max("through")
    return watermark.agg(at.alias("built_through"), (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))).alias("lag_secs"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count(F.lit(1)).alias("total"), F.max("updated_at").alias("latest_updated"))


def subscriber_stats(subscribers: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    of = lambda f: F.count_if(F.col("freq") == f).alias(f)
    mine = subscribers.agg(F.count(F.lit(1)).alias("total"), of("daily"), of("weekly"), F.count_if(F.col("next_run_at") <= now).alias("due_now"), F.min("next_run_at").alias("next_run"))
    return mine.withColumn("subscriptions", subscriptions.agg(F.count(F.lit(1))).scalar())


def digest_stats(digests: DataFrame) -> DataFrame:
    sent = F.col("delivered_at").isNotNull()
    return digests.agg(F.count(F.lit(1)).alias("total"), F.count_if(~sent).alias("pending"), F.count_if(sent).alias("delivered"), F.max("delivered_at").alias("last_delivered"))


def report(connections: DataFrame, events: DataFrame, watermark: DataFrame, clusters: DataFrame, subscribers: DataFrame, subscriptions: DataFrame, digests: DataFrame, now: Column, through: Column, fetchable: list[str], attempts: int) -> DataFrame:
    """The whole status as rows (block, measure, value), one scan of each table."""
    blocks = {
        "connections": connection_stats(connections, now), "events": event_backlog(events, through, fetchable, attempts), "build": build_status(watermark, now),
        "clusters": cluster_stats(clusters), "subscribers": subscriber_stats(subscribers, subscriptions, now), "digests": digest_stats(digests),
    }
    rows = [_measures(name, df) for name, df in blocks.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def due_connections(connections: DataFrame, now: Column) -> DataFrame:
    return connections.filter((F.col("status") == "active") & (F.col("next_poll_at") <= now))


def due_maintenance(subscribers: DataFrame, watermarks: DataFrame, now: Column, cadence: str = "1 hour") -> DataFrame:
    """Subscribers whose threads weren't maintained for a cadence, never counting as long ago."""
    ran = F.coalesce("ran_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return subscribers.join(watermarks, "subscriber", "left").filter(ran <= now - F.expr(f"interval {cadence}")).select("subscriber")


def record_failure(connections: DataFrame, failed: DataFrame, now: Column, most_secs: int, most_failures: int) -> DataFrame:
    """connections (connection_id, status, poll_interval_secs, consecutive_failures, next_poll_at) after a
    failed poll: waiting twice as long each time, in error after so many."""
    j = connections.join(failed.select("connection_id", F.lit(True).alias("_f")), "connection_id", "left")
    n = F.col("consecutive_failures") + 1
    wait = F.least(F.col("poll_interval_secs") * F.pow(F.lit(2.0), n), F.lit(float(most_secs)))
    return j.withColumns(
        {
            "consecutive_failures": F.when(F.col("_f"), n).otherwise(F.col("consecutive_failures")),
            "status": F.when(F.col("_f") & (n >= most_failures), "errored").otherwise(F.col("status")),
            "next_poll_at": F.when(F.col("_f"), now + F.make_dt_interval(secs=wait)).otherwise(F.col("next_poll_at")),
        }
    ).drop("_f")


def fetch_frontier(events: DataFrame, limit: int, per_domain: int) -> DataFrame:
    """Links to fetch, newest first, so many of a domain at most: rows (event_id, link, domain)."""
    from pyspark.sql import Window as W

    link = F.get(F.filter("links", lambda x: F.lower(x).rlike("^https?://")), F.lit(0))
    due = events.withColumn("link", link).filter("link is not null and full_text is null and attempts < 3")
    domain = F.regexp_replace(F.lower(F.regexp_extract("link", r"^[A-Za-z]+://([^/?#]+)", 1)), r"^www\.", "")
    first = W.partitionBy("domain").orderBy(F.desc("event_time"), F.desc("event_id"))
    return due.withColumn("domain", domain).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= per_domain).orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit).select("event_id", "link", "domain")
