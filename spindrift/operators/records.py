"""Records of connections, subscribers, events and digests: scans, checks and changes as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import next_run
from .mutations import upsert
from .rollup import KEY, append_new

#: Sources, and which of them can hold private content, link to articles, and gain from enrichment. Fixed values.
SOURCES, PRIVATE_SOURCES, ARTICLE_SOURCES, ENRICHABLE_SOURCES = ("rss", "github", "slack"), ("github", "slack"), ("rss",), ("rss",)
#: Seconds between polls, tries of an article, characters from which a text is longform, and a schedule's defaults. Fixed values.
POLL_SECS, FETCH_ATTEMPTS, LONGFORM_CHARS, FREQ, ZONE, DIGEST_TIME = 900, 3, 400, "daily", "UTC", "08:00"


def append_counted(log: DataFrame, batch: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The new rows of a batch, and for each scope how many were inserted and how many were there already."""
    new = append_new(log, batch, key)
    got = batch.groupBy("scope_kind", "owner").agg(F.count(F.lit(1)).alias("n"))
    kept = new.groupBy(F.col("scope_kind").alias("_s"), F.col("owner").alias("_o")).agg(F.count(F.lit(1)).alias("inserted"))
    j = got.join(kept, (F.col("scope_kind") == F.col("_s")) & F.col("owner").eqNullSafe(F.col("_o")), "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return new, j.select("scope_kind", "owner", "inserted", (F.col("n") - F.col("inserted")).alias("deduplicated"))


def advance_cursor(connections: DataFrame, polled: DataFrame, now: Column) -> DataFrame:
    """connections after polls that went well (connection_id, cursor): the cursor kept, failures forgotten, the
    next poll an interval on."""
    j = connections.join(polled.select("connection_id", F.col("cursor").alias("_c"), F.lit(True).alias("_ok")), "connection_id", "left")
    new = {"cursor": F.coalesce("_c", "cursor"), "consecutive_failures": F.when(F.col("_ok"), 0).otherwise(F.col("consecutive_failures")), "status": F.when(F.col("_ok"), "active").otherwise(F.col("status"))}
    new["next_poll_at"] = F.when(F.col("_ok"), now + F.make_dt_interval(secs=F.col("poll_interval_secs"))).otherwise(F.col("next_poll_at"))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in connections.columns])


def store_full_text(events: DataFrame, fetched: DataFrame) -> DataFrame:
    """events after fetches (event_id, text, permanent): a text is kept and, if long, makes its event longform;
    a failure (no text) counts, and one that won't mend spends all tries."""
    j = events.join(fetched.select("event_id", "text", "permanent", F.lit(True).alias("_tried")), "event_id", "left")
    tried = F.coalesce("attempts", F.lit(0)) + 1
    new = {"full_text": F.coalesce("text", "full_text"), "attempts": F.when(F.col("_tried") & F.col("text").isNull() & F.col("permanent"), FETCH_ATTEMPTS).when(F.col("_tried"), tried).otherwise(F.col("attempts"))}
    new["content_kind"] = F.when(F.length("text") >= LONGFORM_CHARS, "longform").otherwise(F.col("content_kind"))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])


def touched_by_fetch(events: DataFrame, fetched: DataFrame) -> DataFrame:
    """(scope, source, group, raise_depth) of groups that got a text: to be marked updated, and raised where one is long."""
    got = fetched.filter("text is not null").select("event_id", (F.length("text") >= LONGFORM_CHARS).alias("_long"))
    return events.join(got, "event_id").groupBy(*KEY).agg(F.bool_or("_long").alias("raise_depth"))


def connection_problem(source: Column, config: Column, owner: Column) -> Column:
    """Why a connection can't be made; null if it can."""
    return (
        F.when(~F.coalesce(source.isin(*SOURCES), F.lit(False)), F.concat(F.lit("unknown source '"), F.coalesce(source, F.lit("")), F.lit("'")))
        .when(source.isin(*PRIVATE_SOURCES) & owner.isNull(), F.concat(F.lit("a "), source, F.lit(" connection needs an owner")))
        .when(F.try_parse_json(config).isNull(), F.lit("config is not valid JSON"))
        .when((source == "github") & F.get_json_object(config, "$.installation_id").try_cast("long").isNull(), F.lit("a github config needs an integer installation_id"))
    )


def prepare_connections(wanted: DataFrame) -> DataFrame:
    """Connections that can be made (connection_id, source, config, poll_interval_secs, owner): with the
    account that deliveries are routed by, and the usual interval if none is asked for."""
    account = F.when(F.col("source") == "github", F.get_json_object("config", "$.installation_id").try_cast("long").cast("string"))
    interval = F.when(F.col("poll_interval_secs") > 0, F.col("poll_interval_secs")).otherwise(POLL_SECS)
    fine = wanted.filter(connection_problem(F.col("source"), F.col("config"), F.col("owner")).isNull())
    return fine.select("connection_id", "source", "config", interval.alias("poll_interval_secs"), "owner", account.alias("provider_account_id"))


def schedule_problem(freq: Column, weekday: Column, digest_time: Column) -> Column:
    """Why a schedule can't be kept; null if it can. Empty values stand for the defaults."""
    asked = schedule_freq(freq, weekday)
    time = F.when(F.coalesce(digest_time, F.lit("")) == "", DIGEST_TIME).otherwise(digest_time)
    return (
        F.when(~asked.isin("daily", "weekly"), F.concat(F.lit("unknown frequency '"), asked, F.lit("'")))
        .when((asked == "weekly") & ~F.coalesce(weekday.between(0, 6), F.lit(False)), F.lit("a weekly schedule needs a weekday from 0 to 6"))
        .when((asked == "daily") & weekday.isNotNull(), F.lit("a daily schedule has no weekday"))
        .when(~time.rlike("^([01]?[0-9]|2[0-3]):[0-5]?[0-9]$"), F.lit("digest_time must be HH:MM (24-hour)"))
    )


def schedule_freq(freq: Column, weekday: Column) -> Column:
    return F.when(F.coalesce(freq, F.lit("")) != "", freq).when(weekday.isNotNull(), "weekly").otherwise(FREQ)


def set_schedules(subscribers: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """subscribers with the schedules that are fine (subscriber, freq, weekday, timezone, digest_time), new
    ones among them, due at their next slot."""
    fine = wanted.filter(schedule_problem(F.col("freq"), F.col("weekday"), F.col("digest_time")).isNull())
    time = F.when(F.coalesce(F.col("digest_time"), F.lit("")) == "", DIGEST_TIME).otherwise(F.col("digest_time"))
    zone = F.when(F.coalesce(F.col("timezone"), F.lit("")) == "", ZONE).otherwise(F.col("timezone"))
    minute = (F.split(time, ":")[0].cast("int") * 60 + F.split(time, ":")[1].cast("int")).cast("int")
    asked = fine.select("subscriber", schedule_freq(F.col("freq"), F.col("weekday")).alias("freq"), F.coalesce("weekday", F.lit(0)).alias("weekday"), zone.alias("timezone"), minute.alias("minute"))
    made = asked.withColumn("next_run_at", next_run(now, F.col("timezone"), F.col("minute"), F.col("freq"), F.col("weekday")))
    was = subscribers.select("subscriber", "last_run")
    return upsert(subscribers, made.join(was, "subscriber", "left").select(*subscribers.columns), ["subscriber"])


def due_subscribers(subscribers: DataFrame, now: Column) -> DataFrame:
    """Subscribers whose digest is due, the longest due first."""
    return subscribers.filter(F.col("next_run_at") <= now).orderBy("next_run_at", "subscriber")


def build_due(events: DataFrame, through: Column, until: Column) -> DataFrame:
    """One row: whether public events wait to be built."""
    waiting = events.filter((F.col("scope_kind") == "public") & (F.col("ingest_time") > through) & (F.col("ingest_time") <= until))
    return waiting.limit(1).agg((F.count(F.lit(1)) > 0).alias("due"))


def summary_gate(require: Column, band: Column) -> Column:
    """Whether a cluster may be shown: if a summary is required, only with one of some confidence."""
    return ~require | F.coalesce(band.isin("confirmed", "probable"), F.lit(False))


def edges_and_vetoes(edges: DataFrame, visible: Column) -> tuple[DataFrame, DataFrame]:
    """What is visible of identity edges (a, b, confidence): links, and pairs that must not be one."""
    seen = edges.filter(visible)
    return seen.filter("confidence >= 0"), seen.filter("confidence < 0").select("a", "b")


def recent_events(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit)


def put_config(config: DataFrame, new: DataFrame) -> DataFrame:
    """The one row of the configuration, replaced by a new one if there is any."""
    both = new.withColumn("_p", F.lit(0)).unionByName(config.withColumn("_p", F.lit(1)))
    return both.orderBy("_p").limit(1).drop("_p")


def tolerant(raw: Column, schema: str, default: Column) -> Column:
    """Raw JSON as a value of the schema; the default where it isn't one."""
    return F.coalesce(F.from_json(raw, schema, {"mode": "PERMISSIVE"}), default)


def record_decisions(digests: DataFrame, decisions: DataFrame, lead: DataFrame | None = None) -> DataFrame:
    """digests with what decided them: for each, how often each verdict was given and why stories were left
    out, and the lead (digest_id, lead). The decisions themselves are a table of their own, by digest."""
    counted = decisions.groupBy("digest_id", "verdict", "drop_cause").agg(F.count(F.lit(1)).alias("n"))
    said = counted.groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct("verdict", "drop_cause", "n"))).alias("decided"))
    out = digests.join(said, "digest_id", "left")
    return out if lead is None else out.join(lead, "digest_id", "left")
