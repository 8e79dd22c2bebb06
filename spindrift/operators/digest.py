"""Digests: what was shown, freezing, the render walk, provenance, facts and text assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import best_text, grounded_token, normalize_text, sorted_set
from .rollup import KEY


def last_shown(items: DataFrame, digests: DataFrame, before: Column, since: Column) -> DataFrame:
    """(subscriber, story_id, shown_time, shown_format, window_end): each story's latest item in a digest
    whose window ended before `before` and not before `since`, delivered or not."""
    d = digests.filter((F.col("window_end") < before) & (F.col("window_end") >= since)).select("digest_id", "subscriber", "window_end")
    j = items.join(d, "digest_id")
    newest = W.partitionBy("subscriber", "story_id").orderBy(F.desc("window_end"), F.desc("digest_id"))
    return j.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select(
        "subscriber", "story_id", F.col("story_last_event_time").alias("shown_time"), F.col("format").alias("shown_format"), "window_end"
    )


def freeze(decisions: DataFrame, digests: DataFrame, subscriber: Column, window_end: Column) -> tuple[DataFrame, DataFrame]:
    """The digest and its items of selected decisions, empty if that window has one already. Items keep the
    natural format, so that a damped story isn't taken to have grown."""
    new = decisions.select(subscriber.alias("subscriber"), window_end.alias("window_end")).distinct().join(digests.select("subscriber", "window_end"), ["subscriber", "window_end"], "left_anti")
    new = new.withColumn("digest_id", F.abs(F.xxhash64("subscriber", "window_end")))
    items = decisions.filter("verdict = 'selected'").withColumns({"subscriber": subscriber, "window_end": window_end}).join(new, ["subscriber", "window_end"])
    return new, items.select("digest_id", "story_id", "position", "thread_id", F.col("last_event_time").alias("story_last_event_time"), F.col("natural_format").alias("format"))


def mark_delivered(digests: DataFrame, digest_ids: DataFrame, at: Column) -> DataFrame:
    """digests with those delivered now that weren't before."""
    j = digests.join(digest_ids.select("digest_id", F.lit(True).alias("_now")), "digest_id", "left")
    return j.withColumn("delivered_at", F.coalesce("delivered_at", F.when(F.col("_now"), at))).drop("_now")


def digest_list(digests: DataFrame, items: DataFrame, subscribers: DataFrame, limit: int) -> DataFrame:
    """The newest digests with their subscriber's name and their number of items."""
    n = items.groupBy("digest_id").agg(F.count(F.lit(1)).alias("n_items"))
    return digests.join(subscribers, "subscriber").join(n, "digest_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).orderBy(F.desc("window_end"), F.desc("digest_id")).limit(limit)


def render_walk(items: DataFrame, digests: DataFrame, stories: DataFrame, threads: DataFrame) -> DataFrame:
    """Items in order with their story, and their thread if it is the subscriber's own."""
    t = threads.select(F.col("thread_id"), F.col("subscriber"), "label", "band")
    j = items.join(digests.select("digest_id", "subscriber"), "digest_id").join(stories, "story_id").join(t, ["thread_id", "subscriber"], "left")
    shown = F.when(F.col("band") == "probable", F.concat(F.lit("possibly "), "label")).when(F.col("band") == "uncertain", F.lit(None).cast("string")).otherwise(F.col("label"))
    return j.withColumn("thread_label", shown).drop("label", "band")


def story_timeline(story_members: DataFrame, clusters: DataFrame, events: DataFrame) -> DataFrame:
    """(story_id, event_id, source, event_time, title): the events that a story is made of. A merged story
    (members: story_id, cluster_id, merged_into) shows its survivor's."""
    m = story_members
    if "merged_into" in m.columns:
        here = m.select(F.coalesce("merged_into", "story_id").alias("of"), F.col("story_id").alias("asked")).distinct()
        m = here.join(m.filter("merged_into is null").select(F.col("story_id").alias("of"), "cluster_id"), "of").select(F.col("asked").alias("story_id"), "cluster_id")
    c = m.join(clusters.select("cluster_id", *[F.col(k).alias(f"_{k}") for k in KEY]), "cluster_id")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return events.join(c, same).select("story_id", "cluster_id", "event_id", "source", "event_time", "title")


def lead_tiers(selected: DataFrame, by: tuple[str, ...] = ("subscriber",)) -> DataFrame:
    """Titles of the first three selected stories, and of the next three."""
    lists = selected.filter("position < 6").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("x"))
    titles = F.transform("x", lambda s: s["title"])
    return lists.select(*by, F.slice(titles, 1, 3).alias("dominant"), F.slice(titles, 4, 3).alias("also"))


def source_corpus(events: DataFrame, most: int, by: list[str], order: list[str], text: str) -> DataFrame:
    """(by, corpus): texts newest first, joined by newlines, as many characters as fit the budget. Texts
    that begin beyond the budget are cut off before they are gathered; one that begins just there stays, as the
    newline before it fits."""
    newest = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    before = F.coalesce(F.sum(F.length(text) + 1).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = events.withColumn("_before", before).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_before") <= most)
    lists = near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(text).alias("t")))).alias("x"))
    return lists.select(*by, F.substring(F.array_join(F.transform("x", lambda s: s["t"]), "\n"), 1, most).alias("corpus"))


def summary_hash(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, summary_hash): SHA-256 over title, best text (the full text if it was fetched, else the body),
    links and entities of a group's events in order, with a separator after each field and each item of a
    list."""
    said = best_text(F.col("full_text"), F.col("body")) if "full_text" in events.columns else F.col("body")
    field, item = "\x00", "\x1f"
    many = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(item))), "")
    framed = F.concat(F.coalesce("title", F.lit("")), F.lit(field), F.coalesce(said, F.lit("")), F.lit(field), many(F.col("links")), F.lit(field), many(F.col("entities")), F.lit(field))
    lists = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, framed.alias("f")))).alias("x"))
    return lists.select(*by, F.sha2(F.array_join(F.transform("x", lambda s: s["f"]), ""), 256).alias("summary_hash"))


def member_signature(members: DataFrame) -> DataFrame:
    """(story_id, signature) over the sorted hashes of a story's clusters."""
    return members.groupBy("story_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("summary_hash")), ""), 256).alias("signature"))


def needs_summary(rows: DataFrame, signature: Column, model: Column, limit: int, most_attempts: int = 4) -> DataFrame:
    """Rows whose summary is missing, of another input or of another model, and that haven't failed too
    often; newest first."""
    stale = ~F.col("summary_hash").eqNullSafe(signature) | ~F.col("summary_model").eqNullSafe(model)
    return rows.filter(stale & (F.coalesce("summary_attempts", F.lit(0)) < most_attempts)).orderBy(F.desc("last_event_time"), "cluster_id").limit(limit)


def apply_enrichment(events: DataFrame, found: DataFrame) -> DataFrame:
    """events with found tokens (event_id, tokens, salience) added to their entities, and their severity
    raised to the salience if that is above 0."""
    j = events.join(found, "event_id", "left")
    severity = F.when(F.col("salience") > 0, F.greatest("severity", "salience")).otherwise(F.col("severity"))
    entities = F.when(F.col("tokens").isNotNull(), sorted_set(F.concat("entities", "tokens"))).otherwise(F.col("entities"))
    return j.withColumns({"entities": entities, "severity": severity}).drop("tokens", "salience")


def enriched(events: DataFrame, texts: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """events after found names (event_id, names: kind, name; salience) of their texts (event_id, text): names
    that stand in the text become tokens, and enriched_at is set on all that were found out about."""
    told = found.join(texts, "event_id").withColumn("_source", normalize_text(F.col("text")))
    tokens = F.filter(F.transform(F.coalesce("names", F.array()), lambda x: grounded_token(x["kind"], x["name"], F.col("_source"))), lambda t: t.isNotNull())
    out = apply_enrichment(events, told.select("event_id", tokens.alias("tokens"), "salience"))
    seen = told.select("event_id", F.lit(True).alias("_seen"))
    return out.join(seen, "event_id", "left").withColumn("enriched_at", F.when(F.col("_seen"), at).otherwise(F.col("enriched_at"))).drop("_seen").select(*events.columns)
