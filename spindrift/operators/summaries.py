"""Facts, frontiers and records of summaries; models themselves are outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prose import compose_tldr, eyebrow, reason_line
from ..functions.text import best_text, numbers_and_dates, sorted_set
from .threads import spine

#: Failures after which an input is set aside until it changes. Fixed value.
ATTEMPTS = 4
#: Steps of seed and temperature with each attempt, and the greatest temperature. Fixed values.
SEED_STEP, HEAT_STEP, HEAT_MOST = 0x9E3779B9, 0.15, 0.9
#: Words for kinds and states of what happened that a model may use. Parameters.
EVENT_TYPES, STATES = ("release", "incident", "decision", "change", "announcement", "other"), ("planned", "ongoing", "resolved", "none")


def extract_facts(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, entities, numbers, dates): what a group's events name, sorted and distinct: their nameable
    entities, and numbers and dates of their titles and best texts. Each is made distinct before it is
    gathered."""
    said = best_text(F.col("full_text"), F.col("body")) if "full_text" in events.columns else F.col("body")
    parts = [numbers_and_dates(F.coalesce(t, F.lit(""))) for t in (F.col("title"), said)]
    kinds = {"entities": spine(F.coalesce("entities", F.array().cast("array<string>"))), "numbers": F.concat(*[p[0] for p in parts]), "dates": F.concat(*[p[1] for p in parts])}
    tag = lambda k, xs: F.transform(xs, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("x")))
    tagged = F.flatten(F.array(*[tag(k, xs) for k, xs in kinds.items()]))
    each = events.select(*by, F.explode(tagged).alias("f")).select(*by, "f.kind", "f.x").distinct()
    lists = each.groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in kinds])
    none = F.array().cast("array<string>")
    return events.select(*by).distinct().join(lists, by, "left").select(*by, *[F.coalesce(k, none).alias(k) for k in kinds])


def apply_comprehension(facts: DataFrame) -> DataFrame:
    """facts (event_type, state, tentative, and a model's said_type, said_state, said_tentative) with what the
    model said where it is one of the words it may use."""
    typed = F.col("said_type").isin(*[t for t in EVENT_TYPES if t != "other"])
    stated = F.col("said_state").isin(*[t for t in STATES if t != "none"])
    return facts.withColumns({"event_type": F.when(typed, F.col("said_type")).otherwise(F.col("event_type")), "state": F.when(stated, F.col("said_state")).otherwise(F.col("state")), "tentative": F.col("said_tentative")})


def apply_relations(entities: Column, relations: Column) -> Column:
    """A model's relations (subject, predicate, object), trimmed, without those that lack a part or whose
    subject isn't an entity, each once."""
    trimmed = F.transform(F.coalesce(relations, F.array()), lambda r: F.struct(*[F.trim(r[k]).alias(k) for k in ("subject", "predicate", "object")]))
    return F.array_distinct(F.filter(trimmed, lambda r: (r["subject"] != "") & (r["predicate"] != "") & (r["object"] != "") & F.array_contains(entities, r["subject"])))


def due(rows: DataFrame, model: Column, changed: str = "updated_at") -> DataFrame:
    """Clusters or stories (summarized_at, summary_model, quarantined_at, updated_at, merged_into if stories)
    to summarize: never done, changed since, or of another model, and not set aside since they last changed;
    with retry_reset, whether a change has let them in again."""
    stale = F.col("summarized_at").isNull() | (F.col(changed) > F.col("summarized_at")) | ~F.col("summary_model").eqNullSafe(model)
    back = F.coalesce(F.col(changed) > F.col("quarantined_at"), F.lit(False))
    live = rows.filter("merged_into is null") if "merged_into" in rows.columns else rows
    return live.filter(stale & (F.col("quarantined_at").isNull() | back)).withColumn("retry_reset", back)


def newest(rows: DataFrame, limit: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows by last_event_time, of each group of `by` if there is one."""
    if not by:
        return rows.orderBy(F.desc("last_event_time"), key).limit(limit)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("last_event_time"), key))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def threads_due(threads: DataFrame, model: Column, limit: int) -> DataFrame:
    """Each subscriber's live threads to name: never done, of another model, or with news since their delta."""
    stale = F.col("summarized_at").isNull() | ~F.col("summary_model").eqNullSafe(model) | ~F.col("last_story_time").eqNullSafe(F.col("delta_through"))
    live = threads.filter(F.col("merged_into").isNull() & (F.col("state") != "archived") & stale)
    rank = F.row_number().over(W.partitionBy("subscriber").orderBy(F.desc_nulls_last("last_story_time"), "thread_id"))
    return live.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def thread_recent_stories(threads: DataFrame, stories: DataFrame, members: DataFrame, clusters: DataFrame, limit: int) -> DataFrame:
    """(subscriber, thread_id, place, story_id, last_event_time, headline): a thread's newest stories, those of
    which a member cluster shares an entity with it, under the headline of their latest cluster."""
    wanted = threads.select("subscriber", "thread_id", F.explode("entities").alias("e"))
    having = members.join(clusters.select("cluster_id", F.explode("entities").alias("e")), "cluster_id").select("subscriber", "story_id", "e").distinct()
    hit = wanted.join(having, ["subscriber", "e"]).select("subscriber", "thread_id", "story_id").distinct()
    line = F.coalesce(F.when(F.trim("headline") != "", F.col("headline")), F.col("title")) if "headline" in clusters.columns else F.col("title")
    latest = members.join(clusters.select("cluster_id", F.col("last_event_time").alias("_at"), line.alias("headline")), "cluster_id").groupBy("subscriber", "story_id").agg(F.max_by("headline", F.struct("_at", "cluster_id")).alias("headline"))
    live = stories.filter("merged_into is null") if "merged_into" in stories.columns else stories
    told = hit.join(live.select("subscriber", "story_id", "last_event_time"), ["subscriber", "story_id"]).join(latest, ["subscriber", "story_id"])
    place = F.row_number().over(W.partitionBy("subscriber", "thread_id").orderBy(F.desc("last_event_time"), "story_id"))
    return told.withColumn("place", place).filter(F.col("place") <= limit).select("subscriber", "thread_id", "place", "story_id", "last_event_time", "headline")


def store(rows: DataFrame, done: DataFrame, key: str, at: Column) -> DataFrame:
    """rows after a sweep's outcomes (key, outcome: stored, unchanged or failed, summary, summary_hash,
    summary_model, error): a stored summary replaces the old and clears its failures; unchanged input only
    moves the stamp and clears them; a failure counts, from 0 again if the input changed since it was set
    aside (retry_reset), and the last allowed one sets the input aside."""
    o = done.select(F.col(key).alias("_k"), "outcome", *[F.col(c).alias(f"_{c}") for c in ("summary", "summary_hash", "summary_model", "error", "retry_reset")])
    j = rows.join(o, F.col(key) == F.col("_k"), "left")
    is_ = lambda *k: F.coalesce(F.col("outcome").isin(*k), F.lit(False))
    n = F.when(F.col("_retry_reset"), F.lit(0)).otherwise(F.coalesce("attempts", F.lit(0))) + 1
    new = {c: F.when(is_("stored"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("summary", "summary_hash", "summary_model")}
    new["summarized_at"] = F.when(is_("stored", "unchanged"), at).otherwise(F.col("summarized_at"))
    new["attempts"] = F.when(is_("stored", "unchanged"), 0).when(is_("failed"), n).otherwise(F.col("attempts"))
    new["last_error"] = F.when(is_("failed"), F.col("_error")).when(~is_("stored", "unchanged"), F.col("last_error"))
    new["quarantined_at"] = F.when(is_("failed"), F.when(n >= ATTEMPTS, at)).when(~is_("stored", "unchanged"), F.col("quarantined_at"))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def for_attempt(seed: Column, temperature: Column, attempt: Column) -> tuple[Column, Column]:
    """Seed (modulo 2^32) and temperature of a retry."""
    again = attempt > 0
    return F.when(again, F.pmod(seed + attempt * SEED_STEP, F.lit(1 << 32))).otherwise(seed), F.when(again, F.least(temperature + HEAT_STEP * attempt, F.lit(HEAT_MOST))).otherwise(temperature)


def pending_enrichment(events: DataFrame, through: Column, sources: list[str], limit: int) -> DataFrame:
    """Public events of link-poor sources that aren't enriched and weren't built yet, oldest first."""
    return events.filter((F.col("scope_kind") == "public") & F.col("enriched_at").isNull() & F.col("source").isin(*sources) & (F.col("ingest_time") > through)).orderBy("ingest_time", "event_id").limit(limit)


def render_items(items: DataFrame, digests: DataFrame, members: DataFrame, clusters: DataFrame, fan_in: int = 6) -> DataFrame:
    """(digest_id, position, story_id, cluster_id, headline, tldr, connections): each item under its
    representative, the story's latest cluster, with its other clusters newest first, so many at most, and a
    summary composed of their headlines (clusters: cluster_id, title, headline, last_event_time)."""
    told = items.join(digests.select("digest_id", "subscriber"), "digest_id").join(members, ["subscriber", "story_id"]).join(clusters, "cluster_id")
    newest_first = W.partitionBy("digest_id", "position").orderBy(F.desc("last_event_time"), F.desc("cluster_id"))
    line = F.coalesce(F.when(F.trim("headline") != "", F.trim("headline")), F.trim("title"))
    near = told.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= fan_in + 1)
    lists = near.groupBy("digest_id", "position", "story_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "cluster_id", line.alias("line")))).alias("x"))
    others = F.slice("x", 2, fan_in)
    first = F.get("x", F.lit(0))
    return lists.select("digest_id", "position", "story_id", first["cluster_id"].alias("cluster_id"), first["line"].alias("headline"), compose_tldr(F.transform(others, lambda s: s["line"])).alias("tldr"), F.transform(others, lambda s: s["cluster_id"]).alias("connections"))


def render_parts(items: DataFrame, digests: DataFrame, members: DataFrame, clusters: DataFrame | None, threads: DataFrame, fan_in: int = 6) -> DataFrame:
    """All that an item is rendered from: digest_id, position, format, headline, tldr, link, source,
    last_event_time, reason, thread (as sure as its band is, with what is new), connections (title, source,
    link_reason, link).

    items: digest_id, story_id, position, format, richness, relevance, thread_id; members: subscriber, story_id,
    cluster_id, link_reason; clusters: cluster_id, title, headline, link, source, last_event_time, or None if members
    have these columns themselves; threads: subscriber, thread_id, label, band, delta, of which only the digest's
    subscriber's own are told. A story's clusters are gathered once, where its members are, whatever shows it.
    """
    told = members if clusters is None else members.select("subscriber", "story_id", "cluster_id", "link_reason").join(clusters, "cluster_id")
    newest_first = W.partitionBy("story_id", "subscriber").orderBy(F.desc("last_event_time"), F.desc("cluster_id"))
    line = F.coalesce(F.when(F.trim("headline") != "", F.trim("headline")), F.trim("title"))
    one = F.struct(line.alias("title"), "source", "link_reason", "link", "last_event_time")
    near = F.collect_list("_one").over(newest_first.rowsBetween(W.currentRow, fan_in))
    lists = told.select("subscriber", "story_id", "cluster_id", "last_event_time", one.alias("_one")).select("subscriber", "story_id", F.row_number().over(newest_first).alias("_rn"), near.alias("x")).filter("_rn = 1")
    first, others = F.get("x", F.lit(0)), F.slice("x", 2, fan_in)
    # threads are told before the lists are, which are wider
    own = items.join(digests.select("digest_id", "subscriber"), "digest_id").join(threads.select("subscriber", "thread_id", "label", "band", "delta"), ["subscriber", "thread_id"], "left")
    return own.join(lists, ["story_id", "subscriber"]).select(
        "digest_id", "position", "format", first["title"].alias("headline"), compose_tldr(F.transform(others, lambda c: c["title"])).alias("tldr"), first["link"].alias("link"), first["source"].alias("source"),
        first["last_event_time"].alias("last_event_time"), reason_line(F.col("format"), F.col("richness"), F.col("relevance")).alias("reason"), eyebrow(F.col("label"), F.col("band"), F.col("delta")).alias("thread"),
        F.transform(others, lambda c: F.struct(c["title"].alias("title"), c["source"].alias("source"), c["link_reason"].alias("link_reason"), c["link"].alias("link"))).alias("connections"),
    )


def cards(clusters: DataFrame, ids: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The clusters that a list of ids names."""
    return clusters.join(ids.select(key).distinct(), key, "left_semi")


def join_facts(members: DataFrame) -> DataFrame:
    """A story's facts from those of its clusters (story_id, position, entities, numbers, dates, tentative,
    event_type, state): unions; tentative if any is; the first type and state that one has."""
    none = F.array().cast("array<string>")
    union = lambda c: sorted_set(F.flatten(F.collect_list(F.coalesce(c, none)))).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    return members.groupBy("story_id").agg(union("entities"), union("numbers"), union("dates"), F.bool_or("tentative").alias("tentative"), first("event_type"), first("state"))
