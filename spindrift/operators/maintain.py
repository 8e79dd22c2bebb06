"""The maintenance pass over subscribers' threads: sources, resolution, communities, matching, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import feedback_delta
from ..operators import threads
from ..storage import kept
from .mutations import upsert


def co_occurrence_sources(stories: DataFrame, members: DataFrame, clusters: DataFrame, since: Column) -> DataFrame:
    """(subscriber, story_id, last_event_time, entities, sources) of stories with news since then: what their
    clusters name, addresses left out, and their sources; a story whose clusters name nothing is kept."""
    recent = stories.filter(F.col("last_event_time") >= since).select("subscriber", "story_id", F.col("last_event_time").alias("_at"))
    mine = recent.join(members.select("subscriber", "story_id", "cluster_id"), ["subscriber", "story_id"]).join(clusters.select("cluster_id", "source", "entities"), "cluster_id")
    each = mine.select("subscriber", "story_id", "_at", "source", F.explode_outer(threads.spine(F.col("entities"))).alias("e"))
    distinct = each.groupBy("subscriber", "story_id", "_at").agg(F.array_sort(F.collect_set("e")).alias("entities"), F.array_sort(F.collect_set("source")).alias("sources"))
    return distinct.withColumnRenamed("_at", "last_event_time")


def care_since(feedback: DataFrame, since: Column) -> DataFrame:
    """(subscriber, thread_id, care): what later feedback on threads (target_type, target_id, signal,
    created_at) adds to their affinity."""
    f = feedback.filter((F.col("target_type") == "thread") & (F.col("created_at") > since))
    return f.groupBy("subscriber", F.col("target_id").alias("thread_id")).agg(F.sum(feedback_delta(F.col("signal"))).alias("care"))


def _key(c: str) -> Column:
    return F.concat(F.col("subscriber").cast("string"), F.lit("\x1f"), F.col(c))


def maintain(sources: DataFrame, prior: DataFrame, care: DataFrame, since: Column, now: Column, edges: DataFrame | None = None, vetoes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Threads after the pass, and the weights of their entities, both by subscriber.

    sources: as co_occurrence_sources() gives them; prior: subscriber, thread_id, entities, affinity, pinned,
    first_seen, last_story_time; care: as care_since() gives it; edges and vetoes: identities (a, b,
    confidence) beside those that names suggest. Entities are resolved, communities of what occurs together
    are matched with prior threads, whose ids they keep; threads that none claims are carried forward; those
    absorbed are left out and pass their care on. A thread is measured on the sources that share an entity
    with it.
    """
    by = ("subscriber",)
    # each step is read by several of those that follow, which would plan and run it again each time
    sources, prior = kept(sources), kept(prior)
    spined = prior.withColumn("entities", threads.spine(F.col("entities")))
    nodes = kept(sources.select(F.explode("entities").alias("id")).distinct())
    # a forest holds together what all edges do, but not without those that are vetoed
    named = (threads.lexical_forest(nodes) if vetoes is None else threads.lexical_edges(nodes, vetoes)).select("a", "b", "confidence")
    known = named if edges is None else named.unionByName(edges.select("a", "b", "confidence"))
    reps = kept(threads.resolve(nodes, known, vetoes).select("id", "representative", "band"))
    resolved = sources.select("subscriber", "story_id", "last_event_time", F.explode("entities").alias("id")).join(reps, "id")
    items = resolved.groupBy("subscriber", "story_id", "last_event_time").agg(F.collect_set("representative").alias("entities"))
    graph = threads.co_occurrence(items.withColumnRenamed("last_event_time", "at"), now, by=by)
    # no component spans subscribers, so tasks that have theirs whole tell least of them on
    keyed = graph.repartition("subscriber").select(_key("a").alias("a"), _key("b").alias("b"), "weight")
    found = kept(threads.communities(threads.label_propagation(keyed)))
    old = spined.select(_key("thread_id").alias("thread_id"), F.transform("entities", lambda e: F.concat(F.col("subscriber").cast("string"), F.lit("\x1f"), e)).alias("entities"), "pinned")
    matched = kept(threads.match_threads(found, old))
    bare = lambda c: F.substring_index(c, "\x1f", -1)
    who = F.substring_index("label", "\x1f", 1).cast("long")
    minted = F.concat(F.lit("thread-"), F.sha2("label", 256).substr(1, 24))
    found_in = matched.select(who.alias("subscriber"), F.coalesce(bare(F.col("thread_id")), minted).alias("thread_id"), F.transform("entities", bare).alias("entities"), F.transform(F.coalesce("merged", F.array().cast("array<string>")), bare).alias("absorbed"))
    claimed = found_in.select("subscriber", "thread_id").unionByName(found_in.select("subscriber", F.explode("absorbed").alias("thread_id")))
    carried = spined.join(claimed, ["subscriber", "thread_id"], "left_anti").select("subscriber", "thread_id", "entities", F.array().cast("array<string>").alias("absorbed"))
    every = found_in.unionByName(carried).join(prior.select("subscriber", "thread_id", "affinity", "pinned", "first_seen", "last_story_time"), ["subscriber", "thread_id"], "left")
    every = kept(every.withColumns({"affinity": F.coalesce("affinity", F.lit(0.0)), "pinned": F.coalesce("pinned", F.lit(False))}))
    passed = every.select("subscriber", F.explode(F.concat(F.array("thread_id"), F.col("absorbed"))).alias("from"), "thread_id").join(care.select("subscriber", F.col("thread_id").alias("from"), "care"), ["subscriber", "from"])
    total = passed.groupBy("subscriber", "thread_id").agg(F.sum("care").alias("care"))
    measured = threads.thread_metrics(every.drop("absorbed"), sources, since, now, total, by=by)
    bands = every.select("subscriber", "thread_id", F.explode("entities").alias("id")).join(reps.select("id", "band"), "id").groupBy("subscriber", "thread_id").agg(F.max(F.when(F.col("band") == "uncertain", 2).when(F.col("band") == "probable", 1).otherwise(0)).alias("_weak"))
    band = F.when(F.col("_weak") == 2, "uncertain").when(F.col("_weak") == 1, "probable").otherwise("confirmed")
    out = measured.join(bands, ["subscriber", "thread_id"], "left").withColumn("band", band).drop("_weak").join(every.select("subscriber", "thread_id", "entities", "pinned", "absorbed"), ["subscriber", "thread_id"])
    out = kept(out)
    return out, threads.project_weights(out, by=by)


def save_threads(stored: DataFrame, written: DataFrame) -> DataFrame:
    """Stored threads (subscriber, thread_id, entities, affinity, pinned, state, first_seen, last_story_time,
    merged_into) after a pass: written ones in their place, absorbed ones pointing to what took them in."""
    cols = [c for c in stored.columns if c != "merged_into"]
    fresh = written.select(*cols).withColumn("merged_into", F.lit(None).cast("string"))
    taken = written.select("subscriber", F.explode("absorbed").alias("thread_id"), F.col("thread_id").alias("_by"))
    marked = stored.join(taken, ["subscriber", "thread_id"], "left").withColumn("merged_into", F.coalesce("_by", "merged_into")).select(*stored.columns)
    return upsert(marked, fresh.select(*stored.columns), ["subscriber", "thread_id"])
