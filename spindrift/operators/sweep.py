"""Sweeps: what is due goes to a model in batches, what comes back goes through the gate, and every outcome is
recorded.

A model is any function of pandas batches, so that a server, a library in the worker or a stub can stand for
it; it runs in mapInPandas, apart from everything else, and its answers are kept before they are judged, so
that a later step that is run again doesn't ask again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_text, faithful
from ..session import ship
from ..storage import kept
from . import digest, summaries
from .evaluate import faithfulness

#: What a model is asked: attempt counts earlier failures; facts are sorted lists; ground is all that was said.
ASKED = ("cluster_id", "attempt", "seed", "temperature", "entities", "numbers", "dates", "ground")
#: What it answers; error in place of the rest if it couldn't.
ANSWERED = "cluster_id string, headline string, tldr string, refs array<string>, error string"
#: Sampling of a first attempt. Parameters.
SEED, TEMPERATURE = 7, 0.2

Model = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass
class Swept:
    """rows as they stand after a sweep; outcomes (cluster_id, outcome, error, headline, tldr), one for each row
    that was due; and the number of each outcome, those set aside among the failed counted apart."""

    rows: DataFrame
    outcomes: DataFrame
    counts: DataFrame


def ground_of(events: DataFrame) -> DataFrame:
    """(cluster_id, ground): titles and best texts of a cluster's events, in order."""
    said = best_text(F.col("full_text"), F.col("body")) if "full_text" in events.columns else F.col("body")
    line = F.concat_ws("\n", "title", said)
    lists = events.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("event_time", "event_id", line.alias("t")))).alias("x"))
    return lists.select("cluster_id", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("ground"))


def asked(due: DataFrame, events: DataFrame) -> DataFrame:
    """The questions about due clusters (cluster_id, summary_hash of their stored summary, attempts,
    retry_reset), and what their content hashes to now; clusters without events ask nothing."""
    mine = events.join(due.select("cluster_id"), "cluster_id", "left_semi")
    now = digest.summary_hash(mine, ["cluster_id"], ["event_time", "event_id"]).withColumnRenamed("summary_hash", "hash")
    facts = summaries.extract_facts(mine, ["cluster_id"])
    attempt = F.when(F.col("retry_reset"), 0).otherwise(F.coalesce("attempts", F.lit(0)))
    first = due.select("cluster_id", attempt.alias("attempt"), F.col("summary_hash").alias("was"), "retry_reset")
    seed, heat = summaries.for_attempt(F.lit(SEED).cast("long"), F.lit(TEMPERATURE), F.col("attempt"))
    return first.join(now, "cluster_id").join(facts, "cluster_id").join(ground_of(mine), "cluster_id").withColumns({"seed": seed, "temperature": heat})


def answers(questions: DataFrame, model: Model) -> DataFrame:
    """ANSWERED rows of a model. A question that it leaves out, or a batch that raises, is an error."""
    ship(questions.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                said = model(batch)
            except Exception as problem:  # noqa: BLE001  a model may fail in any way, and the sweep goes on
                said = pd.DataFrame({"cluster_id": batch["cluster_id"], "error": type(problem).__name__})
            said = batch[["cluster_id"]].merge(said.drop_duplicates("cluster_id"), "left", "cluster_id")
            for name in ("headline", "tldr", "refs", "error"):
                if name not in said:
                    said[name] = None
            said = said.astype(object).where(said.notna(), None)
            said.loc[said["headline"].isna() & said["error"].isna(), "error"] = "no answer"
            yield said[["cluster_id", "headline", "tldr", "refs", "error"]]

    return questions.select(*ASKED).mapInPandas(run, ANSWERED)


def judged(questions: DataFrame, said: DataFrame) -> DataFrame:
    """(cluster_id, verdict, headline, tldr): passed, why the gate refused it, or null with the model's error."""
    both = questions.select("cluster_id", "entities", "ground").join(said, "cluster_id")
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    reason = faithful(F.col("headline"), F.coalesce("tldr", F.lit("")), refs, F.col("entities"), F.col("ground"))
    return both.select("cluster_id", F.when(F.col("error").isNull(), F.coalesce(reason, F.lit("passed"))).alias("verdict"), "error", "headline", "tldr")


def sweep_clusters(rows: DataFrame, events: DataFrame, model: Model, name: str, at: Column, limit: int | None = None) -> Swept:
    """One sweep over clusters (cluster_id, updated_at, last_event_time, summarized_at, summary, summary_hash,
    summary_model, attempts, last_error, quarantined_at) and their events (cluster_id, event_id, event_time,
    title, body, links, entities).

    Due are clusters without a summary, changed since, or of another model; the newest `limit` of them. Where
    the content still hashes to what was summarized, only the stamp moves. The rest are asked; an answer that
    passes the gate is stored, all else is a failure, and the last that is allowed sets the cluster aside until
    it changes.
    """
    waiting = summaries.due(rows, F.lit(name))
    if limit is not None:
        waiting = summaries.newest(waiting, limit, "cluster_id")
    questions = kept(asked(waiting, events))
    same = F.col("was").eqNullSafe(F.col("hash"))
    verdicts = judged(questions, kept(answers(questions.filter(~same), model)))
    failed = F.coalesce(F.col("verdict"), F.concat(F.lit("model:"), F.col("error")))
    done = questions.select("cluster_id", "hash", "retry_reset", same.alias("same")).join(verdicts, "cluster_id", "left")
    outcome = F.when(F.col("same"), "unchanged").when(F.col("verdict") == "passed", "stored").otherwise("failed")
    outcomes = kept(done.select("cluster_id", "hash", "retry_reset", outcome.alias("outcome"), F.when(outcome == "failed", failed).alias("error"), "headline", "tldr"))
    summary = F.to_json(F.struct("headline", "tldr"))
    record = outcomes.select("cluster_id", "outcome", summary.alias("summary"), F.col("hash").alias("summary_hash"), F.lit(name).alias("summary_model"), "error", "retry_reset")
    after = kept(summaries.store(rows, record, "cluster_id", at))
    aside = after.filter(F.col("quarantined_at") == at).select("cluster_id", F.lit(True).alias("aside"))
    said = F.when(F.col("aside"), "quarantined").otherwise(F.col("outcome"))
    counts = outcomes.join(aside, "cluster_id", "left").groupBy(said.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return Swept(after, outcomes.drop("hash", "retry_reset"), counts)


def evaluate_model(clusters: DataFrame, events: DataFrame, model: Model, limit: int) -> DataFrame:
    """faithfulness() of a model on the newest public clusters: asked and judged as in a sweep, nothing stored."""
    sample = summaries.newest(clusters.filter("scope_kind = 'public'"), limit, "cluster_id")
    none = sample.select("cluster_id", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("summary_hash"), F.lit(False).alias("retry_reset"))
    questions = kept(asked(none, events))
    return faithfulness(judged(questions, kept(answers(questions, model))))


def sweep_enrichment(events: DataFrame, model: Model, through: Column, sources: list[str], at: Column, limit: int) -> DataFrame:
    """events after a sweep over those that link-poor sources brought and that aren't built yet, the oldest
    `limit`: the model's names (event_id, names: kind, name) become tokens where the event's own text has
    them, its salience raises the severity, and enriched_at is set. Where the model failed (error) the event
    stays as it was and waits for the next sweep."""
    ship(events.sparkSession)
    waiting = kept(summaries.pending_enrichment(events, through, sources, limit).select("event_id", F.concat_ws("\n", "title", "body").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)[["event_id", "names", "salience", "error"]]

    said = kept(waiting.mapInPandas(run, "event_id long, names array<struct<kind:string,name:string>>, salience int, error string"))
    return digest.enriched(events, waiting, said.filter("error is null"), at)
