"""Scalar functions of scoring, ages and schedules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFIRMED, PROBABLE, TEMPORAL_WINDOW_DAYS, Scoring


def micros(t: Column) -> Column:
    """Microseconds since the epoch of a zone-less time, read as UTC."""
    return F.unix_micros(t.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds; the difference is cut, not the times."""
    d = micros(later) - micros(earlier)
    return F.when(d < 0, -F.floor(-d / 1_000_000)).otherwise(F.floor(d / 1_000_000)).cast("double")


def recency_decay(now: Column, t: Column, half_life_days: float) -> Column:
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(seconds_between(now, t), F.lit(0.0)) / 86_400.0 / half_life_days)


def base_relevance(private: Column, cfg: Scoring) -> Column:
    return F.when(private, 1.0 + cfg.scope_bonus).otherwise(F.lit(1.0))


def relevance(private: Column, thread: Column, cfg: Scoring) -> Column:
    return base_relevance(private, cfg) + thread


def priority(private: Column, thread: Column, severity: Column, t: Column, now: Column, cfg: Scoring) -> Column:
    """Freshness, salience and thread, each ageing at its own pace."""
    return (
        base_relevance(private, cfg) * recency_decay(now, t, cfg.recency_half_life_days)
        + cfg.severity_weight * F.coalesce(severity, F.lit(0)) * recency_decay(now, t, cfg.salience_half_life_days)
        + thread * recency_decay(now, t, cfg.thread_half_life_days)
    )


def richness(sources: Column, events: Column, depth: Column) -> Column:
    return F.when(sources > 1, "multi-source").when(events > 1, "multi-event").when(depth == 2, "longform").when(depth == 1, "announcement").otherwise("message")


def natural_format(richness_: Column) -> Column:
    return F.when(richness_.isin("announcement", "message"), "note").otherwise("story")


def namespace_prior(entity: Column) -> Column:
    kind = F.substring_index(entity, ":", 1)
    return (
        F.when(~F.contains(entity, F.lit(":")), 0.0)
        .when(kind.isin("cve", "url", "person"), 1.0)
        .when(kind.isin("repo", "user"), 0.9)
        .when(kind == "org", 0.8)
        .when(kind == "place", 0.7)
        .otherwise(0.0)
    )


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def link_strength(entity: Column) -> Column:
    """strong, weak, or null for what never links."""
    return (
        F.when(entity.rlike("^(cve|url):"), "strong")
        .when(entity.startswith("user:"), F.when(~entity.endswith("[bot]"), "weak"))
        .when(entity.rlike("^(repo|place|org|person):"), "weak")
    )


def temporal_closeness(a: Column, b: Column) -> Column:
    return F.greatest(1.0 - F.abs(seconds_between(a, b)) / 86_400.0 / TEMPORAL_WINDOW_DAYS, F.lit(0.0))


def band(confidence: Column) -> Column:
    return F.when(confidence >= CONFIRMED, "confirmed").when(confidence >= PROBABLE, "probable").otherwise("uncertain")


def decay_affinity(prior: Column, elapsed_secs: Column, half_life_days: float, delta: Column, most: float) -> Column:
    aged = prior * F.pow(F.lit(0.5), F.greatest(elapsed_secs, F.lit(0.0)) / (86_400.0 * half_life_days))
    return F.least(F.greatest(aged + delta, F.lit(0.0)), F.lit(most))


def thread_state(last: Column, now: Column, pinned: Column, dormant_days: int, archive_days: int) -> Column:
    age = micros(now) - micros(last)
    day = 86_400_000_000
    return F.when(last.isNull() | (age < dormant_days * day), "active").when(pinned | (age < archive_days * day), "dormant").otherwise("archived")


def feedback_delta(signal: Column) -> Column:
    return F.when(signal == "care_more", 1.0).when(signal == "care_less", -1.0).when(signal == "done", -5.0).otherwise(0.0)


def grade(signal: Column) -> Column:
    return F.when(signal == "care_more", "up").when(signal.isin("care_less", "done"), "down")


def gain(grade_: Column) -> Column:
    return F.when(grade_ == "up", 2.0).when(grade_ == "down", 0.0).otherwise(1.0)


def candidate_floor(last_run: Column, now: Column, horizon_days: int, most_days: int) -> Column:
    """How far back candidates go; never run before counts as the horizon alone."""
    return F.greatest(F.least(last_run, now - F.expr(f"interval {horizon_days} days")), now - F.expr(f"interval {most_days} days"))


def display_floor(last_run: Column, now: Column, freq: Column) -> Column:
    window = F.when(freq == "weekly", now - F.expr("interval 8 days")).otherwise(now - F.expr("interval 36 hours"))
    return F.least(F.coalesce(last_run, window), window)


def next_run(ref: Column, tz: Column, minute_of_day: Column, freq: Column, weekday: Column) -> Column:
    """The next slot strictly after ref (a zone-less UTC time), reckoned on the local wall clock; weekday 0
    is Sunday. A wall-clock time that occurs twice means its second, standard-time, occurrence."""
    local = F.from_utc_timestamp(ref.cast("timestamp"), tz)
    at = F.make_dt_interval(mins=minute_of_day)
    shift = F.pmod(weekday - (F.dayofweek(local) - 1), F.lit(7))
    day = F.to_date(local)
    daily = day.cast("timestamp") + at
    weekly = F.date_add(day, shift).cast("timestamp") + at
    cand = F.when(freq == "daily", F.when(daily <= local, daily + F.expr("interval 1 day")).otherwise(daily)).otherwise(F.when(weekly <= local, weekly + F.expr("interval 7 days")).otherwise(weekly))
    first = F.to_utc_timestamp(cand, tz)
    later = first + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(later, tz) == cand, later).otherwise(first).cast("timestamp_ntz")


def poll_backoff_secs(interval_secs: Column, failures: Column, most: int) -> Column:
    return F.least(interval_secs * F.pow(F.lit(2.0), failures), F.lit(float(most))).cast("long")


#: Importance of words for impact and of kinds of code-forge activity; anything else is routine. Fixed values.
IMPACT = {"routine": 0, "notable": 1, "significant": 2, "major": 3}
FORGE_IMPACT = {"ReleaseEvent": "significant", "IssuesEvent": "notable", "PullRequestEvent": "notable"}


def impact_score(impact: Column) -> Column:
    """A model's word for impact as a number; what isn't such a word counts as routine."""
    known = F.create_map(*[F.lit(x) for pair in IMPACT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(impact))), F.lit(0))


def forge_importance(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in FORGE_IMPACT.items() for x in (k, IMPACT[v])])
    return F.coalesce(F.try_element_at(known, kind), F.lit(0))
