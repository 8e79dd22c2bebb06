"""Evaluation of selections against feedback, and replays under another configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import gain, grade
from ..schema import Scoring
from .select import score, select_full


def latest_grades(feedback: DataFrame) -> DataFrame:
    """(story_id, grade) by each story's newest signal that is one."""
    g = feedback.withColumn("grade", grade(F.col("signal"))).filter("grade is not null")
    return g.groupBy("story_id").agg(F.max_by("grade", "created_at").alias("grade"))


def ndcg(items: DataFrame, by: tuple[str, ...] = ("digest_id",)) -> DataFrame:
    """(by, ndcg) of rows (by, position, gain): discounted gain in the order shown over that in the best
    order; null without any gain."""
    best = W.partitionBy(*by).orderBy(F.desc("gain"), "position")
    place = W.partitionBy(*by).orderBy("position")
    r = items.withColumn("i", F.row_number().over(place) - 1).withColumn("j", F.row_number().over(best) - 1)
    s = r.groupBy(*by).agg(F.sum(F.col("gain") / F.log2(F.col("i") + 2.0)).alias("actual"), F.sum(F.col("gain") / F.log2(F.col("j") + 2.0)).alias("ideal"))
    return s.select(*by, F.when(F.col("ideal") > 0, F.col("actual") / F.col("ideal")).alias("ndcg"))


def evaluate(decisions: DataFrame, grades: DataFrame) -> DataFrame:
    """One row of metrics over decisions (digest_id, story_id, verdict, position, cause, format) and grades
    (story_id, grade)."""
    d = decisions.join(grades, "story_id", "left")
    picked = F.col("verdict") == "selected"
    per = d.groupBy("digest_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(picked).alias("selected"), F.count_if(F.col("verdict") == "over_cap").alias("over_cap"),
        F.count_if(F.col("cause") == "below_floor").alias("below_floor"), F.count_if(F.col("cause") == "stale_for_cadence").alias("stale"),
        F.count_if(picked & (F.col("format") == "story")).alias("stories"), F.count_if(picked & (F.col("format") == "note")).alias("notes"),
        F.count_if(picked & F.col("grade").isNotNull()).alias("n_graded"),
    )
    shown = d.filter(picked).select("digest_id", "position", gain(F.col("grade")).alias("gain"))
    per = per.join(ndcg(shown), "digest_id", "left")
    total = per.agg(
        F.count(F.lit(1)).alias("digests"), F.sum("candidates").alias("candidates"), F.sum("selected").alias("selected"), F.sum("over_cap").alias("over_cap"),
        F.sum("below_floor").alias("dropped_below_floor"), F.sum("stale").alias("dropped_stale_for_cadence"), F.sum("stories").alias("selected_stories"), F.sum("notes").alias("selected_notes"),
        F.count_if(F.col("selected") == 0).alias("empty_digests"), F.count_if(F.col("over_cap") > 0).alias("cap_limited_digests"),
        F.avg(F.when((F.col("selected") >= 2) & (F.col("n_graded") >= 1), F.col("ndcg"))).alias("ndcg"),
    )
    once = d.filter(picked & F.col("grade").isNotNull()).select("story_id", "grade").distinct()
    votes = once.agg(F.count_if(F.col("grade") == "up").alias("care_more"), F.count_if(F.col("grade") == "down").alias("care_less"))
    one = total.withColumns({c: votes.select(c).scalar() for c in votes.columns})
    graded = F.col("care_more") + F.col("care_less")
    return one.select(
        "*", graded.alias("graded"), (F.col("selected") / F.greatest("digests", F.lit(1))).alias("mean_items"),
        F.when(F.col("selected") > 0, F.col("selected_stories") / F.col("selected")).otherwise(0.0).alias("story_share"), F.when(graded > 0, F.col("care_more") / graded).alias("precision"),
    )


def replay(candidates: DataFrame, cfg: Scoring, now, by: tuple[str, ...] = ("digest_id",)) -> DataFrame:
    """The decisions that another configuration would have made of frozen candidates; nothing is too old."""
    return select_full(score(candidates, cfg, now, F.lit("1970-01-01").cast("timestamp_ntz")), cfg, by)


def sweep(candidates: DataFrame, configs: dict[str, Scoring], grades: DataFrame, now, by: tuple[str, ...] = ("digest_id",)) -> DataFrame:
    """evaluate() of what each configuration would have made of the same frozen candidates: a row for each, with
    its name as config, all in one job."""
    rows = [evaluate(replay(candidates, cfg, now, by).withColumn("cause", F.col("drop_cause")), grades).withColumn("config", F.lit(name)) for name, cfg in configs.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """Counts of summaries by verdict (passed, or why not; null: not made), and the share of those made that
    passed."""
    made = F.col("verdict").isNotNull()
    out = verdicts.agg(F.count_if(F.col("verdict") == "passed").alias("passed"), F.count_if(made & (F.col("verdict") != "passed")).alias("rejected"), F.count_if(~made).alias("unavailable"))
    return out.withColumn("rate", F.when(F.col("passed") + F.col("rejected") > 0, F.col("passed") / (F.col("passed") + F.col("rejected"))))
