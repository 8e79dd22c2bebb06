"""Upserts and deletions as new snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new rows in place of those that have their key; a null in a key equals itself."""
    k = new.select(*[F.col(c).alias(f"_{c}") for c in key])
    return old.join(k, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti").unionByName(new)


def upsert_changed(old: DataFrame, new: DataFrame, key: str, at: Column, stamp: str = "updated_at") -> DataFrame:
    """As upsert(), but a row that says what it said before keeps its stamp."""
    said = [c for c in new.columns if c not in (key, stamp)]
    was = old.select(F.col(key).alias("_k"), F.struct(*said).alias("_said"), F.col(stamp).alias("_stamp"))
    j = new.join(was, F.col(key) == F.col("_k"), "left")
    kept = F.when(F.struct(*said).eqNullSafe(F.col("_said")), F.col("_stamp")).otherwise(at)
    fresh = j.select(key, *said, kept.alias(stamp))
    return old.join(new.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def edges_of_feedback(feedback: DataFrame) -> DataFrame:
    """Identity edges and vetoes from must-link and cannot-link feedback (a, b, signal, created_at), pairs in
    order, the last word on a pair counting."""
    f = feedback.filter(F.col("signal").isin("must_link", "cannot_link")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "signal", "created_at")
    last = f.groupBy("a", "b").agg(F.max_by("signal", "created_at").alias("signal"))
    return last.select("a", "b", F.when(F.col("signal") == "must_link", 1.0).otherwise(-1.0).alias("confidence"), F.lit("feedback").alias("source"))


def subscribe(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    return subscriptions.unionByName(wanted.dropDuplicates(["subscriber", "connection_id"]).join(subscriptions.select("subscriber", "connection_id"), ["subscriber", "connection_id"], "left_anti"))


def delete_with(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of what is gone."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in children.items()}
