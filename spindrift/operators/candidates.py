"""The clusters that a subscriber's digest may draw on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subscribed(clusters: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, cluster) rows of public clusters from a subscriber's connections."""
    public = clusters.filter("scope_kind = 'public'")
    return public.join(subscriptions.select("subscriber", F.col("connection_id").alias("_c")), F.col("connection_id") == F.col("_c")).drop("_c")


def candidate_clusters(clusters: DataFrame, subscriptions: DataFrame, subscriber: int, floor: Column) -> DataFrame:
    """For one subscriber: public clusters of the connections subscribed to, or of none; own private ones;
    both updated since the floor; and public ones of any age that share a strong key with those."""
    mine = subscriptions.filter(F.col("subscriber") == subscriber).select(F.col("connection_id").alias("_c"))
    recent = clusters.filter(F.col("updated_at") >= floor)
    public = recent.filter("scope_kind = 'public'")
    own = recent.filter((F.col("scope_kind") == "private") & (F.col("owner") == subscriber))
    chosen = public.join(mine, F.col("connection_id") == F.col("_c"), "left_semi").unionByName(public.filter("connection_id is null"))
    seeded = cross_boundary(clusters, own)
    return chosen.unionByName(own).unionByName(seeded).dropDuplicates(["cluster_id"])


def strong_keys(clusters: DataFrame) -> DataFrame:
    """Distinct cve: and url: tokens."""
    return clusters.select(F.explode("entities").alias("key")).filter(F.col("key").rlike("^(cve|url):")).distinct()


def strong_keys_of(clusters: DataFrame, owner: str) -> DataFrame:
    """Distinct (owner, key) rows of the clusters' cve: and url: tokens."""
    return clusters.select(owner, F.explode("entities").alias("key")).filter(F.col("key").rlike("^(cve|url):")).distinct()


def cross_boundary(clusters: DataFrame, own: DataFrame) -> DataFrame:
    """Public clusters that share a strong key with own private ones: an equi-join of exploded keys, as an
    overlap of arrays would be a nested loop."""
    keys = clusters.filter("scope_kind = 'public'").select("cluster_id", F.explode("entities").alias("key")).filter(F.col("key").rlike("^(cve|url):"))
    hit = keys.join(strong_keys(own), "key", "left_semi").select("cluster_id").distinct()
    return clusters.join(hit, "cluster_id", "left_semi")
