"""Linking clusters into stories: scored edges, guarded components, stable ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import idf, link_strength, namespace_prior, temporal_closeness
from ..schema import SATURATED, SATURATED_MIN_WEIGHT, W_JACCARD, W_TEMPORAL, WEAK_MIN_JACCARD, WEAK_THRESHOLD
from ..session import ship
from ..storage import kept, shared_folder
from . import blocks
from .graph import min_label_components
from .rollup import distinct_tokens

#: Edges of a component that one task walks in order; larger components are merged in rounds.
WALK = 1 << 17


def entity_weights(clusters: DataFrame, overrides: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_id, entity, strong, weight): how much sharing an entity is worth, by its kind and by how rare
    it is among the clusters (of each group of `by`), times an override (entity, factor)."""
    tokens = clusters.select(*by, "cluster_id", F.explode(F.array_distinct("entities")).alias("entity")).withColumn("strength", link_strength(F.col("entity"))).filter("strength is not null")
    df = tokens.groupBy(*by, "entity").agg(F.count(F.lit(1)).alias("df"))
    if by:
        df = df.join(clusters.groupBy(*by).agg(F.count_distinct("cluster_id").alias("n")), list(by))
    else:
        df = df.withColumn("n", clusters.agg(F.count_distinct("cluster_id")).scalar())
    weight = namespace_prior(F.col("entity")) * idf(F.col("df"), F.col("n"))
    df = df.withColumn("weight", weight)
    if overrides is not None:
        df = df.join(overrides, "entity", "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0)))
    return tokens.join(df.select(*by, "entity", "df", "weight"), [*by, "entity"]).select(*by, "cluster_id", "entity", (F.col("strength") == "strong").alias("strong"), "df", "weight")


def _numbered(clusters: DataFrame, overrides: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Clusters that have linkable tokens, numbered in the order of their ids (n, cluster_id, last_event_time,
    total), and their tokens (n, entity, strong, weight); both kept, as they are read several times."""
    w = entity_weights(clusters, overrides)
    total = w.groupBy("cluster_id").agg(F.sum("weight").alias("total"))
    placed = clusters.select("cluster_id", "last_event_time").join(total, "cluster_id").orderBy("cluster_id")
    nodes = kept(placed.withColumn("n", F.monotonically_increasing_id()))
    return nodes, kept(w.join(nodes.select("cluster_id", "n"), "cluster_id").select("n", "entity", "strong", "weight"))


def _rare_edges(nodes: DataFrame, posts: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (i, j) of nodes that share an entity which isn't among the words, and the edges (i, j, strong, score,
    reason) among them."""
    rare = posts.join(F.broadcast(words.select("entity")), "entity", "left_anti").select("n", "entity")
    of = lambda c: rare.select(F.col("n").alias(c), "entity")
    pairs = kept(of("i").join(of("j"), "entity").filter("i < j").select("i", "j").distinct())
    left = posts.select(F.col("n").alias("i"), "entity", "strong", "weight")
    acc = pairs.join(left, "i").join(posts.select(F.col("n").alias("j"), "entity"), ["j", "entity"]).groupBy("i", "j").agg(
        F.sum("weight").alias("shared"),
        F.min(F.when(F.col("strong"), F.col("entity"))).alias("strong_key"),
        F.min(F.when(~F.col("strong"), F.struct((-F.col("weight")).alias("w"), F.col("entity").alias("e")))).alias("weak"),
    )
    side = lambda n: nodes.select(F.col("n").alias(n), F.col("last_event_time").alias(f"t_{n}"), F.col("total").alias(f"w_{n}"))
    both = acc.join(side("i"), "i").join(side("j"), "j")
    union = F.col("w_i") + F.col("w_j") - F.col("shared")
    wj = F.when(union > 0, F.col("shared") / union).otherwise(0.0)
    both = both.withColumn("wj", wj).filter(F.col("strong_key").isNotNull() | (F.col("wj") >= WEAK_MIN_JACCARD))
    both = both.withColumn("weak_score", W_JACCARD * F.col("wj") + W_TEMPORAL * temporal_closeness(F.col("t_i"), F.col("t_j")))
    strong = F.col("strong_key").isNotNull()
    holds = (F.col("weak_score") >= WEAK_THRESHOLD) & (F.col("wj") >= WEAK_MIN_JACCARD) & ~((F.col("wj") >= SATURATED) & (F.col("shared") < SATURATED_MIN_WEIGHT)) & F.col("weak").isNotNull()
    reason = F.concat(F.lit("shared "), F.when(strong, F.col("strong_key")).otherwise(F.col("weak.e")))
    return pairs, both.filter(strong | holds).select("i", "j", strong.alias("strong"), F.when(strong, 1.0).otherwise(F.col("weak_score")).alias("score"), reason.alias("reason"))


def _reasons(edges: DataFrame, words: list) -> DataFrame:
    """edges whose reason is the number of a word, with the reason itself."""
    named = edges.sparkSession.createDataFrame([(k, f"shared {w['entity']}") for k, w in enumerate(words)], "word int, reason string")
    return edges.join(F.broadcast(named), "word").drop("word")


def score_edges(clusters: DataFrame, overrides: DataFrame | None = None, rare: int = blocks.RARE) -> DataFrame:
    """Edges (a, b, strong, score, reason), a < b: clusters that share a strong key, or enough of their
    distinctive entities at about the same time.

    Pairs that share a rare entity come from an inverted index, an equi-join on it; all others from blocks of
    clusters, each multiplied by each. An entity of fewer than `rare` clusters is always rare.
    """
    nodes, posts = _numbered(clusters, overrides)
    words = kept(blocks.frequent(posts, rare))
    pairs, edges = _rare_edges(nodes, posts, words)
    order = blocks.words_in_order(words)
    if order:
        found = blocks.judged(nodes, posts, order).join(pairs, ["i", "j"], "left_anti")
        edges = edges.unionByName(_reasons(found, order))
    side = lambda n, c: nodes.select(F.col("n").alias(n), F.col("cluster_id").alias(c))
    return edges.join(side("i", "a"), "i").join(side("j", "b"), "j").select("a", "b", "strong", "score", "reason")


def best_edges(clusters: DataFrame, overrides: DataFrame | None = None, rare: int = blocks.RARE) -> DataFrame:
    """Those of score_edges() among which each cluster has its best, strong ones first, then by score, a and b; of each
    two blocks only some for each cluster are told, so that they don't grow with the pairs."""
    nodes, posts = _numbered(clusters, overrides)
    words = kept(blocks.frequent(posts, rare))
    pairs, edges = _rare_edges(nodes, posts, words)
    order = blocks.words_in_order(words)
    if order:
        # a pair that shares a rare entity too is better than it was judged, so what it went before is no better either
        found = blocks.judged(nodes, posts, order, best=True).drop("sure").join(pairs, ["i", "j"], "left_anti").distinct()
        edges = edges.unionByName(_reasons(found, order))
    side = lambda n, c: nodes.select(F.col("n").alias(n), F.col("cluster_id").alias(c))
    return edges.join(side("i", "a"), "i").join(side("j", "b"), "j").select("a", "b", "strong", "score", "reason")


def linked_components(clusters: DataFrame, overrides: DataFrame | None = None, rare: int = blocks.RARE) -> DataFrame:
    """(cluster_id, component): the components of score_edges(), which are never made one by one: of each two
    blocks only spanning forests are told."""
    nodes, posts = _numbered(clusters, overrides)
    words = kept(blocks.frequent(posts, rare))
    pairs, edges = _rare_edges(nodes, posts, words)
    ties = edges.select("i", "j")
    order = blocks.words_in_order(words)
    if order:
        found = kept(blocks.judged(nodes, posts, order, trees=True))
        ties = ties.unionByName(found.filter("sure").select("i", "j")).unionByName(found.filter("not sure").select("i", "j").join(pairs, ["i", "j"], "left_anti"))
    comp = min_label_components(nodes.select(F.col("n").alias("id")), kept(ties.select(F.col("i").alias("a"), F.col("j").alias("b"))))
    named = comp.join(nodes.select(F.col("n").alias("id"), "cluster_id"), "id").join(nodes.select(F.col("n").alias("component"), F.col("cluster_id").alias("_component")), "component")
    return clusters.select("cluster_id").join(named.select("cluster_id", "_component"), "cluster_id", "left").select("cluster_id", F.coalesce("_component", "cluster_id").alias("component"))


def apply_constraints(edges: DataFrame, must: DataFrame | None = None, cannot: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Edges without those that feedback forbids, and with those that it asks for, as strong ones. Pairs
    (a, b) come in either order; those outside the clusters do nothing."""
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    if cannot is not None:
        edges = edges.join(ordered(cannot), ["a", "b"], "left_anti")
    if must is not None:
        asked = ordered(must)
        if clusters is not None:
            for side in "ab":
                asked = asked.join(clusters.select(F.col("cluster_id").alias(side)), side, "left_semi")
        edges = edges.join(asked, ["a", "b"], "left_anti").unionByName(
            asked.select("a", "b", F.lit(True).alias("strong"), F.lit(1.0).alias("score"), F.lit("must-link (feedback)").alias("reason"))
        )
    return edges


def checkpointed(spark) -> None:
    """Make sure there is a folder for what is kept between steps."""
    shared_folder(spark)


def _root(up: dict, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def guarded_components(clusters: DataFrame, edges: DataFrame, prior: DataFrame, walk: int = WALK) -> DataFrame:
    """(cluster_id, component): strong edges join anything; then weak ones, best first, unless they would
    join two different delivered stories (prior: cluster_id, story_id, delivered). Edges go by score, then by
    their ends.

    Strong edges don't depend on their order, so their components come first and are what weak edges tie. The
    order only matters within the plain components that hold two delivered stories or more: those of at most
    `walk` edges are walked, each by a task, and larger ones are merged in rounds.
    """
    ship(clusters.sparkSession)
    kind = clusters.schema["cluster_id"].dataType.simpleString()
    plain = min_label_components(clusters.select(F.col("cluster_id").alias("id")), edges)
    told = prior.filter("delivered").select(F.col("cluster_id").alias("id"), F.col("story_id").alias("delivered_story"))
    several = kept(plain.join(told, "id").groupBy("component").agg(F.count_distinct("delivered_story").alias("n")).filter("n > 1").select("component"))
    if several.isEmpty():
        return plain.select(F.col("id").alias("cluster_id"), "component")
    nodes = kept(plain.join(told, "id", "left"))
    ends = edges.join(nodes.select(F.col("id").alias("a"), F.col("component").alias("part")).distinct(), "a")
    sizes = ends.groupBy("part").agg(F.count(F.lit(1)).alias("size")).join(several.withColumnRenamed("component", "part"), "part")
    held = kept(sizes)
    simple = nodes.join(held, F.col("component") == F.col("part"), "left_anti").select(F.col("id").alias("cluster_id"), "component").distinct()

    def walked(key: tuple, members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        up = {x: x for x in members["id"]}
        stories: dict = {x: set() for x in up}
        for i, s in zip(members["id"], members["delivered_story"], strict=True):
            stories[i] |= {s} if isinstance(s, str) else set()
        links = links.sort_values(["strong", "score", "a", "b"], ascending=[False, False, True, True])
        for a, b, strong in zip(links["a"], links["b"], links["strong"], strict=True):
            ra, rb = _root(up, a), _root(up, b)
            if ra == rb or (not strong and stories[ra] and stories[rb] and not stories[ra] & stories[rb]):
                continue
            low, high = min(ra, rb), max(ra, rb)
            up[high] = low
            stories[low] |= stories[high]
        return pd.DataFrame({"cluster_id": list(up), "component": [_root(up, x) for x in up]})

    some = held.filter(F.col("size") <= walk).select("part")
    members = nodes.withColumnRenamed("component", "part").join(some, "part")
    inside = ends.join(some, "part").select("part", "a", "b", "strong", "score")
    small = members.groupBy("part").cogroup(inside.groupBy("part")).applyInPandas(walked, f"cluster_id {kind}, component {kind}")
    many = held.filter(F.col("size") > walk).select("part")
    if many.isEmpty():
        return simple.unionByName(small)
    large = _merged(nodes.withColumnRenamed("component", "part").join(many, "part"), ends.join(many, "part"))
    return simple.unionByName(small).unionByName(large)


def _merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """guarded_components of nodes (id, delivered_story) by edges, in rounds.

    An edge that comes first among those left of both groups that it ties can be decided at once: no edge
    that goes before it can change either group. All such edges of a round are decided together, as no group
    has two. The first edge of all left is always one, so each round ends some.
    """
    strong = min_label_components(nodes.select("id"), edges.filter("strong"))
    label = kept(strong.withColumnRenamed("component", "g"))
    stories = kept(nodes.filter("delivered_story is not null").select("id", F.col("delivered_story").alias("s")).distinct())
    left = kept(edges.filter("not strong").select("a", "b", "score"))
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    while True:
        of = lambda side: label.select(F.col("id").alias(side), F.col("g").alias(f"g{side}"))
        tied = left.join(of("a"), "a").join(of("b"), "b").filter("ga <> gb").withColumn("o", order)
        # of the edges between the same two groups only the first can be next
        tied = kept(tied.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.min("o").alias("o")))
        if tied.isEmpty():
            return label.select(F.col("id").alias("cluster_id"), F.col("g").alias("component"))
        either = tied.select(F.col("x").alias("g"), "o").unionByName(tied.select(F.col("y").alias("g"), "o"))
        first = either.groupBy("g").agg(F.min("o").alias("first"))
        side = lambda c: first.select(F.col("g").alias(c), F.col("first").alias(f"f{c}"))
        due = kept(tied.join(side("x"), "x").join(side("y"), "y").filter("o = fx and o = fy").select("x", "y", "o"))
        held = stories.join(label, "id").select("g", "s").distinct()
        sets = held.groupBy("g").agg(F.collect_set("s").alias("set"))
        both = due.join(sets.withColumnsRenamed({"g": "x", "set": "sx"}), "x", "left").join(sets.withColumnsRenamed({"g": "y", "set": "sy"}), "y", "left")
        fine = F.col("sx").isNull() | F.col("sy").isNull() | F.arrays_overlap("sx", "sy")
        judged = kept(both.select("x", "y", "o", F.coalesce(fine, F.lit(True)).alias("fine")))
        joined = judged.filter("fine").select(F.col("y").alias("g"), F.col("x").alias("into"))
        label = kept(label.join(joined, "g", "left").select("id", F.coalesce("into", "g").alias("g")))
        refused = judged.filter("not fine").select("o.a", "o.b")
        left = kept(left.join(refused, ["a", "b"], "left_anti"))


def in_order(stories: DataFrame, merges: DataFrame, by: tuple[str, ...] = ("subscriber",)) -> tuple[DataFrame, DataFrame]:
    """stories with their place (from 0) in a subscriber's list, newest first and then by id, and merges once each
    in order. Places are given within a subscriber; nothing is sorted as a whole."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("last_event_time"), "story_id")) - 1
    return stories.withColumn("place", place), merges.select("loser", "survivor").distinct().sortWithinPartitions("loser", "survivor")


def member_reasons(components: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
    """(cluster_id, link_reason): the best edge to another member of its story, strong ones first. whole: no edge
    was refused, so every edge is within a story."""
    c = components
    ends = edges.select(F.col("a").alias("cluster_id"), F.col("b").alias("other"), "a", "b", "strong", "score", "reason").unionByName(
        edges.select(F.col("b").alias("cluster_id"), F.col("a").alias("other"), "a", "b", "strong", "score", "reason")
    )
    inside = ends if whole else ends.join(c, "cluster_id").join(c.select(F.col("cluster_id").alias("other"), F.col("component").alias("theirs")), "other").filter("component = theirs")
    best = inside.groupBy("cluster_id").agg(F.min(F.struct((~F.col("strong")).alias("weak"), (-F.col("score")).alias("s"), "a", "b", "reason")).alias("x"))
    return c.join(best, "cluster_id", "left").select("cluster_id", "component", F.col("x.reason").alias("link_reason"))


def forward_ids(components: DataFrame, prior: DataFrame, subscriber: str = "") -> tuple[DataFrame, DataFrame]:
    """Story ids of components, and merges (loser, survivor). A component keeps the oldest prior id (by
    minted_at if prior has it, then the smallest) that no earlier component (by smallest cluster) has taken;
    else it gets an id made of its smallest cluster.

    Claims only compete where components share a prior id. Only those are settled within groups of components
    that do, each walked in order by one task; the others keep the first of their ids.
    """
    ship(components.sparkSession)
    kind = components.schema["component"].dataType.simpleString()
    firsts = components.groupBy("component").agg(F.min("cluster_id").alias("first"))
    age = F.col("minted_at") if "minted_at" in prior.columns else F.lit(None).cast("timestamp_ntz")
    known = prior.select("cluster_id", "story_id", age.cast("timestamp_ntz").alias("minted_at"))
    has = kept(components.join(known, "cluster_id").groupBy("component", "story_id").agg(F.unix_micros(F.min("minted_at").cast("timestamp")).alias("age")))
    minted = F.concat(F.lit("story-"), F.sha2(F.concat(F.lit(subscriber), F.lit("|"), F.col("first")), 256).substr(1, 32))
    if has.isEmpty():
        return firsts.select("component", minted.alias("story_id")), has.select(F.col("story_id").alias("loser"), F.col("story_id").alias("survivor"))
    ties = kept(_ties(has))
    rivals = ties.select(F.col("a").alias("id")).unionByName(ties.select(F.col("b").alias("id"))).distinct()
    alone = has.join(rivals, F.col("component") == F.col("id"), "left_anti")
    best = alone.groupBy("component").agg(F.min(F.struct("age", "story_id"))["story_id"].alias("kept"))
    settled = best.select("component", "kept", F.lit(None).cast("string").alias("loser"))
    settled = settled.unionByName(alone.join(best, "component").filter("story_id <> kept").select("component", "kept", F.col("story_id").alias("loser")))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        own: dict = {}
        rows = rows.sort_values(["first", "component", "age", "story_id"], na_position="first")
        for comp, story in zip(rows["component"], rows["story_id"], strict=True):
            own.setdefault(comp, []).append(story)
        taken: set[str] = set()
        got = {}
        for comp, ids in own.items():
            got[comp] = next((i for i in ids if i not in taken), None)
            taken.add(got[comp])
        out = [(comp, first, None) for comp, first in got.items()]
        out += [(comp, got[comp], i) for comp, ids in own.items() for i in ids if i != got[comp] and i not in taken]
        return pd.DataFrame(out, columns=["component", "kept", "loser"])

    if not ties.isEmpty():
        tied = min_label_components(rivals, ties)
        claims = has.join(firsts, "component").join(tied.select(F.col("id").alias("component"), F.col("component").alias("tie")), "component")
        settled = settled.unionByName(claims.groupBy("tie").applyInPandas(settle, f"component {kind}, kept string, loser string"))
    settled = kept(settled)
    ids = firsts.join(settled.filter("loser is null").select("component", "kept"), "component", "left").select("component", F.coalesce("kept", minted).alias("story_id"))
    merges = settled.filter("loser is not null").join(ids, "component").select("loser", F.col("story_id").alias("survivor"))
    return ids, merges


def _ties(has: DataFrame) -> DataFrame:
    """Edges between components that share a prior id: each with the first that has it."""
    first = has.groupBy("story_id").agg(F.min("component").alias("b"))
    return has.join(first, "story_id").filter("component <> b").select(F.col("component").alias("a"), "b").distinct()


def story_rollup(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Stories from (cluster_id, story_id): counts, sources, depth, severity, span, entities, own-private."""
    return rollup_stories(clusters.join(members, "cluster_id"))


def rollup_stories(mine: DataFrame) -> DataFrame:
    """Stories of clusters that have a story_id; with a subscriber, which a story has one of, that too."""
    who = [F.first("subscriber").alias("subscriber")] if "subscriber" in mine.columns else []
    facts = mine.groupBy("story_id").agg(
        *who,
        F.count(F.lit(1)).alias("clusters"),
        F.sum("event_count").alias("event_count"),
        F.count_distinct("source").alias("source_diversity"),
        F.max("depth_rank").alias("depth_rank"),
        F.max("max_severity").alias("max_severity"),
        F.bool_or(F.col("scope_kind") == "private").alias("has_private"),
        F.min("first_event_time").alias("first_event_time"),
        F.max("last_event_time").alias("last_event_time"),
    )
    tokens = distinct_tokens(mine, ["story_id"])
    return facts.join(tokens, "story_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
