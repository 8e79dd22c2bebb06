"""Threads and identity: co-occurrence, communities, matching, weights, resolution of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import decay_affinity, seconds_between, thread_state
from ..functions.text import auto_label, split_namespace
from ..schema import AFFINITY_HALF_LIFE_DAYS, AFFINITY_MAX, ARCHIVE_DAYS, CONFIRMED, DORMANT_DAYS, LEXICAL_MOST, LEXICAL_THRESHOLD, MATCH_THRESHOLD, PROBABLE, THETA
from ..session import ship
from ..storage import kept
from .graph import min_label_components


def spine(entities: Column) -> Column:
    """Entities that threads are made of: neither addresses nor domains."""
    return F.filter(entities, lambda e: ~e.rlike("^(domain|url):"))


def co_occurrence(items: DataFrame, now: Column, half_life_days: float = AFFINITY_HALF_LIFE_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b, weight), a < b, of entities that items (entities, at) have in common, each item adding
    its recency. Pairs are formed within an item, whose entities are few."""
    w = F.pow(F.lit(0.5), F.greatest(seconds_between(now, F.col("at")), F.lit(0.0)) / (86_400.0 * half_life_days))
    sets = items.select(*by, F.array_sort(F.array_distinct("entities")).alias("e"), w.alias("w"))
    firsts = sets.select(*by, "w", "e", F.posexplode("e").alias("i", "a"))
    pairs = firsts.select(*by, "w", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return pairs.groupBy(*by, "a", "b").agg(F.sum("w").alias("weight"))


#: Weights of label propagation are whole multiples of this, so that sums don't depend on their order.
GRAIN = 1e-9
#: What a node's own label weighs, in grains.
OWN = 1_000_000
#: Edges of a component that one task walks in order; larger components are gone through in rounds.
WALK = 1 << 17


def label_propagation(edges: DataFrame, rounds: int = 30, walk: int = WALK) -> DataFrame:
    """(node, label): communities by label propagation in ascending order of nodes, in place; of equal
    weights the smallest label. Weights count to nine decimals.

    Order matters within a component and not across. Components of at most `walk` edges are walked, each by a
    task. In larger ones a node's turn comes when all smaller neighbours have had theirs, so nodes are dealt
    to steps, and those of a step have their turns at once.
    """
    ship(edges.sparkSession)
    edges = kept(edges.select("a", "b", F.round(F.col("weight") / GRAIN).cast("long").alias("weight")))
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    parted = kept(edges.join(min_label_components(nodes, edges).withColumnRenamed("id", "a"), "a"))
    sizes = kept(parted.groupBy("component").agg(F.count(F.lit(1)).alias("size")))

    def walked(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[tuple[str, int]]] = {}
        for a, b, w in zip(g["a"], g["b"], g["weight"].tolist(), strict=True):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        label = {n: n for n in near}
        for _ in range(rounds):
            changed = False
            for n in sorted(near):
                pull = {label[n]: OWN}
                for other, w in near[n]:
                    pull[label[other]] = pull.get(label[other], 0) + w
                best = min(pull, key=lambda x: (-pull[x], x))
                changed |= best != label[n]
                label[n] = best
            if not changed:
                break
        return pd.DataFrame({"node": list(label), "label": list(label.values())})

    small = parted.join(sizes.filter(F.col("size") <= walk).select("component"), "component").groupBy("component").applyInPandas(walked, "node string, label string")
    many = sizes.filter(F.col("size") > walk).select("component")
    if many.isEmpty():
        return small
    return small.unionByName(_stepwise(parted.join(many, "component").select("a", "b", "weight"), rounds))


def _stepwise(edges: DataFrame, rounds: int) -> DataFrame:
    """label_propagation() of whole components, by steps: a node's step is one after the last of its smaller
    neighbours'."""
    arcs = edges.select(F.col("a").alias("n"), F.col("b").alias("m"), "weight").unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m"), "weight"))
    step = kept(arcs.select("n").distinct().withColumn("step", F.lit(0)))
    while True:
        before = arcs.filter("m < n").join(step.select(F.col("n").alias("m"), "step"), "m").groupBy("n").agg((F.max("step") + 1).alias("later"))
        moved = kept(step.join(before, "n", "left").select("n", F.coalesce("later", F.lit(0)).alias("step"), F.col("step").alias("was")))
        step = moved.select("n", "step")
        if moved.filter("step <> was").isEmpty():
            break
    arcs = kept(arcs.join(step, "n"))
    last = arcs.agg(F.max("step")).first()[0]
    labels = kept(step.select("n", F.col("n").alias("label")))
    for _ in range(rounds):
        start = labels
        for k in range(last + 1):
            pulls = arcs.filter(F.col("step") == k).join(labels.select(F.col("n").alias("m"), "label"), "m").select("n", "label", "weight")
            own = labels.join(step.filter(F.col("step") == k).select("n"), "n").select("n", "label", F.lit(OWN).cast("long").alias("weight"))
            each = pulls.unionByName(own).groupBy("n", "label").agg(F.sum("weight").alias("pull"))
            best = each.groupBy("n").agg(F.min(F.struct((-F.col("pull")).alias("p"), "label"))["label"].alias("best"))
            labels = kept(labels.join(best, "n", "left").select("n", F.coalesce("best", "label").alias("label")))
        if labels.join(start.withColumnRenamed("label", "was"), "n").filter("label <> was").isEmpty():
            break
    return labels.select(F.col("n").alias("node"), "label")


def communities(labels: DataFrame, least: int = 2) -> DataFrame:
    """(label, entities) of labels that at least so many nodes have."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_set("node")).alias("entities")).filter(F.size("entities") >= least)


def match_threads(candidates: DataFrame, existing: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Per community (label, entities): action (new, keep, merge), thread_id and merged ids. Threads
    (thread_id, entities, pinned) match by Jaccard similarity and are claimed once, in order of label; the
    smallest id wins; a pinned thread is never absorbed.

    Similarities come from an equi-join on entities. A community's turn comes when it is the first of all that
    still match any of its threads; those whose turn it is choose together, as they share none.
    """
    c = candidates.select("label", F.size("entities").alias("nc"), F.explode("entities").alias("e"))
    t = existing.select("thread_id", "pinned", F.size("entities").alias("nt"), F.explode("entities").alias("e"))
    shared = c.join(t, "e").groupBy("label", "thread_id", "pinned", "nc", "nt").agg(F.count(F.lit(1)).alias("o"))
    left = kept(shared.filter(F.col("o") / (F.col("nc") + F.col("nt") - F.col("o")) >= threshold).select("label", "thread_id", "pinned"))
    found = None
    while not left.isEmpty():
        first = left.groupBy("thread_id").agg(F.min("label").alias("first"))
        due = left.join(first, "thread_id").groupBy("label").agg(
            F.bool_and(F.col("first") == F.col("label")).alias("due"), F.array_sort(F.collect_list(F.struct("thread_id", "pinned"))).alias("ids")
        )
        others = F.filter(F.slice("ids", 2, F.size("ids")), lambda x: ~x["pinned"])
        made = kept(due.filter("due").select("label", F.when(F.size("ids") == 1, "keep").otherwise("merge").alias("action"), F.col("ids")[0]["thread_id"].alias("thread_id"), F.transform(others, lambda x: x["thread_id"]).alias("merged")))
        found = made if found is None else found.unionByName(made)
        taken = made.select("thread_id").unionByName(made.select(F.explode("merged").alias("thread_id")))
        left = kept(left.join(made.select("label"), "label", "left_anti").join(taken, "thread_id", "left_anti"))
    if found is None:
        return candidates.select("*", F.lit("new").alias("action"), F.lit(None).cast("string").alias("thread_id"), F.array().cast("array<string>").alias("merged"))
    return candidates.join(found, "label", "left").withColumn("action", F.coalesce("action", F.lit("new")))


def project_weights(threads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(entity, weight): what entities of threads (state, affinity, entities) are worth; a dormant thread
    counts a quarter, an archived one nothing."""
    factor = F.when(F.col("state") == "active", 1.0).when(F.col("state") == "dormant", 0.25)
    live = threads.filter(factor.isNotNull() & (F.size("entities") > 0))
    each = live.select(*by, F.explode("entities").alias("entity"), (F.col("affinity") * factor / F.size("entities")).alias("w"))
    return each.groupBy(*by, "entity").agg(F.sum("w").alias("weight"))


def thread_terms(stories: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """stories (story_id, entities) with thread_term, the sum of their entities' weights."""
    each = stories.select(*by, "story_id", F.explode("entities").alias("entity")).join(weights, [*by, "entity"])
    return stories.join(each.groupBy(*by, "story_id").agg(F.sum("weight").alias("thread_term")), [*by, "story_id"], "left")


def assign_threads(stories: DataFrame, threads: DataFrame, min_overlap: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(story_id, thread_id, overlap): each story's best thread by shared entities times affinity, then by
    affinity, then the smallest id."""
    s = stories.select(*by, "story_id", F.explode("entities").alias("e"))
    t = threads.select(*by, "thread_id", "affinity", F.explode("entities").alias("e"))
    hits = s.join(t, [*by, "e"]).groupBy(*by, "story_id", "thread_id", "affinity").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= min_overlap)
    best = W.partitionBy(*by, "story_id").orderBy(F.desc(F.col("overlap") * F.col("affinity")), F.desc("affinity"), "thread_id")
    return hits.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(*by, "story_id", "thread_id", "overlap")


def thread_metrics(threads: DataFrame, stories: DataFrame, since: Column, now: Column, care: DataFrame | None = None, engagement: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Threads (thread_id, entities, affinity, pinned, first_seen, last_story_time) measured against stories
    (story_id, entities, sources, last_event_time): counts, sources, state, affinity, label."""
    key = [*by, "thread_id"]
    t = threads.select(*key, F.explode("entities").alias("e"))
    s = stories.select(*by, "story_id", "last_event_time", F.explode("entities").alias("e"))
    hit = kept(t.join(s, [*by, "e"]).select(*key, "story_id", "last_event_time").distinct())
    m = hit.groupBy(*key).agg(F.count(F.lit(1)).alias("story_count"), F.count_if(F.col("last_event_time") > since).alias("new_stories"), F.min("last_event_time").alias("lo"), F.max("last_event_time").alias("hi"))
    seen = hit.join(stories.select(*by, "story_id", F.explode("sources").alias("source")), [*by, "story_id"]).groupBy(*key).agg(F.count_distinct("source").alias("source_diversity"))
    out = threads.join(m, key, "left").join(seen, key, "left")
    if care is not None:
        out = out.join(care, key, "left")
    delta = (F.coalesce("care", F.lit(0.0)) if care is not None else F.lit(0.0)) + engagement * F.coalesce("new_stories", F.lit(0))
    last = F.greatest("last_story_time", "hi")
    return out.select(
        *key, F.coalesce("story_count", F.lit(0)).alias("story_count"), F.coalesce("new_stories", F.lit(0)).alias("new_stories"),
        F.coalesce("source_diversity", F.lit(0)).alias("source_diversity"), F.least("first_seen", "lo").alias("first_seen"), last.alias("last_story_time"),
        thread_state(last, now, F.col("pinned"), DORMANT_DAYS, ARCHIVE_DAYS).alias("state"),
        decay_affinity(F.col("affinity"), seconds_between(now, since), AFFINITY_HALF_LIFE_DAYS, delta, AFFINITY_MAX).alias("affinity"), auto_label(F.col("entities")).alias("label"),
    )


#: Tokens of names whose pairs are found by two of them, and of names all of whose sets of words are told.
SHORT, TOLD = 16, 8
#: Names of a key are dealt to so many tasks.
SPREAD = 8
#: What rounding may do to a bound.
SLACK = 1e-9


def _tokens(nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, kind, letters, tokens, n, least): what names (id) are compared by, rarest first: their words, and of those of
    one word at most their letter pairs too, numbered where they repeat. least: the Jaccard similarity of tokens
    that amounts to the threshold."""
    kind, value = split_namespace(F.col("id"))
    n = nodes.select("id", kind.alias("kind"), value.alias("value")).filter("kind is not null").distinct()
    words = F.array_distinct(F.filter(F.split("value", "[ /_-]"), lambda w: w != ""))
    several = F.size(words) > 1
    pairs = F.when(several | (F.length("value") < 2), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2))))
    numbered = F.transform("_pairs", lambda x, i: F.concat(x, F.size(F.filter(F.slice("_pairs", 1, i), lambda y: y == x)).cast("string")))
    each = n.select("id", "kind", words.alias("_words"), pairs.alias("_pairs")).select("id", "kind", F.explode(F.array(F.struct(F.lit(False).alias("letters"), F.col("_words").alias("t")), F.struct(F.lit(True).alias("letters"), numbered.alias("t")))).alias("x"))
    one = each.select("id", "kind", "x.letters", F.explode("x.t").alias("t"))
    df = one.groupBy("kind", "letters", "t").agg(F.count(F.lit(1)).alias("df"))
    ranked = one.join(df, ["kind", "letters", "t"]).groupBy("id", "kind", "letters").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("x"))
    # Dice similarity 2s / (n + m) is at least t where Jaccard similarity is at least t / (2 - t)
    return ranked.select("id", "kind", "letters", F.transform("x", lambda x: x["t"]).alias("tokens"), F.size("x").alias("n"), F.when(F.col("letters"), threshold / (2.0 - threshold)).otherwise(threshold).alias("least"))


def _overlap(n: Column, m: Column) -> Column:
    """How many tokens names of n and m must share."""
    return F.greatest(F.ceil(F.col("least") * (n + m) / (1.0 + F.col("least")) - SLACK).cast("int"), F.lit(1))


def _keyed(t: DataFrame, small: bool, above: int) -> DataFrame:
    """Names of _tokens() with the keys of which any two that are similar share one, as the smaller or the larger of
    two: for each size of the other, two of the tokens that remain before so many as they must share (one where they
    need share but one); of more than SHORT tokens, one for any size. Of words, only for pairs of which the larger has more than
    `above`."""
    n = F.col("n")
    far = F.floor(n / F.col("least") + SLACK).cast("int") if small else n
    near = n if small else F.greatest(F.ceil(F.col("least") * n - SLACK).cast("int"), F.lit(1))
    most = F.least(far, F.lit(SHORT))
    sizes = F.when(near <= most, F.sequence(near, F.greatest(near, most))).otherwise(F.array().cast("array<int>"))
    short = t.withColumn("m", F.explode(F.when(n <= SHORT, sizes).otherwise(F.array().cast("array<int>"))))
    # names of one word are compared by their letters
    short = short.filter(F.col("letters") | (F.greatest(n, F.col("m")) > max(above, 1))).withColumn("o", _overlap(n, F.col("m"))).filter("o <= n and o <= m")
    short = short.withColumn("head", F.slice("tokens", 1, F.when(F.col("o") > 1, n - F.col("o") + 2).otherwise(n)))
    twos = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda y: F.array(x, y))))
    short = short.withColumn("key", F.explode(F.when(F.col("o") > 1, twos).otherwise(F.transform("head", lambda x: F.array(x)))))
    sides = (n, F.col("m")) if small else (F.col("m"), n)
    short = short.select("id", "kind", "letters", "tokens", "n", "head", sides[0].alias("_n"), sides[1].alias("_m"), "key")
    long = t.withColumn("head", F.slice("tokens", 1, n - F.greatest(F.ceil(F.col("least") * n - SLACK).cast("int"), F.lit(1)) + 1))
    long = long.withColumn("key", F.explode(F.transform("head", lambda x: F.array(x)))).filter(F.lit(small) | (n > SHORT))
    return short.unionByName(long.select("id", "kind", "letters", "tokens", "n", "head", F.lit(0).alias("_n"), F.lit(0).alias("_m"), "key"))


def compared(t: DataFrame, above: int = 0) -> DataFrame:
    """(a, b, letters, na, nb, shared), a < b, once each: the pairs of names of _tokens() that are compared, which share a
    key of the rarest tokens that similar ones must share; shared: tokens that both have. above: as _keyed() takes it."""
    left, right = (_keyed(t, small, above) for small in (True, False))
    left = left.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    on = ["kind", "letters", "_n", "_m", "key", "_s"]
    # few names may make many pairs, which a small table's one task would make alone; and many keys, which plans take to be
    # as small as the names and would gather on the driver to broadcast them
    left = left.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    both = left.select(*on, *[F.col(c).alias(f"{c}a") for c in ("id", "n", "head", "tokens")]).join(right.select(*on, *[F.col(c).alias(f"{c}b") for c in ("id", "n", "head", "tokens")]).hint("merge"), on)
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ida") < F.col("idb")))
    # of the keys that both have, the first brings the pair in
    first = F.slice(F.array_intersect("heada", "headb"), 1, F.size("key")) == F.col("key")
    return both.filter(once & first).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), "letters", "na", "nb", F.size(F.array_intersect("tokensa", "tokensb")).alias("shared"))


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, confidence, source) of pairs as lexical_similarity() judges them."""
    total = F.col("na") + F.col("nb")
    likeness = F.when(F.col("letters"), 2.0 * F.col("shared") / total).otherwise(F.col("shared") / (total - F.col("shared")))
    found = pairs.withColumn("confidence", likeness).filter(F.col("confidence") >= threshold)
    return found.select("a", "b", F.least("confidence", F.lit(LEXICAL_MOST)).alias("confidence"), F.lit("lexical").alias("source"))


def lexical_edges(nodes: DataFrame, vetoes: DataFrame | None = None, threshold: float = LEXICAL_THRESHOLD) -> DataFrame:
    """Edges (a, b, confidence, source), a < b, of tokens (id) of one kind with similar values."""
    pairs = compared(kept(_tokens(nodes, threshold)))
    if vetoes is not None:
        pairs = pairs.join(vetoes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return _alike(pairs, threshold)


def lexical_forest(nodes: DataFrame, threshold: float = LEXICAL_THRESHOLD) -> DataFrame:
    """So many of lexical_edges() that what they connect at any confidence, these connect too. Their number doesn't grow
    with the square of the names that share words.

    A name of at most TOLD words is tied, for each set of its words, to the least name of each size not above its own
    that has the set: two names that share the set both are tied to the smaller's least, no worse than to each
    other. Other names are tied by their pairs.
    """
    t = kept(_tokens(nodes, threshold))
    told = t.filter(~F.col("letters") & (F.col("n") <= TOLD)).withColumn("words", F.array_sort("tokens"))
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), TOLD) - 1)
    bit = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
    sets = F.transform(F.filter(masks, lambda k: k < F.call_function("shiftleft", F.lit(1), F.col("n"))), lambda k: F.filter("words", lambda w, i: bit(k, i)))
    some = told.withColumn("words", F.explode(sets)).select("id", "kind", "tokens", "n", "least", "words")
    heads = some.groupBy("kind", "words", F.col("n").alias("m")).agg(F.min(F.struct("id", "tokens")).alias("head"))
    sizes = some.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("n")))).filter((F.size("words") >= _overlap(F.col("n"), F.col("m"))) & (F.size("words") <= F.col("m")) & (F.col("n") > 1))
    ties = sizes.join(heads.hint("merge"), ["kind", "words", "m"]).filter(F.col("id") != F.col("head.id"))
    ties = ties.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"), F.lit(False).alias("letters"), F.col("n").alias("na"), F.col("m").alias("nb"), F.size(F.array_intersect("tokens", "head.tokens")).alias("shared"))
    return _alike(ties.unionByName(compared(t, TOLD)), threshold)


def resolve(nodes: DataFrame, edges: DataFrame, vetoes: DataFrame | None = None, theta: float = THETA, prior: DataFrame | None = None) -> DataFrame:
    """(id, representative, band): classes of tokens by edges of confidence theta or more that aren't vetoed.
    A class's band is that of the weakest edge it needs: the best at which it still hangs together."""
    e = edges.filter(F.col("confidence") >= theta).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence")
    if vetoes is not None:
        e = e.join(vetoes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    e = kept(e)
    ids = kept(nodes.select("id").unionByName(e.select(F.col("a").alias("id"))).unionByName(e.select(F.col("b").alias("id"))).distinct())
    out = min_label_components(ids, e)
    for name, least in (("confirmed", CONFIRMED), ("probable", PROBABLE)):
        part = min_label_components(ids, e.filter(F.col("confidence") >= least)).select("id", F.col("component").alias(name))
        out = out.join(part, "id")
    out = kept(out)
    held = out.groupBy("component").agg((F.count_distinct("confirmed") == 1).alias("c"), (F.count_distinct("probable") == 1).alias("p"))
    named = F.when(F.col("c"), "confirmed").when(F.col("p"), "probable").otherwise("uncertain")
    reps = out.select("id", "component")
    if prior is not None:
        first = reps.join(prior.select("id"), "id", "left_semi").groupBy("component").agg(F.min("id").alias("was"))
        reps = reps.join(first, "component", "left")
    else:
        reps = reps.withColumn("was", F.lit(None).cast("string"))
    return reps.join(held, "component").select("id", F.coalesce("was", "component").alias("representative"), named.alias("band"))


