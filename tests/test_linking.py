"""Linking for all subscribers, guarded merging in rounds, the summary gate, and the second window."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.operators import generate, graph, incidence, link, threads
from spindrift.plans import jobs  # noqa: F401
from spindrift.plans.queries import QUERIES

T0 = datetime(2024, 1, 1)
CLUSTERS = "cluster_id string, scope_kind string, owner long, entities array<string>, last_event_time timestamp_ntz"


def some_clusters(rng, n):
    pool = [f"repo:r{k}" for k in range(9)] + [f"user:u{k}" for k in range(5)] + ["cve:CVE-1", "url:http://e.org/a", "person:p", "domain:e.org", "user:x[bot]"]
    rows = []
    for k in range(n):
        own = rng.random() < 0.3
        rows.append((f"c{rng.randrange(10**6):06}-{k}", "private" if own else "public", rng.randrange(3) if own else None, rng.sample(pool, rng.randint(0, 4)), T0 + timedelta(hours=rng.randrange(900))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_incidences_give_each_subscribers_own_edges(spark, seed):
    """The same weak edges as scoring a subscriber's candidates alone; of strong ones, the same components and
    best reasons, with feedback too."""
    rng = random.Random(seed)
    rows = some_clusters(rng, 45)
    clusters = spark.createDataFrame(rows, CLUSTERS)
    pairs = [(s, r[0]) for s in range(3) for r in rows if (r[2] == s if r[1] == "private" else rng.random() < 0.7)]
    heard = spark.createDataFrame(pairs, "subscriber long, cluster_id string")
    overrides = spark.createDataFrame([("repo:r1", 2.0), ("user:u1", 0.5)], "entity string, factor double")
    ids = [r[0] for r in rows]
    asked = lambda n: [(rng.randrange(3), *rng.sample(ids, 2)) for _ in range(n)]
    feedback = "subscriber long, a string, b string"
    must, cannot = spark.createDataFrame(asked(6), feedback), spark.createDataFrame(asked(60), feedback)
    found = incidence.edges_for_all(clusters, heard, overrides, must, cannot)
    _, members, _ = generate.link_all(clusters, heard, spark.createDataFrame([], generate.NO_PRIOR), overrides, must, cannot)
    name = {r["h"]: r["cluster_id"] for r in found.nodes.collect()}
    weak = {(r["subscriber"], name[r["a"]], name[r["b"]]): (round(r["score"], 9), r["reason"]) for r in found.edges.filter("not strong").collect()}
    want_weak, want = {}, {}
    for s in range(3):
        mine = clusters.join(heard.filter(F.col("subscriber") == s), "cluster_id")
        edges = link.score_edges(mine, overrides)
        edges = link.apply_constraints(edges, must.filter(F.col("subscriber") == s), cannot.filter(F.col("subscriber") == s), mine)
        listed = edges.collect()
        want_weak |= {(s, r["a"], r["b"]): (round(r["score"], 9), r["reason"]) for r in listed if not r["strong"]}
        edges = spark.createDataFrame(listed, edges.schema)
        comp = graph.min_label_components(mine.select(F.col("cluster_id").alias("id")), edges).withColumnRenamed("id", "cluster_id")
        want |= {(s, r["cluster_id"]): (r["component"], r["link_reason"]) for r in link.member_reasons(comp, edges).collect()}
    assert weak == want_weak and len(weak) > 10
    assert {(r["subscriber"], r["cluster_id"]): (r["component"], r["link_reason"]) for r in members.collect()} == want


def walked(nodes, edges, told):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {n: set(told.get(n, ())) for n in nodes}
    for a, b, strong, _ in sorted(edges, key=lambda e: (not e[2], -e[3], e[0], e[1])):
        x, y = sorted((root(a), root(b)))
        if x == y or (not strong and sets[x] and sets[y] and not sets[x] & sets[y]):
            continue
        up[y] = x
        sets[x] |= sets[y]
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed,walk", [(1, 0), (2, 0), (3, 1 << 17), (4, 12)])
def test_guarded_merging_equals_the_ordered_pass(spark, seed, walk):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(36)]
    tied = {tuple(sorted(rng.sample(nodes[:26] if rng.random() < 0.8 else nodes[26:], 2))) for _ in range(70)}
    edges = [(a, b, rng.random() < 0.15, rng.choice([0.4, 0.5, 0.6, rng.random()])) for a, b in tied]
    told = [(n, f"s{rng.randrange(7)}", rng.random() < 0.8) for n in nodes if rng.random() < 0.5]
    sets = {}
    for n, s, d in told:
        if d:
            sets.setdefault(n, []).append(s)
    df = spark.createDataFrame(edges, "a string, b string, strong boolean, score double")
    found = link.guarded_components(spark.createDataFrame([(n,) for n in nodes], "cluster_id string"), df, spark.createDataFrame(told, "cluster_id string, story_id string, delivered boolean"), walk)
    assert {r["cluster_id"]: r["component"] for r in found.collect()} == walked(nodes, edges, sets)


@pytest.mark.parametrize("unite", [1 << 17, 20])
def test_components_equal_a_search(spark, monkeypatch, unite):
    """Also where no task may unite all edges."""
    monkeypatch.setattr(graph, "UNITE", unite)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(300, 420)]
    want = walked(range(450), [(a, b, True, 1.0) for a, b in edges], {})
    nodes = spark.createDataFrame([(n,) for n in range(450)], "id long")
    found = graph.min_label_components(nodes, spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert {r["id"]: r["component"] for r in found.collect()} == want


def test_summary_gate_withholds_but_private_keys_still_seed(spark):
    """Neither a cluster without a summary nor one with a rejected summary is a candidate; the keys of a withheld
    private one still bring in an old public one, if that has a summary."""
    old, new = T0, T0 + timedelta(days=99)
    rows = [
        ("good", "public", None, [], new, "confirmed"), ("likely", "public", None, [], new, "probable"), ("weak", "public", None, [], new, "uncertain"), ("none", "public", None, [], new, None),
        ("mine", "private", 1, ["cve:A", "cve:B"], new, None), ("told", "public", None, ["cve:A"], old, "confirmed"), ("untold", "public", None, ["cve:B"], old, "uncertain"), ("told-mine", "private", 1, [], new, "confirmed"),
    ]
    c = spark.createDataFrame([(*r[:5], None, r[4], r[5]) for r in rows], CLUSTERS + ", connection_id long, updated_at timestamp_ntz, band string")
    users = spark.createDataFrame([(1, None), (2, None)], "subscriber long, last_run timestamp_ntz")
    subs = spark.createDataFrame([], "subscriber long, connection_id long")
    now = F.lit(new).cast("timestamp_ntz")
    of = lambda gate: sorted((r[0], r[1]) for r in generate.candidates_for_all(c, subs, users, now, gate).collect())
    assert of(True) == [(1, "good"), (1, "likely"), (1, "told"), (1, "told-mine"), (2, "good"), (2, "likely")]
    everyone = ["good", "likely", "none", "weak"]
    assert of(False) == sorted([(s, x) for s in (1, 2) for x in everyone] + [(1, x) for x in ("mine", "told", "told-mine", "untold")])


def test_second_window_sees_the_first(spark, sf_dir):
    """Stories keep their ids, delivered ones come back only as notes or with news, and nobody gets too many."""
    found = QUERIES["second_window"](spark, sf_dir).collect()
    assert any(r["before"] for r in found) and any(not r["before"] for r in found)
    assert any(r["resurfaced"] for r in found) and all(r["format"] == "note" for r in found if r["resurfaced"])
    per: dict = {}
    for r in found:
        if r["verdict"] == "selected":
            per.setdefault(r["subscriber"], []).append(r)
    assert all(len(x) <= 10 and sum(r["format"] == "story" for r in x) <= 4 for x in per.values())
    assert all(sorted(r["position"] for r in x) == list(range(len(x))) for x in per.values())


def test_classes_link_again_as_each_subscriber_does(spark):
    """Of one class, some have delivered stories that must stay apart, and some don't."""
    rng = random.Random(5)
    rows = [r for r in some_clusters(rng, 60) if r[1] == "public"]
    clusters = spark.createDataFrame(rows, CLUSTERS)
    alike = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "subscriber long, like long")
    heard = spark.createDataFrame([(u, r[0]) for u in (1, 4) for r in rows if u == 1 or rng.random() < 0.8], "subscriber long, cluster_id string")
    prior = [(u, x[0], f"s{u}-{k % (12 if u == 2 else 4)}", u != 1, T0 + timedelta(hours=k)) for u in (1, 2, 4) for k, x in enumerate(rows[:24])]
    prior = spark.createDataFrame(prior, generate.NO_PRIOR)
    every = heard.withColumnRenamed("subscriber", "like").join(alike, "like").select("subscriber", "cluster_id")
    _, want, lost = generate.link_all(clusters, every, prior)
    got, merges = generate.link_again(clusters, heard, alike, prior)
    told = lambda d: sorted(d.select("subscriber", "cluster_id", "story_id").collect())
    assert told(got) == told(want) and sorted(merges.select("loser", "survivor").collect()) == sorted(lost.select("loser", "survivor").collect())
    stories = {u: {r["story_id"] for r in told(got) if r["subscriber"] == u} for u in (1, 2, 3)}
    assert len(stories[2]) > len(stories[3])


def propagated(edges, rounds=30):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(near):
            pull = {label[n]: 1e-3}
            for m, w in near[n]:
                pull[label[m]] = pull.get(label[m], 0) + w
            label[n] = min(pull, key=lambda x: (-round(pull[x], 9), x))
        if label == before:
            break
    return label


@pytest.mark.parametrize("seed,walk", [(1, 0), (2, 8), (3, 1 << 17)])
def test_label_propagation_by_steps_equals_the_ordered_walk(spark, seed, walk):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(26)]
    tied = {tuple(sorted(rng.sample(nodes[:16] if rng.random() < 0.7 else nodes[16:], 2))) for _ in range(34)}
    edges = [(a, b, rng.choice([0.1, 0.2, 0.3, 1.0, 0.7])) for a, b in tied]
    found = threads.label_propagation(spark.createDataFrame(edges, "a string, b string, weight double"), walk=walk)
    assert {r["node"]: r["label"] for r in found.collect()} == propagated(edges)


def matched(communities, existing, threshold):
    taken, out = set(), {}
    for label, entities in sorted(communities):
        e = set(entities)
        ids = sorted((t, pinned) for t, own, pinned in existing if t not in taken and e & set(own) and len(e & set(own)) / len(e | set(own)) >= threshold)
        if not ids:
            out[label] = ("new", None, [])
            continue
        merged = [t for t, pinned in ids[1:] if not pinned]
        taken |= {ids[0][0], *merged}
        out[label] = ("keep" if len(ids) == 1 else "merge", ids[0][0], merged)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_in_turns_equals_the_ordered_walk(spark, seed):
    rng = random.Random(seed)
    some = lambda n: sorted(rng.sample([f"e{k}" for k in range(14)], rng.randint(2, n)))
    communities = [(f"l{k:02}", some(5)) for k in range(16)]
    existing = [(f"t{k:02}", some(4), rng.random() < 0.3) for k in range(14)]
    found = threads.match_threads(spark.createDataFrame(communities, "label string, entities array<string>"), spark.createDataFrame(existing, "thread_id string, entities array<string>, pinned boolean"), 0.25)
    assert {r["label"]: (r["action"], r["thread_id"], r["merged"] or []) for r in found.collect()} == matched(communities, existing, 0.25)
