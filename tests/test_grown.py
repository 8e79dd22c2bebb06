"""What differed from SQL, or grew faster than its input, on larger tables."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.functions.scoring import micros
from spindrift.operators import blocks, classes, digest, generate, link, rollup, status, summaries, threads
from spindrift.operators.graph import min_label_components
from spindrift.plans import jobs
from spindrift.plans.queries import ORACLE
from spindrift.storage import kept


def _at(s: str):
    return F.lit(s).cast("timestamp_ntz")


def test_a_touched_cluster_is_marked_even_if_an_event_came_in_later(spark):
    rows = [("a", 0, 5), ("b", 1, -5), ("c", 0, 5)]
    clusters = spark.createDataFrame(rows, "cluster_id string, depth_rank int, s int").select("cluster_id", "depth_rank", (_at("2024-01-31 00:00:00") + F.make_dt_interval(secs=F.col("s"))).alias("updated_at"))
    touched = spark.createDataFrame([("a", True), ("b", False)], "cluster_id string, raise_depth boolean")
    found = {r[0]: (r[1], r[2]) for r in rollup.touch(clusters, touched, _at("2024-01-31 00:00:00")).select("cluster_id", "depth_rank", micros(F.col("updated_at"))).collect()}
    now = 1706659200000000
    assert found == {"a": (2, now), "b": (1, now), "c": (0, now + 5_000_000)}


def test_a_corpus_ends_with_the_newline_that_fits_its_budget(spark):
    rows = [(c, turn, text) for c, texts in enumerate((["old", "12345", "1234"], ["old", "12345", "123"], ["1234567890"])) for turn, text in enumerate(texts)]
    found = digest.source_corpus(spark.createDataFrame(rows, "c int, turn int, text string"), 11, ["c"], ["turn"], "text").collect()
    assert {r[0]: r[1] for r in found} == {0: "1234\n12345\n", 1: "123\n12345\no", 2: "1234567890"}


def test_times_of_the_status_are_told_to_the_nearest_second(spark):
    c = spark.createDataFrame([(0.25,), (1.75,)], "s double").select((_at("2024-01-31 00:00:00") + F.make_dt_interval(secs=F.col("s"))).alias("updated_at"))
    assert {r[1]: r[2] for r in status._measures("clusters", status.cluster_stats(c)).collect()} == {"total": 2, "latest_updated": 1706659202}


def test_an_interval_of_less_than_a_second_was_asked_for(spark, tmp_path):
    balance = "CASE i WHEN 1 THEN 0.37 WHEN 3 THEN 0.0 WHEN 5 THEN -0.5 WHEN 7 THEN 1.0 ELSE 60.9 END::DOUBLE AS s_acctbal"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE supplier AS SELECT i AS s_suppkey, {balance}, (i % 9)::INTEGER AS s_nationkey FROM range(20) t(i)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    found = [tuple(r) for r in jobs.connections_made(spark, str(tmp_path)).orderBy("connection_id").collect()]
    assert found == sorted(con.execute(ORACLE["connections_made"]).fetchall())


def _clusters(spark, seed: int, n: int = 60):
    rng = random.Random(seed)
    few = [f"repo:k{i}" for i in range(9)] + ["cve:CVE-2024-1000", "url:http://e.org", "person:p", "user:x"]
    rows = [(f"c{i}", rng.sample(few, rng.randint(0, 4)) + ([f"user:u{i // 3}"] if rng.random() < 0.7 else []), rng.randint(0, 20 * 86_400)) for i in range(n)]
    c = spark.createDataFrame(rows, "cluster_id string, entities array<string>, s int")
    return c.select("cluster_id", "entities", (_at("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("s"))).alias("last_event_time"))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_give_the_edges_and_components_that_the_join_gives(spark, monkeypatch, seed):
    c = _clusters(spark, seed)
    light = spark.createDataFrame([("repo:k1", 0.05), ("repo:k2", 0.1), ("user:u1", 0.0)], "entity string, factor double") if seed == 2 else None
    edges = link.score_edges(c, light, rare=1 << 30)
    want = sorted((r.a, r.b, r.strong, round(r.score, 9), r.reason) for r in edges.collect())
    classes = {tuple(r) for r in min_label_components(c.select(F.col("cluster_id").alias("id")), edges).collect()}
    monkeypatch.setattr(blocks, "BLOCK", 23)
    monkeypatch.setattr(blocks, "TILE", 5)
    got = link.score_edges(c, light, rare=2)
    assert sorted((r.a, r.b, r.strong, round(r.score, 9), r.reason) for r in got.collect()) == want and len(want) > 50
    assert {tuple(r) for r in link.linked_components(c, light, rare=2).collect()} == classes


def test_of_clusters_that_all_link_no_pair_leaves_its_task(spark, monkeypatch):
    rows = [(f"c{i:04}", ["repo:a", "repo:b"]) for i in range(400)]
    c = spark.createDataFrame(rows, "cluster_id string, entities array<string>").withColumn("last_event_time", _at("2024-01-01 00:00:00"))
    told = []
    judged = blocks.judged
    monkeypatch.setattr(blocks, "judged", lambda *a, **k: told.append(judged(*a, **k).cache()) or told[-1])
    assert {r.component for r in link.linked_components(c).collect()} == {"c0000"}
    assert 399 <= told[0].count() < 800


@pytest.mark.parametrize(("block", "rare"), [(1 << 14, 2), (17, 2)])
def test_who_hears_the_same_is_linked_once_and_as_the_edges_say(spark, monkeypatch, block, rare):
    monkeypatch.setattr(classes, "BLOCK", block)
    c = _clusters(spark, 5).withColumns({"scope_kind": F.lit("public"), "owner": F.lit(None).cast("long"), "connection_id": F.substring("cluster_id", 2, 2).cast("long") % 3, "updated_at": F.col("last_event_time")})
    c = c.unionByName(c.filter("cluster_id like 'c1%'").select(*[F.concat(F.lit("p"), "cluster_id").alias(n) if n == "cluster_id" else F.lit("private").alias(n) if n == "scope_kind" else F.lit(3).cast("long").alias(n) if n == "owner" else n for n in c.columns]))
    subs = spark.createDataFrame([(s, k) for s in range(6) for k in range(3) if k != s % 2], "subscriber long, connection_id long")
    users = spark.createDataFrame([(s,) for s in range(6)], "subscriber long").withColumn("last_run", F.lit(None).cast("timestamp_ntz"))
    now = _at("2024-01-22 00:00:00")
    heard, alike = generate.first_heard(c, subs, users, now)
    assert {tuple(r) for r in alike.collect()} == {(0, 0), (2, 0), (4, 0), (1, 1), (5, 1), (3, 3)}
    found = generate.first_members(classes.components(c, heard, rare=rare), alike)
    _, members, _ = generate.link_all(c, generate.candidates_for_all(c, subs, users, now), spark.createDataFrame([], generate.NO_PRIOR))
    want = {(r.subscriber, r.cluster_id, r.story_id) for r in members.collect()}
    assert {(r.subscriber, r.cluster_id, r.story_id) for r in found.collect()} == want and len({w[2] for w in want}) > 6


def test_candidates_are_made_once_and_not_shuffled_to_be_so(spark):
    rows = [
        ("mine", "private", 1, ["cve:A", "cve:B"], 20, None), ("old", "public", None, ["cve:A", "cve:B", "cve:B"], -20, 1), ("heard", "public", None, ["cve:A", "cve:B"], 20, 1),
        ("unheard", "public", None, ["cve:B"], 20, 2), ("all", "public", None, ["cve:A"], 20, None), ("old-all", "public", None, ["cve:A"], -20, None), ("stale", "private", 2, ["cve:A"], -20, None),
    ]
    c = spark.createDataFrame(rows, "cluster_id string, scope_kind string, owner long, entities array<string>, d int, connection_id long").withColumn("updated_at", _at("2024-02-01 00:00:00") + F.make_dt_interval(days=F.col("d")))
    subs = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, None)], "subscriber long, connection_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "subscriber long").withColumn("last_run", _at("2024-02-10 00:00:00"))
    found = generate.candidates_for_all(c, subs, users, _at("2024-02-22 00:00:00"))
    want = [(1, x) for x in ("all", "heard", "mine", "old", "old-all", "unheard")] + [(2, "all"), (2, "unheard"), (3, "all")]
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def _similar(a: str, b: str) -> float:
    words = lambda v: {w for w in re.split("[ /_-]", v) if w}
    letters = lambda v: Counter(v[i : i + 2] for i in range(len(v) - 1))
    if len(words(a)) > 1 or len(words(b)) > 1:
        return len(words(a) & words(b)) / len(words(a) | words(b))
    n = letters(a).total() + letters(b).total()
    return 2.0 * (letters(a) & letters(b)).total() / n if letters(a) and letters(b) else 0.0


def _names(seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(7)] + ["x" * i for i in range(1, 22, 5)]
    some = {" ".join(rng.sample(base, rng.randint(1, 5))) for _ in range(60)}
    long = [[f"v{k}{i}" for i in range(rng.randint(6, 20))] for k in range(3)]
    some |= {"/".join(rng.sample(v, len(v) - rng.randint(0, 2)) + ([f"z{rng.randint(0, 3)}"] if rng.random() < 0.5 else [])) for v in long for _ in range(12)}
    some |= {"".join(rng.choice("ab1") for _ in range(rng.randint(0, 24))) for _ in range(70)} | {"-", "--", "ab-", "-ab", "w1-"}
    return sorted({f"{k}:{v}" for v in some for k in rng.sample(["p", "q"], rng.randint(1, 2))})


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.8), (3, 0.65), (4, 0.3)])
def test_names_that_are_similar_are_all_found_once_and_a_forest_connects_them_alike(spark, seed, threshold):
    names = _names(seed)
    nodes = spark.createDataFrame([(n,) for n in names + ["nokind"]], "id string")
    split = [n.split(":", 1) for n in names]
    scored = [(a, b, _similar(va, vb)) for (a, (ka, va)), (b, (kb, vb)) in itertools.combinations(zip(names, split), 2) if ka == kb]
    want = sorted((a, b, min(c, 0.95)) for a, b, c in scored if c >= threshold)
    edges = threads.lexical_edges(nodes, threshold=threshold)
    assert sorted((r.a, r.b, r.confidence) for r in edges.collect()) == want and len(want) > 50
    forest = kept(threads.lexical_forest(nodes, threshold))
    assert {(r.a, r.b, r.confidence) for r in forest.collect()} <= set(want)
    of = lambda e: sorted(tuple(r) for r in threads.resolve(nodes, e, theta=threshold).collect())
    assert of(forest) == of(edges)


def test_names_that_share_a_frequent_word_alone_are_not_compared(spark):
    nodes = spark.createDataFrame([(f"p:hot a{i} b{i}",) for i in range(300)] + [(f"q:u{i}",) for i in range(1000, 1300)], "id string")
    assert threads.compared(threads._tokens(nodes, 0.8)).count() < 3000


def test_keys_of_names_are_not_gathered_on_the_driver(spark):
    """A written table of names is small, but not the keys that are made of it."""
    nodes = spark.createDataFrame([(f"p:hot bolt {i}",) for i in range(200)] + [(f"q:u{i}",) for i in range(200)], "id string")
    for found in (threads.compared(kept(threads._tokens(nodes, 0.5))), threads.lexical_forest(nodes, 0.5)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_that_all_link_are_tied_by_a_forest(spark):
    nodes = spark.createDataFrame([(f"p:hot bolt {i}",) for i in range(200)], "id string")
    assert threads.lexical_forest(nodes, 0.5).count() < 4 * 200


def test_digests_are_rendered_by_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    """More lines are more tasks, not larger ones."""
    monkeypatch.setattr(storage, "DEALT", 100)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    found = jobs.digest_bodies(spark, sf_dir)
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= lines // 100 * 0.9 and max(sizes) <= 100


def test_parts_are_told_by_tasks_of_bounded_rows_that_read_lines_once(spark, sf_dir, monkeypatch):
    """Lines aren't joined with themselves, and where tables are too large to be broadcast, more of them are more tasks, not larger ones."""
    monkeypatch.setattr(storage, "DEALT", 100)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jobs.digest_parts(spark, sf_dir)
        assert found._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert len(sizes) >= lines // 100 * 0.9 and max(sizes) <= 100


def test_parts_are_told_alike_by_members_with_their_clusters_and_without(spark):
    """Nine clusters of one story, shown in two digests, of which another subscriber has one of the same name."""
    clusters = spark.createDataFrame([(f"c{i}", f" t{i} ", "h8" if i == 8 else " ", f"l{i}", "rss", i // 2) for i in range(10)], "cluster_id string, title string, headline string, link string, source string, s int")
    clusters = clusters.select("cluster_id", "title", "headline", "link", "source", (_at("2024-01-31 00:00:00") + F.make_dt_interval(secs=F.col("s"))).alias("last_event_time"))
    members = spark.createDataFrame([(1, "x", f"c{i}", f"r{i}") for i in range(9)] + [(2, "x", "c9", "r9"), (1, "unshown", "c0", "r0")], "subscriber int, story_id string, cluster_id string, link_reason string")
    items = spark.createDataFrame([(d, "x", 0, "story", "longform", 1.0, "t") for d in (10, 11, 20)] + [(11, "memberless", 1, "story", "longform", 1.0, None)], "digest_id int, story_id string, position int, format string, richness string, relevance double, thread_id string")
    digests = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "digest_id int, subscriber int")
    known = spark.createDataFrame([(1, "t", "T", "confirmed", None)], "subscriber int, thread_id string, label string, band string, delta string")
    for args in ((members, clusters), (members.join(clusters, "cluster_id"), None)):
        found = {r.digest_id: r for r in summaries.render_parts(items, digests, *args, known).collect()}
        assert sorted(found) == [10, 11, 20]
        for d in (10, 11):
            assert (found[d].headline, found[d].link, found[d].thread) == ("h8", "l8", "T")
            assert [(c.title, c.link_reason) for c in found[d].connections] == [(f"t{i}", f"r{i}") for i in (7, 6, 5, 4, 3, 2)]
            assert found[d].tldr == "t7. t6. t5. t4."
        assert (found[20].headline, found[20].thread, found[20].connections) == ("t9", "", [])


@pytest.mark.parametrize(("block", "grown"), [(1 << 16, 64), (17, 4)])
def test_a_groups_clusters_are_judged_once_for_all_who_have_private_ones_besides(spark, monkeypatch, block, grown):
    """Private clusters change what entities are worth to their owner, tie components and bring in old clusters."""
    monkeypatch.setattr(classes, "BLOCK", block)
    monkeypatch.setattr(classes, "GROWN", grown)
    monkeypatch.setattr(classes, "MEMBERS", 2)
    facts = {"owner": F.lit(None).cast("long"), "scope_kind": F.lit("public"), "source": F.concat(F.lit("s"), F.substring("cluster_id", 2, 1)), "title": F.concat(F.lit("t-"), "cluster_id"), "event_count": F.lit(2).cast("long"), "depth_rank": F.lit(1), "max_severity": F.lit(None).cast("int")}
    c = _clusters(spark, 7, 90).withColumns({**facts, "connection_id": F.substring("cluster_id", 2, 2).cast("long") % 3, "updated_at": F.when(F.col("cluster_id").like("c2%"), _at("2023-01-01 00:00:00")).otherwise(_at("2024-01-21 00:00:00")), "first_event_time": F.col("last_event_time")})
    mine = _clusters(spark, 8, 40).withColumn("entities", F.filter("entities", lambda e: ~e.like("url:%") & (~e.like("cve:%") | F.col("cluster_id").like("c2%")))).withColumns({**facts, "owner": F.substring("cluster_id", 2, 2).cast("long") % 8, "scope_kind": F.lit("private"), "connection_id": F.lit(None).cast("long"), "updated_at": _at("2024-01-21 00:00:00"), "first_event_time": F.col("last_event_time")})
    c = kept(c.unionByName(mine.withColumn("cluster_id", F.concat(F.lit("p"), "cluster_id")).filter("owner < 6")))
    subs = spark.createDataFrame([(s, k) for s in range(10) for k in range(3) if k != s % 2], "subscriber long, connection_id long")
    users = spark.createDataFrame([(s,) for s in range(10)], "subscriber long").withColumn("last_run", F.lit(None).cast("timestamp_ntz"))
    now = _at("2024-01-22 00:00:00")
    found = generate.link_first(c, subs, users, now)
    cands = kept(generate.candidates_for_all(c, subs, users, now))
    _, members, _ = generate.link_all(c, cands, spark.createDataFrame([], generate.NO_PRIOR))
    got = kept(generate.first_named(generate.linked_members(found)))
    told = lambda d: sorted((r.subscriber, r.cluster_id, r.story_id) for r in d.select("subscriber", "cluster_id", "story_id").collect())
    assert told(got) == told(members) and len({w[2] for w in told(got)}) > 20
    assert found.base.select("grp").distinct().count() < 8 and 2 * found.base.count() < cands.count()
    want = generate.stories_of(c, members)
    rows = lambda d: sorted(map(str, d.select(*want.columns).collect()))
    assert rows(generate.first_stories(c, found)) == rows(want)


@pytest.mark.parametrize("seed", [4])
def test_of_each_two_blocks_a_clusters_best_edges_alone_are_told(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "BLOCK", 23)
    monkeypatch.setattr(blocks, "WIDE", 40)
    monkeypatch.setattr(blocks, "TILE", 5)
    c = _clusters(spark, seed, 150)
    light = spark.createDataFrame([("repo:k1", 0.05), ("repo:k2", 0.1), ("user:u1", 0.2)], "entity string, factor double")
    edges, best = kept(link.score_edges(c, light, rare=2)), kept(link.best_edges(c, light, rare=2))
    comp = kept(link.linked_components(c, light, rare=2))
    of = lambda e: sorted((r.cluster_id, r.link_reason) for r in link.member_reasons(comp, e, whole=True).collect())
    assert of(best) == of(edges) and any(r for _, r in of(best)) and best.count() < edges.count()
    told = lambda e: {(r.a, r.b, r.strong, r.score, r.reason) for r in e.collect()}
    assert told(best) <= told(edges)
