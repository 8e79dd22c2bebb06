"""Golden cases and models in plain Python for what SQL can't express."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.functions import prose, scoring, text
from spindrift.operators import candidates, digest, evaluate, generate, link, maintain, mutations, rollup, select, status, summaries, threads
from spindrift.schema import Scoring
from spindrift.scope import Context, finalize_scope, scoped
from spindrift.sources import feeds, github, guard
from spindrift.streaming import incremental
from spindrift.plans import jobs  # noqa: F401  (adds its queries)
from spindrift.plans.queries import QUERIES

T0 = datetime(2024, 1, 10)


def clusters(spark, rows):
    """rows: (id, entities, day)."""
    data = [(i, "public", None, i.split("/")[0], T0 + timedelta(days=d), T0 + timedelta(days=d), e, 1, 0, None) for i, e, d in rows]
    return spark.createDataFrame(data, "cluster_id string, scope_kind string, owner long, source string, first_event_time timestamp_ntz, last_event_time timestamp_ntz, entities array<string>, event_count long, depth_rank int, max_severity int")


def stories(spark, rows, prior=()):
    c = clusters(spark, rows)
    edges = link.score_edges(c)
    p = spark.createDataFrame(list(prior), "cluster_id string, story_id string, delivered boolean")
    comp = link.guarded_components(c, edges, p)
    return c, edges, comp, p


def count(comp):
    return comp.select("component").distinct().count()


def test_shared_cve_fuses(spark):
    c, edges, comp, _ = stories(spark, [("a/1", ["cve:CVE-2026-1234"], 0), ("b/1", ["cve:CVE-2026-1234"], 59)])
    assert count(comp) == 1
    assert {r["link_reason"] for r in link.member_reasons(comp, edges).collect()} == {"shared cve:CVE-2026-1234"}


def test_shared_topic_never_fuses(spark):
    assert count(stories(spark, [(f"a/{i}", ["topic:x", "domain:d.org"], 0) for i in range(4)])[2]) == 4


def test_sparse_items_of_one_broad_place_stay_apart(spark):
    assert count(stories(spark, [(f"a/{i}", ["place:germany"], 0) for i in range(5)])[2]) == 5


def test_place_shared_by_three_of_nine(spark):
    rows = [(f"a/{i}", ["place:baltic"] if i < 3 else [f"place:p{i}"], 0) for i in range(9)]
    assert count(stories(spark, rows)[2]) == 7


def test_weak_pair_needs_time(spark):
    near = [("a/1", ["person:x", "org:y"], 0), ("b/1", ["person:x", "org:y"], 0)]
    assert count(stories(spark, near)[2]) == 1
    broad = [("a/1", ["org:y", "person:p"], 0), ("b/1", ["org:y", "person:q"], 59)]
    assert count(stories(spark, broad)[2]) == 2


def test_delivered_stories_only_merge_by_strong_edges(spark):
    rows = [("a/1", ["person:x", "org:y"], 0), ("b/1", ["person:x", "org:y"], 0)]
    prior = [("a/1", "s1", True), ("b/1", "s2", True)]
    assert count(stories(spark, rows, prior)[2]) == 2
    rows = [(i, [*e, "url:https://e.org/a"], d) for i, e, d in rows]
    _, _, comp, p = stories(spark, rows, prior)
    assert count(comp) == 1
    ids, merges = link.forward_ids(comp, p)
    assert [r["story_id"] for r in ids.collect()] == ["s1"]
    assert [(r["loser"], r["survivor"]) for r in merges.collect()] == [("s2", "s1")]


def test_constraints(spark):
    c, edges, _, _ = stories(spark, [("a/1", ["cve:CVE-2026-1234"], 0), ("b/1", ["cve:CVE-2026-1234"], 0), ("c/1", [], 0)])
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
    kept = link.apply_constraints(edges, must=pair("c/1", "a/1"), cannot=pair("b/1", "a/1"), clusters=c)
    assert [(r["a"], r["b"], r["strong"]) for r in kept.collect()] == [("a/1", "c/1", True)]


def greedy(rows, cfg):
    """The selection pass as a loop."""
    n = {"story": 0, "note": 0}
    again, threads_, out = 0, {}, {}
    rows = sorted(rows, key=lambda r: (-r["priority"], -r["t"], r["story_id"]))
    position = 0
    for r in rows:
        cap = cfg.story_cap if r["format"] == "story" else cfg.note_cap
        ok = n[r["format"]] < cap and (not r["resurfaced"] or again < cfg.resurface_cap) and position < cfg.max_items
        ok = ok and (r["thread_id"] is None or cfg.thread_cap <= 0 or threads_.get(r["thread_id"], 0) < cfg.thread_cap)
        if ok:
            n[r["format"]] += 1
            again += r["resurfaced"]
            if r["thread_id"] is not None:
                threads_[r["thread_id"]] = threads_.get(r["thread_id"], 0) + 1
            out[r["story_id"]] = position
            position += 1
        else:
            out[r["story_id"]] = None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_selection_is_the_greedy_pass(spark, seed):
    rnd = random.Random(seed)
    cfg = Scoring(story_cap=4, note_cap=6, thread_cap=2, resurface_cap=2, max_items=9)
    rows = [dict(subscriber=1, story_id=f"s{i:02}", priority=rnd.choice([1.0, 0.5, 0.25]), t=rnd.randrange(5), format=rnd.choice(["story", "note"]), resurfaced=rnd.random() < 0.3, thread_id=rnd.choice([None, "a", "b"]), drop_cause=None) for i in range(30)]
    df = spark.createDataFrame([(*r.values(),) for r in rows], "subscriber long, story_id string, priority double, t int, format string, resurfaced boolean, thread_id string, drop_cause string").withColumn("last_event_time", F.col("t"))
    found = {r["story_id"]: r["position"] for r in select.select_full(df, cfg).collect()}
    assert found == greedy(rows, cfg)


def test_scope(spark):
    df = spark.createDataFrame([("public", None), ("private", 1), ("private", 2)], "scope_kind string, owner long")
    assert [scoped("cluster", df, c).count() for c in (Context(), Context(1), Context(admin=True))] == [1, 2, 1]
    with pytest.raises(PermissionError):
        scoped("thread", df, Context())
    with pytest.raises(Exception, match="needs an owner"):
        finalize_scope(df, F.lit(True), F.col("owner")).collect()


def test_rollup_keeps_scopes_apart_and_takes_the_latest(spark):
    rows = [(1, "public", None, 0, "first", "a", 0, None), (2, "public", None, 1, "second", "b", 2, 5), (3, "private", 7, 2, "mine", "c", 1, None)]
    ev = spark.createDataFrame([(i, k, o, "rss", "g", T0 + timedelta(hours=h), T0, t, [e], [], d, s, None) for i, k, o, h, t, e, d, s in rows], "event_id long, scope_kind string, owner long, source string, group_key string, event_time timestamp_ntz, ingest_time timestamp_ntz, title string, entities array<string>, links array<string>, depth_rank int, severity int, connection_id long")
    out = {r["scope_kind"]: r for r in rollup.rollup(ev).collect()}
    assert (out["public"]["title"], out["public"]["event_count"], out["public"]["entities"], out["public"]["depth_rank"], out["public"]["max_severity"]) == ("second", 2, ["a", "b"], 2, 5)
    assert out["private"]["owner"] == 7


def propagate(edges, rounds=30):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(near):
            pull = {label[n]: 1e-3}
            for o, w in near[n]:
                pull[label[o]] = pull.get(label[o], 0) + w
            label[n] = min(pull, key=lambda x: (-pull[x], x))
        if label == before:
            break
    return label


def test_label_propagation(spark):
    rnd = random.Random(4)
    edges = [(f"n{a}", f"n{b}", float(rnd.randrange(1, 4))) for a in range(12) for b in range(a + 1, 12) if rnd.random() < 0.2]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    assert {r["node"]: r["label"] for r in threads.label_propagation(df).collect()} == propagate(edges)


def test_threads_are_claimed_once_and_the_oldest_wins(spark):
    cand = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["a", "b", "d"])], "label string, entities array<string>")
    old = spark.createDataFrame([("t1", ["a", "b"], False), ("t2", ["b", "c"], False), ("t3", ["a", "c"], True)], "thread_id string, entities array<string>, pinned boolean")
    out = {r["label"]: (r["action"], r["thread_id"], r["merged"]) for r in threads.match_threads(cand, old).collect()}
    assert out["x"] == ("merge", "t1", ["t2"])
    assert out["y"][:2] == ("keep", "t3") or out["y"][0] == "new"


def test_states_affinity_and_weights(spark):
    now = F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz")
    df = spark.createDataFrame([(d, p) for d in (5, 30, 120) for p in (False, True)], "d int, pinned boolean").withColumn("t", now - F.make_dt_interval(days=F.col("d")))
    states = [r[0] for r in df.select(scoring.thread_state(F.col("t"), now, F.col("pinned"), 21, 90)).collect()]
    assert states == ["active", "active", "dormant", "dormant", "archived", "dormant"]
    one = spark.range(1)
    assert one.select(scoring.decay_affinity(F.lit(1.0), F.lit(30 * 86400.0), 30, F.lit(0.3), 10.0)).first()[0] == pytest.approx(0.8)
    t = spark.createDataFrame([("active", 1.0, ["a", "b"]), ("dormant", 2.0, ["a", "c"]), ("archived", 9.0, ["b"])], "state string, affinity double, entities array<string>")
    assert {r["entity"]: r["weight"] for r in threads.project_weights(t).collect()} == {"a": 0.75, "b": 0.5, "c": 0.25}


def test_identity_bands_and_vetoes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.85), ("c", "d", 0.9)], "a string, b string, confidence double")
    veto = spark.createDataFrame([("d", "c")], "a string, b string")
    out = {r["id"]: (r["representative"], r["band"]) for r in threads.resolve(nodes, edges, veto).collect()}
    assert out == {"a": ("a", "probable"), "b": ("a", "probable"), "c": ("a", "probable"), "d": ("d", "confirmed")}


def test_next_run_keeps_the_wall_clock(spark):
    cases = [
        ("2024-03-09 23:00:00", "America/New_York", 150, "daily", 0, datetime(2024, 3, 10, 7, 30)),  # the hour that is left out
        ("2024-11-02 23:00:00", "America/New_York", 90, "daily", 0, datetime(2024, 11, 3, 6, 30)),  # the hour that comes twice
        ("2024-01-31 09:30:00", "UTC", 1020, "weekly", 2, datetime(2024, 2, 6, 17, 0)),
        ("2024-01-31 17:00:00", "UTC", 1020, "daily", 0, datetime(2024, 2, 1, 17, 0)),
    ]
    for ref, tz, minute, freq, dow, want in cases:
        got = spark.range(1).select(scoring.next_run(F.lit(ref).cast("timestamp_ntz"), F.lit(tz), F.lit(minute), F.lit(freq), F.lit(dow))).first()[0]
        assert got == want, (ref, tz)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_entities_are_derived(spark):
    """Only marks after an address are trimmed, so that one behind a bracket is none."""
    said = F.lit("See https://www.Example.com/Path/#x), (https://b.org xcve-2024-1234 cve-2024-12345")
    e = one(spark, text.derive_entities(said, F.lit(None).cast("string"), F.array(F.lit("HTTP://a.org"))))
    assert e == ["cve:CVE-2024-12345", "domain:a.org", "domain:example.com", "url:http://a.org", "url:https://www.example.com/Path"]


def test_similarity_and_names(spark):
    lit = F.lit
    assert one(spark, text.lexical_similarity(lit("night"), lit("nacht"))) == pytest.approx(0.25)
    assert one(spark, text.lexical_similarity(lit("a b"), lit("b-c"))) == pytest.approx(1 / 3)
    assert one(spark, text.canonicalize(lit(" Repo:Acme/X "))) == "repo:Acme/X"
    assert one(spark, text.auto_label(F.array(lit("user:d"), lit("repo:acme/auth"), lit("cve:CVE-1")))) == "acme/auth +2"


def test_defang_and_markup(spark):
    lit = F.lit
    assert one(spark, text.defang(lit("see  acme.com,\nnow"))) == "see  acme[.]com,\nnow"
    html = "<html><nav>x</nav><article><p>Hello &amp;  <b>world</b></p><script>no</script> # </article></html>"
    assert one(spark, text.html_text(text.article_html(lit(html)))) == "Hello & world"
    assert one(spark, text.html_text(lit("coast.<a>[tagesschau.de]</a>The [[x] ## ] #1"))) == "coast. tagesschau.de The x #1"
    assert one(spark, text.truncate_words(lit("alpha beta gamma"), 12)) == "alpha beta"
    assert one(spark, text.escape(text.clean(lit("a\x07<b> & 'c'")))) == "a&lt;b&gt; &amp; &#39;c&#39;"
    assert [one(spark, text.safe_href(lit(u))) for u in ("HTTPS://e.org", "javascript:x")] == ["HTTPS://e.org", None]
    assert one(spark, text.strip_reasoning(lit("<think>so</think> yes"))) == "yes"


def test_linked_data_comes_before_the_article(spark):
    """Wherever it stands in the JSON; a page whose linked data says nothing falls back to its article, then to itself."""
    bodies = {
        '{"articleBody": " own "}': "own", '{"@graph": [{"x": 1}, {"articleBody": "deep"}]}': "deep", '[{"a": 2}, {"articleBody": "listed"}]': "listed",
        '{"articleBody": " ", "z": {"articleBody": "z"}, "b": [[{"articleBody": "b"}]]}': "b", '{"articleBody": 5, "k": {"articleBody": "k"}}': "k", '{"o": "\\"articleBody\\":\\"no\\""}': None,
        "{broken": None, "7": None, '{"a": NaN, "articleBody": "x"}': None, '{"articleBody": "\\ud800"}': None, "[" * 5000 + "]" * 5000: None,
    }
    assert {j: text.first_body([j]) for j in bodies} == bodies
    assert text.first_body(["{broken", '{"articleBody": "second"}']) == "second" and text.first_body(None) is None and text.first_body([]) is None
    script = lambda j, kind="application/ld+json": f'<html><SCRIPT id="a" TYPE="{kind}">{j}</script><article> <p>the article</p></article>'
    pages = {
        script('{"@graph": [{"articleBody": "A &amp; B [x] ## c"}]}'): "A & B x c", script("{}"): "the article", script('{"articleBody": "no"}', "text/javascript"): "the article",
        '<script type="application/ld+json">{}</script><article> </article><p>the page': "the page", "<script>x</script>": None, script('{"articleBody": "<br>"}'): "the article",
    }
    df = spark.createDataFrame(list(enumerate([*pages, None])), "i int, html string")
    assert [r[0] for r in df.orderBy("i").select(text.article_text(F.col("html"))).collect()] == [*pages.values(), None]
    assert one(spark, text.article_text(F.lit(script('{"articleBody": "alpha beta gamma"}')), 1000, 12)) == "alpha beta"


def test_failures_of_fetches(spark):
    lit = F.lit
    lasting = lambda status, error: one(spark, guard.permanent_failure(lit(status).cast("int"), lit(error).cast("string")))
    named = lambda status, error: one(spark, guard.fetch_failure(lit(status).cast("int"), lit(error).cast("string")))
    assert [e for e in guard.FAILURES if lasting(None, e)] == ["bad_scheme", "blocked_address", "too_many_redirects", "disallowed_content_type", "too_large", "empty"]
    assert [s for s in (200, 400, 404, 408, 410, 429, 499, 500, 503) if lasting(s, None)] == [400, 404, 410, 499]
    assert [named(*x) for x in ((200, None), (404, None), (None, "empty"), (None, "reset"), (None, None))] == [None, "bad_status", "empty", "transport", None]


def test_summaries_are_gated(spark):
    lit = F.lit
    gate = lambda h, t, refs=(): one(spark, text.faithful(lit(h), lit(t), F.array(*map(lit, refs)).cast("array<string>"), F.array(lit("repo:a")), lit("12% of 40")))
    assert gate("Outage", "12% failed") is None
    assert gate("x" * 91, "") == "too_long"
    assert gate("Outage", "99% failed") == "ungrounded_number:99%"
    assert gate("Outage", "a huge day") == "banned_word:huge"
    assert gate("Outage", "at acme.com") == "url_in_prose:acme.com"
    assert gate("Outage", "so", ["user:e"]) == "ungrounded_entity:user:e"


def test_banned_words_come_in_order(spark):
    cases = {"your exciting day": "exciting", "for you!": "you", "weird!": "!", "game changing": "game changing", "We.": "we", "yours": None, None: None, "_huge_": "huge"}
    assert {k: one(spark, text.banned_word(F.lit(k))) for k in cases} == cases


def test_prose(spark):
    lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x))
    assert [one(spark, prose.time_of_day(lit(h))) for h in (4, 5, 8, 13, 17, 21, 22)] == ["A late hello", "An early hello", "Morning", "Noon greetings", "Afternoon", "Evening", "A late hello"]
    assert one(spark, prose.greeting(lit(9), lit("weekly"), lit(7), lit(" Ann "))) == "Morning, Ann: one weekly round-up, freshly sorted."
    assert one(spark, prose.compose_lead(arr("...", " Auth is back! ", "x"))) == "Leading this digest: Auth is back, with 2 more updates below."
    assert one(spark, prose.compose_lead(arr("Auth is back!"))) == "Leading this digest: Auth is back!"
    assert one(spark, prose.compose_lead(arr("a", "b"))) == "Leading this digest: a, with 1 more update below."
    assert [one(spark, prose.compose_lead(x)) for x in (arr("???"), F.array().cast("array<string>"))] == ["", ""]
    assert one(spark, prose.compose_tldr(arr("a", " ", "b!", "c", "d", "e"))) == "a. b! c. d."
    assert one(spark, prose.reason_line(lit("story"), lit(""), lit(1.5))) == "Story · — · relevance 1.50"
    assert [one(spark, prose.clean_label(lit(x))) for x in (" Auth ", "", "x" * 49, "your day", "at acme.com")] == ["Auth", None, None, None, None]
    assert [one(spark, prose.clean_delta(lit(x))) for x in ("cutover landed.", "a b c d e f g", "!")] == ["cutover landed", None, None]
    assert [one(spark, prose.clean_lead(lit(x), lit("3 items"))) for x in ("All 3 are up", "All 4 are up")] == ["All 3 are up", None]
    assert one(spark, prose.join_runs(arr("data centres,", "Ann", "Paris", "; so (", "x", ")"))) == "data centres, Ann Paris; so (x)"
    item = prose.plain_item(lit(1), lit("story"), lit("see acme.com"), lit(""), lit("javascript:x"), lit("rss"), lit("now"), lit("why not"), lit(None).cast("string"), lit(None).cast("string"))
    assert one(spark, item) == "1. [STORY] see acme[.]com\n   rss · now\n   why: why not\n\n"
    assert one(spark, prose.plain_body(lit("Hello."), lit(""), lit("today"), F.array(lit("x")))) == "Hello.\n\nYour digest for the window ending today\n\nx"
    assert [one(spark, scoring.impact_score(lit(x))) for x in (" Major", "odd", None)] == [3, 0, 0]


def test_feeds(spark):
    rss = '<rss version="2.0" xmlns:content="http://x"><channel><item><guid>g1</guid><title>T1</title><link>https://e.org/1</link><description>&lt;p&gt;Hi &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>T2</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title>A</title><link href="https://e.org/a"/><content>body</content><updated>2024-01-02T03:04:05Z</updated></entry></feed>'
    items = feeds.parse_feed(spark.createDataFrame([(1, rss), (2, atom)], "feed long, xml string"))
    got = [(r["feed"], r["id"], r["title"], r["body"], r["link"], r["published"]) for r in items.orderBy("feed", "id").collect()]
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert got == [(1, "T2", "T2", None, None, None), (1, "g1", "T1", "Hi you", "https://e.org/1", at), (2, "a1", "A", "body", "https://e.org/a", at)]
    odd = feeds.parse_feed(spark.createDataFrame([(1, "not xml"), (2, None), (3, "<other/>"), (4, "<rss><channel/></rss>")], "feed long, xml string"))
    assert odd.count() == 0
    kinds = [r["content_kind"] for r in feeds.to_events(items, F.lit(at).cast("timestamp_ntz")).orderBy("stable_id").collect()]
    assert kinds == ["announcement", "longform", "longform"]


def test_github(spark):
    issue = '{"id":"9","type":"IssuesEvent","actor":{"login":"ann"},"repo":{"name":"acme/x"},"created_at":"2024-01-02T03:04:05Z","payload":{"action":"opened","issue":{"id":5,"number":7,"title":"Bug","html_url":"https://github.com/acme/x/issues/7"}}}'
    push = '{"id":"10","type":"PushEvent","actor":{"login":"bob"},"repo":{"name":"acme/x"},"public":false,"payload":{"ref":"refs/heads/main","head":"abc"}}'
    r = {x["stable_id"]: x for x in github.seal(github.map_events(spark.createDataFrame([(issue,), (push,)], "raw string"))).collect()}
    assert set(r) == {"issue:5:opened", "push:acme/x:abc"}
    assert (r["push:acme/x:abc"]["title"], r["push:acme/x:abc"]["severity"], r["issue:5:opened"]["severity"]) == ("acme/x: push to refs/heads/main", 0, 1)
    assert r["issue:5:opened"]["group_key"] == "gh:acme/x#issue-7" and r["issue:5:opened"]["content_kind"] == "longform"
    assert "url:https://github.com/acme/x/issues/7" in r["issue:5:opened"]["entities"] and "repo:acme/x" in r["issue:5:opened"]["entities"]
    assert r["push:acme/x:abc"]["private"] and not r["issue:5:opened"]["private"]
    assert one(spark, github.webhook_type(F.lit("pull_request"))) == "PullRequestEvent"
    assert [guard.allowed_ip(x) for x in ("8.8.8.8", "10.0.0.1", "::ffff:127.0.0.1", "169.254.169.254")] == [True, False, False, False]
    assert [one(spark, guard.allowed_url(F.lit(u))) for u in ("https://e.org/x", "http://localhost/", "ftp://e.org", "https://u@e.org", "http://10.1.2.3/")] == [True, False, False, False, False]


def test_webhooks_are_the_events_that_a_poll_finds(spark):
    body = '{"action":"opened","issue":{"id":5,"number":7,"title":"A \\"bug\\"","updated_at":"2024-01-02T03:04:05Z"},"repository":{"full_name":"acme/x","private":true},"sender":{"login":"ann"},"installation":{"id":77}}'
    sent = spark.createDataFrame([("issues", "d1", body), ("star", "d2", '{"installation":{"id":1}}')], "event string, delivery_id string, body string")
    known = spark.createDataFrame([(3, 8, "github", "77")], "connection_id long, owner long, source string, provider_account_id string")
    at = F.lit(datetime(2024, 5, 6)).cast("timestamp_ntz")
    (got,) = github.map_events(github.from_webhooks(github.route(sent, known), at)).collect()
    assert (got["stable_id"], got["group_key"], got["title"]) == ("issue:5:opened", "gh:acme/x#issue-7", 'acme/x issue opened: A "bug"')
    assert (got["event_time"], got["login"], got["private"]) == (datetime(2024, 1, 2, 3, 4, 5), "ann", True)
    late = github.map_events(github.from_webhooks(sent, at)).filter("login = ''").first()
    assert (late["event_time"], late["private"]) == (datetime(2024, 5, 6), False)


def test_polls_stop_at_what_was_seen(spark):
    rows = [(1, "r", 0, "e5", True), (1, "r", 1, "e4", True), (1, "r", 2, "e3", True), (1, "s", 0, "f1", False), (2, "r", 0, "g1", False)]
    polled = spark.createDataFrame(rows, "connection_id long, repo string, place int, id string, repo_private boolean")
    fresh, moved = github.new_of_poll(polled, spark.createDataFrame([(1, "r", "e4"), (1, "s", "gone"), (9, "q", "h1")], "connection_id long, repo string, last_id string"))
    assert sorted((r["id"], r["private"]) for r in fresh.collect()) == [("e5", True), ("f1", False), ("g1", False)]
    assert sorted(tuple(r) for r in moved.collect()) == [(1, "r", "e5"), (1, "s", "f1"), (2, "r", "g1"), (9, "q", "h1")]


def test_stream_in_any_split_is_one_rollup(spark, sf_dir, tmp_path):
    from spindrift.plans.adapters import event_log

    log = event_log(spark, sf_dir)
    for part in range(3):
        log.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.limit(50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # some come again
    root = str(tmp_path / "tables")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run_available(stream, root, str(tmp_path / "ck"))
    said = lambda df: sorted(map(str, df.drop("updated_at").collect()))
    assert said(incremental.clusters(spark, root)) == said(rollup.rollup(log).select(*incremental.clusters(spark, root).columns))
    schema = incremental._ddl(log)
    assert incremental.events(spark, root, schema).count() == log.count()
    last = max(r["batch"] for r in spark.read.parquet(f"{root}/event").select("batch").distinct().collect())
    incremental.fold_batch(root, incremental.events(spark, root, schema).limit(40), last)  # the last batch comes again, with what is known
    assert incremental.events(spark, root, schema).count() <= log.count()
    first = [r[0] for r in spark.range(1).select(*incremental.bounds(F.lit(None).cast("timestamp_ntz"), F.lit(T0).cast("timestamp_ntz"))).collect()[0:1]]
    assert first == [datetime(1970, 1, 1)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "k string, v int, updated_at int")
    new = spark.createDataFrame([("a", 1, 0), ("b", 3, 0), ("c", 4, 0)], "k string, v int, updated_at int")
    assert sorted(map(tuple, mutations.upsert_changed(old, new, "k", F.lit(99)).collect())) == [("a", 1, 10), ("b", 3, 99), ("c", 4, 99)]
    assert mutations.upsert(old, new, ["k"]).count() == 3


def test_digest_is_frozen_once(spark):
    d = spark.createDataFrame([("s1", "selected", 0, None, T0, "story"), ("s2", "over_cap", None, None, T0, "note")], "story_id string, verdict string, position int, thread_id string, last_event_time timestamp_ntz, natural_format string")
    none = spark.createDataFrame([], "digest_id long, subscriber long, window_end timestamp_ntz")
    at = F.lit(T0).cast("timestamp_ntz")
    new, items = digest.freeze(d, none, F.lit(1).cast("long"), at)
    assert new.count() == 1 and [r["story_id"] for r in items.collect()] == ["s1"]
    again, more = digest.freeze(d, new, F.lit(1).cast("long"), at)
    assert again.isEmpty() and more.isEmpty()
    assert candidates.strong_keys(spark.createDataFrame([(["cve:x", "repo:y"],)], "entities array<string>")).count() == 1
    assert evaluate.faithfulness(spark.createDataFrame([("passed",), ("too_long",), (None,)], "verdict string")).first()["rate"] == 0.5
    assert status.due_maintenance(spark.createDataFrame([(1,), (2,)], "subscriber long"), spark.createDataFrame([(1, T0)], "subscriber long, ran_at timestamp_ntz"), at).count() == 1


def test_cross_boundary_seed_of_all_owners(spark, tmp_path):
    """Owner 4 alone shares a strong key with user 1's public cluster; 4 isn't a multiple of 8."""
    rows = [(1, "error", 4), (2, "error", 1), (3, "click", 1)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").selectExpr(
        "event_id", "timestamp_ntz'2024-01-02' AS ts", "user_id", "event_type", "100D AS value", """'{"k": 3}' AS props"""
    ).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["cross_boundary_seed_all"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("public||error|u1", "cve:CVE-2024-1003")]


def test_selection_takes_linked_stories(spark, sf_dir):
    stories = {r["story_id"] for r in QUERIES["story_rollup"](spark, sf_dir).collect()}
    found = QUERIES["select_full"](spark, sf_dir).collect()
    assert {r["story_id"] for r in found} == stories and len(found) == len(stories)
    assert any(r["richness"] == "multi-source" for r in found)
    counts = {r["verdict"]: r["n"] for r in QUERIES["story_verdict_counts"](spark, sf_dir).collect()}
    assert counts == {v: sum(r["verdict"] == v for r in found) for v in {r["verdict"] for r in found}} and "selected" in counts


def test_captured_responses_stream_into_feed_events(spark, tmp_path):
    rss = "<rss><channel><item><guid>g{0}</guid><title>T{0}</title></item></channel></rss>"
    spark.createDataFrame([(1, 200, rss.format(1)), (2, 304, None), (3, 500, "x")], "connection_id long, status int, xml string").coalesce(1).write.json(str(tmp_path / "in"))
    schema = "connection_id long, status int, xml string"
    stream = feeds.poll(incremental.poll_stream(spark, str(tmp_path / "in"), schema))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["connection_id"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "g1")]


def test_persisted_stories_are_stamped_only_if_changed(spark):
    at = lambda d: F.lit(T0 + timedelta(days=d)).cast("timestamp_ntz")
    story = "subscriber long, story_id string, clusters array<string>, first_event_time timestamp_ntz, last_event_time timestamp_ntz, event_count long, source_diversity long, depth_rank int, max_severity int, merged_into string"
    row = lambda i, c: (1, i, c, T0, T0, 1, 1, 0, None, None)
    before = spark.createDataFrame([row("a", ["x"]), row("b", ["y"]), row("c", ["z"])], story).select("*", F.lit(None).cast("timestamp_ntz").alias("last_delivered_at"), at(0).alias("minted_at"), at(0).alias("updated_at"))
    stories = spark.createDataFrame([row("a", ["x"]), row("b", ["y", "z"])], story).drop("clusters", "merged_into")
    members = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "b", "z")], "subscriber long, story_id string, cluster_id string")
    merges = spark.createDataFrame([("c", "b")], "loser string, survivor string")
    out = {r["story_id"]: r for r in generate.persist(generate.Generated(None, None, members, stories, merges, None), before, at(5)).collect()}
    assert (out["a"]["updated_at"], out["b"]["updated_at"], out["c"]["updated_at"]) == (T0, T0 + timedelta(days=5), T0 + timedelta(days=5))
    assert (out["c"]["merged_into"], out["c"]["clusters"], out["b"]["clusters"]) == ("b", [], ["y", "z"])
    again = generate.prior_members(generate.persist(generate.Generated(None, None, members, stories, merges, None), before, at(5)))
    assert sorted((r["story_id"], r["cluster_id"]) for r in again.collect()) == [("a", "x"), ("b", "y"), ("b", "z")]


def test_delivery_moves_everything_together(spark):
    at = F.lit(T0).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    stories = spark.createDataFrame([("s",), ("t",)], "story_id string").withColumn("last_delivered_at", none)
    digests = spark.createDataFrame([(1, 7, T0)], "digest_id long, subscriber long, window_end timestamp_ntz").withColumn("delivered_at", none)
    items = spark.createDataFrame([(1, "s")], "digest_id long, story_id string")
    users = spark.createDataFrame([(7,), (8,)], "subscriber long").select("subscriber", none.alias("last_run"), none.alias("next_run_at"))
    s, d, u = generate.deliver(stories, digests, items, users, at, at)
    assert {r["story_id"]: r["last_delivered_at"] for r in s.collect()} == {"s": T0, "t": None}
    assert d.first()["delivered_at"] == T0 and {r["subscriber"]: r["last_run"] for r in u.collect()} == {7: T0, 8: None}
    later = F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")
    again, _, _ = generate.deliver(s, d, items, u, later, later)
    assert {r["story_id"]: r["last_delivered_at"] for r in again.collect()} == {"s": T0, "t": None}


def test_older_ids_survive(spark):
    comp = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "z")], "cluster_id string, component string")
    prior = spark.createDataFrame([("x", "a-new", False, T0 + timedelta(days=1)), ("y", "z-old", False, T0)], "cluster_id string, story_id string, delivered boolean, minted_at timestamp_ntz")
    ids, merges = link.forward_ids(comp, prior)
    assert {r["component"]: r["story_id"] for r in ids.collect()}["x"] == "z-old"
    assert [(r["loser"], r["survivor"]) for r in merges.collect()] == [("a-new", "z-old")]


def test_maintained_threads(spark):
    """A community keeps the thread that it matches and takes in another; an unmatched thread is carried on."""
    t = lambda d: T0 + timedelta(days=d)
    src = spark.createDataFrame([(1, f"s{i}", t(i), ["repo:a", "repo:b", "user:c"], ["rss", "forge"][: i % 2 + 1]) for i in range(4)] + [(2, "s9", t(0), ["repo:a"], ["rss"])], "subscriber long, story_id string, last_event_time timestamp_ntz, entities array<string>, sources array<string>")
    prior = spark.createDataFrame(
        [(1, "t1", ["repo:a", "repo:b"], 1.0, False, None, None), (1, "t2", ["repo:b", "user:c"], 1.0, False, None, None), (1, "t3", ["repo:z"], 2.0, False, None, t(-100)), (2, "t1", ["repo:a"], 3.0, True, None, None)],
        "subscriber long, thread_id string, entities array<string>, affinity double, pinned boolean, first_seen timestamp_ntz, last_story_time timestamp_ntz",
    )
    care = spark.createDataFrame([(1, "t1", 1.0), (1, "t2", 2.0)], "subscriber long, thread_id string, care double")
    now = F.lit(t(3)).cast("timestamp_ntz")
    written, weights = maintain.maintain(src, prior, care, now, now)
    got = {(r["subscriber"], r["thread_id"]): r for r in written.collect()}
    assert set(got) == {(1, "t1"), (1, "t3"), (2, "t1")} and got[1, "t1"]["absorbed"] == ["t2"]
    assert (got[1, "t1"]["story_count"], got[1, "t1"]["source_diversity"], got[1, "t1"]["affinity"], got[1, "t1"]["band"]) == (4, 2, 4.0, "confirmed")
    assert (got[1, "t3"]["state"], got[1, "t3"]["story_count"], got[2, "t1"]["story_count"]) == ("archived", 0, 1)
    assert {(r["subscriber"], r["entity"]) for r in weights.collect()} == {(1, "repo:a"), (1, "repo:b"), (1, "user:c"), (2, "repo:a")}
    stored = prior.select("subscriber", "thread_id", "entities", "affinity", "pinned", F.lit("active").alias("state"), "first_seen", "last_story_time", F.lit(None).cast("string").alias("merged_into"))
    saved = {(r["subscriber"], r["thread_id"]): r["merged_into"] for r in maintain.save_threads(stored, written).collect()}
    assert saved == {(1, "t1"): None, (1, "t2"): "t1", (1, "t3"): None, (2, "t1"): None}


def test_maintenance_reads_its_sources_once(spark):
    """What the pass reads isn't made again for each of its steps."""
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    made = F.udf(counted, "array<string>").asNondeterministic()
    src = spark.createDataFrame([(1, f"s{i}", T0, ["repo:a", f"user:u{i}"], ["rss"]) for i in range(4)], "subscriber long, story_id string, last_event_time timestamp_ntz, entities array<string>, sources array<string>")
    prior = spark.createDataFrame([(1, "t1", ["repo:a"], 1.0, False, None, None)], "subscriber long, thread_id string, entities array<string>, affinity double, pinned boolean, first_seen timestamp_ntz, last_story_time timestamp_ntz")
    care = spark.createDataFrame([(1, "t1", 1.0)], "subscriber long, thread_id string, care double")
    now = F.lit(T0).cast("timestamp_ntz")
    written, weights = maintain.maintain(src.withColumn("entities", made("entities")), prior, care, now, now)
    assert written.count() > 0 and weights.count() > 0 and read.value == 4


def test_retries_and_relations(spark):
    lit = F.lit
    assert spark.range(1).select(*summaries.for_attempt(lit(5).cast("long"), lit(0.2), lit(2))).first()[:] == ((5 + 2 * 0x9E3779B9) % 2**32, 0.5)
    assert spark.range(1).select(*summaries.for_attempt(lit(5).cast("long"), lit(0.8), lit(9))).first()[1] == 0.9
    rel = spark.createDataFrame([(["a"], [("a ", "has", "b"), ("a", "has", "b"), ("x", "has", "b"), ("a", "", "b")])], "e array<string>, r array<struct<subject:string,predicate:string,object:string>>")
    assert rel.select(summaries.apply_relations(F.col("e"), F.col("r"))).first()[0] == [("a", "has", "b")]
    f = spark.createDataFrame([(None, "planned", False, "release", "none", True), ("change", None, True, "other", "resolved", False)], "event_type string, state string, tentative boolean, said_type string, said_state string, said_tentative boolean")
    assert [r[:3] for r in summaries.apply_comprehension(f).collect()] == [("release", "planned", True), ("change", "resolved", False)]
