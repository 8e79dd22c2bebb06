"""Sweeps: budgets of failures, changed content, models that raise or leave answers out, and enrichment."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import prose
from spindrift.operators import digest, records, sweep

T0 = datetime(2024, 1, 1)
ROWS = "cluster_id string, scope_kind string, updated_at timestamp_ntz, last_event_time timestamp_ntz, summarized_at timestamp_ntz, summary string, summary_hash string, summary_model string, attempts int, last_error string, quarantined_at timestamp_ntz"
EVENTS = "cluster_id string, event_id long, event_time timestamp_ntz, title string, body string, links array<string>, entities array<string>"


def at(day):
    return F.lit(T0 + timedelta(days=day)).cast("timestamp_ntz")


def answering(batch):
    """By id: fine, with a number that nobody said, an error, or no answer at all."""
    kind = batch["cluster_id"].str[0]
    out = pd.DataFrame({"cluster_id": batch["cluster_id"], "headline": "Outage", "tldr": ["99 of them" if k == "n" else "over" for k in kind], "refs": None, "error": ["timeout" if k == "e" else None for k in kind]})
    return out[kind != "m"]


def raising(batch):
    raise RuntimeError("down")


def by_id(df, *columns):
    return {r["cluster_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_a_sweep_records_every_outcome(spark):
    d = lambda n: T0 + timedelta(days=n)
    ids = ["ok", "number", "error", "missing", "same", "held", "back", "empty"]
    events = spark.createDataFrame([(i, k, d(0), f"Outage {k}", "body", [], ["repo:a"]) for k, i in enumerate(ids) if i != "empty"], EVENTS)
    told = {r["cluster_id"]: r["summary_hash"] for r in digest.summary_hash(events, ["cluster_id"], ["event_time", "event_id"]).collect()}
    state = {"same": (d(0), "s", told["same"], "m", 2, "old", None), "held": (None, None, None, None, 4, "x", d(5)), "back": (None, None, None, None, 4, "x", d(0))}
    rows = spark.createDataFrame([(i, "public", d(1), d(k), *state.get(i, (None, None, None, None, 3 if i in ("number", "error") else 0, None, None))) for k, i in enumerate(ids)], ROWS)
    one = sweep.sweep_clusters(rows, events, answering, "m", at(9))
    assert {r["outcome"]: r["n"] for r in one.counts.collect()} == {"stored": 2, "unchanged": 1, "failed": 1, "quarantined": 2}
    assert by_id(one.rows, "attempts", "last_error", "quarantined_at") == {
        "ok": (0, None, None), "number": (4, "ungrounded_number:99", d(9)), "error": (4, "model:timeout", d(9)), "missing": (1, "model:no answer", None),
        "same": (0, None, None), "held": (4, "x", d(5)), "back": (0, None, None), "empty": (0, None, None),
    }
    two = sweep.sweep_clusters(one.rows, events, raising, "m", at(10))
    assert by_id(two.outcomes, "outcome", "error") == {"missing": ("failed", "model:RuntimeError")}
    three = sweep.sweep_clusters(one.rows, events, answering, "other", at(10), limit=2)
    assert by_id(three.outcomes, "outcome") == {"back": ("unchanged",)}  # the newest two: one has no events
    report = sweep.evaluate_model(rows.filter("cluster_id in ('ok', 'number', 'error')"), events, answering, 10).first()
    assert (report["passed"], report["rejected"], report["unavailable"], report["rate"]) == (1, 1, 1, 0.5)


def test_enrichment_keeps_what_the_text_has(spark):
    rows = [(1, "public", "feed", "Ann Lee met Bob", None, ["a:b"], 1), (2, "public", "feed", None, "the Ann Lee", [], None), (3, "private", "feed", "Ann Lee", None, [], None), (4, "public", "forge", "Ann Lee", None, [], None), (5, "public", "feed", "Ann Lee", None, [], 3)]
    log = spark.createDataFrame([(*r, T0 + timedelta(days=r[0]), None) for r in rows], "event_id long, scope_kind string, source string, title string, body string, entities array<string>, severity int, ingest_time timestamp_ntz, enriched_at timestamp_ntz")

    def names(batch):
        return pd.DataFrame({"event_id": batch["event_id"], "names": [[{"kind": "person", "name": "the Ann  Lee"}, {"kind": "place", "name": "Rome"}]] * len(batch), "salience": [2] * len(batch), "error": [None if i != 5 else "down" for i in batch["event_id"]]}).astype({"salience": "int32"})

    out = {r["event_id"]: (r["entities"], r["severity"], r["enriched_at"] is not None) for r in sweep.sweep_enrichment(log, names, at(0), ["feed"], at(9), 10).collect()}
    assert out == {1: (["a:b", "person:ann-lee"], 2, True), 2: (["person:ann-lee"], 2, True), 3: ([], None, False), 4: ([], None, False), 5: ([], 3, False)}


def test_configuration_is_one_row(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert [r["v"] for r in records.put_config(rows(1), rows(2)).collect()] == [2]
    assert [r["v"] for r in records.put_config(rows(1), rows()).collect()] == [1]
    assert records.put_config(rows(), rows()).count() == 0


def test_bodies_without_items_and_with_hostile_text(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    one = lambda c: spark.range(1).select(c).first()[0]
    empty = one(prose.html_body(lit("Hi <b>"), lit(" "), lit("today"), F.array().cast("array<string>"), footer="a & b"))
    assert "Hi &lt;b&gt;" in empty and "Nothing new this time." in empty and 'class="lead"' not in empty and "a &amp; b" in empty
    item = one(prose.html_item(lit("story"), lit("<script>x</script>"), lit("1 < 2"), lit("javascript:alert(1)"), lit("rss"), lit("now"), lit("why"), lit("T"), lit("uncertain"), lit("new"), F.array(F.struct(lit("\u202ea").alias("title"), lit("rss").alias("source"), none.alias("link_reason"), lit('http://e.org/"x').alias("link")))))
    assert "<script" not in item and "javascript" not in item and 'class="thread"' not in item and "1 &lt; 2" in item
    assert '<li><a href="http://e.org/&quot;x">a</a> [rss]</li>' in item
    said = [one(prose.eyebrow(lit(label).cast("string"), lit(band), lit(delta).cast("string"))) for label, band, delta in ((" T ", "confirmed", None), ("T", "probable", " 2 updates"), ("T", "uncertain", "x"), (None, "confirmed", "x"))]
    assert said == ["T", "possibly T · 2 updates", "", ""]
    plain = one(prose.plain_item(lit(1), lit("note"), lit("h"), none, none, lit("rss"), lit("now"), lit("why"), none, none, F.array(F.struct(lit("also").alias("title"), lit("forge").alias("source"), lit("shared cve:X").alias("link_reason"), lit("https://e.org").alias("link")))))
    assert plain == "1. [NOTE] h\n   rss · now\n   why: why\n   ↳ also [forge] — shared cve:X\n     https://e.org\n\n"
    assert one(prose.empty_subject(lit("Morning"))) == "Morning. You're all caught up"
