"""Code-forge events: captured JSON of polls and webhooks mapped to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import forge_importance
from ..functions.text import derive_entities, fingerprint


def _at(path: str) -> Column:
    return F.get_json_object("raw", f"$.{path}")


COMMENTS = ("IssueCommentEvent", "CommitCommentEvent", "PullRequestReviewCommentEvent")


def map_events(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (raw: one event's JSON) as the columns to keep, stable_id, group_key, title, link, content_kind,
    event_time, repo, login, private and severity. An event and its webhook get the same stable_id."""
    kind, repo, act = _at("type"), F.coalesce(_at("repo.name"), F.lit("")), F.coalesce(_at("payload.action"), F.lit(""))
    fallback = F.concat(kind, F.lit(":"), F.coalesce(_at("id"), F.lit("")))
    obj = lambda name: _at(f"payload.{name}.id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sha = F.coalesce(_at("payload.head"), _at("payload.after"))
    stable = F.coalesce(
        F.when(kind == "IssuesEvent", text("issue:", obj("issue"), ":", act))
        .when(kind.isin(*COMMENTS), text("comment:", obj("comment")))
        .when(kind == "PullRequestEvent", text("pr:", obj("pull_request"), ":", act))
        .when(kind == "PullRequestReviewEvent", text("review:", obj("review")))
        .when(kind == "ReleaseEvent", text("release:", obj("release"), ":", act))
        .when(kind == "PushEvent", text("push:", repo, ":", sha)),
        fallback,
    )
    nothing = F.lit("")
    group = (
        F.when(kind.isin("IssuesEvent", "IssueCommentEvent"), text("gh:", repo, "#issue-", F.coalesce(_at("payload.issue.number"), nothing)))
        .when(kind.isin("PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent"), text("gh:", repo, "#pr-", F.coalesce(_at("payload.pull_request.number"), nothing)))
        .when(kind == "ReleaseEvent", text("gh:", repo, "@release-", F.coalesce(_at("payload.release.tag_name"), nothing)))
        .when(kind == "PushEvent", text("gh:", repo, "@", F.coalesce(_at("payload.ref"), F.lit("push"))))
        .otherwise(text("gh:", repo, ":", kind))
    )
    title = (
        F.when(kind == "IssuesEvent", text(repo, " issue ", act, ": ", F.coalesce(_at("payload.issue.title"), nothing)))
        .when(kind == "PullRequestEvent", text(repo, " PR ", act, ": ", F.coalesce(_at("payload.pull_request.title"), nothing)))
        .when(kind == "ReleaseEvent", text(repo, " release ", F.coalesce(_at("payload.release.name"), _at("payload.release.tag_name"), nothing)))
        .when(kind == "PushEvent", text(repo, ": push to ", F.coalesce(_at("payload.ref"), F.lit("a branch"))))
        .when(kind.isin(*COMMENTS), text(repo, ": new comment"))
        .otherwise(text(repo, ": ", kind))
    )
    link = F.coalesce(*[_at(f"payload.{o}.html_url") for o in ("issue", "pull_request", "release", "comment")])
    depth = F.when(kind == "ReleaseEvent", "announcement").when(kind.isin("IssuesEvent", "PullRequestEvent"), "longform").otherwise("message")
    return raw.select(
        *keep, stable.alias("stable_id"), group.alias("group_key"), title.alias("title"), link.alias("link"), depth.alias("content_kind"),
        F.try_to_timestamp(_at("created_at")).cast("timestamp_ntz").alias("event_time"), repo.alias("repo"), F.coalesce(_at("actor.login"), nothing).alias("login"),
        (F.coalesce(_at("public"), F.lit("true")) == "false").alias("private"), forge_importance(kind).alias("severity"),
    )


def seal(events: DataFrame, source: str = "github") -> DataFrame:
    """Mapped events with their fingerprint and entities."""
    links = F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.array(F.when(F.col("repo") != "", F.concat(F.lit("repo:"), "repo")), F.when(F.col("login") != "", F.concat(F.lit("user:"), "login"))), lambda x: x.isNotNull())
    tokens = F.array_sort(F.array_distinct(F.concat(derive_entities(F.col("title"), F.lit(None).cast("string"), links), own)))
    return events.withColumns({"fingerprint": fingerprint(F.lit(source), F.col("stable_id")), "entities": tokens})


def webhook_type(event: Column) -> Column:
    """pull_request -> PullRequestEvent."""
    return F.concat(F.replace(F.initcap(F.replace(event, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.lit("Event"))


#: Where a webhook of a kind holds its time. Fixed values.
WEBHOOK_TIME = {
    "IssuesEvent": "issue.updated_at", "PullRequestEvent": "pull_request.updated_at", "PullRequestReviewEvent": "review.submitted_at", "IssueCommentEvent": "comment.updated_at",
    "CommitCommentEvent": "comment.updated_at", "PullRequestReviewCommentEvent": "comment.updated_at", "ReleaseEvent": "release.published_at", "PushEvent": "head_commit.timestamp",
}


def from_webhooks(deliveries: DataFrame, now: Column) -> DataFrame:
    """Webhook deliveries (event, delivery_id, body) as rows (raw) of the shape that map_events() reads: the
    body is the payload, its repository and sender the event's; the time is the kind's own, else now."""
    kind = webhook_type(F.col("event"))
    of = lambda path: F.get_json_object("body", f"$.{path}")
    when = F.lit(None).cast("string")
    for name, path in WEBHOOK_TIME.items():
        when = F.when(kind == name, of(path)).otherwise(when)
    when = F.coalesce(F.when(F.try_to_timestamp(when).isNotNull(), when), F.date_format(now.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    public = F.when(of("repository.private") == "true", "false").otherwise("true")
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    raw = F.concat(
        F.lit('{"id":'), quoted(F.col("delivery_id")), F.lit(',"type":'), quoted(kind), F.lit(',"repo":{"name":'), quoted(F.coalesce(of("repository.full_name"), F.lit(""))),
        F.lit('},"actor":{"login":'), quoted(F.coalesce(of("sender.login"), F.lit(""))), F.lit('},"public":'), public, F.lit(',"created_at":'), quoted(when), F.lit(',"payload":'), F.col("body"), F.lit("}"),
    )
    return deliveries.select(*[c for c in deliveries.columns if c not in ("event", "delivery_id", "body")], raw.alias("raw"))


def route(deliveries: DataFrame, connections: DataFrame) -> DataFrame:
    """Deliveries with the connection of their installation; those of none are left out."""
    who = deliveries.withColumn("_account", F.get_json_object("body", "$.installation.id"))
    known = connections.filter("source = 'github'").select("connection_id", "owner", F.col("provider_account_id").cast("string").alias("_account"))
    return who.join(known, "_account").drop("_account")


def new_of_poll(polled: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of polled events (connection_id, repo, place, id, repo_private, ...), each repository's newest first
    by place: those before the one that was seen last (cursors: connection_id, repo, last_id), or all of
    them, with private set from the repository; and the new cursors."""
    key = ["connection_id", "repo"]
    seen = polled.join(cursors, key).filter("id = last_id").groupBy(*key).agg(F.min("place").alias("stop"))
    fresh = polled.join(seen, key, "left").filter("stop is null or place < stop").drop("stop").withColumnRenamed("repo_private", "private")
    newest = polled.groupBy(*key).agg(F.min_by("id", "place").alias("newest"))
    moved = cursors.join(newest, key, "full").select(*key, F.coalesce("newest", "last_id").alias("last_id"))
    return fresh, moved


def lifecycle_status(action: Column) -> Column:
    """What an installation's change makes of its connection; null: nothing."""
    return F.when(action == "deleted", "revoked").when(action == "suspend", "suspended").when(action == "unsuspend", "active")
