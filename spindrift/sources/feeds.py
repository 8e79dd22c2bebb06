"""RSS and Atom documents, one a row, parsed once each into typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, truncate_words

#: Greatest length of a body and of the markup that it is made from, in characters. Fixed values.
BODY_CAP, MARKUP_CAP = 2000, 16_000
RSS = "struct<channel: struct<item: array<struct<guid: string, link: string, title: string, description: string, encoded: string, pubDate: string>>>>"
ATOM = "struct<entry: array<struct<id: string, title: string, link: array<struct<_href: string>>, content: string, summary: string, published: string, updated: string>>>"
ITEM = "struct<id: string, title: string, markup: string, link: string, published: timestamp>"


def _some(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def body_text(markup: Column) -> Column:
    """The text of a feed's markup, cut at a word; null if there is none."""
    return _some(truncate_words(html_text(F.substring(markup, 1, MARKUP_CAP)), BODY_CAP))


def parse_feed(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of feed documents: the other columns, and id (guid, else link, else title), title (else the id),
    body, link and published. A document without an RSS channel is read as Atom, whose entries give their own
    id and title; one that is neither, or null, has no items. Namespaces are ignored."""
    others = [c for c in docs.columns if c != xml]
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    read = docs.select(*others, F.from_xml(F.col(xml), RSS, options).alias("_rss"), F.from_xml(F.col(xml), ATOM, options).alias("_atom"))

    def item(id_: Column, title: Column, markup: Column, link: Column, when: Column) -> Column:
        return F.struct(id_.alias("id"), title.alias("title"), markup.alias("markup"), link.alias("link"), when.alias("published")).cast(ITEM)

    def of_rss(x: Column) -> Column:
        id_ = F.coalesce(_some(x["guid"]), _some(x["link"]), _some(x["title"]), F.lit(""))
        when = F.try_to_timestamp(F.regexp_replace(F.trim(x["pubDate"]), r"^\w+,\s*|\s*\(.*\)$", ""), F.lit("d MMM yyyy HH:mm:ss [Z][z]"))
        return item(id_, F.coalesce(_some(x["title"]), id_), F.coalesce(_some(x["encoded"]), _some(x["description"])), _some(x["link"]), when)

    def of_atom(x: Column) -> Column:
        when = F.try_to_timestamp(F.coalesce(_some(x["published"]), _some(x["updated"])))
        return item(F.coalesce(_some(x["id"]), F.lit("")), F.coalesce(_some(x["title"]), F.lit("")), F.coalesce(_some(x["content"]), _some(x["summary"])), _some(F.get(x["link"], F.lit(0))["_href"]), when)

    items = F.when(F.col("_rss.channel").isNotNull(), F.transform("_rss.channel.item", of_rss)).otherwise(F.transform("_atom.entry", of_atom))
    each = read.select(*others, F.explode(items).alias("_i"))
    return each.select(*others, "_i.id", "_i.title", body_text(F.col("_i.markup")).alias("body"), "_i.link", F.col("_i.published").cast("timestamp_ntz").alias("published"))


def next_cursor(responses: DataFrame) -> DataFrame:
    """(connection_id, etag, last_modified) to poll with next: what a 304 leaves as it was and a success
    replaces, even by nothing; other statuses keep the cursor, as they are failures. Responses hold
    connection_id, status, etag, last_modified and the cursor that was sent (sent_etag, sent_modified)."""
    new = F.col("status").between(200, 299)
    return responses.select("connection_id", F.when(new, F.col("etag")).otherwise(F.col("sent_etag")).alias("etag"), F.when(new, F.col("last_modified")).otherwise(F.col("sent_modified")).alias("last_modified"))


def poll(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of the responses that succeeded; one that isn't modified has none."""
    return parse_feed(responses.filter(F.col("status").between(200, 299)).drop("status", "etag", "last_modified", "sent_etag", "sent_modified"), xml)


def to_events(items: DataFrame, now: Column) -> DataFrame:
    """Feed items as events: each its own group, longform with a body, at the time published or now."""
    return items.select(
        F.col("id").alias("stable_id"), F.lit("rss").alias("source"), F.col("id").alias("group_key"), F.coalesce("title", F.lit("")).alias("title"), "body",
        F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>")).alias("links"), F.coalesce("published", now).alias("event_time"),
        F.when(F.col("body").isNotNull(), "longform").otherwise("announcement").alias("content_kind"),
    )
