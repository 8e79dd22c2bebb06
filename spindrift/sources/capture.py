"""Captured responses of polled connections as a stream with an offset of its own.

A poller leaves each response as a file of JSON, numbered within the folder of its connection:
<path>/<connection>/<number>.json with status, etag, last_id and body. The offset of a batch is, for each
connection, the number of the last capture and the ETag or last id of the last success up to it. It is what
the query's checkpoint holds, so a restart goes on where the last batch ended; and a success that bears the
cursor of the one before it, as servers that ignore conditions send them, has nothing new and gives no row.

The driver lists names and reads the newest captures' cursors; bodies are read where they are parsed, a
partition for each connection.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship
from .feeds import parse_feed

SCHEMA = "connection_id long, number long, status int, etag string, last_id string, body string"


@dataclass
class Part(InputPartition):
    connection: str
    after: int
    until: int
    cursor: str | None


def _load(path: str, connection: str, number: int) -> dict:
    with open(f"{path}/{connection}/{number}.json", encoding="utf-8") as file:
        return json.load(file)


def _numbers(path: str, connection: str) -> list[int]:
    names = (n.removesuffix(".json") for n in os.listdir(f"{path}/{connection}") if n.endswith(".json"))
    return sorted(int(n) for n in names if n.isdecimal())


def _cursor(capture: dict) -> str | None:
    return capture.get("etag") or capture.get("last_id")


def _good(capture: dict) -> bool:
    return 200 <= capture.get("status", 0) < 300


class CaptureReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for connection in sorted(os.listdir(self.path) if os.path.isdir(self.path) else ()):
            if not connection.isdecimal():
                continue
            numbers = _numbers(self.path, connection)
            if numbers:
                good = (c for n in reversed(numbers) if _good(c := _load(self.path, connection, n)))
                found[connection] = [numbers[-1], next((_cursor(c) for c in good), None)]
        return found

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for connection, (until, _) in end.items():
            after, cursor = start.get(connection, (-1, None))
            if until > after:
                parts.append(Part(connection, after, until, cursor))
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        cursor = partition.cursor
        for number in _numbers(self.path, partition.connection):
            if not partition.after < number <= partition.until:
                continue
            capture = _load(self.path, partition.connection, number)
            if not _good(capture) or (cursor is not None and _cursor(capture) == cursor):
                continue
            cursor = _cursor(capture)
            yield (int(partition.connection), number, capture["status"], capture.get("etag"), capture.get("last_id"), capture.get("body"))

    def commit(self, end: dict) -> None:
        """Captures stay: whoever made them clears them away."""


class CaptureSource(DataSource):
    """Option path: the folder of captures, which the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return "spindrift_captures"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"])


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New successes of all connections' captures."""
    ship(spark)
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format(CaptureSource.name()).option("path", path).load()


def feed_items(captures: DataFrame) -> DataFrame:
    """Items of a stream of captured feeds, each item of a connection once: a feed repeats its items from poll
    to poll, and the query's state knows those that were seen."""
    items = parse_feed(captures.select("connection_id", "number", F.col("body").alias("xml")))
    return items.dropDuplicates(["connection_id", "id"])
